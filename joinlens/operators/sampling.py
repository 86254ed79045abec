"""Samples of tables and of whole databases, snapshots, and walks over joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from joinlens.functions.scalars import Z99
from joinlens.operators.cards import Loader, sub_plan_counts
from joinlens.operators.windows import global_rank
from joinlens.session import materialize
from joinlens.workload.spec import JoinQuery, key

# Fixed values of the arithmetic draw, which any SQL engine can repeat.
MULTIPLIER = 950706376
MODULUS = 2147483647
#: Rows of one key that a window may order in one task.
WINDOW_ROWS = 1 << 20
#: Walks up to this number are broadcast, one row each.
BROADCAST_WALKS = 100_000
#: Tables of fewer rows are kept whole.
SMALL_TABLE = 1000


def draw(key_column: str | Column, seed: int = 0) -> Column:
    """A number in 0..MODULUS-1 by the key; keys below 2^31."""
    k = F.col(key_column) if isinstance(key_column, str) else key_column
    return F.pmod(k.cast("long") * MULTIPLIER + seed, F.lit(MODULUS).cast("long"))


def hash_sample(df: DataFrame, key_column: str, share: float, seed: int = 0) -> DataFrame:
    """The rows whose draw falls below the share; the same key is always in or out, without a shuffle."""
    return df.where(draw(key_column, seed) < int(share * MODULUS))


def sample_or_all(df: DataFrame, key_column: str, share: float, seed: int = 0, small: int = SMALL_TABLE) -> DataFrame:
    """hash_sample, but a small table whole."""
    return df if df.limit(small).count() < small else hash_sample(df, key_column, share, seed)


def sample_database(load: Loader, tables: dict[str, str], foreign_keys: list[tuple[str, str, str, str]], share: float, seed: int = 0) -> dict[str, DataFrame]:
    """A sample of every table (table -> key column), topped up so that references hold.

    foreign_keys: (table, column, referenced table, its key). For each, the referenced rows of a sample of the referencing
    rows are added where they are missing.
    """
    made = {t: hash_sample(load(t), k, share, seed) for t, k in tables.items()}
    for table, column, other, other_key in foreign_keys:
        wanted = hash_sample(load(table), tables[table], share, seed).select(F.col(column).alias(other_key)).where(F.col(other_key).isNotNull())
        missing = load(other).join(wanted, other_key, "left_semi").join(made[other].select(other_key), other_key, "left_anti")
        made[other] = made[other].unionByName(missing)
    return made


def consistent_sample(load: Loader, ids: DataFrame, members: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """The rows of each (table, column) whose column is among the sampled ids (one column `id`)."""
    return {t: load(t).join(ids.select(F.col("id").alias(c)), c, "left_semi") for t, c in members}


def replicated_draws(df: DataFrame, n: int, order: list[str], seed: int = 0) -> DataFrame:
    """n draws with replacement: row numbers by arithmetic, met by a join on the global rank."""
    ranked = global_rank(df, order, "__at")
    total = df.count()
    picks = df.sparkSession.range(n).select(F.col("id").alias("draw_no"), (F.floor(draw(F.col("id") + 1, seed) * total / MODULUS) + 1).alias("__at"))
    return picks.join(ranked, "__at").drop("__at")


def weighted_draws(df: DataFrame, n: int, weight: str, order: list[str], seed: int = 0) -> DataFrame:
    """n draws with replacement, each row as likely as its weight (null and negative ones count as 0).

    Cumulative weights are built within range partitions plus one sum a partition; a draw falls into the row whose interval
    holds its arithmetic number.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "weighted")
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = ranged.groupBy("__range").agg(F.sum(w).alias("__s")).withColumn("__base", F.coalesce(F.sum("__s").over(before), F.lit(0.0)))
    total = sums.agg(F.sum("__s")).first()[0] or 0.0
    upto = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    high = F.col("__base") + F.sum(w).over(upto)
    placed = ranged.join(sums, "__range").withColumn("__high", high).withColumn("__low", F.col("__high") - w).where("__high > __low")
    picks = df.sparkSession.range(n).select(F.col("id").alias("draw_no"), (draw(F.col("id") + 1, seed) / MODULUS * total).alias("__at"))
    buckets = 4096  # draws meet rows by equality on slices of the total weight
    width = total / buckets if total else 1.0
    slices = F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))
    rows = placed.withColumn("__slice", F.explode(slices))
    met = picks.withColumn("__slice", F.floor(F.col("__at") / width)).join(rows, "__slice").where("__at >= __low AND __at < __high")
    return met.drop("__slice", "__at", "__low", "__high", "__base", "__s", "__range")


def snapshot(load: Loader, root: str, keep: Callable[[], Column], facts: list[tuple[str, str, str]], dims: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """A historical state: rows of root that fail keep are dropped (null does not fail), then the references follow.

    facts: (table, column, referenced key of root) lose rows whose reference vanished; dims: (table, key, fact table, its
    column) lose rows that no fact refers to any more.
    """
    out = {root: load(root).where(F.coalesce(keep(), F.lit(True)))}
    for table, column, root_key in facts:
        out[table] = load(table).join(out[root].select(F.col(root_key).alias(column)), column, "left_semi")
    for table, table_key, fact, column in dims:
        out[table] = load(table).join(out[fact].select(F.col(column).alias(table_key)), table_key, "left_semi")
    return out


def sampled_counts(spark: SparkSession, load: Loader, query: JoinQuery, keys: dict[str, str], share: float, seed: int = 0) -> DataFrame:
    """Counts over sampled base tables, scaled up by 1 / share for each sampled table of a subset; at least 1."""

    def sampled(table: str) -> DataFrame:
        return hash_sample(load(table), keys[table], share, seed) if table in keys else load(table)

    counts = sub_plan_counts(spark, sampled, query)
    scale = {key(s): (1 / share) ** sum(query.tables[a] in keys for a in s) for s in query.subsets()}
    factor = F.create_map(*(x for k, v in scale.items() for x in (F.lit(k), F.lit(float(v)))))
    return counts.withColumn("value", F.greatest(F.col("value") * F.element_at(factor, F.col("subset")), F.lit(1.0)))


def scan_estimate(sample: DataFrame, total: int, condition: Column) -> DataFrame:
    """One row: total times the share of sampled rows that meet the condition."""
    return sample.agg(F.when(F.count(F.lit(1)) > 0, F.count_if(condition) / F.count(F.lit(1)) * total).otherwise(0.0).alias("estimate"))


def walk_order(query: JoinQuery, removed: dict[str, int]) -> list[str]:
    """The alias with most rows removed by filters first, then always the adjacent alias with most; ties by name."""
    order = [max(sorted(query.tables), key=lambda a: removed.get(a, 0))]
    while len(order) < len(query.tables):
        near = {n for a in order for n in query.neighbours(a)} - set(order)
        if not near:
            break
        order.append(max(sorted(near), key=lambda a: removed.get(a, 0)))
    return order


def wander_join(spark: SparkSession, load: Loader, query: JoinQuery, walks: int, seed: int = 0, order: list[str] | None = None, unique: dict[str, list[str]] | None = None, successes: int | None = None) -> DataFrame:
    """(subset, estimate, sd, half_interval) of every prefix of the walk order, by a fixed number of random walks, or by those
    up to the walk with which so many have succeeded.

    Walk w picks, at hop h, candidate floor(x_h size / MODULUS) with x_h = (w + 1 + seed) MULTIPLIER^(h + 1) mod MODULUS among
    the candidates ordered by their unique columns; its weight is the product of the candidate numbers, 0 once a walk is
    dead. All conditions between the new alias and the visited ones are applied.

    Only what the walks reach is numbered: the rows of an alias that meet the keys of the walks (a semi-join with one row a
    walk), and of the first alias those in the slices of its key range in which picks fall. Candidates are never gathered
    into lists: a walk meets its row by an equality join on (key, number).
    """
    unique = unique or {}
    order = order or walk_order(query, {})
    state = spark.range(walks).select(F.col("id").alias("w"), F.pmod((F.col("id") + 1 + seed) * MULTIPLIER, F.lit(MODULUS)).alias("x"), F.lit(1.0).alias("weight"))
    states: list[tuple[str, DataFrame]] = []
    for hop, alias in enumerate(order):
        base = query.base(load, alias)
        done = order[:hop]
        linking = [e for e in query.edges if alias in (e.a, e.b) and (e.b if e.a == alias else e.a) in done]
        columns = base.columns
        ranked_by = [f"{alias}__{c}" for c in unique.get(alias, columns) if c in columns] or [f"{alias}__{c}" for c in columns]
        renamed = base.select(*(F.col(c).alias(f"{alias}__{c}") for c in columns))
        pairs = []
        for e in (e for e in linking if e.op == "="):
            own, other = ((e.ca, f"{e.b}__{e.cb}") if e.a == alias else (e.cb, f"{e.a}__{e.ca}"))
            pairs.append((f"{alias}__{own}", other))
        keys = list(dict.fromkeys(own for own, _ in pairs))
        first = {own: other for own, other in reversed(pairs)}
        number = f"{alias}__no"
        if keys:
            reached = state.select(*(F.col(first[k]).alias(k) for k in keys)).distinct()  # at most a row a walk
            near = renamed.join(F.broadcast(reached) if walks <= BROADCAST_WALKS else reached, keys, "left_semi")
            near = materialize(near, "walk-rows")
            sizes = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
            numbered = number_within(near, keys, ranked_by, number, sizes.agg(F.max("__size")).first()[0] or 0)
            state = state.join(sizes, [F.col(first[k]) == F.col(k) for k in keys], "left").drop(*keys)
            state = state.withColumn("__no", F.floor(F.col("x") * F.col("__size") / MODULUS))
        else:
            limits = key_limits(renamed, ranked_by[0])
            state = state.withColumn("__size", F.lit(limits["n"]))
            state = state.withColumn("__no", F.floor(F.col("x") * F.col("__size") / MODULUS))
            numbered = numbered_picks(renamed, state.select(F.col("__no").alias(number)).distinct(), ranked_by, number, limits)
        extra = [F.col(o) == F.col(p) for o, p in pairs if first[o] != p]
        extra += [F.col(f"{e.a}__{e.ca}") != F.col(f"{e.b}__{e.cb}") for e in linking if e.op == "!="]
        on = [F.col("__no") == F.col(number), *(F.col(first[k]) == F.col(k) for k in keys)]
        state = state.join(numbered, on, "left").drop("__no", number)
        alive = F.col("__size").isNotNull() & reduce(lambda a, b: a & b, extra, F.lit(True)) & F.col(f"{alias}__{columns[0]}").isNotNull()
        state = state.withColumn("weight", F.when(alive, F.col("weight") * F.col("__size")).otherwise(0.0)).drop("__size")
        state = materialize(state.withColumn("x", F.pmod(F.col("x") * MULTIPLIER, F.lit(MODULUS))), "walk")
        states.append((key(tuple(order[: hop + 1])), state))
    last = walks - 1
    if successes is not None:
        enough = state.where("weight > 0").orderBy("w").limit(successes).agg(F.count(F.lit(1)).alias("c"), F.max("w").alias("w")).first()  # bounded by the parameter
        last = enough["w"] if enough["c"] == successes else last
    n = F.count(F.lit(1))
    sd = F.when(n > 1, F.stddev_samp("weight")).otherwise(0.0)
    sums = (F.ceil(F.sum("weight") / n).alias("estimate"), sd.alias("sd"), (sd * Z99 / F.sqrt(n)).alias("half_interval"))
    return reduce(DataFrame.unionByName, (s.where(F.col("w") <= last).agg(*sums).select(F.lit(name).alias("subset"), "*") for name, s in states))


def key_limits(df: DataFrame, column: str) -> Row:
    """Rows, nulls and range of a column."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("none"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()


def numbered_picks(df: DataFrame, picks: DataFrame, order: list[str], out: str, limits: Row, slices: int = 4096) -> DataFrame:
    """The rows of df at the places in picks (column out, from 0) of the order, with their place; limits: of order's first column.

    The range of the first order column is cut into equal slices, whose rows are counted; only the rows of slices that hold
    a pick are ranked. A column that is no whole number, or nulls in it, are ranked over the whole table.
    """
    kind = df.schema[order[0]].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long") or limits["none"] or limits["lo"] is None:
        return global_rank(df, order, out).withColumn(out, F.col(out) - 1).join(picks, out, "left_semi")
    width = (int(limits["hi"]) - int(limits["lo"])) // slices + 1
    sliced = df.withColumn("__slice", F.floor((F.col(order[0]).cast("long") - int(limits["lo"])) / width))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    places = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("__c"))
    places = places.withColumn("__low", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    table = places.agg(F.array_sort(F.collect_list(F.struct("__low", "__slice", "__c"))).alias("__t"))  # one row of `slices` entries
    found = picks.crossJoin(F.broadcast(table)).select(F.element_at(F.filter("__t", lambda x: x["__low"] <= F.col(out)), -1).alias("x"))
    hit = materialize(found.select("x.*").distinct(), "walk-slices")  # at most a row a slice
    near = sliced.join(F.broadcast(hit.drop("__c")), "__slice")
    ranked = number_within(near, ["__slice"], order, "__at", hit.agg(F.max("__c")).first()[0] or 0)
    return ranked.withColumn(out, F.col("__low") + F.col("__at")).select(*df.columns, out).join(picks, out, "left_semi")


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str, most: int) -> DataFrame:
    """df with the number of each row within its key, from 0, given the rows of its largest key. Null keys are left out.

    If a key is too large for one task, all rows are ranked together in ranges.
    """
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    rest = [c for c in order if c not in keys]
    if most <= WINDOW_ROWS:
        return known.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*(rest or keys))) - 1)
    ranked = global_rank(known, [*keys, *rest], "__g")
    starts = ranked.groupBy(*keys).agg(F.min("__g").alias("__first"))
    return ranked.join(starts, keys).withColumn(out, F.col("__g") - F.col("__first")).drop("__g", "__first")
