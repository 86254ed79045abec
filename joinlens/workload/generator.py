"""Workloads from templates: seeded, with domain queries run by Spark."""

from __future__ import annotations

import hashlib
import random
import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.operators.percentiles import exact_percentiles
from joinlens.operators.windows import global_rank
from joinlens.session import materialize
from joinlens.workload.parser import UnsupportedQuery, parse


#: Fixed value: words of one text beyond which a domain is refused.
MAX_TOKENS = 150


@dataclass
class Domain:
    """Rows of domain queries, cached by the SHA-1 of their text and kept as tables; the driver sees only the rows drawn.

    A column beyond the group's own is the count of the row; without one every row counts once.
    """

    spark: SparkSession
    cache: dict[str, tuple[DataFrame, int]]

    def _plain(self, sql: str, width: int) -> DataFrame:
        """(c0..., n) of the query's rows."""
        df = self.spark.sql(sql)
        df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        n = F.col(df.columns[-1]) if len(df.columns) > width else F.lit(1)
        return df.select(*(f"c{i}" for i in range(width)), n.cast("long").alias("n"))

    def rows(self, sql: str, width: int) -> tuple[DataFrame, int]:
        """(c0..., n, at) and its size: the first width columns, the count and the number from 1, the most frequent first, ties by value."""
        name = hashlib.sha1(f"rows {width} {sql}".encode()).hexdigest()
        if name not in self.cache:
            df = self._plain(sql, width)
            ranked = global_rank(df.withColumn("__less", -F.col("n")), ["__less", *df.columns[:-1]], "at").select(*df.columns, "at")
            self.cache[name] = ranked, ranked.count()
        return self.cache[name]

    def texts(self, sql: str) -> DataFrame:
        """(c0, n) of the query's rows, run once: a domain query may hold random()."""
        name = hashlib.sha1(f"texts {sql}".encode()).hexdigest()
        if name not in self.cache:
            df = materialize(self._plain(sql, 1), "domain")
            self.cache[name] = df, 0
        return self.cache[name][0]


def _numbered(df: DataFrame, at: list[int]) -> list[tuple]:
    """The rows with these numbers, in their order; one that is asked for twice comes twice."""
    found = {r["at"]: tuple(r) for r in df.where(F.col("at").isin(sorted(set(at)))).collect()}  # as many rows as drawn
    return [found[i] for i in at]


def load_template(text: str) -> dict:
    """A template file: [base_sql].sql, [[templates]] with ordered [[templates.predicates]] groups."""
    return tomllib.loads(text)


def _quoted(value) -> str:
    return "'" + str(value).replace("'", "") + "'"


def _in_list(rng: random.Random, group: dict, domain: DataFrame, size: int) -> dict[str, str] | None:
    """k rows, by quantile chunk or uniform with replacement; columns stay aligned. A null in the list adds OR IS NULL."""
    k = rng.randint(int(group.get("min_samples", 1)), int(group.get("max_samples", 1)))
    if not size:
        return None
    if group.get("sampling_method") == "quantile":
        q = int(group.get("num_quantiles", 1))
        chunk = max(1, size // q)
        i = rng.randrange(min(q, size // chunk))
        drawn = rng.sample(range(i * chunk + 1, (i + 1) * chunk + 1), min(k, chunk))
    else:
        drawn = [rng.choice(range(1, size + 1)) for _ in range(k)]
    chosen = _numbered(domain, drawn)
    out = {}
    for at, (name, column) in enumerate(zip(group["keys"], group["columns"], strict=True)):
        values = sorted({r[at] for r in chosen if r[at] is not None}, key=str)
        condition = f"{column} IN ({', '.join(map(_quoted, values))})" if values else ""
        if any(r[at] is None for r in chosen):
            condition = f"({condition} OR {column} IS NULL)" if condition else f"{column} IS NULL"
        out[name] = condition
    return out


def _words() -> Column:
    """The distinct lower-case words of c0."""
    return F.array_distinct(F.filter(F.split(F.lower(F.col("c0").cast("string")), r"\W+"), lambda w: F.length(w) >= 1))


def _starts(word: Column, least: int, most: int) -> Column:
    """The prefixes of a word of least or more characters."""
    return F.transform(F.sequence(F.lit(least), F.least(F.length(word), F.lit(most))), lambda k: F.substr(word, F.lit(1), k))


def word_counts(rows: DataFrame) -> DataFrame:
    """(w, n): every lower-case word of c0, and the rows that hold it."""
    return rows.where("c0 IS NOT NULL").select(F.explode(_words()).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))


def prefix_counts(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(p, n): every prefix of lower-case words of c0, and the rows that hold it; a row with two such words counts once."""
    each = F.flatten(F.transform(F.filter(_words(), lambda w: F.length(w) >= least), lambda w: _starts(w, least, most)))
    return rows.where("c0 IS NOT NULL").select(F.explode(F.array_distinct(each)).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))


def size_band(rng: random.Random, group: dict, words: DataFrame, total: int) -> tuple[float, float]:
    """The open interval of rows for an ILIKE group: between two thresholds, or a part of num_quantiles, by percentile of the
    words' counts or by rows (even odds); without either key, min_count rows or more."""
    least = int(group.get("min_count", 1))
    if "thresholds" in group:
        cuts = [*group["thresholds"], float("inf")]
        i = rng.randrange(len(cuts) - 1)
        return cuts[i], cuts[i + 1]
    if "num_quantiles" not in group:
        return least - 1, float("inf")
    q = int(group["num_quantiles"])
    by_percentile, i = rng.random() > 0.5, rng.randrange(q)
    if by_percentile:
        found = exact_percentiles(words, [], "n", {"low": i / q, "high": (i + 1) / q}).first()
        return max(least, found["low"]), found["high"]
    return max(least, i * total / q), (i + 1) * total / q


def pick_prefix(rng: random.Random, group: dict, rows: DataFrame) -> str | None:
    """A prefix whose rows lie in the group's band, or None if there is none, or if the domain holds whole documents (a text of
    more than MAX_TOKENS words), for which the domain query is wrong.

    The plain way tries words, weighted by count and uniform in turns, each with a random prefix length, until one fits. Here
    the shares of fitting tries tell which of the two would have succeeded first, and the smallest exponential key among the
    fitting (word, length) pairs is the draw: the law of those tries, without a limit on their number.
    """
    least, most = int(group.get("min_chars", 3)), int(group.get("max_chars", 6))
    if (rows.agg(F.max(F.size(_words()))).first()[0] or 0) > MAX_TOKENS:
        return None
    words = word_counts(rows)
    n_words, total = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    if n_words <= 1:
        return None
    low, high = size_band(rng, group, words, total)
    fits = prefix_counts(rows, least, most).where((F.col("n") > float(low)) & (F.col("n") < float(high))).select("p")
    starts = words.where(F.length("w") >= least).withColumn("ps", _starts(F.col("w"), least, most))
    pairs = starts.select("w", F.explode("ps").alias("p"), (1 / F.size("ps")).alias("even"), (F.col("n") / F.size("ps")).alias("heavy")).join(fits, "p")

    def drawn(weight: str) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(rng.getrandbits(31)), "w", "p"), 11).cast("double") + 0.5) / F.lit(float(2**53))
        return F.min(F.struct((-F.ln(u) / F.col(weight)).alias("key"), "p"))["p"]

    heavy, even, p_heavy, p_even = pairs.agg(drawn("heavy"), drawn("even"), F.sum("heavy") / total, F.sum("even") / n_words).first()
    if heavy is None:
        return None
    first = p_heavy / (1 - (1 - p_heavy) * (1 - p_even))  # the tries begin with a weighted one
    return heavy if rng.random() < first else even


def instantiate(spark: SparkSession, template: dict, rng: random.Random, domain: Domain) -> str | None:
    """One query text, or None if a group finds no values."""
    sql, known = template["base_sql"]["sql"], {}
    for t in template["templates"]:
        for group in t["predicates"]:
            if "multi" in group:
                group = rng.choice(group["multi"])
            kind, pred = group.get("type", "sql"), str(group.get("pred_type", "in")).lower()
            made: dict[str, str] | None
            if kind == "list":
                option = rng.choice(group["options"])
                if pred == "range" or (isinstance(option, list) and len(option) == 2 and len(group["keys"]) == 2):
                    lo, hi = option
                    c = group["columns"][0]
                    number = f"try_cast({c} AS DOUBLE)" if group.get("numeric_col_type") else c
                    made = {group["keys"][0]: f"{number} >= {lo}", group["keys"][1]: f"{number} <= {hi}"} if len(group["keys"]) == 2 else {group["keys"][0]: f"{number} >= {lo} AND {number} <= {hi}"}
                elif group.get("replace"):
                    made = {group["keys"][0]: str(option)}
                elif pred == "ilike":
                    made = {group["keys"][0]: f"{group['columns'][0]} ILIKE {_quoted('%' + str(option).strip('%') + '%')}"}
                else:
                    values = option if isinstance(option, list) else [option]
                    made = {group["keys"][0]: f"{group['columns'][0]} IN ({', '.join(map(_quoted, values))})"}
            else:
                text = rng.choice(group["sqls"]) if kind == "sqls" else group["sql"]
                if group.get("dependencies"):
                    for name, value in known.items():
                        text = text.replace(name, value)
                if pred == "ilike":
                    prefix = pick_prefix(rng, group, domain.texts(text))
                    made = {group["keys"][0]: f"{group['columns'][0]} ILIKE {_quoted('%' + prefix + '%')}"} if prefix else None
                else:
                    made = _in_list(rng, group, *domain.rows(text, len(group["keys"])))
            if made is None:
                return None
            known |= made
            for name, value in made.items():
                sql = sql.replace(name, value)
    return sql


def generate(spark: SparkSession, template_text: str, n: int, seed: int = 0) -> list[str]:
    """Up to n distinct queries of a template that parse and can be planned, in the order they were drawn."""
    template, rng, domain = load_template(template_text), random.Random(seed), Domain(spark, {})
    drawn = [q for q in (instantiate(spark, template, rng, domain) for _ in range(n)) if q]
    return [q for q in dict.fromkeys(drawn) if verify(spark, q)]


def generate_all(spark: SparkSession, templates: dict[str, str], quotas: dict[str, int], default: int = 20, seed: int = 0, tries: int = 3) -> list[tuple[str, int, str]]:
    """(template, number, query) of several templates, as many distinct queries of each as its quota says, or as can be
    found in `tries` times as many draws."""
    out = []
    for at, (name, text) in enumerate(sorted(templates.items())):
        wanted = quotas.get(name, default)
        found: dict[str, None] = {}
        for attempt in range(tries):
            if len(found) < wanted:
                found |= dict.fromkeys(generate(spark, text, wanted, seed * 1_000_003 + at * tries + attempt))
        out += [(name, i, q) for i, q in enumerate(list(found)[:wanted])]
    return out


def verify(spark: SparkSession, sql: str) -> bool:
    """The text is within the dialect and Spark can analyse it."""
    try:
        parse(sql)
        spark.sql(sql).schema  # noqa: B018 - analysis is what is tested
    except UnsupportedQuery:
        return False
    except Exception:  # noqa: BLE001 - whatever analysis refuses is not a valid query
        return False
    return True


def synthetic_queries(columns: list[str], table: str, domains: dict[str, list], n: int, seed: int = 0) -> list[str]:
    """Random column combinations with IN lists over one table."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        chosen = sorted(rng.sample(columns, rng.randint(1, len(columns))))
        parts = [f"{c} IN ({', '.join(_quoted(v) for v in sorted(set(rng.choices(domains[c], k=rng.randint(1, 5))), key=str))})" for c in chosen]
        out.append(f"SELECT COUNT(*) FROM {table} AS t WHERE " + " AND ".join(f"t.{p}" for p in parts))
    return list(dict.fromkeys(out))


def fill_v1(sql: str, domains: dict[str, list], ranges: dict[str, tuple], seed: int = 0) -> str:
    """Older templates: a placeholder 'SELECT c' domain in IN becomes 1 to 15 values, Xc and Yc the ends of a range."""
    rng = random.Random(seed)
    for c, values in domains.items():
        chosen = sorted(set(rng.choices(values, k=rng.randint(1, 15))), key=str)
        sql = sql.replace(f"IN ('SELECT {c}')", f"IN ({', '.join(map(_quoted, chosen))})")
    for c, values in ranges.items():
        a, b = sorted((rng.choice(values), rng.choice(values)))
        sql = sql.replace(f"X{c}", str(a)).replace(f"Y{c}", str(b))
    return sql


def profile(preds: DataFrame) -> DataFrame:
    """Operators, columns and constants of a workload: (op, n_filters, n_columns, mean_values)."""
    return preds.groupBy("op").agg(F.count(F.lit(1)).alias("n_filters"), F.count_distinct("col").alias("n_columns"), F.avg("n_values").alias("mean_values"))


def curate(queries: DataFrame, runtimes: DataFrame, most_timeouts: int = 10, timeout: float = 909.0) -> DataFrame:
    """Executed queries with at most so many timed-out runs, numbered within their template by key."""
    from pyspark.sql import Window

    runs = runtimes.where("runtime IS NOT NULL").groupBy("sql_key").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("runtime") >= timeout).alias("n_timeouts"))
    kept = queries.join(runs.where(F.col("n_timeouts") <= most_timeouts), "sql_key").dropDuplicates(["sql_key"])
    return kept.withColumn("number", F.row_number().over(Window.partitionBy("template").orderBy("sql_key")))
