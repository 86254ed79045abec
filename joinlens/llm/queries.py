"""The queries of the corpus problems, p1_ to p9_, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.llm import bpe, canonical, mixture, overlap, packing, pieces, quantiles, splits
from joinlens.session import load, materialize


def _hashed(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    columns = [splits.template_key(k).alias("template_key") if k == "template_name" else k for k in keep]
    return materialize(canonical.with_query_hash(load(spark, d, "qrep"), "sql", list(columns)), "query-hash")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = load(spark, d, "qrep").select("qid", splits.template_key("template_name").alias("template_key"), "n_tables", "split")
    targets = load(spark, d, "mix_targets").select(
        "mix_id", splits.template_key("template_name").alias("template_key"), "target_permille", "sample_percent", "min_records"
    )
    return mixture.sample_to_targets(rows, "qid", "template_key", ["n_tables", "split"], targets)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The targets that the rows at hand cannot meet, from the sampler's report."""
    return _mixture(spark, d)[1].where("unmet").select("mix_id", "template_key")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0].select("mix_id", "qid", "template_key")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1].select("mix_id", "template_key", "at_hand", "quota", "drawn", "target_share", "drawn_share", "gap", "fit_error", "unmet")


def p1_margins(spark: SparkSession, d: str) -> DataFrame:
    """The gap that remains in every further margin of every mix."""
    return _mixture(spark, d)[2]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Template keys that belong together, as the splitter links them."""
    linked = splits.linked_keys(_hashed(spark, d, "qid", "template_name"), "template_key")
    return linked.select(F.col("node").alias("template_key"), F.col("component").alias("group_key"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    shares = [(r["split"], r["share"]) for r in load(spark, d, "split_shares").orderBy(F.desc("share"), "split").collect()]  # does not grow
    rows = _hashed(spark, d, "qid", "template_name", "n_tables")
    return splits.grouped_split(rows, "qid", "template_key", "n_tables", shares)


_STATS_KEYS = ["template", "num_tables", "samples_type"]
_QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def _sketches(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    single = load(spark, d, "stats").where("summary_type = 'value'").withColumn("day", F.to_date("run_at"))
    return quantiles.sketch_groups(single, "stat_id", keys, "loss")


def _percentiles(sketches: DataFrame) -> DataFrame:
    merged = quantiles.merge_sketches(sketches, _STATS_KEYS, list(_QUANTILES.values()))
    return merged.select(*_STATS_KEYS, "n", *(F.get("vals", F.lit(i)).alias(name) for i, name in enumerate(_QUANTILES)))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each group over all days, from its sketch; the same as p3_from_days, as sketches are linear."""
    return _percentiles(_sketches(spark, d, _STATS_KEYS))


def p3_day_sketches(spark: SparkSession, d: str) -> DataFrame:
    """One sketch for each group and day, to be kept and merged later."""
    return _sketches(spark, d, [*_STATS_KEYS, "day"])


def p3_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each group from the sketches of separate days, added up."""
    return _percentiles(p3_day_sketches(spark, d))


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    held_out, train = F.coalesce(F.col("split").isin("val", "test"), F.lit(False)), F.coalesce(F.col("split") == "train", F.lit(False))
    return overlap.cross_overlaps(load(spark, d, "qrep"), "qid", "sql", held_out, train)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlap_pairs(*_overlaps(spark, d), "qid")
    return pairs.select(F.least("eval_id", "train_id").alias("qid_a"), F.greatest("eval_id", "train_id").alias("qid_b"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows of val and test with an overlap in train, per split and template."""
    found = overlap.overlap_rows(*_overlaps(spark, d), "qid")
    rows = load(spark, d, "qrep").select("qid", "split", splits.template_key("template_name").alias("template_key"))
    held_out = rows.where("split IN ('val', 'test')").join(found, "qid", "left")
    return held_out.groupBy("split", "template_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("n_train_rows").alias("n_overlapping"),
        F.coalesce(F.sum("n_train_rows"), F.lit(0)).alias("n_pairs"), F.count_if(F.col("similarity") == 1).alias("n_same_words"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copies(_hashed(spark, d, "qid"), "qid")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.collapse(_hashed(spark, d, "qid"), "qid").select("qid", "n_copies", "is_query")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """The account of the collapse, hash collisions included."""
    return canonical.account(materialize(canonical.collapse(_hashed(spark, d, "qid"), "qid"), "query-classes"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(load(spark, d, "documents").select("doc_id", "text"), "text")


def _budget(spark: SparkSession, d: str, name: str) -> tuple[str, int, int]:
    row = load(spark, d, "token_budgets").where(F.col("budget") == name).first()  # a fixed table of two rows
    return row["tokenizer"], int(row["max_tokens"]), int(row["overlap_tokens"])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or its parts, with its container."""
    tokenizer, capacity, _ = _budget(spark, d, "container")
    sized = bpe.count_column(load(spark, d, "documents").select("doc_id", "text"), "text", tokenizer=tokenizer)
    return packing.pack(packing.token_items(sized, "doc_id", "n_tokens", capacity), "doc_id", capacity)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by number of tokens in them."""
    per = p8_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("n_tokens") > 0).alias("n_items"))
    return per.groupBy("used").agg(F.count(F.lit(1)).alias("n_containers"), F.max("n_items").alias("most_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the splitter cuts."""
    tokenizer, limit, shared = _budget(spark, d, "piece")
    cut = pieces.split_column(load(spark, d, "documents"), "doc_id", "text", limit, shared, tokenizer, with_text=False)
    return cut.where("n_pieces > 1 AND piece = 0").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    tokenizer, limit, shared = _budget(spark, d, "piece")
    return pieces.split_column(load(spark, d, "documents"), "doc_id", "text", limit, shared, tokenizer)


QUERIES = {
    "p1_found": p1_found,
    "p1_sample": p1_sample,
    "p1_report": p1_report,
    "p1_margins": p1_margins,
    "p2_found": p2_found,
    "p2_splits": p2_splits,
    "p3_percentiles": p3_percentiles,
    "p3_day_sketches": p3_day_sketches,
    "p3_from_days": p3_from_days,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_report": p6_report,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_pieces": p9_pieces,
}

_KEY = "nullif(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), '')"

ORACLES = {
    "p1_found": f"""
WITH have AS (SELECT {_KEY.format('template_name')} AS template_key, count(*) AS n FROM qrep GROUP BY 1),
     t AS (SELECT coalesce(sum(n), 0) AS total FROM have WHERE template_key IS NOT NULL)
SELECT mix_id, {_KEY.format('template_name')} AS template_key
FROM mix_targets LEFT JOIN have ON have.template_key = {_KEY.format('template_name')}, t
WHERE coalesce(n, 0) * 100000 < target_permille::BIGINT * sample_percent * total OR coalesce(n, 0) < min_records
""",
    "p5_found": """
WITH w AS (SELECT qid, split, list_distinct(regexp_extract_all(lower(sql), '[a-z0-9_]+')) AS words FROM qrep WHERE sql IS NOT NULL),
     p AS (SELECT e.qid AS e, t.qid AS t, len(list_intersect(e.words, t.words)) AS common, len(e.words) + len(t.words) AS n
           FROM w AS e JOIN w AS t ON e.split IN ('val', 'test') AND t.split = 'train')
SELECT least(e, t) AS qid_a, greatest(e, t) AS qid_b FROM p WHERE common * 100 >= 85 * (n - common) AND common > 0
""",
}
