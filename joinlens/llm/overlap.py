"""Same and near-same records across splits (problem 5): exact prefix-filter join between evaluation and training rows.

A record is the set of its distinct words; equal sets are joined once, as one representative. Words are put in a global
order, rarest first. For similarity t and |x| words, two matching sets share at least a = ceil(t |x|) words, so the first
k words they share (in the global order) all stand within the first |x| - a + k words of each. Evaluation sets are indexed
under the combinations of k words of that prefix, training sets probe with theirs, and two sets meet only where they share
one. Length and position filters cut candidates within the join, word arrays are compared for the rest. Nothing is
estimated and no candidate is dropped.

The depth k: sets of at most PAIR_WORDS words are indexed by pairs, whose posting lists are far shorter than those of
single words, which grow with the data while the vocabulary does not. Longer sets are indexed by single words (their
prefixes are long, and pairs would grow with the square of it); sets between PAIR_WORDS and PAIR_WORDS / t words, which may
match a set on either side, have both. So entries stay linear in the words of a record. Sets so small that one shared word
is enough (a < 2) are also indexed under single words. A key that still is hot is a skewed join partition, which AQE splits
on both sides.

Words are compared by 64-bit hashes. Only the order of the frequent_words commonest words is broadcast (a fixed number of
rows); all others count as rare and are ordered by hash. Any order is exact, this one keeps keys rare.

Defined cases: null texts and texts without words have no partner; repeated rows are members of one representative; rows
of neither side are left out; extra columns are ignored; empty sides give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlens.session import materialize


#: Sets of up to so many words are indexed by pairs of words.
PAIR_WORDS = 128


def word_set(text: str | Column) -> Column:
    """Hashes of the distinct maximal runs of a-z, 0-9 and _ in the lower-cased text, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    return F.array_sort(F.transform(F.array_distinct(words), lambda w: F.xxhash64(w)))


def _prefix_keys(lengths: np.ndarray, flat: np.ndarray, rank: np.ndarray, t: Fraction, pair_words: int) -> tuple[np.ndarray, ...]:
    """(row, key, first position, second position) of every index entry; rank orders the words."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((flat, rank, row))
    flat = flat[order]  # rows stay in place, their words now in global order
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    rows, keys, first, second = [], [], [], []

    def put(of: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        rows.append(np.repeat(of, len(i)))
        keys.append(key.ravel())
        first.append(np.tile(i, len(of)))
        second.append(np.tile(j, len(of)))

    for n in np.unique(lengths[lengths > 0]).tolist():
        of = np.flatnonzero(lengths == n)
        least = math.ceil(t * n)
        prefix = flat[start[of][:, None] + np.arange(min(n, n - least + 2))].astype(np.uint64)
        if n * t <= pair_words:
            i, j = np.triu_indices(prefix.shape[1], 1)
            with np.errstate(over="ignore"):
                pair = prefix[:, i] * np.uint64(0x9E3779B97F4A7C15) + (prefix[:, j] ^ (prefix[:, j] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            put(of, pair, i, j)
        if n > pair_words or least < 2:
            i = np.arange(n - least + 1)
            put(of, prefix[:, : len(i)], i, i)
    if not rows:
        return (np.zeros(0, np.int64),) * 4
    return tuple(map(np.concatenate, (rows, keys, first, second)))


def _index(sets: DataFrame, side: str, common: Broadcast, t: Fraction, pair_words: int) -> DataFrame:
    """(key, <side>_set, <side>_n, <side>_i, <side>_j): the prefix entries of every representative."""
    names = ["key", *(f"{side}_{c}" for c in ("set", "n", "i", "j"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = common.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = part.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                spot = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
                rank = np.where(known[spot] == flat, place[spot], 0) if len(known) else np.zeros(len(flat), np.int64)
                rows, keys, first, second = _prefix_keys(lengths, flat, rank, t, pair_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int64)), part.column(0).take(pa.array(rows)), pa.array(lengths[rows].astype(np.int32)),
                     pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))], names,
                )

    schema = "key long, " + ", ".join(f"{side}_{c} {kind}" for c, kind in (("set", "binary"), ("n", "int"), ("i", "int"), ("j", "int")))
    return sets.select("set_id", "words").mapInArrow(run, schema)


def cross_overlaps(
    rows: DataFrame, row_id: str, text: str, in_eval: Column, in_train: Column, similarity: str = "0.85", frequent_words: int = 65536,
    pair_words: int = PAIR_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(links, members): links eval_set, train_set, overlap, n_eval, n_train (a set that stands on both sides links to
    itself), members set_id, row id, in_eval. similarity is a decimal text, so that the threshold is exact."""
    t = Fraction(similarity)
    narrow = rows.select(F.col(row_id), in_eval.alias("in_eval"), in_train.alias("in_train"), word_set(text).alias("words"))
    narrow = narrow.where("(in_eval OR in_train) AND size(words) > 0")
    narrow = narrow.withColumn("set_id", F.unhex(F.md5(F.array_join(F.transform("words", lambda w: F.hex(w)), " "))))
    narrow = materialize(narrow, "overlap-rows")
    members = narrow.select("set_id", row_id, "in_eval")
    sets = narrow.groupBy("set_id").agg(
        F.first("words").alias("words"), F.bool_or("in_eval").alias("in_eval"), F.bool_or("in_train").alias("in_train")
    )
    sets = materialize(sets, "overlap-sets")
    counts = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    top = counts.orderBy(F.desc("c"), "w").limit(frequent_words).toPandas()  # bounded by the parameter
    known = top["w"].to_numpy(np.int64)
    place = len(top) - np.arange(len(top))  # the commonest word comes last
    by_word = np.argsort(known)
    common = rows.sparkSession.sparkContext.broadcast((known[by_word], place[by_word]))
    e, r = (_index(sets.where(side), name, common, t, pair_words) for name, side in (("e", "in_eval"), ("r", "in_train")))
    num, den = t.numerator, t.denominator
    # entries under one word stand for the first shared word, those under two for the first two
    same_depth = (F.col("e_i") == F.col("e_j")) == (F.col("r_i") == F.col("r_j"))
    most = F.when(F.col("e_i") == F.col("e_j"), 1).otherwise(2) + F.least(F.col("e_n") - F.col("e_j"), F.col("r_n") - F.col("r_j")) - 1
    candidates = (
        e.join(r, "key").where((F.col("e_set") != F.col("r_set")) & same_depth)
        .where((F.col("e_n") * den >= F.col("r_n") * num) & (F.col("r_n") * den >= F.col("e_n") * num))
        .where(most * (num + den) >= num * (F.col("e_n") + F.col("r_n")))
        .select("e_set", "r_set").distinct()
    )
    words = sets.select("set_id", "words")
    checked = (
        candidates.join(words.select(F.col("set_id").alias("e_set"), F.col("words").alias("e_words")), "e_set")
        .join(words.select(F.col("set_id").alias("r_set"), F.col("words").alias("r_words")), "r_set")
        .select(F.col("e_set").alias("eval_set"), F.col("r_set").alias("train_set"), F.size(F.array_intersect("e_words", "r_words")).alias("overlap"),
                F.size("e_words").alias("n_eval"), F.size("r_words").alias("n_train"))
        .where(F.col("overlap") * (num + den) >= num * (F.col("n_eval") + F.col("n_train")))
    )
    n = F.size("words")
    same = sets.where("in_eval AND in_train").select(F.col("set_id").alias("eval_set"), F.col("set_id").alias("train_set"), n.alias("overlap"), n.alias("n_eval"), n.alias("n_train"))
    return checked.unionByName(same), members


def overlap_pairs(links: DataFrame, members: DataFrame, row_id: str) -> DataFrame:
    """(eval id, train id) of every overlapping pair of rows; as many rows as there are such pairs."""
    left = members.where("in_eval").select(F.col("set_id").alias("eval_set"), F.col(row_id).alias("eval_id"))
    right = members.where("NOT in_eval").select(F.col("set_id").alias("train_set"), F.col(row_id).alias("train_id"))
    return links.join(left, "eval_set").join(right, "train_set").select("eval_id", "train_id")


def overlap_rows(links: DataFrame, members: DataFrame, row_id: str) -> DataFrame:
    """One row per evaluation row with an overlap: its id and the number of training rows that it overlaps with.

    Pairs are not expanded: training members are counted by set, then summed over links.
    """
    train = members.where("NOT in_eval").groupBy(F.col("set_id").alias("train_set")).agg(F.count(F.lit(1)).alias("n"))
    per_set = links.join(train, "train_set").groupBy("eval_set").agg(
        F.sum("n").alias("n_train_rows"), F.max(F.col("overlap") / (F.col("n_eval") + F.col("n_train") - F.col("overlap"))).alias("similarity")
    )
    return members.where("in_eval").withColumnRenamed("set_id", "eval_set").join(per_set, "eval_set").select(row_id, "n_train_rows", "similarity")
