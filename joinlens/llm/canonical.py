"""Collapse records that differ only in formatting (problem 6).

A query is reduced to a canonical text: lower case, no white space outside quoted values, one kind of quote mark and none
around numbers, no brackets around a single condition, no closing semicolon, and a fixed order of tables, conditions,
members of an IN list and the two sides of an equality between columns. Its 192-bit digest is split into a 128-bit class
hash and a 64-bit check; classes are built by an aggregate on them, so copies are counted map-side before any shuffle and
two texts that share the class hash by accident are kept apart by the check.

Quoted values are unescaped and escaped anew, so that no value can be taken for syntax; a number is one token with its
sign, fraction and exponent, quoted or not, and is compared as it is written.

Defined cases: a null text has null hashes and is a copy of nothing (the collapse keeps each such row by itself, flagged
is_query = false); a blank text is the same as null; a text outside the dialect is compared token by token, in its own
order; repeated rows count as copies; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlens.session import spread

_NUM = r"(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?"
_TOKEN = re.compile(rf"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|{_NUM}(?![\w.$])|[\w.$]+|<=|>=|<>|!=|==|!~\*?|~\*?|::|[^\s]""")
_NUMBER = re.compile(rf"[+-]?{_NUM}\Z")
_COLUMN = re.compile(r"[a-z_]\w*(?:\.[a-z_]\w*)*\Z")
_TAIL = {"group", "order", "having", "limit", "union"}
#: Tokens after which a sign belongs to the number that follows.
_BEFORE_SIGN = {"=", "==", "<", ">", "<=", ">=", "<>", "!=", "(", ",", "and", "or", "between", "in", "like", "ilike", "not", "where", "select", "limit"}


def _tokens(text: str) -> list[str]:
    out: list[str] = []
    for token in _TOKEN.findall(text.lower()):
        mark = token[0]
        if mark in "'\"`" and len(token) > 1:
            inner = " ".join(token[1:-1].replace(mark * 2, mark).split())
            token = inner if _NUMBER.match(inner) else "'" + inner.replace("'", "''") + "'"
        elif len(out) > 1 and out[-1] in "+-" and out[-2] in _BEFORE_SIGN and _NUMBER.match(token):
            token = out.pop() + token
        out.append(token)
    while out and out[-1] == ";":
        out.pop()
    return out


def _split(tokens: list[str], word: str) -> list[list[str]]:
    """Parts between word outside brackets; the AND of a BETWEEN splits nothing."""
    parts, depth, between = [[]], 0, 0
    for token in tokens:
        if token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
        elif depth == 0:
            if token == "between":
                between += 1
            elif token == "and" and between:
                between -= 1
                parts[-1].append(token)
                continue
            if token == word:
                parts.append([])
                continue
        parts[-1].append(token)
    return parts


def _unwrap(tokens: list[str]) -> list[str]:
    while len(tokens) > 2 and tokens[0] == "(" and tokens[-1] == ")":
        depth = 0
        for at, token in enumerate(tokens):
            depth += (token == "(") - (token == ")")
            if depth == 0:
                break
        if at != len(tokens) - 1:
            break
        tokens = tokens[1:-1]
    return tokens


def _top_level(tokens: list[str], word: str) -> int:
    """Where a word stands outside brackets, after the first token; 0 if it does not."""
    if word not in tokens:
        return 0
    depth = 0
    for at, token in enumerate(tokens):
        depth += (token == "(") - (token == ")")
        if at and depth == 0 and token == word:
            return at
    return 0


def _condition(tokens: list[str]) -> str:
    tokens = _unwrap(tokens)
    for word in ("or", "and"):
        if word in tokens:
            parts = _split(tokens, word)
            if len(parts) > 1:
                return f"{word}({' ; '.join(sorted(map(_condition, parts)))})"
    at = _top_level(tokens, "=")
    if at:
        sides = [" ".join(_unwrap(side)) if len(_unwrap(side)) == 1 else " ".join(side) for side in (tokens[:at], tokens[at + 1 :])]
        return " = ".join(sorted(sides) if all(map(_COLUMN.match, sides)) else sides)
    at = _top_level(tokens, "in")
    if at and tokens[-1] == ")" and tokens[at + 1] == "(" and tokens[at + 2 : at + 3] != ["select"]:
        values = sorted(" ".join(v) for v in _split(tokens[at + 2 : -1], ","))
        return f"{' '.join(tokens[: at + 1])} ({' , '.join(values)})"
    if tokens and tokens[0] == "not":
        return f"not {_condition(tokens[1:])}"
    return " ".join(tokens)


def canonical_query(text: str | None) -> str | None:
    """The canonical text of one query; None for a null or blank text."""
    tokens = _tokens(text) if text else []
    if not tokens:
        return None
    clause, depth, parts = "select", 0, {"select": [], "from": [], "where": [], "tail": []}
    if tokens[0] != "select":
        return " ".join(tokens)
    for token in tokens[1:]:
        depth += (token == "(") - (token == ")")
        if depth == 0:
            if token in ("from", "where") and clause != "tail" and not parts[token]:
                clause = token
                continue
            if token in _TAIL:
                clause = "tail"
        parts[clause].append(token)
    tables = sorted(" ".join(t for t in _unwrap(table) if t != "as") for table in _split(parts["from"], ","))
    conditions = sorted(map(_condition, _split(parts["where"], "and"))) if parts["where"] else []
    if len(_split(parts["where"], "or")) > 1:
        conditions = [_condition(parts["where"])]
    elif len(conditions) == 1 and conditions[0].startswith("and("):
        conditions = [_condition(parts["where"])[4:-1]]
    return " | ".join((" ".join(parts["select"]), " , ".join(tables), " ; ".join(conditions), " ".join(parts["tail"])))


#: The hashes of a canonical text, in the order of the digest's bytes.
HASHES = ("hash_hi", "hash_lo", "hash_check")


def with_query_hash(df: DataFrame, text: str, keep: list[str | Column], digest: int = 24) -> DataFrame:
    """The columns keep of df beside the hashes of the canonical form of column text.

    Rows stream through the Python workers in Arrow batches; only keep and text are shipped. digest shortens the hash
    in bytes for tests of the collision check.
    """
    narrow = df.select(*keep, F.col(text).alias("__text"))
    schema = narrow.drop("__text").schema
    for name in HASHES:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed: tuple[list, list, list] = ([], [], [])
            for value in batch.column(batch.num_columns - 1).to_pylist():
                form = canonical_query(value)
                raw = form and blake2b(form.encode("utf-8", "surrogatepass"), digest_size=digest).digest().ljust(24, b"\0")
                for at, into in enumerate(hashed):
                    into.append(raw and int.from_bytes(raw[8 * at : 8 * at + 8], "little", signed=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(h, pa.int64()) for h in hashed)], [*batch.schema.names[:-1], *HASHES])

    return spread(narrow).mapInArrow(run, schema)


def collapse(hashed: DataFrame, row_id: str) -> DataFrame:
    """One row per class of equal records: smallest id, number of copies, hashes. hashed: of with_query_hash."""
    classes = hashed.where("hash_lo IS NOT NULL").groupBy(*HASHES).agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("n_copies"))
    none = hashed.where("hash_lo IS NULL").select(*HASHES, row_id, F.lit(1).cast("long").alias("n_copies"))
    return classes.unionByName(none).withColumn("is_query", F.col("hash_lo").isNotNull())


def account(classes: DataFrame) -> DataFrame:
    """One row: rows, queries, copies beyond the first, rows that hold no query, and records that share a 128-bit hash."""
    shared = hash_collisions(classes).agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_collisions"))
    query = F.col("is_query")
    sums = classes.agg(
        F.coalesce(F.sum("n_copies"), F.lit(0)).alias("n_rows"), F.count_if(query).alias("n_queries"),
        F.coalesce(F.sum(F.when(query, F.col("n_copies") - 1)), F.lit(0)).alias("n_surplus"), F.count_if(~query).alias("n_without"),
    )
    return sums.crossJoin(F.broadcast(shared))  # single rows


def hash_collisions(classes: DataFrame) -> DataFrame:
    """The 128-bit hashes shared by different records, as the checks tell; empty unless the hash fails."""
    return classes.where("is_query").groupBy("hash_hi", "hash_lo").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def copies(hashed: DataFrame, row_id: str) -> DataFrame:
    """(id, copy): the smallest id of every class of two or more, beside each other id.

    The class table is joined back on its hash; a class that holds much of the data is a skewed left side, which AQE
    splits by its map outputs, and no task sorts a whole class.
    """
    classes = collapse(hashed, row_id).where("is_query AND n_copies > 1").select(*HASHES, F.col(row_id).alias("first_id"))
    found = hashed.where("hash_lo IS NOT NULL").join(classes, list(HASHES)).where(F.col(row_id) != F.col("first_id"))
    return found.select(F.col("first_id").alias(row_id), F.col(row_id).alias(f"copy_{row_id}"))
