"""Counts of sub-joins that start from the text of a query."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.operators import labelling
from joinlens.queries.base import Registry, Tables

R = Registry()
add = R.add

_MOVIE = {"t": "title", "mi": "movie_info", "mi2": "movie_info", "kt": "kind_type", "it": "info_type"}
_ON = {("mi", "t"): "mi.movie_id = t.id", ("mi2", "t"): "t.id = mi2.movie_id", ("mi", "mi2"): "mi.movie_id = mi2.movie_id", ("kt", "t"): "t.kind_id = kt.id", ("it", "mi"): "mi.info_type_id = it.id"}
#: (name, aliases, filters by alias as they stand in the text); a pair is text and what other engines call it.
_TEXTS = [
    ("a", "t mi", {"t": ["t.production_year > 1960 AND t.production_year <= 2005", "(t.kind_id IN (1, '3') OR t.kind_id IS NULL)"], "mi": ["mi.info_type_id != 7"]}),
    ("b", "t mi kt", {"t": ["t.production_year BETWEEN 1950 AND 2000", "t.title ILIKE '%DRA%'"], "mi": ["mi.note IS NULL"], "kt": ["kt.kind in ('feature', 'series')"]}),
    ("c", "t mi it kt", {"mi": ["(mi.info_type_id = 4 OR mi.info_type_id = 12 AND mi.note IS NOT NULL)"], "it": ["it.info LIKE '%label'"], "kt": ["NOT kt.kind = 'clip'"]}),
    ("d", "t mi mi2", {"t": ["NOT (t.production_year < 1980)"], "mi": ["mi.info LIKE 'B%'"], "mi2": ["mi2.info_type_id >= 3", "mi2.info_type_id < '9'"]}),
    ("e", "mi it", {"mi": [(r"mi.info ~ '^(?:[1-9]\d*|0)?(?:\.\d+)?$' AND mi.info::float <= 6.5", "TRY_CAST(mi.info AS DOUBLE) <= 6.5")], "it": ["it.id > -5"]}),
    ("f", "t", {"t": ["t.episode_nr IS NOT NULL", "t.production_year > t.kind_id", "t.title NOT LIKE '%a%'"]}),
    ("g", "mi t", {"mi": ["mi.info NOT IN ('n/a', 'it''s')"], "t": ["(1990 < t.production_year OR (t.kind_id <> 4))"]}),
]


def _joined(aliases: tuple[str, ...]) -> list[str]:
    return [on for pair, on in _ON.items() if set(pair) <= set(aliases)]


def _connected(aliases: tuple[str, ...]) -> bool:
    reached = {aliases[0]}
    for _ in aliases:
        reached |= {a for pair in _ON if set(pair) <= set(aliases) and set(pair) & reached for a in pair}
    return reached == set(aliases)


def query_text(aliases: tuple[str, ...], filters: dict[str, list], version: int = 0) -> str:
    where = _joined(aliases) + [f if isinstance(f, str) else f[version] for a in aliases for f in filters.get(a, [])]
    return f"SELECT COUNT(*) FROM {', '.join(f'{_MOVIE[a]} AS {a}' for a in aliases)}" + (f" WHERE {' AND '.join(where)}" if where else "")


def _sql() -> str:
    """Every sub-join by pasting the pieces of the text together, without the parser."""
    parts = []
    for name, aliases, filters in _TEXTS:
        names = tuple(sorted(aliases.split()))
        for n in range(1, len(names) + 1):
            parts += [f"SELECT '{name}' AS qid, '{' '.join(s)}' AS subset, {n} AS n_tables, ({query_text(s, filters, 1)}) AS value" for s in combinations(names, n) if _connected(s)]
    return " UNION ALL ".join(parts)


@add(_sql())
def subplan_from_sql(t: Tables) -> DataFrame:
    """Counts of all sub-joins of queries that are given as texts."""
    texts = [(name, query_text(tuple(aliases.split()), filters)) for name, aliases, filters in _TEXTS]
    rows = t.spark.createDataFrame(texts, "qid string, sql string")
    found = labelling.label_workload(t.spark, t, labelling.read_texts(rows, "sql", set(_MOVIE.values())))
    names = rows.select("qid", F.sha1(F.col("sql").cast("binary")).alias("sql_key"))
    return found.join(names, "sql_key").select("qid", "subset", "n_tables", "value")


@add()
def labelled_workload(t: Tables) -> DataFrame:
    """Counts of all sub-joins of the stored queries whose tables are at hand, by distinct text."""
    texts = labelling.read_texts(t.qrep, "sql", set(_MOVIE.values()))
    return labelling.label_workload(t.spark, t, texts)


@add()
def labelled_without_zeros(t: Tables) -> DataFrame:
    """The same, without the queries of which a sub-join is empty; texts that are not run keep their status."""
    texts = labelling.read_texts(t.qrep, "sql", set(_MOVIE.values()))
    return labelling.label_workload(t.spark, t, texts, skip_zero=True)


QUERIES, ORACLES = R.queries, R.oracles
