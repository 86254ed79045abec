"""Join queries as data: aliases, filters and join conditions, and the SQL of any sub-join."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edge:
    """A join condition a.ca op b.cb; op is = or !=."""

    a: str
    ca: str
    b: str
    cb: str
    op: str = "="

    def sql(self) -> str:
        return f"{self.a}.{self.ca} {self.op} {self.b}.{self.cb}"

    def column(self) -> Column:
        left, right = F.col(f"{self.a}.{self.ca}"), F.col(f"{self.b}.{self.cb}")
        return left == right if self.op == "=" else left != right


_COMPARE = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_CASTS = {"float": "double", "float8": "double", "double": "double", "numeric": "double", "real": "double", "int": "bigint", "integer": "bigint", "bigint": "bigint", "text": "string", "varchar": "string"}


_NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def _as_number(text: str) -> int | float | None:
    """A text that meets a numeric column; None, which meets nothing, if it is no number."""
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return None


@dataclass(frozen=True)
class Predicate:
    """A typed filter on one column of an alias.

    op: eq, ne, lt, le, gt, ge, between, in, like, ilike, null, match (a regular expression), most also as not_..;
    range (lo < c <= hi, an open side is None); <comparison>_column with the name of another column of the alias; any, whose
    values are branches, each a tuple of filters. cast: type to which the column is cast, null where that fails.
    """

    column: str
    op: str
    values: tuple = ()
    cast: str | None = None

    def sql(self, alias: str) -> str:
        c = f"{alias}.{self.column}"
        if self.cast:
            c = f"TRY_CAST({c} AS {_CASTS.get(self.cast, self.cast).upper().replace('STRING', 'VARCHAR')})"

        def lit(v) -> str:
            return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

        if self.op == "any":
            return "(" + " OR ".join(" AND ".join(p.sql(alias) for p in branch) for branch in self.values) + ")"
        if self.op == "range":
            lo, hi = self.values
            return " AND ".join([*([f"{c} > {lit(lo)}"] if lo is not None else []), *([f"{c} <= {lit(hi)}"] if hi is not None else [])])
        if self.op in _COMPARE:
            return f"{c} {_COMPARE[self.op]} {lit(self.values[0])}"
        if self.op.endswith("_column"):
            return f"{c} {_COMPARE[self.op.removesuffix('_column')]} {alias}.{self.values[0]}"
        word = "NOT " if self.op.startswith("not_") else ""
        return {
            "in": lambda: f"{c} {word}IN ({', '.join(map(lit, self.values))})",
            "like": lambda: f"{c} {word}LIKE {lit(self.values[0])}",
            "ilike": lambda: f"{c} {word}ILIKE {lit(self.values[0])}",
            "between": lambda: f"{c} {word}BETWEEN {lit(self.values[0])} AND {lit(self.values[1])}",
            "null": lambda: f"{c} IS {word}NULL",
            "match": lambda: f"{'NOT ' if word else ''}regexp_like({c}, {lit(self.values[0])})",
        }[self.op.removeprefix("not_")]()

    def condition(self, df: DataFrame, prefix: str = "") -> Column:
        """The filter over the columns of df; numbers meet text columns as numbers, null where the text is none."""
        if self.op == "any":
            return reduce(lambda x, y: x | y, (reduce(lambda x, y: x & y, (p.condition(df, prefix) for p in branch)) for branch in self.values))
        c, values = F.col(prefix + self.column), self.values
        kind = "double" if self.cast and _CASTS.get(self.cast, self.cast) != "string" else df.schema[self.column].dataType.typeName()
        if self.cast:
            c = c.try_cast(_CASTS.get(self.cast, self.cast))
        elif kind == "string" and any(isinstance(v, int | float) for v in values):
            c = c.try_cast("double")
        elif kind in _NUMERIC and not self.op.endswith("_column"):
            values = tuple(_as_number(v) if isinstance(v, str) else v for v in values)
        if self.op == "range":
            lo, hi = values
            sides = [*([c > F.lit(lo)] if lo is not None else []), *([c <= F.lit(hi)] if hi is not None else [])]
            return reduce(lambda x, y: x & y, sides, F.lit(True))
        if self.op.endswith("_column") or self.op in _COMPARE:
            other = F.col(prefix + values[0]) if self.op.endswith("_column") else F.lit(values[0])
            return {"eq": c.__eq__, "ne": c.__ne__, "lt": c.__lt__, "le": c.__le__, "gt": c.__gt__, "ge": c.__ge__}[self.op.removesuffix("_column")](other)
        found = {
            "in": lambda: c.isin(*values),
            "like": lambda: c.like(values[0]),
            "ilike": lambda: c.ilike(values[0]),
            "between": lambda: c.between(*values),
            "null": lambda: c.isNull(),
            "match": lambda: c.rlike(values[0]),
        }[self.op.removeprefix("not_")]()
        return ~found if self.op.startswith("not_") else found


@dataclass(frozen=True)
class JoinQuery:
    """One query: alias -> table, alias -> filters, join conditions. hubs: tables whose edges alone do not connect."""

    qid: str
    tables: dict[str, str]
    edges: tuple[Edge, ...]
    preds: dict[str, tuple[Predicate, ...]] = field(default_factory=dict)
    hubs: frozenset[str] = frozenset()
    template: str = ""
    required: dict[str, tuple[str, ...]] = field(default_factory=dict)  # columns that must not be null, filters or not

    def neighbours(self, alias: str, within: set[str] | None = None) -> set[str]:
        found = {e.b if e.a == alias else e.a for e in self.edges if alias in (e.a, e.b)}
        return {x for x in found if within is None or x in within}

    def connected(self, aliases: set[str]) -> bool:
        """Connected without the hub tables, if there are two aliases or more."""
        inner = {a for a in aliases if self.tables[a] not in self.hubs} if len(aliases) > 1 else set(aliases)
        if not inner or (len(aliases) > 1 and len(inner) < len(aliases) and not all(self.neighbours(a, inner) for a in aliases - inner)):
            return False
        seen, todo = set(), [min(inner)]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += self.neighbours(a, inner) - seen
        return seen == inner

    def subsets(self) -> list[tuple[str, ...]]:
        """All connected subsets, sorted aliases each, by size and name. Grown alias by alias along edges."""
        level = {(a,) for a in self.tables}
        found = set(level)
        while level:
            level = {tuple(sorted({*s, n})) for s in level for a in s for n in self.neighbours(a) if n not in s} - found
            found |= level
        return sorted((s for s in found if self.connected(set(s))), key=lambda s: (len(s), s))

    def acyclic(self, subset: tuple[str, ...]) -> bool:
        """A tree of single equalities."""
        inner = [e for e in self.edges if e.a in subset and e.b in subset]
        return all(e.op == "=" for e in inner) and len({frozenset((e.a, e.b)) for e in inner}) == len(inner) == len(subset) - 1

    def restricted(self, aliases: tuple[str, ...], edges: tuple[Edge, ...] | None = None, required: dict[str, tuple[str, ...]] | None = None) -> JoinQuery:
        """The query over some of its aliases, with given edges instead of its own."""
        inner = tuple(e for e in (self.edges if edges is None else edges) if e.a in aliases and e.b in aliases)
        keep = {a: self.tables[a] for a in aliases}
        return JoinQuery(self.qid, keep, inner, self.preds, self.hubs, self.template, self.required | (required or {}))

    def lone_inequality(self, subset: tuple[str, ...]) -> tuple[Edge, tuple[str, ...], tuple[str, ...]] | None:
        """A != condition that alone links two parts of a subset, and the parts."""
        inner = [e for e in self.edges if e.a in subset and e.b in subset]
        for e in (e for e in inner if e.op != "="):
            part = self.restricted(subset, tuple(x for x in inner if x is not e)).reach(e.a)
            if e.b not in part:
                return e, tuple(sorted(part)), tuple(sorted(set(subset) - part))
        return None

    def reach(self, alias: str) -> set[str]:
        seen, todo = set(), [alias]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += self.neighbours(a) - seen
        return seen

    def conditions(self, subset: tuple[str, ...], filters: bool = True) -> list[str]:
        joins = [e.sql() for e in self.edges if e.a in subset and e.b in subset]
        own = [p.sql(a) for a in subset for p in self.preds.get(a, ())] if filters else []
        return sorted({*joins, *own})

    def count_sql(self, subset: tuple[str, ...] | None = None, filters: bool = True, select: str = "COUNT(*)") -> str:
        """SELECT COUNT(*) of a sub-join, tables and conditions in sorted order."""
        subset = subset or tuple(sorted(self.tables))
        where = self.conditions(subset, filters)
        tables = ", ".join(f"{self.tables[a]} AS {a}" for a in sorted(subset))
        return f"SELECT {select} FROM {tables}" + (f" WHERE {' AND '.join(where)}" if where else "")

    def base(self, load, alias: str, filters: bool = True) -> DataFrame:
        """One alias: filtered, with only its join columns."""
        df = load(self.tables[alias])
        for p in self.preds.get(alias, ()) if filters else ():
            df = df.where(p.condition(df))
        for c in self.required.get(alias, ()):
            df = df.where(F.col(c).isNotNull())
        columns = sorted({c for e in self.edges for a, c in ((e.a, e.ca), (e.b, e.cb)) if a == alias})
        return df.select(*columns).alias(alias)

    def join(self, load, subset: tuple[str, ...], filters: bool = True, order: list[str] | None = None) -> DataFrame:
        """The sub-join itself, joined along edges; order forces the sequence of aliases."""
        rest, done, out = list(order or sorted(subset)), [], None
        while rest:
            alias = rest[0] if out is None or order else next((a for a in rest if self.neighbours(a, set(done))), rest[0])
            rest.remove(alias)
            base = self.base(load, alias, filters)
            on = [e.column() for e in self.edges if alias in (e.a, e.b) and (e.b if e.a == alias else e.a) in done]
            if out is not None and not on:
                raise ValueError(f"{alias} has no join condition with {' '.join(done)}: cross joins are not run")
            out = base if out is None else out.join(base, reduce(lambda x, y: x & y, on), "inner")
            done.append(alias)
        return out


def key(subset: tuple[str, ...]) -> str:
    """The name of a subset: sorted aliases with blanks between."""
    return " ".join(sorted(subset))
