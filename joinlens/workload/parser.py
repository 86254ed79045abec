"""Reading select-project-join queries: tables, join conditions and typed filters.

The grammar is that of the query corpora: SELECT .. FROM a list of tables, WHERE with AND, OR, NOT and brackets over
comparisons, IN lists, BETWEEN, LIKE and ILIKE, IS NULL and regular expressions, columns with casts. Whatever is outside it
is refused, never guessed at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from joinlens.workload.spec import Edge, JoinQuery, Predicate

_TOKEN = re.compile(
    r"""\s*(?:('(?:[^']|'')*'|"(?:[^"]|"")*")|((?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w.]))"""
    r"""|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(!~|~|<=|>=|<>|!=|[<>=]|::|[-+(),*;]))"""
)
_TAIL = ("group", "order", "limit", "having")
_MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
_SIGNS = {"=": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "~": "match", "!~": "not_match"}
_NEGATED = {
    "eq": "ne", "ne": "eq", "lt": "ge", "le": "gt", "gt": "le", "ge": "lt", "in": "not_in", "not_in": "in", "like": "not_like", "not_like": "like",
    "ilike": "not_ilike", "not_ilike": "ilike", "null": "not_null", "not_null": "null", "match": "not_match", "not_match": "match",
    "between": "not_between", "not_between": "between",
}
#: Fixed value: the guard that text columns with numbers carry.
_NUMERIC_GUARD = r"^(?:[1-9]\d*|0)?(?:\.\d+)?$"


class UnsupportedQuery(ValueError):
    """The text is outside the dialect of the query corpora."""


@dataclass(frozen=True)
class Leaf:
    """One filter: column as written (alias.column or column), operator, values; cast of the column."""

    column: str
    op: str
    values: tuple = ()
    cast: str | None = None


@dataclass(frozen=True)
class Any:
    """An OR group: branches, each a conjunction of leaves and groups."""

    branches: tuple[tuple, ...]


@dataclass
class Parsed:
    select: str
    tables: dict[str, str] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    where: tuple = ()
    tail: str = ""

    @property
    def preds(self) -> list[dict]:
        """Filters as the extraction of filters gives them: members of OR groups one after another, every kind of range as
        `lt` with [low, high], IS NULL as `in`, ILIKE as `like`; IS NOT NULL and patterns are left out."""
        out: list[dict] = []

        def put(leaf: Leaf) -> None:
            texts = [str(v) for v in leaf.values]
            if leaf.op in ("lt", "le", "gt", "ge"):
                at = 1 if leaf.op in ("lt", "le") else 0
                for p in out:  # a range with both sides is one filter
                    if p["column"] == leaf.column and p["op"] == "lt" and p["values"][at] is None:
                        p["values"][at] = texts[0]
                        return
                out.append({"column": leaf.column, "op": "lt", "values": [None, texts[0]] if at else [texts[0], None]})
            elif leaf.op == "between":
                out.append({"column": leaf.column, "op": "lt", "values": texts})
            elif leaf.op == "null":
                out.append({"column": leaf.column, "op": "in", "values": ["NULL"]})
            elif leaf.op in ("eq", "ne", "in", "not_in", "like", "not_like", "ilike", "not_ilike"):
                out.append({"column": leaf.column, "op": leaf.op.replace("ilike", "like"), "values": texts})

        def walk(nodes: tuple) -> None:
            for node in nodes:
                if isinstance(node, Any):
                    for branch in node.branches:
                        walk(branch)
                else:
                    put(node)

        walk(self.where)
        return out


def _number(text: str) -> int | float:
    return int(text) if text.lstrip("+-").isdigit() else float(text)


def _lex(sql: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = sql.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise UnsupportedQuery(f"cannot read {text[at:at + 20]!r}")
        at = m.end()
        quoted, number, name, sign = m.groups()
        if quoted is not None:
            out.append(("str", quoted[1:-1].replace(quoted[0] * 2, quoted[0])))
        elif number is not None:
            out.append(("num", _number(number)))
        elif name is not None:
            out.append(("name", name))
        else:
            out.append(("sign", sign))
    while out and out[-1] == ("sign", ";"):
        out.pop()
    return out


class _Reader:
    def __init__(self, tokens: list[tuple[str, object]]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> tuple[str, object]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "name" and text.lower() in words

    def sign(self, *signs: str) -> bool:
        kind, text = self.peek()
        return kind == "sign" and text in signs

    def take(self) -> tuple[str, object]:
        token = self.peek()
        self.at += 1
        return token

    def expect(self, text: str) -> None:
        kind, got = self.take()
        if kind == "str" or str(got).lower() != text:
            raise UnsupportedQuery(f"{text!r} expected, not {got!r}")


def parse(sql: str) -> Parsed:
    """The parts of one query; anything outside the grammar is refused."""
    r = _Reader(_lex(sql))
    r.expect("select")
    select = []
    while not r.word("from"):
        if r.peek()[0] == "end":
            raise UnsupportedQuery("no FROM")
        select.append(str(r.take()[1]))
    r.take()
    out = Parsed(" ".join(select))
    while True:
        kind, name = r.take()
        if kind != "name":
            raise UnsupportedQuery(f"a table expected, not {name!r}")
        if r.word("as"):
            r.take()
        alias = r.take()[1] if r.peek()[0] == "name" and not r.word("where", *_TAIL) else name
        if alias.lower() in out.tables:
            raise UnsupportedQuery(f"alias {alias!r} twice")
        out.tables[alias.lower()] = name.lower()
        if not r.sign(","):
            break
        r.take()
    if r.word("where"):
        r.take()
        out.where = _disjunction(r, out, top=True)
    if r.peek()[0] != "end":
        if not r.word(*_TAIL):
            raise UnsupportedQuery(f"unexpected {r.peek()[1]!r}")
        out.tail = " ".join(str(text) for _, text in r.tokens[r.at :])
    return out


def _disjunction(r: _Reader, out: Parsed, top: bool = False) -> tuple:
    """A conjunction of nodes; several joined by OR are one node. Join conditions may stand only under AND."""
    branches, known = [], len(out.edges)
    branches.append(_conjunction(r, out))
    while r.word("or"):
        r.take()
        branches.append(_conjunction(r, out))
    if len(branches) == 1:
        return branches[0]
    if len(out.edges) > known:
        raise UnsupportedQuery("a join condition under OR")
    return (Any(tuple(branches)),)


def _conjunction(r: _Reader, out: Parsed) -> tuple:
    nodes: list = []
    while True:
        negated = False
        while r.word("not"):
            r.take()
            negated = not negated
        known = len(out.edges)
        if r.sign("(") and not _bracketed_operand(r):
            r.take()
            inner = _disjunction(r, out)
            r.expect(")")
        else:
            inner = _condition(r, out)
        if negated:
            if len(out.edges) > known or len(inner) != 1 or isinstance(inner[0], Any) or inner[0].op not in _NEGATED:
                raise UnsupportedQuery("NOT before more than one filter")
            inner = (Leaf(inner[0].column, _NEGATED[inner[0].op], inner[0].values, inner[0].cast),)
        nodes += inner
        if not r.word("and"):
            return tuple(nodes)
        r.take()


def _bracketed_operand(r: _Reader) -> bool:
    """Brackets around a column alone, which are no group of conditions."""
    return r.peek(1)[0] in ("name", "num", "str") and r.peek(2) == ("sign", ")")


def _operand(r: _Reader) -> tuple[str, object, str | None]:
    """(kind, text or value, cast)."""
    if r.sign("(") and _bracketed_operand(r):
        r.take()
        kind, text, cast = _operand(r)
        r.expect(")")
    else:
        minus = r.sign("-")
        if r.sign("-", "+"):
            r.take()
            if r.peek()[0] != "num":
                raise UnsupportedQuery("a sign before something that is no number")
        kind, text = r.take()
        text, cast = -text if minus else text, None
    if kind not in ("str", "num", "name") or (kind == "name" and r.sign("(")):
        raise UnsupportedQuery(f"unexpected {text!r}")
    while r.sign("::"):
        r.take()
        cast = str(r.take()[1]).lower()
    if r.sign("+", "-", "*"):
        raise UnsupportedQuery("arithmetic")
    return kind, text, cast


def _value(r: _Reader) -> object:
    kind, text, _ = _operand(r)
    if kind == "name":
        raise UnsupportedQuery(f"a value expected, not {text!r}")
    return text


def _condition(r: _Reader, out: Parsed) -> tuple:
    kind, column, cast = _operand(r)
    negated = False
    if r.word("not"):
        r.take()
        negated = True
    op_kind, op = r.take()
    op = str(op).lower() if op_kind in ("name", "sign") else ""
    if op not in ("=", "!=", "<>", "<", "<=", ">", ">=", "~", "!~") and kind != "name":
        raise UnsupportedQuery(f"a column expected, not {column!r}")
    name = column.lower() if kind == "name" else column
    if op == "in":
        r.expect("(")
        values = [_value(r)]
        while r.sign(","):
            r.take()
            values.append(_value(r))
        r.expect(")")
        return (Leaf(name, "not_in" if negated else "in", tuple(values), cast),)
    if op in ("like", "ilike"):
        return (Leaf(name, f"not_{op}" if negated else op, (_value(r),), cast),)
    if op == "between":
        low = _value(r)
        r.expect("and")
        return (Leaf(name, "not_between" if negated else "between", (low, _value(r)), cast),)
    if op == "is" and not negated:
        positive = not r.word("not")
        if not positive:
            r.take()
        r.expect("null")
        return (Leaf(name, "null" if positive else "not_null", (), cast),)
    if op not in _SIGNS or negated:
        raise UnsupportedQuery(f"unknown operator {op!r}")
    other_kind, other, other_cast = _operand(r)
    if kind == "name" and other_kind == "name":
        return _between_columns(out, name, op, str(other).lower(), cast or other_cast)
    if kind != "name":
        if other_kind != "name" or "~" in op:
            raise UnsupportedQuery("a comparison without a column")
        name, other, cast, op = str(other).lower(), column, other_cast, _MIRRORED.get(op, op)
    return (Leaf(name, _SIGNS[op], (other,), cast),)


def _between_columns(out: Parsed, left: str, op: str, right: str, cast: str | None) -> tuple:
    a, b = left.split("."), right.split(".")
    if len(a) == len(b) == 2 and a[0] != b[0]:
        if op not in ("=", "!=", "<>") or cast:
            raise UnsupportedQuery(f"join by {op!r}")
        out.edges.append(Edge(a[0], a[1], b[0], b[1], "=" if op == "=" else "!="))
        return ()
    if cast or "~" in op or len(a) != len(b):
        raise UnsupportedQuery("columns compared through a cast or a pattern")
    return (Leaf(left, f"{_SIGNS[op]}_column", (b[-1],)),)


def _predicate(node: Leaf | Any, tables: dict[str, str]) -> tuple[str, Predicate]:
    """(alias, filter) of a node; all columns of a group must be of one alias."""
    if isinstance(node, Any):
        inner = [[_predicate(n, tables) for n in branch] for branch in node.branches]
        aliases = {alias for branch in inner for alias, _ in branch}
        if len(aliases) != 1:
            raise UnsupportedQuery("an OR group over several tables")
        branches = tuple(tuple(p for _, p in branch) for branch in inner)
        return aliases.pop(), Predicate(branches[0][0].column, "any", branches)
    alias, _, column = node.column.rpartition(".")
    if not alias:
        if len(tables) > 1:
            raise UnsupportedQuery(f"column {column!r} without its table")
        alias = next(iter(tables))
    if alias not in tables:
        raise UnsupportedQuery(f"unknown alias {alias!r}")
    return alias, Predicate(column, node.op, node.values, node.cast)


def to_query(sql: str, qid: str) -> JoinQuery:
    """The query as data: every filter with its own operator, OR groups within one table. What cannot be said is refused."""
    parsed = parse(sql)
    if parsed.tail:
        raise UnsupportedQuery(f"not a plain join: {parsed.tail}")
    preds: dict[str, list[Predicate]] = {}
    for node in without_guards(parsed.where):
        alias, predicate = _predicate(node, parsed.tables)
        preds.setdefault(alias, []).append(predicate)
    for e in parsed.edges:
        if e.a not in parsed.tables or e.b not in parsed.tables:
            raise UnsupportedQuery(f"unknown alias in {e.sql()}")
    edges = tuple(dict.fromkeys(parsed.edges))
    return JoinQuery(qid, parsed.tables, edges, {a: tuple(p) for a, p in preds.items()})


def without_guards(nodes: tuple) -> tuple:
    """Nodes without the patterns that only guard a cast of the same column: casts give null where they fail."""
    cast = {n.column for n in nodes if isinstance(n, Leaf) and n.cast}
    return tuple(n for n in nodes if not (isinstance(n, Leaf) and n.op == "match" and n.column in cast and n.values == (_NUMERIC_GUARD,)))


def split_statements(text: str) -> list[str]:
    """SELECT statements of a script, cut at semicolons outside quotes; USE and other statements are skipped."""
    parts = [""]
    for piece in re.findall(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|;|[^'";]+|['"]""", text):
        if piece == ";":
            parts.append("")
        else:
            parts[-1] += piece
    return [s for s in map(str.strip, parts) if s.lower().startswith("select")]
