"""A SELECT subset as plans.

    SELECT * | column | COUNT(*) | COUNT/SUM/MIN/MAX/AVG(column) [[AS] name], ...
    FROM collection [[INNER] JOIN | LEFT [OUTER] JOIN collection ON a = b]
    [WHERE predicate] [GROUP BY column, ...] [ORDER BY column [ASC|DESC], ...] [LIMIT n]

Predicates: comparisons, AND, OR, NOT, parentheses, [NOT] IN, [NOT] LIKE, IS [NOT] NULL. The order of operators is fixed: join, filter, aggregate or project, sort, limit; so ORDER BY sees what SELECT
left. With aggregates, plain columns in the list are ignored: the output is the GROUP BY columns and the aggregates. A qualified name is the field of that dotted name, which only a join's output has.
"""

from __future__ import annotations

import re
from decimal import Decimal  # noqa: F401  (literals of callers)

from facet.functions.expr import And, Compare, Expr, Field, In, IsNotNull, IsNull, Like, Lit, Not, Or

from .logical import AGGREGATES, Agg, Op, SortKey, default_output, scan


class SqlError(ValueError):
    def __init__(self, message: str, at: int | None = None):
        super().__init__(message if at is None else f"{message} (at {at})")
        self.at = at


REFUSED = ("insert", "update", "delete", "create", "drop", "alter", "with")
RESERVED = {"select", "from", "where", "group", "by", "order", "limit", "join", "left", "inner", "outer", "on", "and", "or", "not", "in", "like", "is", "null", "as", "asc", "desc"}
TOKEN = re.compile(r"(?P<skip>\s+|--[^\n]*)|(?P<text>'(?:[^']|'')*')|(?P<number>\d+\.\d+|\d+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<symbol><=|>=|<>|!=|[=<>(),.*;])")


class Cursor:
    def __init__(self, sql: str):
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(sql):
            m = TOKEN.match(sql, at)
            if not m:
                raise SqlError("unterminated string" if sql[at] == "'" else f"unexpected character {sql[at]!r}", at)
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group(), at))
            at = m.end()
        if self.tokens and self.tokens[-1][1] == ";":
            self.tokens.pop()
        self.k, self.end = 0, len(sql)

    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        return self.tokens[self.k + ahead] if self.k + ahead < len(self.tokens) else ("end", "", self.end)

    def take(self) -> tuple[str, str, int]:
        t = self.peek()
        self.k += 1
        return t

    def eat(self, *words: str) -> bool:
        """Takes the words, or symbols, if they come next."""
        for j, w in enumerate(words):
            kind, s, _ = self.peek(j)
            if kind not in ("word", "symbol") or s.lower() != w:
                return False
        self.k += len(words)
        return True

    def need(self, word: str) -> None:
        if not self.eat(word):
            raise SqlError(f"expected {word.upper()}", self.peek()[2])

    def name(self) -> str:
        kind, s, at = self.take()
        if kind != "word" or s.lower() in RESERVED:
            raise SqlError("expected a name", at)
        return s

    def column(self) -> str:
        parts = [self.name()]
        while self.eat("."):
            parts.append(self.name())
        return ".".join(parts)

    def listed(self, one) -> list:
        out = [one()]
        while self.eat(","):
            out.append(one())
        return out


def parse(sql: str) -> Op:
    c = Cursor(sql)
    first = c.peek()[1].lower()
    if first in REFUSED:
        raise SqlError(f"{first.upper()} is not supported; only SELECT is", c.peek()[2])
    c.need("select")
    items = c.listed(lambda: _item(c))
    c.need("from")
    plan = _from(c)
    if c.eat("where"):
        plan = plan.filter(_any(c))
    group = c.listed(c.column) if c.eat("group", "by") else []
    plan = _selected(plan, items, group)
    if c.eat("order", "by"):
        plan = plan.sort(*c.listed(lambda: _key(c)))
    if c.eat("limit"):
        kind, s, at = c.take()
        if kind != "number" or "." in s:
            raise SqlError("LIMIT needs a whole number that is not negative", at)
        plan = plan.limit(int(s))
    if c.peek()[0] != "end":
        raise SqlError("unexpected trailing input", c.peek()[2])
    return plan


def _item(c: Cursor) -> str | Agg:
    if c.eat("*"):
        return "*"
    kind = c.peek()[1].lower()
    if kind not in AGGREGATES or c.peek(1)[1] != "(":
        return "." + c.column()
    c.take()
    c.need("(")
    field = None if c.eat("*") else c.column()
    at = c.peek()[2]
    c.need(")")
    if field is None and kind != "count":
        raise SqlError(f"{kind.upper()}(*) has no meaning; name a column", at)
    named = c.eat("as") or (c.peek()[0] == "word" and c.peek()[1].lower() not in RESERVED)
    return Agg(kind, field, c.name() if named else default_output(kind, field))


def _from(c: Cursor) -> Op:
    plan: Op = scan(c.name())
    joins = 0
    while True:
        if c.eat("left"):
            c.eat("outer")
            kind = "left"
            c.need("join")
        elif c.eat("inner"):
            kind = "inner"
            c.need("join")
        elif c.eat("join"):
            kind = "inner"
        else:
            return plan
        joins += 1
        if joins > 1:
            raise SqlError("only one JOIN per query is supported", c.peek()[2])
        right = c.name()
        c.need("on")
        a = c.column()
        c.need("=")
        b = c.column()
        plan = plan.join(scan(right), kind, (a.split(".")[-1], b.split(".")[-1]))


def _selected(plan: Op, items: list, group: list[str]) -> Op:
    aggs = [x for x in items if isinstance(x, Agg)]
    if group and not aggs:
        raise SqlError("GROUP BY needs an aggregate")
    if aggs:
        return plan.aggregate(group, *aggs)
    return plan if "*" in items else plan.project(*[x[1:] for x in items])


def _key(c: Cursor) -> SortKey:
    field = c.column()
    if c.eat("desc"):
        return SortKey(field, True)
    c.eat("asc")
    return SortKey(field)


def _any(c: Cursor) -> Expr:
    parts = [_all(c)]
    while c.eat("or"):
        parts.append(_all(c))
    return parts[0] if len(parts) == 1 else Or(tuple(parts))


def _all(c: Cursor) -> Expr:
    parts = [_not(c)]
    while c.eat("and"):
        parts.append(_not(c))
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def _not(c: Cursor) -> Expr:
    return Not(_not(c)) if c.eat("not") else _test(c)


def _test(c: Cursor) -> Expr:
    if c.eat("("):
        inner = _any(c)
        c.need(")")
        return inner
    left = _value(c)
    if c.eat("is"):
        no = c.eat("not")
        c.need("null")
        return IsNotNull(left) if no else IsNull(left)
    at = c.peek()[2]
    negated = c.eat("not")
    if c.eat("in"):
        c.need("(")
        out: Expr = In(left, tuple(c.listed(lambda: _value(c))))
        c.need(")")
    elif c.eat("like"):
        kind, s, at = c.take()
        if kind != "text":
            raise SqlError("LIKE needs a string pattern", at)
        out = Like(left, s[1:-1].replace("''", "'"))
    elif negated:
        raise SqlError("NOT must be followed by IN or LIKE here", at)
    else:
        _, op, at = c.take()
        if op not in ("=", "!=", "<>", "<", "<=", ">", ">="):
            raise SqlError("expected a comparison, IS NULL, IN or LIKE", at)
        return Compare("!=" if op == "<>" else op, left, _value(c))
    return Not(out) if negated else out


def _value(c: Cursor) -> Expr:
    kind, s, at = c.peek()
    if kind == "text":
        c.take()
        return Lit(s[1:-1].replace("''", "'"))
    if kind == "number":
        c.take()
        return Lit(float(s) if "." in s else int(s))
    if kind == "word":
        if s.lower() in ("null", "true", "false"):
            c.take()
            return Lit({"null": None, "true": True, "false": False}[s.lower()])
        return Field(c.column())
    raise SqlError("expected a value or column", at)
