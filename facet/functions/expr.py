"""Expressions and their compilation to Spark columns.

Values of different kinds are ordered by rank (null, bool, number, text, bytes, list, map, time), and comparing them has a definite answer; comparing with null has none. Kinds are known from the
schema, so that a comparison across ranks is folded to a constant before Spark could cast anything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = {"null": 0, "bool": 1, "number": 2, "text": 3, "bytes": 4, "list": 5, "map": 6, "time": 7}
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")


class Expr:
    """Base of all expressions; operators build trees: (f("age") >= 3) & ~f("name").like("a%")."""

    predicate = False

    def __eq__(self, other):
        return Compare("=", self, wrap(other))

    def __ne__(self, other):
        return Compare("!=", self, wrap(other))

    def __lt__(self, other):
        return Compare("<", self, wrap(other))

    def __le__(self, other):
        return Compare("<=", self, wrap(other))

    def __gt__(self, other):
        return Compare(">", self, wrap(other))

    def __ge__(self, other):
        return Compare(">=", self, wrap(other))

    def __add__(self, other):
        return Arith("+", self, wrap(other))

    def __sub__(self, other):
        return Arith("-", self, wrap(other))

    def __mul__(self, other):
        return Arith("*", self, wrap(other))

    def __truediv__(self, other):
        return Arith("/", self, wrap(other))

    def __and__(self, other):
        return And((self, other))

    def __or__(self, other):
        return Or((self, other))

    def __invert__(self):
        return Not(self)

    def __hash__(self):
        return id(self)

    def is_null(self):
        return IsNull(self)

    def is_not_null(self):
        return IsNotNull(self)

    def isin(self, *items):
        return In(self, tuple(wrap(x) for x in items))

    def like(self, pattern: str):
        return Like(self, pattern)

    def parts(self) -> tuple[Expr, ...]:
        return ()

    def fields(self) -> set[str]:
        return set().union(*(p.fields() for p in self.parts()))

    def text(self, literals: bool = True) -> str:
        """Canonical text; without literals it is the same for every query of one shape."""
        raise NotImplementedError


def wrap(x) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def f(name: str) -> Field:
    return Field(name)


@dataclass(eq=False)
class Lit(Expr):
    value: object

    def text(self, literals=True):
        return repr(self.value) if literals else "?"


@dataclass(eq=False)
class Field(Expr):
    name: str

    def fields(self):
        return {self.name}

    def text(self, literals=True):
        return f"[{self.name}]"


@dataclass(eq=False)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr
    predicate = True

    def parts(self):
        return (self.left, self.right)

    def text(self, literals=True):
        return f"({self.left.text(literals)} {self.op} {self.right.text(literals)})"


@dataclass(eq=False)
class And(Expr):
    items: tuple
    predicate = True

    def parts(self):
        return tuple(self.items)

    def text(self, literals=True):
        return "(" + " and ".join(x.text(literals) for x in self.items) + ")" if self.items else "true"


@dataclass(eq=False)
class Or(Expr):
    items: tuple
    predicate = True

    def parts(self):
        return tuple(self.items)

    def text(self, literals=True):
        return "(" + " or ".join(x.text(literals) for x in self.items) + ")" if self.items else "false"


@dataclass(eq=False)
class Not(Expr):
    item: Expr
    predicate = True

    def parts(self):
        return (self.item,)

    def text(self, literals=True):
        return f"not {self.item.text(literals)}"


@dataclass(eq=False)
class IsNull(Expr):
    item: Expr
    predicate = True

    def parts(self):
        return (self.item,)

    def text(self, literals=True):
        return f"{self.item.text(literals)} is null"


@dataclass(eq=False)
class IsNotNull(Expr):
    item: Expr
    predicate = True

    def parts(self):
        return (self.item,)

    def text(self, literals=True):
        return f"{self.item.text(literals)} is not null"


@dataclass(eq=False)
class Arith(Expr):
    op: str
    left: Expr
    right: Expr

    def parts(self):
        return (self.left, self.right)

    def text(self, literals=True):
        return f"({self.left.text(literals)} {self.op} {self.right.text(literals)})"


@dataclass(eq=False)
class In(Expr):
    item: Expr
    options: tuple
    predicate = True

    def parts(self):
        return (self.item, *self.options)

    def text(self, literals=True):
        inner = ", ".join(x.text(literals) for x in self.options)
        return f"{self.item.text(literals)} in ({inner})"


@dataclass(eq=False)
class Like(Expr):
    item: Expr
    pattern: str
    predicate = True

    def parts(self):
        return (self.item,)

    def text(self, literals=True):
        return f"{self.item.text(literals)} like {self.pattern!r}" if literals else f"{self.item.text(literals)} like ?"


# --- kinds of Spark types ---------------------------------------------------------------------------------------------


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, (T.MapType, T.StructType)):
        return "map"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    raise TypeError(f"no kind for {t.simpleString()}")


@dataclass
class Value:
    """A compiled value. Exact numbers are whole units of 10**-scale in `exact` (null where they overflowed), with the same value as a
    double in `column`; everything else is in `column` alone."""

    kind: str
    column: Column
    exact: Column | None = None
    scale: int = 0
    simple: bool = True  # a plain column or literal: compared as it is, so that Spark can push it into the scan

    @property
    def rank(self) -> int:
        return RANKS[self.kind]


UNITS = T.DecimalType(38, 0)


def null_value() -> Value:
    return Value("null", F.lit(None))


def literal(x) -> Value:
    if x is None:
        return null_value()
    if isinstance(x, bool):
        return Value("bool", F.lit(x))
    if isinstance(x, int):
        col = F.lit(x) if -(2**63) <= x < 2**63 else F.lit(Decimal(x))
        return Value("number", col, F.lit(x).cast(UNITS) if -(2**63) <= x < 2**63 else F.lit(Decimal(x)).cast(UNITS), 0)
    if isinstance(x, Decimal):
        scale = max(0, -x.as_tuple().exponent)
        return Value("number", F.lit(x), F.lit(x.scaleb(scale)).cast(UNITS), scale)
    if isinstance(x, (bytes, bytearray)):
        return Value("bytes", F.lit(bytes(x)))
    if isinstance(x, str):
        return Value("text", F.lit(x))
    if isinstance(x, (list, tuple)):
        return Value("list", F.array(*[F.lit(v) for v in x]))
    if isinstance(x, dict):
        return Value("map", _ordered_map(F.create_map(*[F.lit(v) for kv in x.items() for v in kv])))
    if isinstance(x, float):
        return Value("number", F.lit(x))
    return Value("time", F.lit(x))


def _ordered_map(c: Column) -> Column:
    """Maps have no order in Spark; their sorted entries do."""
    return F.array_sort(F.map_entries(c))


def column_value(c: Column, t: T.DataType) -> Value:
    kind = kind_of(t)
    if isinstance(t, T.IntegralType):
        return Value(kind, c, c.cast(UNITS), 0)
    if isinstance(t, T.DecimalType):
        return Value(kind, c, (c * F.lit(Decimal(10) ** t.scale)).cast(UNITS) if t.scale else c.cast(UNITS), t.scale)
    if isinstance(t, T.MapType):
        return Value(kind, _ordered_map(c))
    return Value(kind, c)


# --- compilation ------------------------------------------------------------------------------------------------------


@dataclass
class Scope:
    """Fields by name: a Spark column and its type. A name that isn't there is absent, which is null."""

    columns: dict[str, tuple[Column, T.DataType]] = field(default_factory=dict)

    def value(self, e: Expr) -> Value:
        if isinstance(e, Lit):
            return literal(e.value)
        if isinstance(e, Field):
            got = self.columns.get(e.name)
            return column_value(*got) if got else null_value()
        if isinstance(e, Arith):
            return self._arith(e)
        return null_value()  # a predicate has no value

    def _arith(self, e: Arith) -> Value:
        a, b = self.value(e.left), self.value(e.right)
        if a.kind != "number" or b.kind != "number":
            return null_value()
        x, y = a.column.cast("double"), b.column.cast("double")
        if e.op == "/":
            approx = F.when(y != 0, x / F.when(y != 0, y))
        else:
            approx = {"+": x + y, "-": x - y, "*": x * y}[e.op]
        approx = F.when(~F.isnan(approx) & (F.abs(approx) != float("inf")), approx)
        if a.exact is None or b.exact is None:
            return Value("number", approx, simple=False)
        s = max(a.scale, b.scale)
        lift = lambda v: F.try_multiply(v.exact, F.lit(Decimal(10) ** (s - v.scale)).cast(UNITS)).cast(UNITS) if s > v.scale else v.exact
        u, v = lift(a), lift(b)
        one = F.lit(Decimal(10) ** s).cast(UNITS)
        # quotients are cut towards zero; Spark's own division would round or wrap
        cut = lambda n, d: F.when(d != 0, (n - n % F.when(d != 0, d)) / F.when(d != 0, d)).cast(UNITS)
        if e.op == "+":
            exact = F.try_add(u, v)
        elif e.op == "-":
            exact = F.try_subtract(u, v)
        elif e.op == "*":
            exact = F.try_multiply(u, v).cast(UNITS)
            exact = cut(exact, one) if s else exact
        else:
            exact = cut(F.try_multiply(u, one).cast(UNITS) if s else u, v)
        exact = exact.cast(UNITS)
        return Value("number", F.coalesce(exact.cast("double") / float(10**s), approx), exact, s, simple=False)

    def predicate(self, e: Expr) -> Column:
        """A boolean column: true, false, or null for unknown."""
        unknown = F.lit(None).cast("boolean")
        if isinstance(e, (Lit, Field, Arith)):
            v = self.value(e)
            return v.column if v.kind == "bool" else unknown
        if isinstance(e, Compare):
            return self._compare(e.op, self.value(e.left), self.value(e.right))
        if isinstance(e, And):
            return reduce(lambda a, b: a & b, map(self.predicate, e.items), F.lit(True)) if len(e.items) != 1 else self.predicate(e.items[0])
        if isinstance(e, Or):
            return reduce(lambda a, b: a | b, map(self.predicate, e.items), F.lit(False)) if len(e.items) != 1 else self.predicate(e.items[0])
        if isinstance(e, Not):
            return ~self.predicate(e.item)
        if isinstance(e, IsNull):
            return F.lit(True) if e.item.predicate else self.value(e.item).column.isNull()
        if isinstance(e, IsNotNull):
            return F.lit(False) if e.item.predicate else self.value(e.item).column.isNotNull()
        if isinstance(e, In):
            item = self.value(e.item)
            if item.kind == "null":
                return unknown
            options = [self.value(x) for x in e.options]
            alike = all(isinstance(x, Lit) for x in e.options) and all(o.kind in (item.kind, "null") for o in options) and item.simple
            if alike and options:
                return item.column.isin([x.value for x in e.options])
            found = reduce(lambda a, b: a | b, [self._compare("=", item, o) for o in options], F.lit(False))
            return F.when(item.column.isNotNull(), found)
        if isinstance(e, Like):
            v = self.value(e.item)
            return v.column.like(like_pattern(e.pattern)) if v.kind == "text" else unknown
        raise TypeError(f"not an expression: {e!r}")

    def _compare(self, op: str, a: Value, b: Value) -> Column:
        if "null" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        if a.rank != b.rank:
            known = {"=": False, "!=": True, "<": a.rank < b.rank, "<=": a.rank < b.rank, ">": a.rank > b.rank, ">=": a.rank > b.rank}[op]
            return F.when(a.column.isNotNull() & b.column.isNotNull(), F.lit(known))
        if a.kind == "number" and not (a.simple and b.simple) and a.exact is not None and b.exact is not None:
            s = max(a.scale, b.scale)
            lift = lambda v: F.try_multiply(v.exact, F.lit(Decimal(10) ** (s - v.scale)).cast(UNITS)).cast(UNITS) if s > v.scale else v.exact
            x, y = lift(a), lift(b)
            return F.when(x.isNotNull() & y.isNotNull(), _spark_compare(op, x, y)).otherwise(_spark_compare(op, a.column.cast("double"), b.column.cast("double")))
        return _spark_compare(op, a.column, b.column)


def _spark_compare(op: str, x: Column, y: Column) -> Column:
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def like_pattern(pattern: str) -> str:
    r"""A pattern in which \x is x for any x and a trailing \ is itself, in Spark's terms, which allow \%, \_ and \\ alone."""
    out = []
    for token in re.findall(r"\\.|.", pattern, re.S):
        if len(token) == 2:
            out.append("\\" + token[1] if token[1] in "%_\\" else token[1])
        else:
            out.append("\\\\" if token == "\\" else token)
    return "".join(out)


def conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return [y for x in e.items for y in conjuncts(x)] if isinstance(e, And) else [e]


def pinned(e: Expr | None) -> dict[str, object]:
    """Fields that a predicate holds equal to a literal, through AND alone."""
    out = {}
    for x in conjuncts(e):
        if isinstance(x, Compare) and x.op == "=":
            a, b = (x.left, x.right) if isinstance(x.left, Field) else (x.right, x.left)
            if isinstance(a, Field) and isinstance(b, Lit) and b.value is not None:
                out[a.name] = b.value
    return out


def ranged(e: Expr | None) -> set[str]:
    """Fields that a predicate bounds by literals, through AND alone."""
    out = set()
    for x in conjuncts(e):
        if isinstance(x, Compare) and x.op in ("<", "<=", ">", ">="):
            a, b = (x.left, x.right) if isinstance(x.left, Field) else (x.right, x.left)
            if isinstance(a, Field) and isinstance(b, Lit):
                out.add(a.name)
    return out
