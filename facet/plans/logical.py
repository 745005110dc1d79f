"""The nine logical operators, their builders, and the shape and key of a plan."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

from facet.functions.expr import Expr, Lit

AGGREGATES = ("count", "sum", "min", "max", "avg")


@dataclass(frozen=True)
class Agg:
    """kind over a field, or over rows for count with no field."""

    kind: str
    field: str | None
    output: str

    def __post_init__(self):
        if self.kind not in AGGREGATES:
            raise ValueError(f"no aggregate {self.kind!r}")
        if self.field is None and self.kind != "count":
            raise ValueError(f"{self.kind}(*) has no meaning; name a field")


def count(field: str | None = None, output: str | None = None) -> Agg:
    return Agg("count", field, output or default_output("count", field))


def over(kind: str, field: str, output: str | None = None) -> Agg:
    return Agg(kind, field, output or default_output(kind, field))


def default_output(kind: str, field: str | None) -> str:
    return f"{kind}_star" if field is None else f"{kind}_{field.replace('.', '_')}"


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False


class Op:
    """Builders: scan("c").filter(...).project("a").sort("a", SortKey("b", True)).limit(3)."""

    def filter(self, predicate: Expr) -> Filter:
        return Filter(self, predicate)

    def project(self, *fields: str) -> Project:
        return Project(self, tuple(fields))

    def sort(self, *keys: str | SortKey) -> Sort:
        return Sort(self, tuple(k if isinstance(k, SortKey) else SortKey(k) for k in keys))

    def limit(self, n: int) -> Limit:
        if n < 0:
            raise ValueError("a limit is not negative")
        return Limit(self, n)

    def aggregate(self, group_by, *aggs: Agg) -> Aggregate:
        return Aggregate(self, tuple(group_by), tuple(aggs))

    def join(self, right: Op, kind: str, on: tuple[str, str]) -> Join:
        if kind not in ("inner", "left"):
            raise ValueError(f"no join of kind {kind!r}")
        return Join(self, right, kind, tuple(on))

    def inputs(self) -> tuple[Op, ...]:
        return tuple(getattr(self, n) for n in ("input", "left", "right") if hasattr(self, n))

    def walk(self) -> Iterator[Op]:
        yield self
        for x in self.inputs():
            yield from x.walk()

    def collections(self) -> list[str]:
        return [x.collection for x in self.walk() if hasattr(x, "collection")]

    def line(self, literals: bool = True) -> str:
        raise NotImplementedError

    def explain(self, depth: int = 0) -> str:
        return "\n".join(["  " * depth + self.line(), *(x.explain(depth + 1) for x in self.inputs())])

    def _text(self, literals: bool) -> str:
        return self.line(literals) + "(" + ",".join(x._text(literals) for x in self.inputs()) + ")"

    def shape(self) -> str:
        """The same for queries that differ in literals, ids or limits alone."""
        return hashlib.sha256(self._text(False).encode()).hexdigest()[:16]

    def key(self) -> str:
        return hashlib.sha256(self._text(True).encode()).hexdigest()

    def required_fields(self) -> set[str] | None:
        """Fields that a query over one collection reads; None for all."""
        return _required(self, None)


def _required(op: Op, above: set[str] | None) -> set[str] | None:
    if isinstance(op, Project):
        return _required(op.input, set(op.fields) if above is None else set(op.fields) & above)
    if isinstance(op, Aggregate):
        return _required(op.input, set(op.group_by) | {a.field for a in op.aggs if a.field})
    if isinstance(op, Filter):
        return None if (x := _required(op.input, None if above is None else above | op.predicate.fields())) is None else x
    if isinstance(op, Sort):
        return _required(op.input, None if above is None else above | {k.field for k in op.keys})
    if isinstance(op, Limit):
        return _required(op.input, above)
    return None if isinstance(op, Join) else above


@dataclass(frozen=True)
class GetById(Op):
    collection: str
    id: int

    def line(self, literals=True):
        return f"GetById {self.collection} {self.id if literals else '?'}"


@dataclass(frozen=True)
class GetByIds(Op):
    collection: str
    ids: tuple[int, ...]

    def line(self, literals=True):
        return f"GetByIds {self.collection} {sorted(set(self.ids)) if literals else '?'}"


@dataclass(frozen=True)
class Scan(Op):
    collection: str

    def line(self, literals=True):
        return f"Scan {self.collection}"


@dataclass(frozen=True)
class Filter(Op):
    input: Op
    predicate: Expr

    def line(self, literals=True):
        return f"Filter {self.predicate.text(literals)}"


@dataclass(frozen=True)
class Project(Op):
    input: Op
    fields: tuple[str, ...]

    def line(self, literals=True):
        return f"Project {', '.join(dict.fromkeys(self.fields))}"


@dataclass(frozen=True)
class Sort(Op):
    input: Op
    keys: tuple[SortKey, ...]

    def line(self, literals=True):
        return "Sort " + ", ".join(k.field + (" desc" if k.descending else "") for k in self.keys)


@dataclass(frozen=True)
class Limit(Op):
    input: Op
    n: int

    def line(self, literals=True):
        return f"Limit {self.n if literals else '?'}"


@dataclass(frozen=True)
class Aggregate(Op):
    input: Op
    group_by: tuple[str, ...]
    aggs: tuple[Agg, ...]

    def line(self, literals=True):
        return f"Aggregate by [{', '.join(self.group_by)}]: " + ", ".join(f"{a.kind}({a.field or '*'}) as {a.output}" for a in self.aggs)


@dataclass(frozen=True)
class Join(Op):
    left: Op
    right: Op
    kind: str
    on: tuple[str, str]

    def line(self, literals=True):
        return f"Join {self.kind} on {self.on[0]} = {self.on[1]}"


def scan(collection: str) -> Scan:
    return Scan(collection)


def get(collection: str, id: int) -> GetById:
    return GetById(collection, id)


def get_many(collection: str, ids) -> GetByIds:
    return GetByIds(collection, tuple(ids))


def query_spec(collection: str, field: str | None = None, op: str = "=", value=None, limit: int | None = None) -> Op:
    """The smallest useful query: one comparison and a limit."""
    from facet.functions.expr import Compare, Field

    out: Op = scan(collection)
    if field is not None:
        out = out.filter(Compare(op, Field(field), Lit(value)))
    return out if limit is None else out.limit(limit)


def with_input(op: Op, new: Op) -> Op:
    return replace(op, input=new)
