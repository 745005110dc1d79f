"""The relational operators over Rel: a DataFrame with its visible fields, hidden id columns and the order its rows have.

No operator sorts. Each says what order its output has, and one sort at the root (or below a limit, where Spark makes it a top-k) realises it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facet.functions.expr import RANKS, Expr, Scope, column_value, kind_of
from facet.plans.logical import Agg, SortKey

ID = "_id"


class Unsupported(Exception):
    """A query that the engine refuses."""


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Key:
    """A column to order by; nulls_first as it stands, direction included."""

    name: str
    descending: bool = False
    nulls_first: bool = False

    def column(self) -> Column:
        c = quoted(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    fields: tuple[str, ...]
    ids: tuple[str, ...]  # hidden columns, in order, that break ties
    order: tuple[Key, ...]
    explicit_nulls: bool = False  # nulls made by an aggregate are values of the lowest rank; others are absent
    exact_sums: int | None = None  # sums of doubles by way of decimals of this scale, the same in any order
    absent: frozenset[str] = field(default_factory=frozenset)

    def scope(self) -> Scope:
        types = {f.name: f.dataType for f in self.df.schema.fields}
        return Scope({f: (quoted(f), types[f]) for f in self.fields if f not in self.absent})

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType


def base(df: DataFrame, exact_sums: int | None = None) -> Rel:
    """A collection's rows: ascending by id."""
    return Rel(df, tuple(c for c in df.columns if c != ID), (ID,), (Key(ID),), exact_sums=exact_sums)


def by_ids(rel: Rel, ids: tuple[int, ...], broadcast_from: int = 1000) -> Rel:
    """Rows of the given ids, once each; ids that aren't there are passed over. Long lists are joined instead of spelled out."""
    ids = sorted(set(ids))
    if len(ids) <= broadcast_from:
        return replace(rel, df=rel.df.where(F.col(ID).isin(ids) if ids else F.lit(False)))
    spark = rel.df.sparkSession
    return replace(rel, df=rel.df.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], f"{ID} long")), ID, "left_semi"))


def filtered(rel: Rel, predicate: Expr) -> Rel:
    return replace(rel, df=rel.df.where(rel.scope().predicate(predicate)))


def projected(rel: Rel, fields: tuple[str, ...]) -> Rel:
    """Fields by name, each once; one that isn't there is absent: a null column."""
    fields = tuple(dict.fromkeys(fields))
    missing = [f for f in fields if f not in rel.fields]
    hidden = [i for i in rel.ids if i not in fields]
    # an order by a field that goes is kept by a hidden copy
    kept, columns = [], []
    for k in rel.order:
        if k.name in fields or k.name in rel.ids:
            kept.append(k)
        else:
            name = f"__order_{len(columns)}"
            columns.append(quoted(k.name).alias(name))
            kept.append(replace(k, name=name))
    shown = [F.lit(None).cast("string").alias(f) if f in missing else quoted(f) for f in fields]
    return replace(rel, df=rel.df.select(*shown, *[quoted(i) for i in hidden], *columns), fields=fields, order=tuple(kept), absent=(rel.absent & set(fields)) | set(missing))


def ordered(rel: Rel, keys: tuple[SortKey, ...]) -> Rel:
    """Absent values come last ascending and first descending, an aggregate's nulls the other way round. Ties are broken by id, ascending whatever the keys' directions. A field that
    isn't there orders nothing."""
    order, df = [], rel.df
    for k in keys:
        if k.field not in rel.fields or k.field in rel.absent:
            continue
        name = k.field
        if kind_of(rel.type_of(name)) == "map":
            name = f"__sort_{len(order)}"
            df = df.withColumn(name, column_value(quoted(k.field), rel.type_of(k.field)).column)
        order.append(Key(name, k.descending, nulls_first=k.descending != rel.explicit_nulls))
    return replace(rel, df=df, order=(*order, *[Key(i) for i in rel.ids]))


def limited(rel: Rel, n: int) -> Rel:
    if n == 0:
        return replace(rel, df=rel.df.where(F.lit(False)))
    return replace(rel, df=rel.df.orderBy(*[k.column() for k in rel.order]).limit(n))


def _aggregate(rel: Rel, a: Agg) -> Column:
    if a.field is None:
        return F.count(F.lit(1)).alias(a.output)
    there = a.field in rel.fields and a.field not in rel.absent
    t = rel.type_of(a.field) if there else T.NullType()
    c = quoted(a.field) if there else F.lit(None)
    kind = kind_of(t)
    if a.kind == "count":
        out = F.count(c) if there else F.sum(F.lit(0).cast("long"))
        out = F.coalesce(out, F.lit(0).cast("long"))
    elif a.kind in ("sum", "avg"):
        if kind != "number":
            out = F.max(F.lit(None).cast("double"))
        elif isinstance(t, T.DecimalType):
            # exact, where a sum of doubles would not be
            out = (F.sum(c) if a.kind == "sum" else F.sum(c) / F.count(c)).cast("double")
        elif rel.exact_sums is not None and isinstance(t, (T.DoubleType, T.FloatType)):
            total = F.sum(c.cast(T.DecimalType(18 + rel.exact_sums, rel.exact_sums))).cast("double")
            out = total if a.kind == "sum" else total / F.count(c)
        else:
            out = F.sum(c.cast("double")) if a.kind == "sum" else F.avg(c.cast("double"))
    elif isinstance(t, T.MapType):
        out = F.map_from_entries((F.min if a.kind == "min" else F.max)(column_value(c, t).column))
    elif not there:
        out = F.max(F.lit(None).cast("string"))
    else:
        out = (F.min if a.kind == "min" else F.max)(c)
    return out.alias(a.output)


def aggregated(rel: Rel, group_by: tuple[str, ...], aggs: tuple[Agg, ...]) -> Rel:
    """Groups in ascending order of their keys, the null group first; a global aggregate of nothing is one row, a grouped one none. Sums and means are doubles, counts longs; values that are no
    numbers don't add up."""
    keys = tuple(dict.fromkeys(group_by))
    columns = [quoted(k) if k in rel.fields else F.lit(None).cast("string").alias(k) for k in keys]
    if keys:
        df = rel.df.groupBy(*[c.alias(k) for c, k in zip(columns, keys)]).agg(*[_aggregate(rel, a) for a in aggs])
    else:
        df = rel.df.agg(*[_aggregate(rel, a) for a in aggs])
    fields = (*keys, *[a.output for a in aggs])
    return Rel(df, tuple(dict.fromkeys(fields)), keys, tuple(Key(k, nulls_first=True) for k in keys), explicit_nulls=True, exact_sums=rel.exact_sums)


def tie_keys(rel: Rel) -> tuple[Key, ...]:
    return tuple(Key(i, nulls_first=rel.explicit_nulls) for i in rel.ids)


def joined(left: Rel, right: Rel, names: tuple[str, str], kind: str, on: tuple[str, str]) -> Rel:
    """Equi-join on one pair of fields. Every field is named collection.field; null keys never match; unmatched right fields are absent. Rows come in the left's order of ids, then the right's."""
    if names[0] == names[1]:
        raise Unsupported("a collection is not joined with itself")

    def side(rel: Rel, name: str, tag: str) -> DataFrame:
        return rel.df.select(*[quoted(f).alias(f"{name}.{f}") for f in rel.fields], quoted(rel.ids[0]).alias(tag))

    l_df, r_df = side(left, names[0], "__left_id"), side(right, names[1], "__right_id")
    have = on[0] in left.fields and on[1] in right.fields
    if have:
        a, b = kind_of(left.type_of(on[0])), kind_of(right.type_of(on[1]))
        have = RANKS[a] == RANKS[b] and a not in ("null", "map")
    condition = quoted(f"{names[0]}.{on[0]}") == quoted(f"{names[1]}.{on[1]}") if have else F.lit(False)
    fields = tuple(f"{names[0]}.{f}" for f in left.fields) + tuple(f"{names[1]}.{f}" for f in right.fields)
    if not have and kind == "inner":
        # no keys can match: nothing, without a join
        df = l_df.where(F.lit(False)).select("*", *[F.lit(None).cast(right.type_of(f)).alias(f"{names[1]}.{f}") for f in right.fields], F.lit(None).cast("long").alias("__right_id"))
    elif not have:
        df = l_df.select("*", *[F.lit(None).cast(right.type_of(f)).alias(f"{names[1]}.{f}") for f in right.fields], F.lit(None).cast("long").alias("__right_id"))
    else:
        df = l_df.join(r_df, condition, kind)
    ids = ("__left_id", "__right_id")
    return Rel(df, fields, ids, tuple(Key(i) for i in ids), exact_sums=left.exact_sums)


def result(rel: Rel, order: bool = True, ids: bool = False) -> DataFrame:
    """The visible fields, in the rel's order where asked."""
    df = rel.df.orderBy(*[k.column() for k in rel.order]) if order and rel.order else rel.df
    shown = [quoted(f) for f in rel.fields]
    return df.select(*([quoted(i) for i in rel.ids if i == ID] if ids else []), *shown)
