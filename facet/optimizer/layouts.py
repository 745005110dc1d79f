"""Physical copies of a collection, and which of them a query reads.

A layout is a derived copy that may be dropped at any time: the same rows sorted, bucketed or cached, or fewer columns or rows of them. A query may read a layout if that can't change its answer: the copy is of the
collection's current epoch, has every field the query needs, and, for a partial copy, its condition is among the query's own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facet.functions.expr import Expr, Scope, conjuncts, pinned, ranged
from facet.operators.relational import ID, quoted
from facet.plans.logical import Filter, GetById, GetByIds, Op

KINDS = ("sorted", "bucketed", "covering", "partial", "cached", "direct", "delta", "bitmap")
#: Rows of a bucket, about, and the values a bitmap copy has at most.
BUCKET_ROWS, BITMAP_VALUES = 1_000_000, 256
PART = "_facet_value"


@dataclass
class Layout:
    kind: str
    collection: str
    fields: tuple[str, ...] = ()  # what it is sorted or bucketed by
    covers: tuple[str, ...] | None = None  # columns it holds; None for all
    condition: Expr | None = None  # of a partial copy
    epoch: int = -1
    df: DataFrame | None = field(default=None, repr=False)
    place: str = ""
    path: str = ""
    uses: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}({','.join(self.fields)})" + (f" covering {','.join(self.covers)}" if self.covers else "") + (f" where {self.condition.text()}" if self.condition else "")


def predicate_of(plan: Op, collection: str) -> Expr | None:
    """The filter right above a collection's scan."""
    for op in plan.walk():
        if isinstance(op, Filter) and getattr(op.input, "collection", None) == collection:
            return op.predicate
    return None


def buckets_for(n: int) -> int:
    """Buckets for n rows: so many that one holds about BUCKET_ROWS, and 16 at least."""
    return max(16, -(-n // BUCKET_ROWS))


def bitmap_serves(rows: DataFrame, name: str) -> bool:
    """Whether a field has few enough values for a bitmap copy, and none that are equal but written in two ways, as 0.0 and -0.0."""
    if name not in rows.columns or isinstance(rows.schema[name].dataType, (T.FloatType, T.DoubleType)) or not isinstance(rows.schema[name].dataType, T.AtomicType):
        return False
    return rows.select(quoted(name)).distinct().limit(BITMAP_VALUES + 1).count() <= BITMAP_VALUES


def build(layout: Layout, rows: DataFrame, epoch: int, root: str, buckets: int | None = None) -> Layout:
    """Writes the copy under root (or caches it), and makes it readable. buckets: by default as the number of rows asks for."""
    spark = rows.sparkSession
    df = rows
    if layout.condition is not None:
        types = {f.name: f.dataType for f in df.schema.fields}
        df = df.where(Scope({c: (quoted(c), types[c]) for c in df.columns}).predicate(layout.condition))
    if layout.covers is not None:
        df = df.select(*dict.fromkeys([ID, *layout.fields, *layout.covers]))
    path = f"{root.rstrip('/')}/{layout.kind}-{uuid.uuid4().hex}"
    layout.path = "" if layout.kind == "cached" else path
    if layout.kind == "cached":
        layout.df = df.persist()
    elif layout.kind in ("bucketed", "direct"):
        # a table bucketed by the field: an equality reads one bucket, a join on it needs no exchange
        by = list(layout.fields) or [ID]
        layout.place = f"facet_{uuid.uuid4().hex}"
        buckets = buckets or min(buckets_for(df.count()), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
        df.repartition(buckets, *[quoted(b) for b in by]).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(layout.place)
        layout.df = spark.table(layout.place)
    elif layout.kind == "bitmap":
        # a folder for each value: an equality reads its rows alone, as a bitmap of the value would
        (by,) = layout.fields
        if not bitmap_serves(rows, by):
            raise ValueError(f"{by} has more than {BITMAP_VALUES} values, or is of a type that a bitmap copy doesn't serve")
        df.withColumn(PART, F.coalesce(F.xxhash64(quoted(by)), F.lit(0)).cast("string")).repartition(PART).sortWithinPartitions(PART, ID).write.partitionBy(PART).parquet(path)
        layout.df = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(PART, T.StringType())])).parquet(path)
    else:
        by = [quoted(b) for b in layout.fields] or [quoted(ID)]
        writer = df.repartitionByRange(*by).sortWithinPartitions(*by).write
        if layout.kind == "delta":
            writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
        writer.parquet(path)
        layout.df = spark.read.schema(df.schema).parquet(path)
    layout.epoch = epoch
    return layout


def read(layout: Layout, plan: Op) -> DataFrame:
    """The copy as a plan reads it: of a bitmap copy, the folder of the value that the plan pins."""
    if layout.kind != "bitmap":
        return layout.df
    name = layout.fields[0]
    df = layout.df
    value = pinned(predicate_of(plan, layout.collection)).get(name)
    if value is not None:
        of_value = F.lit(value).cast(df.schema[name].dataType)
        digest = df.sparkSession.range(1).select(F.xxhash64(of_value).cast("string"), (of_value == F.lit(value))).first()
        if digest[1]:  # the literal is a value of the field's type; else the plan's own filter reads everything
            df = df.where(F.col(PART) == digest[0])
    return df.drop(PART)


def drop(layout: Layout) -> None:
    """Forgets the copy and deletes its files. What still reads it lazily fails."""
    if layout.df is None:
        return
    spark = layout.df.sparkSession
    if layout.kind == "cached":
        layout.df.unpersist()
    elif layout.kind in ("bucketed", "direct"):
        spark.sql(f"drop table if exists {layout.place}")
    if layout.path:
        p = spark._jvm.org.apache.hadoop.fs.Path(layout.path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    layout.df = None


def choose(layouts: list[Layout], collection: str, plan: Op, epoch: int) -> tuple[Layout | None, str]:
    """The layout to read for a collection, with the reason. Covering copies go first, then partial ones, composites (longest first), one pinned field, a range, a cached copy, the rows themselves."""
    where = predicate_of(plan, collection)
    equal, bounded = pinned(where), ranged(where)
    needs = plan.required_fields()
    by_id = any(isinstance(op, (GetById, GetByIds)) and op.collection == collection for op in plan.walk())
    written = {x.text() for x in conjuncts(where)}
    best, rank, why = None, 0, "no layout fits: reading the rows themselves"
    for x in layouts:
        if x.collection != collection or x.epoch != epoch or x.df is None:
            continue
        if x.covers is not None and (needs is None or not needs <= {*x.covers, *x.fields}):
            continue
        if x.condition is not None and not {c.text() for c in conjuncts(x.condition)} <= written:
            continue
        hit = len(x.fields) if x.fields and all(f in equal for f in x.fields) else 0
        near = bool(x.fields) and (x.fields[0] in equal or x.fields[0] in bounded)
        if x.kind == "covering" and near:
            score, reason = 60 + hit, "it holds all the query needs, sorted by the filtered field"
        elif x.kind == "partial":
            score, reason = 50, "its condition is among the query's"
        elif x.kind == "bucketed" and hit:
            score, reason = 40 + hit, f"all of {', '.join(x.fields)} are pinned: one bucket"
        elif x.kind == "bitmap" and hit:
            score, reason = 35, f"{x.fields[0]} is pinned: the folder of its value"
        elif x.kind in ("sorted", "delta") and near:
            score, reason = 30 + hit, f"{x.fields[0]} is filtered: row groups outside are skipped"
        elif x.kind == "direct" and by_id:
            score, reason = 45, "a lookup by id: one bucket"
        elif x.kind == "cached":
            score, reason = 10, "the rows are in memory"
        else:
            continue
        if score > rank:
            best, rank, why = x, score, f"{x.name}: {reason}"
    return best, why


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two DataFrames hold the same rows, repeats counted: compared by exceptAll both ways."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def verify(layout: Layout, rows: DataFrame) -> bool:
    """A layout against the rows it was made from."""
    df = rows
    if layout.condition is not None:
        types = {f.name: f.dataType for f in df.schema.fields}
        df = df.where(Scope({c: (quoted(c), types[c]) for c in df.columns}).predicate(layout.condition))
    columns = [c for c in layout.df.columns if c != PART]
    return same_rows(df.select(*[F.col(f"`{c}`") for c in columns]), layout.df.select(*[F.col(f"`{c}`") for c in columns]))
