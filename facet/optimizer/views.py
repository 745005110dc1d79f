"""Maintained aggregates: COUNT, SUM and AVG by group, kept as accumulators and brought forward by deltas.

A view answers a query only if it is exactly its own: same collection, groups and aggregates, no filter. Sums are held as whole numbers and only while they are exact: every value integral, and the sum of absolute values under 2**53; else the
view steps aside and the rows are read. MIN and MAX are never kept, since a delete can't be taken back from them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facet.operators.relational import Key, Rel, quoted
from facet.plans.logical import Agg, Aggregate, Op, Scan

EXACT = 2**53


@dataclass
class View:
    collection: str
    group_by: tuple[str, ...]
    aggs: tuple[Agg, ...]
    epoch: int = -1
    state: DataFrame | None = field(default=None, repr=False)
    exact: bool = False
    uses: int = 0

    @staticmethod
    def of(plan: Op) -> View | None:
        """The view that would answer a plan, if one may."""
        if isinstance(plan, Aggregate) and isinstance(plan.input, Scan) and all(a.kind in ("count", "sum", "avg") for a in plan.aggs):
            return View(plan.input.collection, tuple(plan.group_by), tuple(plan.aggs))
        return None

    def answers(self, plan: Op, epoch: int) -> bool:
        other = View.of(plan)
        return bool(other and self.exact and self.state is not None and self.epoch == epoch and (other.collection, other.group_by, other.aggs) == (self.collection, self.group_by, self.aggs))

    def _fields(self) -> list[str]:
        return sorted({a.field for a in self.aggs if a.field})

    def accumulate(self, rows: DataFrame, sign: int = 1) -> DataFrame:
        """Accumulators of some rows: n rows, and for each field the count and, for numbers, sum, sum of absolute values and whether all are integral."""
        out = [(F.count(F.lit(1)) * sign).alias("n")]
        types = {f.name: f.dataType for f in rows.schema.fields}
        for k, f in enumerate(self._fields()):
            number = f in types and isinstance(types[f], T.NumericType)
            c = quoted(f) if f in types else F.lit(None)
            d = c.cast("decimal(38,6)") if number else F.lit(None).cast("decimal(38,6)")
            out += [
                (F.count(c) * sign).alias(f"c{k}"),
                (F.coalesce(F.sum(d), F.lit(0)) * sign).cast("decimal(38,6)").alias(f"s{k}"),
                F.coalesce(F.sum(F.abs(d)), F.lit(0)).cast("decimal(38,6)").alias(f"a{k}"),
                F.coalesce(F.min((d == F.floor(d)).cast("int")), F.lit(1)).alias(f"w{k}"),
            ]
        keys = [quoted(g) if g in types else F.lit(None).cast("string").alias(g) for g in self.group_by]
        return rows.groupBy(*keys).agg(*out)

    def _merge(self, parts: DataFrame) -> DataFrame:
        out = [F.sum("n").alias("n")]
        for k, _ in enumerate(self._fields()):
            out += [F.sum(f"{x}{k}").cast("long" if x == "c" else "decimal(38,6)").alias(f"{x}{k}") for x in "csa"] + [F.min(f"w{k}").alias(f"w{k}")]
        return parts.groupBy(*[quoted(g) for g in self.group_by]).agg(*out).where("n > 0")

    def build(self, rows: DataFrame, epoch: int) -> View:
        return self._keep(self.accumulate(rows), epoch)

    def apply(self, added: DataFrame | None, removed: DataFrame | None, epoch: int) -> View:
        """Brings the view forward by rows added and rows removed since its epoch, without reading the rest."""
        parts = self.state
        for rows, sign in ((added, 1), (removed, -1)):
            if rows is not None:
                parts = parts.unionByName(self.accumulate(rows, sign))
        old = self.state
        self._keep(self._merge(parts), epoch)
        old.unpersist()
        return self

    def _keep(self, state: DataFrame, epoch: int) -> View:
        self.state = state.persist()
        tests = [F.max(F.when((F.col(f"a{k}") >= EXACT) | (F.col(f"w{k}") == 0), 1).otherwise(0)) for k, f in enumerate(self._fields()) if any(a.field == f and a.kind != "count" for a in self.aggs)]
        row = self.state.agg(F.count(F.lit(1)), *tests).first()
        self.exact = not any(row[1:])
        self.epoch = epoch
        return self

    def answer(self) -> Rel:
        place = {f: k for k, f in enumerate(self._fields())}
        columns = []
        for a in self.aggs:
            if a.field is None:
                c = F.col("n")
            else:
                k = place[a.field]
                if a.kind == "count":
                    c = F.col(f"c{k}")
                elif a.kind == "sum":
                    c = F.when(F.col(f"c{k}") > 0, F.col(f"s{k}").cast("double"))
                else:
                    c = F.when(F.col(f"c{k}") > 0, F.col(f"s{k}").cast("double") / F.col(f"c{k}"))
            columns.append(c.alias(a.output))
        df = self.state.select(*[quoted(g) for g in self.group_by], *columns)
        return Rel(df, (*self.group_by, *[a.output for a in self.aggs]), self.group_by, tuple(Key(g, nulls_first=True) for g in self.group_by), explicit_nulls=True)
