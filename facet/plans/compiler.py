"""Plans to DataFrames. Pushing filters and columns into scans, joins' strategies and top-k are Catalyst's; what it can't know, which copy of a collection to read, is decided by `read`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facet.operators import relational as R

from .logical import Aggregate, Filter, GetById, GetByIds, Join, Limit, Op, Project, Scan, Sort

#: read(collection, plan) gives the rows of a collection with their _id, from any copy that has what the plan needs.
Reader = Callable[[str, Op], DataFrame]


def compile_plan(plan: Op, read: Reader, exact_sums: int | None = None) -> R.Rel:
    joins = sum(isinstance(x, Join) for x in plan.walk())
    if joins > 1:
        raise R.Unsupported("more than one join in a query")

    def build(op: Op) -> R.Rel:
        if isinstance(op, Scan):
            return R.base(read(op.collection, plan), exact_sums)
        if isinstance(op, GetById):
            rel = R.base(read(op.collection, plan), exact_sums)
            return R.replace(rel, df=rel.df.where(F.col(R.ID) == op.id))
        if isinstance(op, GetByIds):
            return R.by_ids(R.base(read(op.collection, plan), exact_sums), op.ids)
        if isinstance(op, Filter):
            return R.filtered(build(op.input), op.predicate)
        if isinstance(op, Project):
            return R.projected(build(op.input), op.fields)
        if isinstance(op, Sort):
            return R.ordered(build(op.input), op.keys)
        if isinstance(op, Limit):
            return R.limited(build(op.input), op.n)
        if isinstance(op, Aggregate):
            return R.aggregated(build(op.input), op.group_by, op.aggs)
        if isinstance(op, Join):
            names = tuple((side.collections() or ["?"])[0] for side in (op.left, op.right))
            return R.joined(build(op.left), build(op.right), names, op.kind, op.on)
        raise R.Unsupported(f"no operator {op!r}")

    return build(plan)
