"""The engine: collections, queries as plans or SQL, and the physical design behind them. An optimization changes how long an answer takes, never the answer."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame, Row, SparkSession

from .operators import relational as R
from .optimizer import layouts as L
from .optimizer.adaptive import AdaptiveDriver, Experiment, Proposal, serves
from .optimizer.registry import at_level, cache_size
from .optimizer.telemetry import Telemetry
from .optimizer.views import View
from .plans.compiler import compile_plan
from .plans.logical import GetById, Join, Op
from .plans.sql import parse
from .sources.store import NoSuchCollection, Store


class Engine:
    """Reads registered DataFrames (with an _id column) and the collections of a store.

    level: which optimizations are on, 0 to 10. root: a folder for layouts. small_rows: results and looked-up collections of at most so many rows, by count, may be held on the driver; larger ones stay in Spark. slow_seconds: queries that take longer
    are kept in `slow`. exact_sums: scale for sums of doubles by way of decimals, which are the same whatever the order of rows; None for plain doubles.
    """

    def __init__(self, spark: SparkSession, store: Store | None = None, root: str | None = None, level: int = 0, exact_sums: int | None = None, driver: AdaptiveDriver | None = None, small_rows: int = 10_000, slow_seconds: float | None = None):
        self.spark, self.store, self.root, self.exact_sums = spark, store, root, exact_sums
        self.frames: dict[str, DataFrame] = {}
        self.epochs: dict[str, int] = {}
        self.layouts: list[L.Layout] = []
        self.views: list[View] = []
        self.results: OrderedDict[str, tuple[dict, list[Row] | None, DataFrame | None]] = OrderedDict()
        self.small_rows, self.slow_seconds = small_rows, slow_seconds
        self.slow: list[tuple[float, str]] = []
        self.lookups: dict[str, int] = {}
        self.prepared: dict[str, tuple[int, dict[int, Row] | None]] = {}
        self.decisions: OrderedDict[tuple, str] = OrderedDict()
        self.telemetry = Telemetry()
        self.driver = driver
        self.experiment: Experiment | None = None
        self.promoted: list[tuple[Proposal, int, int]] = []  # with the cycle and the uses when it was last used
        self.codec: str | None = None
        self.set_level(level)

    def set_level(self, level: int, on: tuple[str, ...] = (), off: tuple[str, ...] = ()) -> None:
        self.level, self.on = level, set(at_level(level, on, off))
        # the session's codec is changed while the optimization is on, and put back when it goes off
        codec = "spark.sql.parquet.compression.codec"
        if "record_compression" in self.on and self.codec is None:
            self.codec = self.spark.conf.get(codec)
            self.spark.conf.set(codec, "zstd")
        elif "record_compression" not in self.on and self.codec is not None:
            self.spark.conf.set(codec, self.codec)
            self.codec = None
        if "result_cache" not in self.on:
            self._forget()

    # collections

    def register(self, name: str, df: DataFrame, id: str | None = None) -> None:
        """A DataFrame as a collection; id names the column that becomes _id and stays a field."""
        if id is not None:
            from pyspark.sql import functions as F

            df = df.withColumn(R.ID, F.col(f"`{id}`").cast("long"))
        self.frames[name] = df
        self.epochs[name] = self.epochs.get(name, -1) + 1

    def rows(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if self.store is None:
            raise NoSuchCollection(name)
        return self.store.scan(name)

    def epoch(self, name: str) -> int:
        return self.epochs[name] if name in self.frames else self.store.epoch(name) if self.store else 0

    # physical design

    def add_layout(self, kind: str, collection: str, fields=(), covers=None, condition=None) -> L.Layout:
        x = L.Layout(kind, collection, tuple(fields), tuple(covers) if covers is not None else None, condition)
        self.layouts.append(L.build(x, self.rows(collection), self.epoch(collection), self._root()))
        return x

    def drop_layout(self, x: L.Layout) -> None:
        L.drop(x)
        self.layouts.remove(x)

    def add_view(self, plan: Op) -> View:
        v = View.of(plan)
        if v is None:
            raise R.Unsupported("a view is a COUNT, SUM or AVG aggregate of a whole collection")
        self.views.append(v.build(self.rows(v.collection), self.epoch(v.collection)))
        return v

    def refresh(self) -> None:
        """Brings layouts of changed collections up to date; until then queries pass them over."""
        for x in self.layouts:
            if x.epoch != self.epoch(x.collection):
                L.drop(x)
                L.build(x, self.rows(x.collection), self.epoch(x.collection), self._root())
        for v in self.views:
            if v.epoch != self.epoch(v.collection):
                v.build(self.rows(v.collection), self.epoch(v.collection))

    def verify(self) -> dict[str, bool]:
        """Every current layout and view against the rows."""
        out = {x.name: L.verify(x, self.rows(x.collection)) for x in self.layouts if x.epoch == self.epoch(x.collection)}
        for v in self.views:
            if v.exact and v.epoch == self.epoch(v.collection):
                anew = View(v.collection, v.group_by, v.aggs).build(self.rows(v.collection), v.epoch)
                out[f"view({','.join(v.group_by)})"] = anew.exact and L.same_rows(anew.answer().df, v.answer().df)
                anew.state.unpersist()
        return out

    def retract(self) -> None:
        """Takes back promoted changes that no longer pay: their measured gain is under what is worth keeping, or no query has read them for `unused_after` cycles."""
        d = self.driver
        for k, (p, cycle, uses) in list(enumerate(self.promoted))[::-1]:
            change = p.change
            used = change.uses
            if used > uses:
                self.promoted[k] = (p, d.cycle, used)
                cycle = d.cycle
            why = "its gain is too small to keep" if not d.worth_keeping(p) else f"unused for {d.cycle - cycle} cycles" if d.cycle - cycle >= d.settings.unused_after else ""
            if why:
                del self.promoted[k]
                if isinstance(change, View):
                    self.views.remove(change)
                    change.state.unpersist()
                elif change in self.layouts:
                    self.drop_layout(change)
                d.retracted[p.key] = d.cycle
                d.note(p.optimization, p.key, "retracted", why)

    def _root(self) -> str:
        if self.root is None:
            raise R.Unsupported("the engine was given no folder for layouts")
        return self.root

    # queries

    def sql(self, text: str) -> DataFrame:
        return self.query(parse(text))

    def query(self, plan: Op, ordered: bool = True) -> DataFrame:
        """The answer as a DataFrame, lazily; its rows are in the plan's order."""
        return R.result(self._answer(plan, self._layouts()), ordered)

    def collect(self, plan: Op | str, tag: str | None = None) -> list[Row]:
        """The answer's rows. Runs the query now, so this is where results are cached, telemetry is taken and experiments compare. A tagged query can be stopped by cancel(tag) from another thread."""
        plan = parse(plan) if isinstance(plan, str) else plan
        began = time.perf_counter()
        if tag:
            self.spark.addTag(tag)
        try:
            out = self._collect(plan)
        finally:
            if tag:
                self.spark.removeTag(tag)
        took = time.perf_counter() - began
        self.telemetry.record(plan, took)
        if self.slow_seconds is not None and took > self.slow_seconds:
            self.slow.append((took, plan.explain()))
        return out

    def cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)

    def _collect(self, plan: Op) -> list[Row]:
        if isinstance(plan, GetById) and (held := self._prepared(plan.collection)) is not None:
            row = held.get(plan.id)
            return [] if row is None else [row]
        e = self.experiment
        if e and e.state in ("shadow", "canary") and serves(e.proposal.change, plan, self.epoch(e.proposal.collection)):
            return self._tried(plan, e)
        if "result_cache" not in self.on:
            return self.query(plan).collect()
        key, at = plan.key(), {c: self.epoch(c) for c in plan.collections()}
        if (held := self.results.get(key)) and held[0] == at:
            self.results.move_to_end(key)
            self.telemetry.caches["result", "hit"] += 1
            return list(held[1]) if held[1] is not None else held[2].collect()
        self.telemetry.caches["result", "miss"] += 1
        if held:
            self._release(key)
        df = self.query(plan)
        out = df.collect()
        # small results are kept as rows; of others the DataFrame is persisted, and filled when it is asked again
        small = len(out) <= self.small_rows
        self.results[key] = (at, list(out) if small else None, None if small else df.persist())
        while len(self.results) > cache_size("result_cache", self.level):
            self._release(next(iter(self.results)))
        return out

    def _prepared(self, name: str, after: int = 256) -> dict[int, Row] | None:
        """A collection's rows by id, once it has been looked up `after` times at its current epoch and has at most small_rows rows."""
        if "direct_lookup" not in self.on:
            return None
        epoch = self.epoch(name)
        if (got := self.prepared.get(name)) and got[0] == epoch:
            return got[1]
        self.lookups[name] = self.lookups.get(name, 0) + 1
        if self.lookups[name] < after:
            return None
        rows = self.rows(name)
        fields = [c for c in rows.columns if c != R.ID]
        some = rows.limit(self.small_rows + 1).collect()
        held = {r[R.ID]: Row(**{c: r[c] for c in fields}) for r in some} if len(some) <= self.small_rows else None
        self.prepared[name] = (epoch, held)
        self.lookups[name] = 0
        return held

    def _tried(self, plan: Op, e: Experiment) -> list[Row]:
        change = e.proposal.change
        t0 = time.perf_counter()
        base = R.result(self._answer(plan, self._layouts())).collect()
        t1 = time.perf_counter()
        rel = change.answer() if isinstance(change, View) else self._answer(plan, [change])
        other = R.result(rel).collect()
        t2 = time.perf_counter()
        e.observe(base == other, t1 - t0, t2 - t1)
        return base if e.state == "reverted" or not e.routes(plan.key(), e.base.n) else other

    def _layouts(self) -> list[L.Layout]:
        return self.layouts

    def _answer(self, plan: Op, layouts: list[L.Layout]) -> R.Rel:
        if not any(isinstance(x, Join) for x in plan.walk()):
            for v in self.views:
                if v.answers(plan, self.epoch(v.collection)):
                    v.uses += 1
                    return v.answer()
        return compile_plan(plan, lambda name, p: self._read(name, p, layouts), self.exact_sums)

    def _read(self, name: str, plan: Op, layouts: list[L.Layout]) -> DataFrame:
        """A join's inputs are read as they are; else from the layout that fits best."""
        if not layouts or any(isinstance(x, Join) for x in plan.walk()):
            return self.rows(name)
        epoch, choice = self.epoch(name), None
        key = (plan.shape(), name, epoch, len(layouts))
        if "plan_cache" in self.on and key in self.decisions:
            self.telemetry.caches["plan", "hit"] += 1
            choice = next((x for x in layouts if x.name == self.decisions[key]), None)
            if choice is not None and L.choose([choice], name, plan, epoch)[0] is None:
                choice = None
        if choice is None:
            choice, _ = L.choose(layouts, name, plan, epoch)
            if "plan_cache" in self.on:
                self.telemetry.caches["plan", "miss"] += 1
                self.decisions[key] = choice.name if choice else ""
                while len(self.decisions) > cache_size("plan_cache", self.level):
                    self.decisions.popitem(last=False)
        if choice is None:
            return self.rows(name)
        choice.uses += 1
        return L.read(choice, plan)

    def explain(self, plan: Op | str) -> str:
        """The plan, what it reads and why, and Spark's physical plan."""
        plan = parse(plan) if isinstance(plan, str) else plan
        lines = [plan.explain()]
        view = next((v for v in self.views if v.answers(plan, self.epoch(v.collection))), None)
        for name in plan.collections():
            lines.append(f"reads {name}: " + ("a maintained view" if view else L.choose(self.layouts, name, plan, self.epoch(name))[1]))
        physical = self.query(plan)._jdf.queryExecution().executedPlan().toString()
        return "\n".join([*lines, physical])

    def _release(self, key: str) -> None:
        df = self.results.pop(key)[2]
        if df is not None:
            df.unpersist()

    def _forget(self) -> None:
        for key in list(self.results):
            self._release(key)

    # the loop

    def optimize(self) -> list[str]:
        """One cycle: moves the running experiment on, or starts the best admitted proposal. Returns what was logged."""
        d = self.driver
        if d is None:
            return []
        before = len(d.log)
        e = self.experiment
        if e is not None:
            if e.advance() in ("promoted", "reverted") or e.state in ("promoted", "reverted"):
                change = e.proposal.change
                if e.state == "promoted":
                    self.promoted.append((e.proposal, d.cycle, change.uses))
                    (self.views if isinstance(change, View) else self.layouts).append(change)
                elif isinstance(change, L.Layout):
                    L.drop(change)
                d.finished(e)
                self.experiment = None
            return [str(x) for x in d.log[before:]]
        self.retract()
        have = {f"{o}:{x.collection}:{x.name}" for x in self.layouts for o in ("auto_index", "auto_composite_index", "auto_covering_index", "direct_lookup", "column_store")}
        have |= {f"auto_index:{x.collection}:bucketed({x.fields[0]})" for x in self.layouts if x.kind == "bitmap"}
        have |= {f"materialized_view:{v.collection}:" + ",".join([*v.group_by, *[f"{a.kind}({a.field})" for a in v.aggs]]) for v in self.views}
        for p in d.consider(self.telemetry, have)[:1]:
            rows, epoch = self.rows(p.collection), self.epoch(p.collection)
            if isinstance(p.change, View):
                p.change.build(rows, epoch)
            else:
                if p.optimization == "auto_index" and p.change.kind == "bucketed" and L.bitmap_serves(rows, p.change.fields[0]):
                    p.change.kind = "bitmap"
                L.build(p.change, rows, epoch, self._root())
            self.experiment = Experiment(p, d.settings)
            self.experiment.built()
        self.telemetry.decay(d.settings.decay)
        return [str(x) for x in d.log[before:]]

    def explain_optimizations(self) -> str:
        return "\n".join(str(x) for x in (self.driver.log if self.driver else []))
