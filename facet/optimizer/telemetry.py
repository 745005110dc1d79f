"""What the engine knows of its traffic: latency by query shape, how fields are filtered, what is projected with them. Counts decay, so that old traffic fades."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from facet.functions.expr import pinned, ranged
from facet.plans.logical import Aggregate, GetById, Join, Op

from .layouts import predicate_of


class Histogram:
    """Latencies in log-linear buckets: sixteen to each doubling, so that a quantile is off by about 4 % at most."""

    def __init__(self):
        self.buckets: Counter[int] = Counter()
        self.n = 0

    def add(self, seconds: float) -> None:
        self.buckets[round(16 * math.log2(max(seconds, 1e-9)))] += 1
        self.n += 1

    def quantile(self, q: float) -> float:
        left = q * self.n
        for b in sorted(self.buckets):
            left -= self.buckets[b]
            if left <= 0:
                return 2 ** (b / 16)
        return 0.0

    def decay(self, keep: float) -> None:
        self.buckets = Counter({b: k for b, c in self.buckets.items() if (k := int(c * keep))})
        self.n = sum(self.buckets.values())


@dataclass
class Telemetry:
    latency: dict[str, Histogram] = field(default_factory=lambda: defaultdict(Histogram))
    equal: Counter = field(default_factory=Counter)  # (collection, field)
    ranges: Counter = field(default_factory=Counter)
    together: Counter = field(default_factory=Counter)  # (collection, fields pinned in one query)
    covers: Counter = field(default_factory=Counter)  # (collection, filtered field, fields read)
    aggregates: dict[str, Op] = field(default_factory=dict)  # plans a view could answer, by key
    asked: Counter = field(default_factory=Counter)  # by key of the whole query
    shapes: Counter = field(default_factory=Counter)
    by_id: Counter = field(default_factory=Counter)
    caches: Counter = field(default_factory=Counter)  # (cache, hit or miss)
    queries: int = 0

    def record(self, plan: Op, seconds: float) -> None:
        self.queries += 1
        self.latency[plan.shape()].add(seconds)
        self.shapes[plan.shape()] += 1
        self.asked[plan.key()] += 1
        if any(isinstance(x, Join) for x in plan.walk()):
            return
        for name in plan.collections():
            where = predicate_of(plan, name)
            eq, rg = sorted(pinned(where)), sorted(ranged(where))
            for f in eq:
                self.equal[name, f] += 1
            for f in rg:
                self.ranges[name, f] += 1
            if len(eq) > 1:
                self.together[name, tuple(eq)] += 1
            needs = plan.required_fields()
            for f in (*eq, *rg):
                if needs is not None:
                    self.covers[name, f, tuple(sorted(needs))] += 1
            if isinstance(plan, GetById):
                self.by_id[name] += 1
        if isinstance(plan, Aggregate) and where_free(plan):
            self.aggregates[plan.key()] = plan

    def decay(self, keep: float = 0.75) -> None:
        for c in (self.equal, self.ranges, self.together, self.covers, self.asked, self.shapes, self.by_id):
            for k in list(c):
                c[k] = int(c[k] * keep)
                if not c[k]:
                    del c[k]
        for h in self.latency.values():
            h.decay(keep)

    def prometheus(self) -> str:
        lines = ["# TYPE facet_queries_total counter", f"facet_queries_total {self.queries}"]
        for shape, h in sorted(self.latency.items()):
            for q in (0.5, 0.99):
                lines.append(f'facet_latency_seconds{{shape="{shape}",quantile="{q}"}} {h.quantile(q):.6f}')
        for (cache, what), n in sorted(self.caches.items()):
            lines.append(f'facet_cache_total{{cache="{cache}",result="{what}"}} {n}')
        return "\n".join(lines) + "\n"


def where_free(plan: Aggregate) -> bool:
    return len(list(plan.walk())) == 2
