"""The fifteen physical optimizations, at which level each comes in, and what it takes and gives up."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Optimization:
    name: str
    level: int
    what: str
    speed: float  # expected gain, resources and freedom given up: 0 to 1 each, until a measurement replaces the gain
    resources: float
    freedom: float
    additive: bool = True  # a derived copy that can be shadowed and dropped
    automatic: bool = True


REGISTRY = {
    o.name: o
    for o in (
        Optimization("plan_cache", 1, "keeps the layout decision of a shape", 0.2, 0.05, 0.0),
        Optimization("result_cache", 1, "keeps a persisted result for the same query at the same epoch", 0.9, 0.3, 0.0),
        Optimization("auto_index", 2, "a bucketed copy for equality, a sorted one for ranges", 0.7, 0.4, 0.0),
        Optimization("record_compression", 2, "zstd instead of the default codec for new copies", 0.2, 0.1, 0.0, additive=False),
        Optimization("buffer_pool", 3, "Spark places and evicts cached blocks by itself; nothing to switch", 0.0, 0.0, 0.0, additive=False),
        Optimization("prefetch", 3, "the Parquet reader reads ahead by itself; nothing to switch", 0.0, 0.0, 0.0, additive=False),
        Optimization("column_store", 4, "a cached columnar copy", 0.6, 0.5, 0.0),
        Optimization("delta_encoding", 4, "a sorted copy with delta-packed whole numbers", 0.3, 0.2, 0.0),
        Optimization("materialized_view", 4, "a maintained aggregate", 0.95, 0.2, 0.1),
        Optimization("auto_composite_index", 5, "a copy bucketed by fields that are pinned together", 0.7, 0.4, 0.0),
        Optimization("auto_covering_index", 5, "a narrow sorted copy with all a query reads", 0.8, 0.4, 0.0),
        Optimization("clustered_sort", 5, "stores rows in the order of a field", 0.5, 0.2, 0.2, additive=False),
        Optimization("freeze_schema", 8, "raises the schema's mode to what the data has", 0.3, 0.0, 1.0, additive=False, automatic=False),
        Optimization("thread_per_core", 9, "Spark places tasks; nothing to switch", 0.0, 0.0, 0.0, additive=False),
        Optimization("direct_lookup", 10, "a copy bucketed by id", 0.6, 0.4, 0.0),
    )
}


def at_level(level: int, on: tuple[str, ...] = (), off: tuple[str, ...] = ()) -> list[str]:
    """What is switched on at a level, with overrides. The caches grow at level 3: see cache_size()."""
    if not 0 <= level <= 10:
        raise ValueError("levels are 0 to 10")
    names = [n for n, o in REGISTRY.items() if (o.level <= level and o.automatic) or n in on]
    return [n for n in names if n not in off]


def cache_size(name: str, level: int) -> int:
    small, large = {"plan_cache": (512, 4096), "result_cache": (256, 4096)}[name]
    return large if level >= 3 else small


@dataclass(frozen=True)
class Policy:
    """What a decision weighs, and what it must keep. rigid: schemas may be raised; resources: copies may be made."""

    speed: float = 1.0
    resources: float = 0.5
    freedom: float = 0.5
    rigid: bool = False
    copies: bool = True

    def allows(self, o: Optimization) -> bool:
        return (self.rigid or o.freedom < 1.0) and (self.copies or not o.additive or o.resources <= 0.05)

    def score(self, o: Optimization, gain: float | None = None) -> float:
        """Gain against what is given up; a measured gain replaces the expected one."""
        return self.speed * (o.speed if gain is None else gain) - self.resources * o.resources * 0.5 - self.freedom * o.freedom * 0.5
