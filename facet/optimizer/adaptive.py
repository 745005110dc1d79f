"""The loop that watches, proposes, proves and keeps.

    Proposed -> Building -> Shadow -> Canary 1, 10, 50, 90, 100 % -> Promoted, or Reverted at any step

A change is proposed from telemetry, scored under the policy, and built as a derived copy. In shadow every query still gets the answer from the rows, and the copy's answer is compared with it: one difference ends the
experiment. In canary a growing share of queries reads the copy, with the same comparison, while its latency is guarded. Every decision is logged with its reason.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from facet.plans.logical import Op

from .layouts import Layout
from .registry import REGISTRY, Policy
from .telemetry import Histogram, Telemetry
from .views import View

STEPS = (0.01, 0.10, 0.50, 0.90, 1.00)


@dataclass(frozen=True)
class Settings:
    least_observations: int = 500
    cooldown: int = 3
    retraction_cooldown: int = 50
    changes_per_cycle: int = 2
    admit: float = 0.5
    keep: float = 0.25
    decay: float = 0.75
    samples_per_step: int = 1000
    judge_p99_from: int = 100
    p99_most: float = 1.10
    early_p50_most: float = 1.50
    stall_after: int = 250
    unused_after: int = 50


@dataclass
class Decision:
    cycle: int
    what: str
    target: str
    verdict: str
    reason: str

    def __str__(self):
        return f"[{self.cycle}] {self.what} {self.target}: {self.verdict} ({self.reason})"


@dataclass
class Proposal:
    optimization: str
    collection: str
    change: Layout | View
    observations: int
    reason: str

    @property
    def key(self) -> str:
        c = self.change
        return f"{self.optimization}:{self.collection}:" + (c.name if isinstance(c, Layout) else ",".join([*c.group_by, *[f"{a.kind}({a.field})" for a in c.aggs]]))


@dataclass
class Experiment:
    proposal: Proposal
    settings: Settings
    state: str = "proposed"
    step: int = -1
    advances: int = 0
    base: Histogram = field(default_factory=Histogram)
    candidate: Histogram = field(default_factory=Histogram)
    reason: str = ""

    @property
    def share(self) -> float:
        """Of the queries that may, how many read the copy."""
        return STEPS[self.step] if self.state == "canary" else 1.0 if self.state == "promoted" else 0.0

    def routes(self, key: str, n: int) -> bool:
        """Whether the n-th query of a key reads the copy: by a hash, so that the share holds for any mix."""
        return zlib.crc32(f"{key}:{n}".encode()) % 10_000 < self.share * 10_000

    def built(self) -> None:
        self.state = "shadow"

    def observe(self, equal: bool | None, base_s: float | None, candidate_s: float | None) -> None:
        """A compared answer, or the latency of one side."""
        if self.state in ("promoted", "reverted"):
            return
        if equal is False:
            self.state, self.reason = "reverted", "an answer differed"
            return
        if base_s is not None:
            self.base.add(base_s)
        if candidate_s is not None:
            self.candidate.add(candidate_s)

    def advance(self) -> str:
        """Called now and then: goes a step further when there are samples enough, back when the guard trips, and gives up when nothing comes."""
        s = self.settings
        if self.state not in ("shadow", "canary"):
            return self.state
        self.advances += 1
        b, c = self.base, self.candidate
        if c.n >= 20 and b.n >= 20 and c.quantile(0.5) > s.early_p50_most * b.quantile(0.5):
            self.state, self.reason = "reverted", f"median {c.quantile(0.5):.4f} s against {b.quantile(0.5):.4f} s"
        elif c.n >= s.samples_per_step and b.n:
            if c.n >= s.judge_p99_from and b.n >= s.judge_p99_from and c.quantile(0.99) > s.p99_most * b.quantile(0.99):
                self.state, self.reason = "reverted", "the 99th percentile rose"
            elif self.state == "shadow":
                self.state, self.step = "canary", 0
                self.candidate = Histogram()
            elif self.step + 1 < len(STEPS):
                self.step += 1
                self.candidate = Histogram()
            else:
                self.state, self.reason = "promoted", "same answers, latency within bounds"
        elif self.advances > s.stall_after:
            self.state, self.reason = "reverted", "stalled: too few queries"
        return self.state


def propose(t: Telemetry, have: set[str], least: int) -> list[Proposal]:
    """Changes that the traffic asks for and that aren't there yet."""
    out: list[Proposal] = []

    def add(opt: str, collection: str, change, n: int, reason: str) -> None:
        p = Proposal(opt, collection, change, n, reason)
        if n >= least and p.key not in have:
            out.append(p)

    for (c, f), n in t.equal.items():
        add("auto_index", c, Layout("bucketed", c, (f,)), n, f"{n} equality filters on {f}")
    for (c, f), n in t.ranges.items():
        add("auto_index", c, Layout("sorted", c, (f,)), n, f"{n} range filters on {f}")
    for (c, fs), n in t.together.items():
        add("auto_composite_index", c, Layout("bucketed", c, fs), n, f"{n} queries pin {', '.join(fs)} together")
    for (c, f, covers), n in t.covers.items():
        add("auto_covering_index", c, Layout("covering", c, (f,), covers), n, f"{n} queries filter {f} and read {', '.join(covers)} alone")
    for key, plan in t.aggregates.items():
        if (v := View.of(plan)) and t.asked[key]:
            add("materialized_view", v.collection, v, t.asked[key], f"asked {t.asked[key]} times")
    asked: dict[str, int] = {}
    for key, plan in t.aggregates.items():
        for c in plan.collections():
            asked[c] = asked.get(c, 0) + t.asked[key]
    for c, n in asked.items():
        add("column_store", c, Layout("cached", c), n, f"{n} aggregates over its rows")
    for c, n in t.by_id.items():
        add("direct_lookup", c, Layout("direct", c), n, f"{n} lookups by id")
    return out


class AdaptiveDriver:
    """Chooses among proposals, one experiment at a time."""

    def __init__(self, policy: Policy | None = None, settings: Settings | None = None, allowed: list[str] | None = None):
        self.policy, self.settings = policy or Policy(), settings or Settings()
        self.allowed = set(allowed if allowed is not None else REGISTRY)
        self.cycle = 0
        self.last_change: dict[str, int] = {}
        self.retracted: dict[str, int] = {}
        self.gains: dict[str, float] = {}
        self.log: list[Decision] = []

    def note(self, what: str, target: str, verdict: str, reason: str) -> None:
        self.log.append(Decision(self.cycle, what, target, verdict, reason))

    def consider(self, t: Telemetry, have: set[str]) -> list[Proposal]:
        """The admitted proposals of a cycle, best first."""
        self.cycle += 1
        s = self.settings
        out = []
        for p in propose(t, have, s.least_observations):
            o = REGISTRY[p.optimization]
            if p.optimization not in self.allowed or not o.automatic:
                continue
            if not self.policy.allows(o):
                self.note(p.optimization, p.key, "refused", "the policy's guarantees forbid it")
                continue
            if self.cycle - self.last_change.get(p.collection, -s.cooldown) < s.cooldown or self.cycle - self.retracted.get(p.key, -s.retraction_cooldown) < s.retraction_cooldown:
                continue
            score = self.policy.score(o, self.gains.get(p.optimization))
            if score < s.admit:
                self.note(p.optimization, p.key, "declined", f"score {score:.2f} under {s.admit}")
                continue
            out.append((score, p))
        out.sort(key=lambda x: (-x[0], -x[1].observations, x[1].key))
        chosen = [p for _, p in out[: s.changes_per_cycle]]
        for p in chosen:
            self.last_change[p.collection] = self.cycle
            self.note(p.optimization, p.key, "proposed", p.reason)
        return chosen

    def finished(self, e: Experiment) -> None:
        p = e.proposal
        if e.base.n and e.candidate.n and e.base.quantile(0.5) > 0:
            gain = 1 - e.candidate.quantile(0.5) / e.base.quantile(0.5)
            self.gains[p.optimization] = max(-1.0, min(1.0, 0.5 * self.gains.get(p.optimization, REGISTRY[p.optimization].speed) + 0.5 * gain))
        if e.state == "reverted":
            self.retracted[p.key] = self.cycle
        self.note(p.optimization, p.key, e.state, e.reason)

    def worth_keeping(self, p: Proposal) -> bool:
        return self.policy.score(REGISTRY[p.optimization], self.gains.get(p.optimization)) >= self.settings.keep


def serves(change: Layout | View, plan: Op, epoch: int) -> bool:
    """Whether a change under trial could answer a plan."""
    from .layouts import choose

    if isinstance(change, View):
        return change.answers(plan, epoch)
    return len(plan.collections()) == 1 and choose([change], change.collection, plan, epoch)[0] is not None
