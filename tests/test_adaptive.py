import pytest

from facet.engine import Engine
from facet.functions.expr import f
from facet.operators.relational import Unsupported
from facet.optimizer.adaptive import AdaptiveDriver, Experiment, Proposal, Settings
from facet.optimizer.layouts import Layout
from facet.optimizer.registry import REGISTRY, Policy, at_level, cache_size
from facet.optimizer.views import View
from facet.plans.logical import count, get, over, scan

QUICK = Settings(least_observations=3, cooldown=0, samples_per_step=2, judge_p99_from=10**6, early_p50_most=1e9)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, root=f"file://{tmp_path}", level=1, driver=AdaptiveDriver(settings=QUICK))
    e.register("c", spark.range(200).selectExpr("id as _id", "id % 5 as k", "id % 50 as v", "cast(id as double) / 4 as x"))
    return e


def test_registry_and_levels():
    assert len(REGISTRY) == 15
    assert at_level(0) == [] and at_level(1) == ["plan_cache", "result_cache"]
    assert "freeze_schema" not in at_level(10) and "freeze_schema" in at_level(0, on=("freeze_schema",))
    assert "auto_index" not in at_level(10, off=("auto_index",))
    assert (cache_size("plan_cache", 1), cache_size("result_cache", 3)) == (512, 4096)
    with pytest.raises(ValueError):
        at_level(11)


def test_an_experiment_is_promoted_and_answers_stay(engine):
    q = scan("c").filter(f("k") == 3).project("v")
    want = [tuple(r) for r in engine.collect(q)]
    states = set()
    for _ in range(40):
        for _ in range(3):
            engine.set_level(1, off=("result_cache",))
            assert [tuple(r) for r in engine.collect(q)] == want
        engine.optimize()
        if engine.experiment:
            states.add((engine.experiment.state, engine.experiment.share))
        if engine.layouts:
            break
    assert engine.layouts and engine.layouts[0].kind in ("bitmap", "bucketed", "covering")
    assert ("shadow", 0.0) in states and ("canary", 0.01) in states and ("canary", 1.0) in states
    assert [tuple(r) for r in engine.collect(q)] == want
    log = engine.explain_optimizations()
    assert "proposed" in log and "promoted" in log
    assert "reads c: " + engine.layouts[0].name in engine.explain(q)


def test_one_difference_ends_an_experiment():
    e = Experiment(Proposal("auto_index", "c", Layout("sorted", "c", ("k",)), 5, ""), QUICK)
    e.built()
    e.observe(True, 1.0, 1.0)
    e.observe(False, 1.0, 0.1)
    assert e.advance() == "reverted" and "differed" in e.reason


def test_a_slow_copy_goes_back_and_a_quiet_one_stalls():
    p = Proposal("auto_index", "c", Layout("sorted", "c", ("k",)), 5, "")
    e = Experiment(p, Settings(samples_per_step=50))
    e.built()
    for _ in range(30):
        e.observe(True, 1.0, 2.0)
    assert e.advance() == "reverted" and "median" in e.reason
    e = Experiment(p, Settings(stall_after=3))
    e.built()
    assert [e.advance() for _ in range(4)][-1] == "reverted" and "stalled" in e.reason


def test_policy_and_cooldowns():
    d = AdaptiveDriver(Policy(copies=False), QUICK)
    from facet.optimizer.telemetry import Telemetry

    t = Telemetry()
    for _ in range(10):
        t.record(scan("c").filter(f("k") == 1), 0.1)
    assert d.consider(t, set()) == [] and "forbid" in str(d.log[-1])
    d = AdaptiveDriver(settings=Settings(least_observations=3, retraction_cooldown=5))
    (p, *_) = d.consider(t, set())
    e = Experiment(p, d.settings)
    e.state, e.reason = "reverted", "test"
    d.finished(e)
    d.last_change.clear()
    assert p.key not in [x.key for x in d.consider(t, set())]
    assert "facet_queries_total 10" in t.prometheus()


def test_views_are_exact_or_step_aside(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 4 else None, i) for i in range(50)], "_id long, g long, v long")
    q = scan("c").aggregate(["g"], count(output="n"), count("v", "nv"), over("sum", "v", "s"), over("avg", "v", "a"))
    e = Engine(spark)
    e.register("c", rows)
    want = [tuple(r) for r in e.collect(q)]
    v = e.add_view(q)
    assert v.exact and [tuple(r) for r in e.collect(q)] == want
    assert not v.answers(q.limit(1), e.epoch("c")) and not v.answers(scan("c").filter(f("v") > 1).aggregate(["g"], count(output="n")), e.epoch("c"))
    assert View.of(scan("c").aggregate(["g"], over("min", "v"))) is None
    with pytest.raises(Unsupported):
        e.add_view(scan("c"))
    e.register("f", rows.selectExpr("_id", "g", "v / 3 as v"))
    assert not e.add_view(scan("f").aggregate(["g"], over("sum", "v", "s"))).exact


def test_result_cache_follows_writes(spark):
    e = Engine(spark, level=1)
    e.register("c", spark.range(5).selectExpr("id as _id", "id as v"))
    q = scan("c").aggregate([], count(output="n"))
    assert e.collect(q)[0][0] == 5 and e.collect(q)[0][0] == 5
    assert e.telemetry.caches["result", "hit"] == 1
    e.register("c", spark.range(6).selectExpr("id as _id", "id as v"))
    assert e.collect(q)[0][0] == 6


def test_refusals(engine, spark):
    engine.register("d", spark.range(3).selectExpr("id as _id", "id as k"))
    with pytest.raises(Unsupported):
        engine.query(scan("c").join(scan("c"), "inner", ("k", "k")))
    with pytest.raises(Unsupported):
        engine.query(scan("c").join(scan("d"), "inner", ("k", "k")).join(scan("d"), "inner", ("k", "k")))
    with pytest.raises(ValueError):
        scan("c").join(scan("d"), "cross", ("k", "k"))
    assert [r["v"] for r in engine.collect(get("c", 7))] == [7]


def test_like_escapes(spark):
    e = Engine(spark)
    e.register("c", spark.createDataFrame([(k, s) for k, s in enumerate(["a%b", "axb", "a\\b", "a_b", "ab\\", None, "A%B"])], "_id long, s string"))
    ask = lambda p: [r["s"] for r in e.collect(scan("c").filter(f("s").like(p)))]
    assert ask(r"a\%b") == ["a%b"] and ask(r"a\_b") == ["a_b"] and ask(r"\a_\b") == ["a%b", "axb", "a\\b", "a_b"]
    assert ask("ab\\") == ["ab\\"] and ask(r"a\\b") == ["a\\b"] and ask("%") == ["a%b", "axb", "a\\b", "a_b", "ab\\", "A%B"]


def test_exact_arithmetic(spark):
    from decimal import Decimal

    e = Engine(spark)
    e.register("c", spark.createDataFrame([(0, Decimal("10.00"), 7, -7, 2**62)], "_id long, d decimal(10,2), a long, b long, big long"))
    holds = lambda p: len(e.collect(scan("c").filter(p))) == 1
    assert holds(f("d") + Decimal("0.50") == Decimal("10.50")) and holds(f("a") / 2 == 3) and holds(f("b") / 2 == -3)
    assert holds(f("d") / 3 == Decimal("3.33")) and not holds(f("a") / 0 == 0) and not holds(~(f("a") / 0 == 0))
    assert holds(f("big") * 4 == 2**64) and holds(f("a") / 2.0 == 3.5) and holds(f("big") * f("big") * f("big") > 1e55)


def test_large_results_stay_in_spark(spark):
    e = Engine(spark, level=1, small_rows=3)
    e.register("c", spark.range(5).selectExpr("id as _id", "id as v"))
    assert len(e.collect(scan("c"))) == 5 == len(e.collect(scan("c")))
    assert e.results[scan("c").key()][1] is None
    assert len(e.collect(scan("c").limit(2))) == 2 and e.results[scan("c").limit(2).key()][2] is None
    e.set_level(0)
    assert not e.results


def test_prepared_lookups_follow_writes(spark):
    e = Engine(spark, level=10, slow_seconds=0.0)
    e.set_level(10, off=("result_cache",))
    e.register("c", spark.range(5).selectExpr("id as _id", "id * 2 as v", "id as w"))
    want = e.collect(get("c", 3))
    e.lookups["c"] = 255
    assert e.collect(get("c", 3)) == want and e.prepared["c"][1] is not None
    assert e.collect(get("c", 3), tag="t") == want and e.collect(get("c", 99)) == [] and e.collect(get("c", 3))[0].__fields__ == ["v", "w"]
    e.register("c", spark.range(5).selectExpr("id as _id", "id * 3 as v", "id as w"))
    assert e.collect(get("c", 3))[0]["v"] == 9
    e.cancel("t")
    assert len(e.slow) == 6 and "GetById c 3" in e.slow[0][1]


def test_promoted_changes_that_do_not_pay_are_taken_back(spark, engine, tmp_path):
    import os

    q = scan("c").filter(f("v") == 3).project("k")
    change = Layout("bucketed", "c", ("v",))
    p = Proposal("auto_index", "c", change, 5, "")

    def promote(gain):
        x = engine.add_layout("bucketed", "c", ["v"])
        p.change = x
        engine.promoted.append((p, engine.driver.cycle, 0))
        engine.driver.gains["auto_index"] = gain
        return x

    want = sorted(tuple(r) for r in engine.query(q).collect())
    x = promote(0.9)
    engine.optimize()
    assert x in engine.layouts and os.path.exists(x.path.removeprefix("file://"))
    engine.driver.gains["auto_index"] = 0.0
    engine.optimize()
    assert x not in engine.layouts and not engine.promoted and not os.path.exists(x.path.removeprefix("file://"))
    assert "retracted" in engine.explain_optimizations()
    assert sorted(tuple(r) for r in engine.query(q).collect()) == want
    x = promote(0.9)
    for _ in range(QUICK.unused_after + 1):
        engine.optimize()
        engine.experiment = None
    assert x not in engine.layouts and "unused" in engine.explain_optimizations()


def test_bitmap_copies(spark, engine):
    engine.register("m", spark.createDataFrame([(k, None if k % 7 == 0 else f"v{k % 3}", k % 4, float(k % 2)) for k in range(60)], "_id long, s string, n int, d double"))
    x = engine.add_layout("bitmap", "m", ["s"])
    for value in ("v1", "none such", 3):
        q = scan("m").filter(f("s") == value)
        got = [tuple(r) for r in engine.query(q).collect()]
        plain = Engine(spark)
        plain.register("m", engine.rows("m"))
        assert got == [tuple(r) for r in plain.query(q).collect()]
    assert x.uses == 3 and all(engine.verify().values())
    assert "PartitionFilters: [isnotnull(_facet_value" in engine.explain(scan("m").filter(f("s") == "v1"))
    y = engine.add_layout("bitmap", "m", ["n"])
    assert [tuple(r) for r in engine.query(scan("m").filter(f("n") == 2.0)).collect()] == [tuple(r) for r in plain.query(scan("m").filter(f("n") == 2.0)).collect()] and y.uses == 1
    for field in ("d", "_id"):
        engine.register("w", spark.range(1000).selectExpr("id as _id", "cast(id % 2 as double) as d"))
        with pytest.raises(ValueError):
            engine.add_layout("bitmap", "w", [field])
    engine.drop_layout(x)


def test_the_sessions_codec_is_put_back(spark):
    name = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(name)
    e = Engine(spark, level=2)
    assert spark.conf.get(name) == "zstd"
    e.set_level(0)
    assert spark.conf.get(name) == before
