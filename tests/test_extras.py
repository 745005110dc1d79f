from facet.cli import load, run_line
from facet.engine import Engine
from facet.optimizer.memory import WorkloadMemory, best_combination, fingerprint
from facet.optimizer.registry import Policy
from facet.optimizer.telemetry import Histogram, Telemetry
from facet.plans.logical import count, over, scan
from facet.streaming.follow import Follower


def test_a_view_follows_a_stream(spark, tmp_path):
    base = spark.range(10).selectExpr("id as _id", "id % 3 as g", "id as v")
    q = scan("c").aggregate(["g"], count(output="n"), over("sum", "v", "s"))
    e = Engine(spark)
    e.register("c", base)
    view = e.add_view(q)
    follower = Follower(view)
    for k in range(2):
        spark.range(100 * k + 100, 100 * k + 110).selectExpr("id as _id", "id % 4 as g", "id as v").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
        follower.start(stream, f"{tmp_path}/state", availableNow=True).awaitTermination()
    got = sorted(tuple(r) for r in e.query(q).collect())
    e.register("all", base.unionByName(spark.read.parquet(f"{tmp_path}/in")))
    assert got == sorted(tuple(r) for r in e.query(scan("all").aggregate(["g"], count(output="n"), over("sum", "v", "s"))).collect())
    follower.batch(base, follower.last)  # a batch that comes again
    assert sorted(tuple(r) for r in e.query(q).collect()) == got


def test_a_follower_goes_on_after_a_restart(spark, tmp_path):
    base = spark.range(10).selectExpr("id as _id", "id % 3 as g", "id as v")
    q = scan("c").aggregate(["g"], count(output="n"), over("sum", "v", "s"))

    def fresh():
        e = Engine(spark)
        e.register("c", base)
        return e, Follower(e.add_view(q), f"file://{tmp_path}/states")

    e, follower = fresh()
    follower.batch(base, 0)
    follower.batch(base, 1)
    got = sorted(tuple(r) for r in e.query(q).collect())
    e, again = fresh()
    assert again.last == 1
    again.batch(base, 1)  # delivered once more
    assert sorted(tuple(r) for r in e.query(q).collect()) == got
    assert again.view.state._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0


def test_memory_and_combinations():
    a, b = Telemetry(), Telemetry()
    for t, n in ((a, 30), (b, 31)):
        for _ in range(n):
            t.record(scan("c").limit(3), 0.1)
        for _ in range(10):
            t.record(scan("d"), 0.1)
    assert fingerprint(a) == fingerprint(b) != fingerprint(Telemetry())
    m = WorkloadMemory()
    m.remember(fingerprint(a), "auto_index", 0.8)
    m.remember(fingerprint(a), "auto_index", 0.4)
    assert abs(WorkloadMemory.loads(m.dumps()).recall(fingerprint(b))["auto_index"] - 0.6) < 1e-9
    some, score = best_combination(["auto_index", "materialized_view", "freeze_schema"], {"auto_index": 0.9, "materialized_view": 0.1}, budget=0.4)
    assert some == ["auto_index"] and score > 0
    assert best_combination(["auto_index"], {}, budget=0.1) == ([], 0.0)
    assert "freeze_schema" in best_combination(["freeze_schema"], {"freeze_schema": 1.0}, 1.0, Policy(rigid=True, freedom=0.1))[0]


def test_histogram_quantiles():
    h = Histogram()
    for k in range(1, 101):
        h.add(k / 1000)
    assert abs(h.quantile(0.5) - 0.050) < 0.003 and abs(h.quantile(0.99) - 0.099) < 0.005
    h.decay(0.5)
    assert h.n < 100


def test_shell(spark, tmp_path):
    e = Engine(spark)
    spark.range(3).selectExpr("id", "id * 2 as v").write.parquet(f"{tmp_path}/t.parquet")
    load(e, str(tmp_path))
    assert run_line(e, ".tables") == "t" and run_line(e, ".layouts") == "none"
    assert run_line(e, "select * from t where v > 1 order by v desc") == "id\tv\n2\t4\n1\t2"
    assert run_line(e, "select * from t where v > 9") == "no rows"
    assert run_line(e, "drop table t").startswith("error: DROP") and run_line(e, "select * from u").startswith("error")
    assert "reads t: no layout fits" in run_line(e, ".explain select * from t") and run_line(e, ".x") == "no command .x"
