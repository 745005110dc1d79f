"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) has the tables, BENCH_CPUS (default 8) is the number of local cores. Each query of the reference's mixes runs over the plain rows and through the layouts that serve it; the answers must be equal. "queries" has the median
seconds, "p99" the slowest of the repeats, "ratio" each layout's share of the plain scan's time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("OMP_NUM_THREADS", "1")


def main() -> None:
    from pyspark.sql import SparkSession

    from facet.functions.expr import f
    from facet.plans.logical import SortKey, count, get, over, scan
    from facet.queries import engine

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")

    mixes = {
        "identity": get("orders", 4242),
        "point_sort_limit": scan("orders").filter(f("o_custkey") == 7).sort(SortKey("o_totalprice", True)).limit(20),
        "range_limit": scan("orders").filter((f("o_totalprice") >= 100_000.0) & (f("o_totalprice") < 105_000.0)).project("o_custkey", "o_totalprice").limit(50),
        "top20": scan("orders").sort(SortKey("o_totalprice", True)).limit(20),
        "group_count": scan("orders").aggregate(["o_orderstatus"], count(output="n"), over("sum", "o_custkey", "s")),
        "filtered_group": scan("lineitem").filter(f("l_quantity") >= 10.0).aggregate(["l_returnflag", "l_linestatus"], count(output="n"), over("sum", "l_extendedprice", "price")),
        "count_all": scan("lineitem").aggregate([], count(output="n")),
        "join_inner": scan("customer").join(scan("orders"), "inner", ("c_custkey", "o_custkey")).aggregate(["customer.c_mktsegment"], count(output="n"), over("sum", "orders.o_totalprice", "total")),
    }
    tables = ("customer", "orders", "lineitem")
    plain, cached = engine(spark, sf, 0, *tables), engine(spark, sf, 3, *tables)
    tuned, covering, viewed = (engine(spark, sf, 1, *tables) for _ in range(3))
    tuned.set_level(1, off=("result_cache",))
    covering.set_level(1, off=("result_cache",))
    viewed.set_level(4, off=("result_cache",))
    tuned.add_layout("bucketed", "orders", ["o_custkey"])
    tuned.add_layout("sorted", "orders", ["o_totalprice"])
    tuned.add_layout("direct", "orders")
    covering.add_layout("covering", "orders", ["o_totalprice"], ["o_custkey"])
    viewed.add_view(mixes["group_count"])
    prepared = engine(spark, sf, 0, *tables)
    prepared.small_rows = 1_000_000
    prepared.set_level(0, on=("direct_lookup",))
    prepared.lookups["orders"] = 255
    runs = [("plain", plain, mixes), ("layout", tuned, ("identity", "point_sort_limit", "range_limit")), ("covering", covering, ("range_limit",)), ("view", viewed, ("group_count",)), ("cached", cached, mixes), ("prepared", prepared, ("identity",))]

    queries, p99, answers = {}, {}, {}
    for label, e, names in runs:
        for name in names:
            took = []
            for k in range(7):
                began = time.perf_counter()
                got = [tuple(r) for r in e.collect(mixes[name])]
                if k > 1:  # the first two compile code and fill caches
                    took.append(time.perf_counter() - began)
            assert answers.setdefault(name, got) == got, f"{name} through {label} differs"
            key = name if label == "plain" else f"{name}@{label}"
            queries[key], p99[key] = round(statistics.median(took), 7), round(max(took), 7)
    ratio = {k: round(v / queries[k.split("@")[0]], 5) for k, v in queries.items() if "@" in k}
    total = round(sum(v for k, v in queries.items() if "@" not in k), 4)
    print(json.dumps({"metric": "sum of median seconds over the plain rows", "value": total, "unit": "sec", "queries": queries, "p99": p99, "ratio": ratio, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
