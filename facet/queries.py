"""Queries over the test tables, each with the SQL it must equal. Sums of doubles go by way of decimals on both sides, so that the order of rows doesn't show in the last bits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.expr import And, Arith, Compare, In, IsNull, Lit, Not, Or, f
from .plans.logical import SortKey, count, get, get_many, over, query_spec, scan
from .sources.shared import shared_dir
from .sources.store import Store

IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, level: int = 0, *tables: str) -> Engine:
    e = Engine(spark, root=f"{shared_dir(spark)}/layouts-{uuid.uuid4().hex}", level=level, exact_sums=2)
    for t in tables or (*IDS, "lineitem"):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t in IDS:
            e.register(t, df, id=IDS[t])
        else:  # no key of its own; used in aggregates and unordered filters alone, so any number will do
            e.register(t, df.withColumn("_id", F.monotonically_increasing_id()))
    return e


def plan(name: str, build: Callable, oracle: str, *tables: str) -> None:
    """Registers a query given as a plan, or as SQL text, over some tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, 0, *tables)
        made = build()
        return e.sql(made) if isinstance(made, str) else e.query(made)

    QUERIES[name], ORACLES[name] = run, oracle


def through(name: str, build: Callable[[Engine], DataFrame], oracle: str, *tables: str, level: int = 0) -> None:
    """Registers a query that goes through a physical design, which must not change its answer."""
    QUERIES[name] = lambda spark, sf_dir: build(engine(spark, sf_dir, level, *tables))
    ORACLES[name] = oracle


CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
SUM = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
AVG = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({0})"

# lookups and scans
plan("get_by_id", lambda: get("customer", 42), f"SELECT {CUSTOMER} FROM customer WHERE c_custkey = 42", "customer")
plan("get_by_id_missing", lambda: get("customer", -1), f"SELECT {CUSTOMER} FROM customer WHERE c_custkey = -1", "customer")
plan("get_by_ids_dedup", lambda: get_many("customer", [5, 3, 3, 99_999_999]), f"SELECT {CUSTOMER} FROM customer WHERE c_custkey IN (5, 3)", "customer")
plan("get_by_ids_many", lambda: get_many("customer", range(0, 4000, 3)), f"SELECT {CUSTOMER} FROM customer WHERE c_custkey < 4000 AND c_custkey % 3 = 0", "customer")
plan("scan_all", lambda: scan("nation"), "SELECT * FROM nation", "nation")
plan("query_spec", lambda: query_spec("orders", "o_totalprice", ">", 300_000.0, 25), "SELECT * FROM orders WHERE o_totalprice > 300000.0 ORDER BY o_orderkey LIMIT 25", "orders")

# comparisons and three-valued logic
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    plan(f"filter_{_name}", lambda op=_op: scan("customer").filter(Compare(op, f("c_nationkey"), Lit(7))), f"SELECT {CUSTOMER} FROM customer WHERE c_nationkey {_op} 7", "customer")
plan(
    "filter_and_or_not",
    lambda: scan("orders").filter(Or((And((f("o_orderstatus") == "F", f("o_totalprice") > 200_000.0)), Not(f("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"))))),
    "SELECT * FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000.0) OR NOT (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'))",
    "orders",
)
plan("filter_range_two_sided", lambda: scan("orders").filter((f("o_totalprice") >= 1000.0) & (f("o_totalprice") < 50_000.0)), "SELECT * FROM orders WHERE o_totalprice >= 1000.0 AND o_totalprice < 50000.0", "orders")
plan("filter_empty_and", lambda: scan("nation").filter(And(())), "SELECT * FROM nation", "nation")
plan("filter_empty_or", lambda: scan("nation").filter(Or(())), "SELECT * FROM nation WHERE false", "nation")
plan("filter_in", lambda: scan("part").filter(f("p_size").isin(1, 7, 15)), "SELECT * FROM part WHERE p_size IN (1, 7, 15)", "part")
plan("filter_not_in", lambda: scan("part").filter(~f("p_size").isin(1, 7, 15)), "SELECT * FROM part WHERE p_size NOT IN (1, 7, 15)", "part")
plan("filter_in_null", lambda: scan("part").filter(f("p_size").isin(1, None)), "SELECT * FROM part WHERE p_size IN (1, NULL)", "part")
plan("filter_not_in_null", lambda: scan("part").filter(~f("p_size").isin(1, None)), "SELECT * FROM part WHERE p_size NOT IN (1, NULL)", "part")
plan("filter_in_fields", lambda: scan("part").filter(In(f("p_size"), (f("p_partkey"), Lit(3)))), "SELECT * FROM part WHERE p_size IN (p_partkey, 3)", "part")
plan("filter_like_prefix", lambda: scan("part").filter(f("p_name").like("b%")), "SELECT * FROM part WHERE p_name LIKE 'b%'", "part")
plan("filter_like_underscore", lambda: scan("part").filter(f("p_brand").like("Brand#_1")), "SELECT * FROM part WHERE p_brand LIKE 'Brand#_1'", "part")
plan("filter_like_escape", lambda: scan("customer").filter(f("c_name").like(r"\Cust_mer\#%7")), "SELECT * FROM customer WHERE c_name LIKE 'Cust_mer#%7'", "customer")
plan("filter_not_like", lambda: scan("part").filter(~f("p_type").like("%A%L")), "SELECT * FROM part WHERE NOT (p_type LIKE '%A%L')", "part")
plan("filter_like_number", lambda: scan("part").filter(f("p_size").like("1%")), "SELECT * FROM part WHERE false", "part")
plan("filter_cross_rank", lambda: scan("nation").filter(f("n_name") > 5), "SELECT * FROM nation", "nation")
plan("filter_cross_rank_equal", lambda: scan("nation").filter(Or((f("n_name") == 5, f("n_nationkey") >= "a"))), "SELECT * FROM nation WHERE false", "nation")
plan("filter_bare_field", lambda: scan("nation").filter(f("n_name")), "SELECT * FROM nation WHERE false", "nation")
plan("filter_absent_field", lambda: scan("nation").filter(Or((f("nope") == 1, IsNull(f("nope"))))), "SELECT * FROM nation", "nation")
plan("filter_null_of_predicate", lambda: scan("nation").filter(IsNull(f("n_nationkey") == 1)), "SELECT * FROM nation", "nation")
plan("filter_arith_add", lambda: scan("part").filter(f("p_size") + f("p_partkey") > 1000), "SELECT * FROM part WHERE p_size + p_partkey > 1000", "part")
plan("filter_arith_sub", lambda: scan("part").filter(f("p_size") - 10 >= 20), "SELECT * FROM part WHERE p_size - 10 >= 20", "part")
plan("filter_arith_mul", lambda: scan("part").filter(f("p_size") * 3 == 21), "SELECT * FROM part WHERE p_size * 3 = 21", "part")
plan("filter_arith_div_trunc", lambda: scan("part").filter(f("p_size") / 4 == 3), "SELECT * FROM part WHERE p_size // 4 = 3", "part")
plan("filter_arith_div_zero", lambda: scan("part").filter(Arith("/", f("p_size"), f("p_size") - 7) >= 0), "SELECT * FROM part WHERE p_size <> 7 AND CAST(trunc(p_size / (p_size - 7)) AS INT) >= 0", "part")
plan("filter_arith_float", lambda: scan("orders").filter(f("o_totalprice") / 2 > 120_000.5), "SELECT * FROM orders WHERE o_totalprice / 2 > 120000.5", "orders")

# projections
plan("project", lambda: scan("customer").project("c_name", "c_acctbal"), "SELECT c_name, c_acctbal FROM customer", "customer")
plan("project_dedup", lambda: scan("customer").project("c_name", "c_acctbal", "c_name"), "SELECT c_name, c_acctbal FROM customer", "customer")
plan("project_missing_field", lambda: scan("nation").project("n_name", "nope"), "SELECT n_name, CAST(NULL AS VARCHAR) AS nope FROM nation", "nation")

# order and limits
plan("sort_multi_key", lambda: scan("part").sort("p_size", SortKey("p_retailprice", True)).limit(50), "SELECT * FROM part ORDER BY p_size, p_retailprice DESC, p_partkey LIMIT 50", "part")
plan("topk_asc", lambda: scan("orders").sort("o_totalprice").limit(20), "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20", "orders")
plan("topk_desc", lambda: scan("orders").sort(SortKey("o_totalprice", True)).limit(20), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "orders")
plan("topk_ties_by_id", lambda: scan("orders").sort(SortKey("o_orderstatus", True)).limit(20), "SELECT * FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 20", "orders")
plan("limit_id_order", lambda: scan("events").limit(17), "SELECT * FROM events ORDER BY event_id LIMIT 17", "events")
plan("limit_zero", lambda: scan("events").limit(0), "SELECT * FROM events LIMIT 0", "events")
plan("limit_over_filtered_range", lambda: scan("orders").filter((f("o_totalprice") >= 50_000.0) & (f("o_totalprice") < 90_000.0)).limit(50), "SELECT * FROM orders WHERE o_totalprice >= 50000.0 AND o_totalprice < 90000.0 ORDER BY o_orderkey LIMIT 50", "orders")
plan("limit_then_filter", lambda: scan("orders").limit(100).filter(f("o_orderstatus") == "F"), "SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) WHERE o_orderstatus = 'F'", "orders")
plan("sort_by_projected_away", lambda: scan("customer").project("c_name").sort("c_acctbal").limit(5), "SELECT c_name FROM customer ORDER BY c_custkey LIMIT 5", "customer")
plan("sort_project_limit", lambda: scan("customer").sort(SortKey("c_acctbal", True)).project("c_name").limit(5), "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5", "customer")

# aggregates
_G = "l_returnflag, l_linestatus"
plan("agg_count_star", lambda: scan("lineitem").aggregate(["l_returnflag", "l_linestatus"], count(output="n")), f"SELECT {_G}, COUNT(*) AS n FROM lineitem GROUP BY {_G}", "lineitem")
plan("agg_count_field", lambda: scan("lineitem").aggregate(["l_returnflag"], count("l_tax", "n")), "SELECT l_returnflag, COUNT(l_tax) AS n FROM lineitem GROUP BY l_returnflag", "lineitem")
plan("agg_sum", lambda: scan("lineitem").aggregate(["l_returnflag", "l_linestatus"], over("sum", "l_quantity", "qty"), over("sum", "l_extendedprice", "price"), count(output="n")), f"SELECT {_G}, {SUM.format('l_quantity')} AS qty, {SUM.format('l_extendedprice')} AS price, COUNT(*) AS n FROM lineitem GROUP BY {_G}", "lineitem")
plan("agg_sum_of_ints", lambda: scan("part").aggregate(["p_brand"], over("sum", "p_size", "size")), "SELECT p_brand, CAST(SUM(p_size) AS DOUBLE) AS size FROM part GROUP BY p_brand", "part")
plan("agg_sum_of_text", lambda: scan("part").aggregate(["p_brand"], over("sum", "p_name", "s"), over("avg", "p_name", "a")), "SELECT p_brand, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS a FROM part GROUP BY p_brand", "part")
plan("agg_avg", lambda: scan("lineitem").aggregate(["l_returnflag", "l_linestatus"], over("avg", "l_discount", "discount")), f"SELECT {_G}, {AVG.format('l_discount')} AS discount FROM lineitem GROUP BY {_G}", "lineitem")
plan("agg_min_max", lambda: scan("events").aggregate(["event_type"], over("min", "ts", "first"), over("max", "ts", "last"), over("min", "value", "low"), over("max", "props", "props")), "SELECT event_type, MIN(ts) AS first, MAX(ts) AS last, MIN(value) AS low, MAX(props) AS props FROM events GROUP BY event_type", "events")
plan("agg_global", lambda: scan("orders").aggregate([], count(output="n"), over("sum", "o_totalprice", "total"), over("max", "o_orderpriority", "p")), f"SELECT COUNT(*) AS n, {SUM.format('o_totalprice')} AS total, MAX(o_orderpriority) AS p FROM orders", "orders")
plan("agg_global_empty", lambda: scan("orders").filter(f("o_orderkey") < 0).aggregate([], count(output="n"), over("sum", "o_totalprice", "total"), over("min", "o_orderstatus", "s")), "SELECT COUNT(*) AS n, CAST(SUM(o_totalprice) AS DOUBLE) AS total, MIN(o_orderstatus) AS s FROM orders WHERE o_orderkey < 0", "orders")
plan("agg_grouped_empty", lambda: scan("orders").filter(f("o_orderkey") < 0).aggregate(["o_orderstatus"], count(output="n")), "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus", "orders")
plan("agg_filtered", lambda: scan("events").filter(f("value") >= 50.0).aggregate(["event_type"], count(output="n"), over("sum", "value", "v")), f"SELECT event_type, COUNT(*) AS n, {SUM.format('value')} AS v FROM events WHERE value >= 50.0 GROUP BY event_type", "events")
plan("agg_then_sort_limit", lambda: scan("events").aggregate(["user_id"], count(output="n")).sort(SortKey("n", True)).limit(10), "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10", "events")
plan("agg_absent_key", lambda: scan("nation").aggregate(["nope"], count(output="n"), count("nope", "k")), "SELECT CAST(NULL AS VARCHAR) AS nope, COUNT(*) AS n, CAST(0 AS BIGINT) AS k FROM nation", "nation")

# joins
_C = ", ".join(f'c.{c} AS "customer.{c}"' for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
_O = ", ".join(f'o.{c} AS "orders.{c}"' for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
plan("join_inner", lambda: scan("customer").join(scan("orders"), "inner", ("c_custkey", "o_custkey")), f"SELECT {_C}, {_O} FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", "customer", "orders")
plan("join_left", lambda: scan("customer").join(scan("orders"), "left", ("c_custkey", "o_custkey")), f"SELECT {_C}, {_O} FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "customer", "orders")
_few = lambda: scan("customer").join(scan("orders").filter(f("o_totalprice") > 400_000.0), "left", ("c_custkey", "o_custkey"))
_FEW = f"SELECT {_C}, {_O} FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000.0) o ON c.c_custkey = o.o_custkey"
plan("join_left_unmatched", _few, _FEW, "customer", "orders")
plan("filter_is_null", lambda: _few().filter(f("orders.o_orderkey").is_null()), f'SELECT * FROM ({_FEW}) WHERE "orders.o_orderkey" IS NULL', "customer", "orders")
plan("filter_is_not_null", lambda: _few().filter(f("orders.o_orderkey").is_not_null()), f'SELECT * FROM ({_FEW}) WHERE "orders.o_orderkey" IS NOT NULL', "customer", "orders")
plan("sort_desc_nulls_first", lambda: _few().sort(SortKey("orders.o_totalprice", True)).limit(30), f'SELECT * FROM ({_FEW}) ORDER BY "orders.o_totalprice" DESC NULLS FIRST, "customer.c_custkey", "orders.o_orderkey" LIMIT 30', "customer", "orders")
plan("sort_asc_nulls_last", lambda: _few().sort("orders.o_totalprice").limit(30), f'SELECT * FROM ({_FEW}) ORDER BY "orders.o_totalprice" NULLS LAST, "customer.c_custkey", "orders.o_orderkey" LIMIT 30', "customer", "orders")
plan("agg_null_group_first", lambda: _few().aggregate(["orders.o_orderstatus"], count(output="n")).limit(1), f'SELECT "orders.o_orderstatus", COUNT(*) AS n FROM ({_FEW}) GROUP BY ALL ORDER BY "orders.o_orderstatus" NULLS FIRST LIMIT 1', "customer", "orders")
plan("join_filter", lambda: scan("customer").join(scan("orders"), "inner", ("c_custkey", "o_custkey")).filter(f("customer.c_mktsegment") == "BUILDING").project("customer.c_name", "orders.o_totalprice"), "SELECT c.c_name AS \"customer.c_name\", o.o_totalprice AS \"orders.o_totalprice\" FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING'", "customer", "orders")
plan("join_agg", lambda: scan("customer").join(scan("orders"), "inner", ("c_custkey", "o_custkey")).aggregate(["customer.c_mktsegment"], count(output="n"), over("sum", "orders.o_totalprice", "total")), f'SELECT c.c_mktsegment AS "customer.c_mktsegment", COUNT(*) AS n, {SUM.format("o.o_totalprice")} AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment', "customer", "orders")
plan("join_unlike_kinds", lambda: scan("nation").join(scan("region"), "left", ("n_name", "r_regionkey")), 'SELECT n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey", CAST(NULL AS INT) AS "region.r_regionkey", CAST(NULL AS VARCHAR) AS "region.r_name" FROM nation', "nation", "region")


def _null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join's output as a collection of its own: its null keys match nothing."""
    e = engine(spark, sf_dir, 0, "customer", "orders")
    half = e.query(_few(), ordered=False).select(F.col("`customer.c_custkey`").alias("c"), F.col("`orders.o_orderkey`").alias("o"))
    e.register("half", half.withColumn("_id", F.monotonically_increasing_id()))
    return e.query(scan("half").join(scan("orders"), "inner", ("o", "o_orderkey")).project("half.c", "orders.o_totalprice"))


QUERIES["join_null_key"] = _null_keys
ORACLES["join_null_key"] = f'SELECT h.c AS "half.c", o.o_totalprice AS "orders.o_totalprice" FROM (SELECT "customer.c_custkey" AS c, "orders.o_orderkey" AS o FROM ({_FEW})) h JOIN orders o ON h.o = o.o_orderkey'

# SQL
plan("sql_filter_sort_limit", lambda: "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 5000.0 AND NOT c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC LIMIT 10 -- best", "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 5000.0 AND c_mktsegment <> 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10", "customer")
plan("sql_group", lambda: "SELECT c_mktsegment, COUNT(*) AS n, AVG(c_acctbal) bal FROM customer GROUP BY c_mktsegment ORDER BY n DESC", f"SELECT c_mktsegment, COUNT(*) AS n, {AVG.format('c_acctbal')} AS bal FROM customer GROUP BY c_mktsegment", "customer")
plan("sql_default_names", lambda: "SELECT COUNT(*), SUM(c_acctbal), MAX(c_name) FROM customer", f"SELECT COUNT(*) AS count_star, {SUM.format('c_acctbal')} AS sum_c_acctbal, MAX(c_name) AS max_c_name FROM customer", "customer")
plan("sql_stray_column_ignored", lambda: "SELECT c_name, COUNT(*) AS n FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey", "customer")
plan("sql_order_by_absent", lambda: "SELECT c_name FROM customer ORDER BY c_acctbal LIMIT 7", "SELECT c_name FROM customer ORDER BY c_custkey LIMIT 7", "customer")
plan("sql_in_like_null", lambda: "SELECT * FROM part WHERE p_size IN (1, 2, NULL) OR (p_name LIKE 'b%' AND p_brand NOT LIKE '%1' AND p_type IS NOT NULL)", "SELECT * FROM part WHERE p_size IN (1, 2) OR (p_name LIKE 'b%' AND p_brand NOT LIKE '%1' AND p_type IS NOT NULL)", "part")
plan("sql_join", lambda: "SELECT nation.n_name, region.r_name FROM nation INNER JOIN region ON nation.n_regionkey = region.r_regionkey WHERE region.r_name <> 'ASIA' ORDER BY nation.n_name", "SELECT n_name AS \"nation.n_name\", r_name AS \"region.r_name\" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", "nation", "region")
plan("sql_left_join_group", lambda: "SELECT COUNT(orders.o_orderkey) AS n FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey GROUP BY customer.c_nationkey", 'SELECT c_nationkey AS "customer.c_nationkey", COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey', "customer", "orders")
plan("sql_qualified_is_absent", lambda: "SELECT c_name FROM customer WHERE customer.c_nationkey = 3", "SELECT c_name FROM customer WHERE false", "customer")

# physical designs
_POINT = lambda: scan("orders").filter(f("o_custkey") == 7)
_RANGE = lambda: scan("orders").filter((f("o_totalprice") >= 50_000.0) & (f("o_totalprice") < 60_000.0)).project("o_custkey", "o_totalprice")
_VIEW = lambda: scan("part").aggregate(["p_brand"], count(output="n"), over("sum", "p_size", "size"), over("avg", "p_size", "mean"))
_GROUPS = "SELECT p_brand, COUNT(*) AS n, CAST(SUM(p_size) AS DOUBLE) AS size, CAST(SUM(p_size) AS DOUBLE) / COUNT(p_size) AS mean FROM part GROUP BY p_brand"


def _with(kind: str, collection: str, fields, query: Callable, covers=None, condition=None) -> Callable[[Engine], DataFrame]:
    def build(e: Engine) -> DataFrame:
        x = e.add_layout(kind, collection, fields, covers, condition)
        out = e.query(query())
        assert x.uses, f"{x.name} was not read"
        return out

    return build


through("bucketed_equality", _with("bucketed", "orders", ["o_custkey"], _POINT), "SELECT * FROM orders WHERE o_custkey = 7", "orders")
through("sorted_range", _with("sorted", "orders", ["o_totalprice"], _RANGE), "SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 50000.0 AND o_totalprice < 60000.0", "orders")
through("delta_range", _with("delta", "orders", ["o_custkey"], lambda: scan("orders").filter(f("o_custkey") < 20)), "SELECT * FROM orders WHERE o_custkey < 20", "orders")
through("covering_range", _with("covering", "orders", ["o_totalprice"], _RANGE, ["o_custkey"]), "SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 50000.0 AND o_totalprice < 60000.0", "orders")
through("covering_lookup", _with("covering", "orders", ["o_custkey"], lambda: _POINT().project("o_totalprice"), ["o_totalprice"]), "SELECT o_totalprice FROM orders WHERE o_custkey = 7", "orders")
through("composite_lookup", _with("bucketed", "customer", ["c_nationkey", "c_mktsegment"], lambda: scan("customer").filter((f("c_nationkey") == 3) & (f("c_mktsegment") == "MACHINERY"))), "SELECT * FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY'", "customer")
through("partial_copy", _with("partial", "orders", ["o_orderkey"], lambda: scan("orders").filter((f("o_orderstatus") == "F") & (f("o_totalprice") > 250_000.0)), None, f("o_orderstatus") == "F"), "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000.0", "orders")
through("bitmap_equality", _with("bitmap", "customer", ["c_mktsegment"], lambda: scan("customer").filter((f("c_mktsegment") == "BUILDING") & (f("c_acctbal") > 0.0))), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0.0", "customer")
through("bitmap_whole_number", _with("bitmap", "customer", ["c_nationkey"], lambda: scan("customer").filter(f("c_nationkey") == 7)), "SELECT * FROM customer WHERE c_nationkey = 7", "customer")
through("direct_lookup", _with("direct", "customer", [], lambda: get("customer", 99)), f"SELECT {CUSTOMER} FROM customer WHERE c_custkey = 99", "customer")
through("column_store_agg", _with("cached", "part", [], _VIEW), _GROUPS, "part")


def _view(e: Engine) -> DataFrame:
    v = e.add_view(_VIEW())
    out = e.query(_VIEW())
    assert v.uses and all(e.verify().values())
    return out


def _view_after_writes(e: Engine) -> DataFrame:
    """A view brought forward by rows that come and go, and the same question asked of it."""
    rows = e.rows("part")
    e.register("part", rows.where("p_partkey % 3 <> 0"))
    v = e.add_view(_VIEW())
    e.register("part", rows.where("p_partkey % 5 <> 0"))
    v.apply(rows.where("p_partkey % 3 = 0 and p_partkey % 5 <> 0"), rows.where("p_partkey % 3 <> 0 and p_partkey % 5 = 0"), e.epoch("part"))
    return e.query(_VIEW())


def _cached_repeat(e: Engine) -> DataFrame:
    q = scan("part").filter(f("p_size") > 30).aggregate(["p_brand"], count(output="n"))
    first = e.collect(q)
    again = e.collect(q)
    assert again == first and e.telemetry.caches["result", "hit"] == 1
    return e.spark.createDataFrame(again, e.query(q).schema)


through("view_group_count", _view, _GROUPS, "part", level=4)
through("view_after_writes", _view_after_writes, _GROUPS.replace("FROM part", "FROM part WHERE p_partkey % 5 <> 0"), "part", level=4)
through("cached_repeat", _cached_repeat, "SELECT p_brand, COUNT(*) AS n FROM part WHERE p_size > 30 GROUP BY p_brand", "part", level=3)
through("shard_merge_group", lambda e: (e.register("orders", e.rows("orders").repartition(7, "_id")), e.query(scan("orders").aggregate(["o_orderstatus"], count(output="n"), over("sum", "o_totalprice", "total"))))[1], f"SELECT o_orderstatus, COUNT(*) AS n, {SUM.format('o_totalprice')} AS total FROM orders GROUP BY o_orderstatus", "orders")


def _plain_sums(e: Engine) -> DataFrame:
    """Sums and means of doubles as Spark adds them; whole values, so that the order of rows doesn't show."""
    e.exact_sums = None
    return e.query(scan("lineitem").aggregate(["l_returnflag"], over("sum", "l_quantity", "quantity"), over("avg", "l_quantity", "mean")))


through("agg_plain_doubles", _plain_sums, "SELECT l_returnflag, SUM(l_quantity) AS quantity, SUM(l_quantity) / COUNT(l_quantity) AS mean FROM lineitem GROUP BY l_returnflag", "lineitem")

# the store
_KEPT = "SELECT s_suppkey AS _id, s_suppkey, s_name, s_acctbal FROM supplier"


def _stored(steps: Callable) -> Query:
    """A collection of suppliers in a store of its own, some steps on it, and what it holds then."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
        store.create_collection("s")
        rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as _id", "s_suppkey", "s_name", "s_acctbal")
        store.insert_batch("s", rows)
        version = steps(store)
        return store.scan("s", version).select("_id", "s_suppkey", "s_name", "s_acctbal")

    return run


def _in_one_transaction(store: Store) -> None:
    with store.begin() as t:
        t.delete("s", 1)
        t.update("s", 2, {"s_suppkey": 2, "s_name": "two", "s_acctbal": 2.0})
        t.insert("s", 1_000_001, {"s_suppkey": 1_000_001, "s_name": "new", "s_acctbal": 0.5})
    aborted = store.begin()
    aborted.delete("s", 3)
    aborted.abort()


def _many_segments(store: Store) -> None:
    store.compact_after = 5
    for k in range(1, 9):
        store.update("s", k % 4, {"s_suppkey": k % 4, "s_name": f"again {k}", "s_acctbal": float(k)})


def _snapshot_of(store: Store) -> int:
    then = store.snapshot()
    store.delete("s", 5)
    return then


def _restored(store: Store) -> None:
    then = store.snapshot()
    for k in (4, 5, 6):
        store.delete("s", k)
    store.restore(then)


_AGAIN = "VALUES (1, 1, 'again 5', 5.0), (2, 2, 'again 6', 6.0), (3, 3, 'again 7', 7.0), (0, 0, 'again 8', 8.0)"
for _name, _steps, _sql in (
    ("store_insert", lambda s: s.insert("s", 1_000_000, {"s_suppkey": 1_000_000, "s_name": "more", "s_acctbal": 1.5}) and None, f"{_KEPT} UNION ALL SELECT 1000000, 1000000, 'more', 1.5"),
    ("store_update", lambda s: s.update("s", 7, {"s_suppkey": 7, "s_name": "seven"}) and None, f"{_KEPT} WHERE s_suppkey <> 7 UNION ALL SELECT 7, 7, 'seven', NULL"),
    ("store_delete", lambda s: s.delete("s", 7) and None, f"{_KEPT} WHERE s_suppkey <> 7"),
    ("store_transaction", _in_one_transaction, f"{_KEPT} WHERE s_suppkey NOT IN (1, 2) UNION ALL SELECT 2, 2, 'two', 2.0 UNION ALL SELECT 1000001, 1000001, 'new', 0.5"),
    ("store_segments_compacted", _many_segments, f"{_KEPT} WHERE s_suppkey NOT IN (0, 1, 2, 3) UNION ALL SELECT * FROM ({_AGAIN}) v(a, b, c, d)"),
    ("store_snapshot", _snapshot_of, _KEPT),
    ("store_restore", _restored, _KEPT),
):
    QUERIES[_name], ORACLES[_name] = _stored(_steps), _sql

# the benchmark's mixes
plan("bench_point_sort_limit", lambda: scan("orders").filter(f("o_orderstatus") == "F").sort(SortKey("o_totalprice", True)).limit(20), "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "orders")
plan("bench_range_limit", lambda: scan("orders").filter((f("o_totalprice") >= 100_000.0) & (f("o_totalprice") < 105_000.0)).limit(50), "SELECT * FROM orders WHERE o_totalprice >= 100000.0 AND o_totalprice < 105000.0 ORDER BY o_orderkey LIMIT 50", "orders")
plan("bench_agg", lambda: scan("customer").filter(f("c_acctbal") >= 0.0).aggregate(["c_nationkey"], count(output="n"), over("avg", "c_acctbal", "bal")), f"SELECT c_nationkey, COUNT(*) AS n, {AVG.format('c_acctbal')} AS bal FROM customer WHERE c_acctbal >= 0.0 GROUP BY c_nationkey", "customer")
plan("bench_identity", lambda: get("orders", 4242), "SELECT * FROM orders WHERE o_orderkey = 4242", "orders")
