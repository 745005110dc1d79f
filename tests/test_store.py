import datetime
from decimal import Decimal

import pytest

from facet.engine import Engine
from facet.plans.logical import count, scan
from facet.sources.schema import Column, FieldType, Schema, SchemaError, infer
from facet.sources.store import CollectionExists, Conflict, NoSuchCollection, RecordExists, Store, StoreError, UniqueViolation

STRICT = Schema("strict", (Column("name", FieldType("str", 8), True), Column("age", FieldType("i64"))))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create_collection("users", STRICT)
    return s


def rows(s, name="users", version=None):
    return [(r["_id"], r["name"], r["age"]) for r in s.scan(name, version).select("_id", "name", "age").orderBy("_id").collect()]


def test_reads_and_writes(store):
    store.insert("users", 3, {"name": "cy", "age": 5})
    store.insert_batch("users", [(1, {"name": "al"}), (2, {"name": "bo", "age": None})])
    assert rows(store) == [(1, "al", None), (2, "bo", None), (3, "cy", 5)]
    assert store.get("users", 2) == {"name": "bo"}  # null and absent are the same
    assert store.get("users", 9) is None
    assert store.get_projected("users", 3, ["age", "nope"]) == {"age": 5}
    assert store.peek_field("users", 2, "age") == (True, None)
    assert store.peek_field("users", 9, "age") == (False, None)
    assert store.update("users", 3, {"name": "di"}) is True
    assert store.update("users", 7, {"name": "ed"}) is False  # an upsert
    assert store.delete("users", 1) is True and store.delete("users", 1) is False
    assert rows(store) == [(2, "bo", None), (3, "di", None), (7, "ed", None)]
    assert store.insert_auto("users", {"name": "fy"}) == 8
    store.compact("users")
    assert store.ids("users") == [2, 3, 7, 8] and store.count("users") == 4


def test_errors(store):
    with pytest.raises(CollectionExists):
        store.create_collection("users")
    with pytest.raises(NoSuchCollection):
        store.scan("nope")
    store.insert("users", 1, {"name": "al"})
    with pytest.raises(RecordExists):
        store.insert("users", 1, {"name": "x"})
    before = store.version()
    with pytest.raises(RecordExists):
        store.insert_batch("users", [(5, {"name": "x"}), (5, {"name": "y"})])
    for bad in ({"name": "far too long"}, {"age": 3}, {"name": "x", "age": "3"}, {"name": "x", "more": 1}, {"name": "x", "age": True}):
        with pytest.raises(SchemaError):
            store.insert_batch("users", [(8, {"name": "ok"}), (9, bad)])
    assert store.version() == before and rows(store) == [(1, "al", None)]
    store.drop_collection("users")
    assert store.collections() == []


def test_bulk_insert_from_a_frame(spark, store):
    store.insert("users", 1, {"name": "al"})
    store.insert_batch("users", spark.range(10, 200).selectExpr("id as _id", "concat('n', id % 10) as name", "id % 7 as age"))
    assert store.count("users") == 191
    with pytest.raises(RecordExists):
        store.insert_batch("users", spark.range(5, 12).selectExpr("id as _id", "'x' as name", "0L as age"))
    with pytest.raises(SchemaError):
        store.insert_batch("users", spark.range(500, 501).selectExpr("id as _id", "'way too long' as name", "0L as age"))
    assert store.insert_auto("users", {"name": "z"}) == 200


def test_unique_ignores_null(store):
    store.insert_batch("users", [(1, {"name": "al", "age": 1}), (2, {"name": "bo"}), (3, {"name": "cy"})])
    store.add_unique("users", "age")
    with pytest.raises(UniqueViolation):
        store.insert("users", 4, {"name": "x", "age": 1})
    store.update("users", 1, {"name": "al", "age": 2})
    store.insert("users", 4, {"name": "x", "age": 1})
    store.update("users", 5, {"name": "al"})
    with pytest.raises(UniqueViolation):
        store.add_unique("users", "name")


def test_snapshots_restore_backup_vacuum(spark, store, tmp_path):
    store.insert("users", 1, {"name": "al"})
    then = store.snapshot()
    store.update("users", 1, {"name": "bo"})
    assert store.get("users", 1, then) == {"name": "al"} and store.get("users", 1) == {"name": "bo"}
    store.backup_to(f"file://{tmp_path}/copy", then)
    assert rows(Store(spark, f"file://{tmp_path}/copy")) == [(1, "al", None)]
    store.restore(then)
    assert rows(store) == [(1, "al", None)]
    assert store.vacuum() == 0  # young segments may belong to a commit under way
    assert rows(store) == [(1, "al", None)]
    store.update("users", 1, {"name": "cy"})
    store.restore(store.snapshot() - 1)
    assert store.vacuum(older_than=0) > 0
    assert rows(store) == [(1, "al", None)]
    with pytest.raises(StoreError):
        store.scan("users", then)


def test_a_read_takes_one_join_and_long_histories_are_compacted(spark, store):
    for k in range(12):
        store.update("users", k % 3, {"name": f"n{k}"})
    store.delete("users", 0)
    assert rows(store) == [(1, "n10", None), (2, "n11", None)]
    plan = store.scan("users")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    store.compact_after = 5
    store.insert("users", 0, {"name": "back"})
    assert len(store.manifest()["collections"]["users"]["segments"]) == 1
    assert rows(store) == [(0, "back", None), (1, "n10", None), (2, "n11", None)]


def test_large_batches(store):
    import time

    began = time.perf_counter()
    store.insert_batch("users", [(k, {"name": "x"}) for k in range(5000)])
    assert time.perf_counter() - began < 30 and store.count("users") == 5000
    with pytest.raises(RecordExists):
        store.insert_batch("users", [(k, {"name": "x"}) for k in range(4999, 9000)])
    with pytest.raises(RecordExists):
        store.insert_batch("users", [(9001, {"name": "x"}), (9001, {"name": "y"})])
    assert store.count("users") == 5000


def test_first_committer_wins(store):
    store.insert_batch("users", [(1, {"name": "al"}), (2, {"name": "bo"})])
    a, b, c = store.begin(), store.begin(), store.begin()
    a.update("users", 1, {"name": "a"})
    b.update("users", 1, {"name": "b"})
    c.update("users", 2, {"name": "c"})
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    c.commit()
    assert rows(store) == [(1, "a", None), (2, "c", None)]


def test_own_writes_are_seen_and_abort_leaves_nothing(store):
    t = store.begin()
    t.insert("users", 1, {"name": "al"})
    assert t.get("users", 1) == {"name": "al"} and t.scan("users") == [(1, {"name": "al"})]
    t.delete("users", 1)
    assert t.get("users", 1) is None
    t.abort()
    assert store.count("users") == 0
    empty = store.begin()
    assert empty.commit() == store.version()


def test_strict_refuses_write_skew_and_phantoms(store):
    store.create_collection("doctors")
    store.insert_batch("doctors", [(1, {"who": "al", "on_call": True}), (2, {"who": "bo", "on_call": True})])
    a, b = store.begin(strict=True), store.begin(strict=True)
    for t, mine, other in ((a, 1, 2), (b, 2, 1)):
        if t.get("doctors", other)["on_call"]:
            t.update("doctors", mine, {"who": "x", "on_call": False})
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    c, d = store.begin(strict=True), store.begin()
    assert len(c.scan("doctors")) == 2
    c.insert("users", 1, {"name": "c"})
    d.insert("doctors", 3, {"who": "new", "on_call": False})
    d.commit()
    with pytest.raises(Conflict):
        c.commit()


def test_dynamic_fields_and_freeze(store):
    store.create_collection("d")
    store.insert_batch("d", [(1, {"a": 1, "s": "xy"}), (2, {"a": 2, "s": "z"})])
    s = infer(store.scan("d"))
    assert s.mode == "fixed" and {c.name: (c.type.name, c.type.size, c.required) for c in s.columns} == {"a": ("i64", None, True), "s": ("char", 18, True)}
    assert store.freeze_schema("d").mode == "fixed"
    with pytest.raises(SchemaError):
        store.freeze_schema("d")
    with pytest.raises(SchemaError):
        store.insert("d", 3, {"a": 1, "s": "x", "t": 1})


def test_evolution(store):
    store.insert("users", 1, {"name": "al", "age": 3})
    wider = Schema("strict", (*STRICT.columns, Column("city", FieldType("str", 10))))
    assert STRICT.accepts_evolution(wider)
    store.alter_schema("users", wider)
    store.insert("users", 2, {"name": "bo", "city": "x"})
    assert store.get("users", 1) == {"name": "al", "age": 3} and store.get("users", 2) == {"name": "bo", "city": "x"}
    text = Schema("strict", (Column("name", FieldType("str", 8), True), Column("age", FieldType("str", 4))))
    assert not wider.accepts_evolution(text)
    store.alter_schema("users", text)
    assert store.get("users", 1) == {"name": "al", "age": "3"}


@pytest.mark.parametrize(
    "t, good, bad",
    [
        (FieldType("u64"), [0, 2**64 - 1], [-1, 2**64, 1.0]), (FieldType("f64"), [1, 2.5, float("nan")], ["1", True]), (FieldType("decimal", 2), [Decimal("1.25"), 3], [Decimal("1.255"), 1.25]),
        (FieldType("char", 4), ["abc", "é"], ["abcd", "éé", 3]), (FieldType("bytes", 2), [b"ab"], [b"abc", "ab"]), (FieldType("list", None, FieldType("i64")), [[1, None]], [["x"], 3]), (FieldType("timestamp"), [datetime.datetime(2020, 1, 1)], [3]),
        (FieldType("map"), [{"a": 1}], [[1]]), (FieldType("any"), [1, "x"], []), (FieldType("bool"), [True], [1]),
    ],
)
def test_field_types(t, good, bad):
    assert [t.problem(v) for v in good] == [None] * len(good)
    assert all(t.problem(v) for v in bad)


def test_schema_definitions():
    for make in (lambda: Schema("strict"), lambda: Schema("odd"), lambda: Schema("fixed", (Column("s", FieldType("str", 3)),)), lambda: Schema("strict", (Column("a", FieldType("i64")),) * 2), lambda: Schema("fixed", (Column("c", FieldType("char", 1)),))):
        with pytest.raises(SchemaError):
            make()
    assert Schema.from_json(STRICT.to_json()) == STRICT


def test_engine_over_a_store(spark, store, tmp_path):
    store.insert_batch("users", [(i, {"name": f"n{i % 3}", "age": i}) for i in range(9)])
    e = Engine(spark, store, root=f"file://{tmp_path}/layouts", level=4)
    q = scan("users").aggregate(["name"], count(output="n"))
    e.add_view(q)
    assert [tuple(r) for r in e.collect(q)] == [("n0", 3), ("n1", 3), ("n2", 3)]
    store.delete("users", 0)
    assert [tuple(r) for r in e.collect(q)] == [("n0", 2), ("n1", 3), ("n2", 3)]  # neither the view nor the cached result is stale
    e.refresh()
    assert e.views[0].answers(q, e.epoch("users"))
    assert [tuple(r) for r in e.collect("select name, count(*) as n from users group by name limit 1")] == [("n0", 2)]
