import pytest

from facet.functions.expr import f
from facet.plans.logical import SortKey, count, over, scan
from facet.plans.sql import SqlError, parse


@pytest.mark.parametrize(
    "sql, plan",
    [
        ("select * from t", scan("t")),
        ("SELECT a, b FROM t WHERE a >= 3 AND NOT b = 'it''s' -- note", scan("t").filter((f("a") >= 3) & ~(f("b") == "it's")).project("a", "b")),
        ("select count(*), sum(x) s, max(y) as m from t group by g order by s desc, g limit 5", scan("t").aggregate(["g"], count(), over("sum", "x", "s"), over("max", "y", "m")).sort(SortKey("s", True), "g").limit(5)),
        ("select t.a from t left outer join u on t.k = u.k where u.z is not null", scan("t").join(scan("u"), "left", ("k", "k")).filter(f("u.z").is_not_null()).project("t.a")),
        ("select a from t where a in (1, 2.5, null) or s not like '%x'", scan("t").filter(f("a").isin(1, 2.5, None) | ~f("s").like("%x")).project("a")),
        ("select count from t", scan("t").project("count")),
        ("select *, a from t", scan("t")),
        ("select avg(u.x) from t", scan("t").aggregate([], over("avg", "u.x", "avg_u_x"))),
    ],
)
def test_plans(sql, plan):
    assert parse(sql).explain() == plan.explain()


@pytest.mark.parametrize(
    "sql, word",
    [
        ("insert into t values (1)", "INSERT"), ("update t set a = 1", "UPDATE"), ("delete from t", "DELETE"), ("create table t", "CREATE"), ("drop table t", "DROP"), ("alter table t", "ALTER"), ("with x as (select 1) select * from x", "WITH"),
        ("select a from t group by a", "aggregate"), ("select sum(*) from t", "meaning"), ("select * from t join u on a = b join v on a = b", "one JOIN"), ("select * from t limit -1", "character"), ("select * from t limit x", "LIMIT"),
        ("select * from t where a between 1 and 2", "comparison"), ("select * from t where a not 3", "NOT must"), ("select * from t where s like 3", "LIKE"), ("select distinct a from t", "trailing|expected"), ("select * from t having a = 1", "trailing"),
        ("select * from t limit 3 offset 2", "trailing"), ("select a + 1 from t", "character"), ("select 'open from t", "string"), ("select * from t x", "trailing"), ("", "SELECT"),
    ],
)
def test_refusals(sql, word):
    with pytest.raises(SqlError, match=word):
        parse(sql)


def test_shape_ignores_literals_and_limits():
    a, b = parse("select * from t where a = 1 limit 3"), parse("select * from t where a = 2 limit 9")
    assert a.shape() == b.shape() and a.key() != b.key()
    assert a.shape() != parse("select * from t where b = 1 limit 3").shape()


def test_required_fields():
    assert parse("select a from t where b = 1 order by c").required_fields() == {"a", "b"}
    assert parse("select count(x) from t where b = 1 group by g").required_fields() == {"x", "g", "b"}
    assert parse("select * from t where b = 1").required_fields() is None
