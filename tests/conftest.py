import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{home}/shared")
        .config("spark.sql.warehouse.dir", f"{home}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def compare(spark, query, sql, tables, sf_dir="/root/testdata/sf0.001"):
    """A query's rows against DuckDB's, whatever their order, columns by name; doubles bit by bit."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in want.fetchall()), key=key)
    assert a == b


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
