import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    held = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}",
    }
    session = SparkSession.builder.master("local[4]").config(map=held).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same_rows(spark, run, sql, sf=SF):
    """Whether a query and its SQL give equal rows, order aside, doubles to nine digits."""
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = run(spark, sf).toPandas(), c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    plain = lambda v: "%.9g" % v if isinstance(v, float) else str(v)
    rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)
