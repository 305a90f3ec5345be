import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def compare(spark, query, sql, sf_dir):
    """Both engines' rows over the same tables, by column name."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    norm = lambda v: round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    key = lambda r: tuple((x is None, str(x)) for x in r)
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    other = con.sql(sql)
    assert sorted(other.columns) == cols
    at = [other.columns.index(c) for c in cols]
    assert ours == sorted((tuple(norm(r[i]) for i in at) for r in other.fetchall()), key=key)
