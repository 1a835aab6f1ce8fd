import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def _cell(v):
    import pandas as pd

    if v is None or pd.isna(v) is True:
        return ""
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(data):
    """Compares a query's rows with those of its SQL in DuckDB."""
    import duckdb

    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")

    def compare(frame, sql):
        mine, theirs = frame.toPandas(), base.execute(sql).df()
        columns = sorted(mine.columns)
        assert columns == sorted(theirs.columns)
        rows = [sorted(tuple(_cell(v) for v in r) for r in x[columns].itertuples(index=False)) for x in (mine, theirs)]
        assert rows[0] == rows[1]
        return len(mine)

    return compare
