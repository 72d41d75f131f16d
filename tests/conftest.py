import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    from voltarc.sources.stages import shared_folder
    shared_folder(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def connect(scale):
        con = duckdb.connect()
        for table in ("events", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/sf{scale}/{table}.parquet'")
        return con
    return connect


def values(frame):
    """Rows of a pandas frame as sorted tuples of comparable text."""
    out = []
    for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
        out.append(tuple("" if v is None else
                         repr(float(v)) if isinstance(v, (int, float)) else str(v) for v in row))
    return sorted(out)


@pytest.fixture(scope="session")
def same():
    def check(spark_df, frame):
        got = spark_df.toPandas()
        assert list(got.columns) == list(frame.columns)
        left, right = values(got), values(frame)
        assert len(left) == len(right)
        wrong = [(a, b) for a, b in zip(left, right) if a != b]
        assert not wrong, wrong[:2]
    return check
