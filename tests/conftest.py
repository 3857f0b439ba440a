import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def told(value):
    """A value as text, numbers to six places."""
    import pandas as pd

    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    try:
        return repr(round(float(value), 6)) if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def same_rows(left, right):
    cols = sorted(left.columns)
    assert cols == sorted(right.columns)
    rows = [sorted(tuple(told(v) for v in r) for r in x[cols].itertuples(index=False)) for x in (left, right)]
    assert rows[0] == rows[1]
