from __future__ import annotations

import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, ROOT)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows of a pandas frame as sorted tuples of text, columns by name, floats to six digits."""

    def one(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return f"{float(v) + 0.0:.6g}" if abs(float(v)) > 1e-9 else "0"
        return str(bool(v)) if type(v).__name__ in ("bool", "bool_") else str(v)

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def database():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con
