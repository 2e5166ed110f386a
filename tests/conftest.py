from __future__ import annotations

import math
import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.sql.session.timeZone": "UTC",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in Path(SMALL).iterdir():
        path = f"{f}/*.parquet" if f.is_dir() else str(f)
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{path}'")
    return c


def comparable(rows):
    """Rows as sorted tuples; NaN and null alike."""
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((v is None, "" if v is None else str(v) if isinstance(v, str) else v) for v in r))


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Holds a Spark query against its SQL at the smallest size."""

    def check(query, sql):
        b = query(spark, SMALL)
        names = sorted(b.columns)
        left = comparable(tuple(r) for r in b.select(*names).collect())
        right = comparable(duck.sql(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({sql}) q").fetchall())
        assert left == right

    return check
