"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a folder in the warehouse, or with a master `local` a temporary one.

    On a cluster a warehouse on the machine's own disk is refused: other machines would not see what is stored there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if urlsplit(warehouse).scheme in ("", "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return f"{warehouse}/_intermediate"
    return _temporary()


@functools.cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="helixmill-")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet into the shared folder: for tables that several later steps read.

    A lost executor never repeats the work above, and later steps are planned with real sizes.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
