"""Writing result tables, and reusing those that are there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from helixmill.functions.columns import broadcast_if_small


def write_results(df: DataFrame, path: str, form: str = "tsv") -> None:
    """Results as gzipped tab-separated text, as csv, or as Parquet."""
    if form == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("sep", "\t" if form == "tsv" else ",").option("header", True).option("compression", "gzip" if form == "tsv" else "none").csv(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def committed(spark: SparkSession, path: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame] | None:
    """The commit record of a store (keys and batch, the newest valid one of each) and its rows; None if nothing was committed.

    A record says how many rows a batch has of a key; where fewer or more are found, it counts for nothing.
    """
    record = read_if_there(spark, f"{path}/commits")
    if record is None:
        return None
    batches = sorted(r["batch"] for r in record.select("batch").distinct().collect())  # one for each run of `write_or_reuse`
    parts = [d.withColumn("_batch", F.lit(b)) for b in batches if (d := read_if_there(spark, f"{path}/{b}")) is not None]
    if not parts:
        return None
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    found = rows.groupBy(*keys, "_batch").agg(F.count("*").alias("_found"))
    same = [*(F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys), F.col("r.batch") == F.col("f._batch"), F.col("r.rows") == F.col("f._found")]
    valid = record.alias("r").join(found.alias("f"), reduce(lambda a, b: a & b, same)).groupBy(*(F.col(f"r.{k}").alias(k) for k in keys)).agg(F.max(F.struct("r.at", "r.batch")).alias("last"))
    return valid.select(*keys, F.col("last.batch").alias("_batch")), rows


def write_or_reuse(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored rows for all `wanted` keys; `build` makes those that are missing, which are then stored.

    What is built goes into a folder of its own, partitioned by the keys, and counts only once a record of its
    keys and their rows is written: a run that breaks off, or files that are lost, are made again.
    """
    there = committed(spark, path, keys)
    missing = wanted if there is None else wanted.join(there[0], list(keys), "left_anti")
    if there is None or not missing.isEmpty():
        batch = f"batch-{uuid.uuid4().hex}"
        build(missing).write.partitionBy(*keys).parquet(f"{path}/{batch}")
        made = spark.read.parquet(f"{path}/{batch}").groupBy(*keys).agg(F.count("*").alias("rows"))
        made.select(*keys, F.lit(batch).alias("batch"), "rows", F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/commits")
        there = committed(spark, path, keys)
    valid, rows = there
    return rows.join(broadcast_if_small(valid), [*keys, "_batch"], "left_semi").drop("_batch").join(wanted, list(keys), "left_semi")
