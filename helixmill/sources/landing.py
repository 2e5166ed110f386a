"""Stored layouts: variants by chromosome and range of positions, and tables bucketed by a key that joins need no shuffle for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The partition column of positions, which ends with the width of a range.
BIN = "bp_by_"


def land_by_region(df: DataFrame, path: str, width: int = 1_000_000) -> None:
    """Write rows with chr and bp as Parquet, in a folder for each chromosome and each range of `width` positions, in order of bp.

    Rows are dealt by sampled ranges of (chr, bp), so a range with very many rows is several files and
    a file seldom spans more than one range; row groups carry their least and greatest bp.
    """
    b = f"{BIN}{width}"
    d = df.withColumn(b, F.floor(F.col("bp") / width).cast("int"))
    d.repartitionByRange("chr", "bp").sortWithinPartitions("chr", "bp").write.mode("overwrite").partitionBy("chr", b).parquet(path)


def read_region(spark: SparkSession, path: str, chromosome: str, first: int, last: int) -> DataFrame:
    """Rows of a chromosome with bp from `first` to `last`, both included; only folders of ranges that meet them are read."""
    d = spark.read.option("basePath", path).parquet(path)
    b = next(c for c in d.columns if c.startswith(BIN))
    width = int(b.removeprefix(BIN))
    inside = (F.col("chr").cast("string") == chromosome) & F.col(b).between(first // width, last // width) & F.col("bp").between(first, last)
    return d.where(inside).drop(b).withColumn("chr", F.col("chr").cast("string"))


def land_bucketed(df: DataFrame, table: str, path: str, key: str = "variant_id", buckets: int = 64) -> DataFrame:
    """Write `df` as `table`, its files at `path`, in `buckets` of `key`, sorted by it: one file a bucket.

    Tables with the same number of buckets join on `key` where they are. Give each bucket what a task can sort.
    """
    d = df.repartition(buckets, key)
    d.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
