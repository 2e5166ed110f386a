"""Cells kept up to date from a stream of called genotypes.

The sums of cells add up, so each micro-batch is reduced by itself and appended; the cells
of all batches so far are the sums of what is stored. A batch written again after a failure
replaces itself, as its files are named by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixmill.operators.cells import SUMS, genotype_cells


def stream_cells(calls: DataFrame, people: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Start a query that reduces each micro-batch of (variant_id, sample_id, dosage) to cells under `store`."""

    def keep(batch: DataFrame, number: int) -> None:
        genotype_cells(batch, people, sparse=False).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return calls.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_cells(df: DataFrame) -> DataFrame:
    """The cells of all batches in what has been stored."""
    return df.groupBy("variant_id", "dosage", "age", "sex").agg(*(F.sum(c).alias(c) for c in SUMS))
