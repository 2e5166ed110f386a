"""What the corpus operators share: durable intermediate tables and Arrow text kernels."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.stored import fresh_path

#: White space as the contracts define it, for RE2, Java and Python patterns alike.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch are worked on in chunks of about so many bytes of text.
CHUNK_BYTES = 2_000_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Cuts the lineage, so that a lost executor never repeats the work above, and
    gives the next steps real sizes to plan with. `discard` removes it again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.written_to = path
    return read


def discard(*written: DataFrame) -> None:
    """Remove materialized tables that nothing will read any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """Materialized tables that belong together, and are removed together."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialize(df, name))
        return self.tables[-1]

    def drop(self, df: DataFrame) -> None:
        """Remove one of them early."""
        discard(df)
        self.tables = [t for t in self.tables if t is not df]

    def clear(self, *but: DataFrame) -> None:
        """Remove all tables `but` those."""
        stay = {df.written_to for df in but if hasattr(df, "written_to")}
        discard(*(df for df in self.tables if df.written_to not in stay))


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, most: int = 4_000_000) -> contextlib.AbstractContextManager[None]:
    """While tables are written within it, Arrow batches hold `most` bytes at most (one row at least)."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)


def wide_rows(spark: SparkSession, rows: int = 16) -> contextlib.AbstractContextManager[None]:
    """While tables are written within it, Parquet is read `rows` rows at a time: for rows with long arrays, of which thousands at once fill a heap."""
    return _setting(spark, "spark.sql.parquet.columnarReaderBatchSize", rows)


def fresh(name: str, *taken: DataFrame) -> str:
    """`name`, with underscores in front until none of the tables has such a column (in any case)."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def bounded_broadcast(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """`df` with a broadcast hint if its counted `rows` are at most `limit`, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def text_or_empty(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` whose `column` holds about `most` bytes each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of the text that each is in."""
    parts = pc.split_pattern_regex(text_or_empty(texts), SPACE_RE)
    words, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), row[real.to_numpy(zero_copy_only=False)]


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts in order, and the number of the text that each is in."""
    parts = pc.split_pattern(text_or_empty(texts), "\n")
    return parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number equal values alike: codes, and the value of each code."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    code, values = codes(words)
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False), categorize=False)[code]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of `values` by row number, for rows 0..n-1."""
    return np.bincount(row, weights=values, minlength=n).astype(np.int64)
