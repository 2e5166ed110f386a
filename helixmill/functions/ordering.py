"""Running sums, ranks and exact quantiles of large groups, without ordering a whole group in one task.

Rows are stored and counted, and dealt by sampled ranges of their order to as many parts as they need, so that none is
much larger than ROWS_A_RANGE. Each part of a group is ordered by itself, and what the parts before it add up to is
carried into it. Results are exact wherever the cuts lie; only one row a part meets in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.functions.columns import broadcast_if_small
from helixmill.functions.stored import store

#: Rows that a task orders, about.
ROWS_A_RANGE = 1_000_000
#: How often parts that came out too large are dealt anew, to twice as many.
CUTS = 4


def beside(df: DataFrame, one: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`df` with the columns of `one`, which has a row for each group (a single one without `by`)."""
    if by:
        return df.join(broadcast_if_small(one), list(by))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k")


def ranged(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """`df`, stored, with _part: rising with the order within a group, and about `rows` rows each (ROWS_A_RANGE).

    The number of parts follows from the rows that are there. Bounds are sampled, so the largest part is looked at, and
    rows are dealt to more parts where it is above twice as many.
    """
    rows = rows or ROWS_A_RANGE
    d = store(df, "ordered")
    parts = -(-d.count() // rows)
    if parts <= 1:
        return d.withColumn("_part", F.lit(0))
    for _ in range(CUTS):
        r = store(d.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
        if r.groupBy("_part").count().agg(F.max("count")).first()[0] <= 2 * rows:
            break
        parts *= 2
    return r


def running_sums(df: DataFrame, key: str, sums: Sequence[str], by: Sequence[str] = (), down: bool = False, cut: Column | None = None, rows: int | None = None) -> DataFrame:
    """`df` with upto_c and total_c for each c of `sums`: its sum over the group's rows up to this one by `key`, and over all.

    A value of `key` is one row of its group. `cut` may name the part of a row, rising with
    `key`; else `ranged` does. With `down` the order is descending.
    """
    turn = F.col(key).desc() if down else F.col(key)
    d = ranged(df, [turn], by, rows) if cut is None else df.withColumn("_part", cut)
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*by, "_part").agg(*(F.sum(c).alias(c) for c in sums))
    totals = totals.select(*by, "_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums), *(F.sum(c).over(group).alias(f"total_{c}") for c in sums))
    inside = Window.partitionBy(*by, "_part").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(broadcast_if_small(totals), [*by, "_part"])
    return d.select(*df.columns, *((F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"upto_{c}") for c in sums), *(f"total_{c}" for c in sums))


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), number: str = "_row", total: str = "_n", rows: int | None = None) -> DataFrame:
    """`df` with the place of each row of its group by `order`, from 1, and the rows of the group; ties of the first columns are no hot spot."""
    d = ranged(df, order, by, rows)
    group = Window.partitionBy(*by)
    totals = d.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    earlier = F.coalesce(F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*by, "_part", earlier.alias("_before"), F.sum("_c").over(group).alias(total))
    d = d.withColumn(number, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    return d.join(broadcast_if_small(totals), [*by, "_part"]).withColumn(number, F.col("_before") + F.col(number)).drop("_part", "_before")


def before(df: DataFrame, key: str, by: Sequence[str] = (), greatest: Sequence[str] = (), last: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """`df` with max_c, the greatest c of the group's rows before this one by `key`, and last_c, that of the row just before; null for the first.

    A value of `key` is one row of its group. Between parts go their greatest values and their last rows.
    """
    d = ranged(df, [F.col(key)], by, rows)
    ends = d.groupBy(*by, "_part").agg(*(F.max(c).alias(f"_m_{c}") for c in greatest), F.max_by(F.struct(F.lit(1).alias("_one"), *last), key).alias("_end"))
    parts = Window.partitionBy(*by).orderBy("_part")
    carried = [F.max(f"_m_{c}").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{c}") for c in greatest]
    ends = ends.select(*by, "_part", *carried, F.lag("_end").over(parts).alias("_end"))
    inside = Window.partitionBy(*by, "_part").orderBy(key)
    first = F.row_number().over(inside) == 1
    d = d.join(broadcast_if_small(ends), [*by, "_part"])
    most = [F.greatest(F.max(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col(f"_c_{c}")).alias(f"max_{c}") for c in greatest]
    return d.select(*df.columns, *most, *(F.when(first, F.col(f"_end.{c}")).otherwise(F.lag(c).over(inside)).alias(f"last_{c}") for c in last))


def counted(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """by, column, n, upto_n and total_n of each value that is there, in rising order."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    return running_sums(counts, column, ["n"], by)


def neighbours(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, i, n, lo, hi and share: the quantile of probs[i] lies that share of the way from lo to hi, two of the n values."""
    d = counted(df, column, by)
    at = F.transform(F.lit([float(p) for p in probs]), lambda p, i: F.struct(i.alias("i"), (p * (F.col("total_n") - 1)).alias("h")))
    here = lambda x: (x >= F.col("upto_n") - F.col("n")) & (x < F.col("upto_n"))
    d = d.withColumn("_at", F.explode(F.filter(at, lambda x: here(F.floor(x["h"])) | here(F.ceil(x["h"])))))
    ends = {name: F.max(F.when(here(f(F.col("_at.h"))), F.col(column))) for name, f in (("lo", F.floor), ("hi", F.ceil))}
    share = F.max(F.col("_at.h") - F.floor("_at.h"))
    return d.groupBy(*by, F.col("_at.i").alias("i")).agg(F.max("total_n").alias("n"), *(e.alias(c) for c, e in ends.items()), share.alias("share"))


def quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, n and q, the exact quantiles (linear interpolation) of `probs` as an array; groups without values have no row."""
    d = neighbours(df, column, probs, by).withColumn("v", F.col("lo") + F.col("share") * (F.col("hi") - F.col("lo")))
    q = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    return d.groupBy(*by).agg(F.max("n").alias("n"), q.alias("q"))


def _first(table: pa.Table, by: Sequence[str], order: Sequence[tuple[str, bool]], k: str, rank: str | None = None) -> pa.Table:
    """The first rows of each group of `by`, as many as its column `k` says, with their place as `rank`."""
    t = table.sort_by([*((c, "ascending") for c in by), *((c, "descending" if down else "ascending") for c, down in order)])
    n = t.num_rows
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in by:
            # groups are numbered, so that nulls and values of any kind compare
            code = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = np.arange(n) - start
    kept = pa.array(place < t.column(k).to_numpy())
    t = t.append_column(rank, pa.array((place + 1).astype(np.int32))) if rank else t
    return t.filter(kept)


def top_k(df: DataFrame, k: str | int, order: Sequence[tuple[str, bool]], by: Sequence[str] = (), rank: str = "rank", parts: int = 32) -> DataFrame:
    """The first `k` rows (a number or a column, one value a group) of each group by `order` (column, whether descending), with `rank`.

    Each task keeps no more than k rows a group while its rows stream through, `parts` tasks merge what the tasks of a group
    kept, and one merges theirs: no task holds or orders a group. Ties must be settled by a last column of `order`;
    nulls come last.
    """
    count = k if isinstance(k, str) else "_most"
    d = df if isinstance(k, str) else df.withColumn("_most", F.lit(k))

    def kept(name: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                t = pa.Table.from_batches([b])
                held = _first(pa.concat_tables([held, t]) if held is not None else t, by, order, count)
            if held is not None:
                yield from _first(held, by, order, count, name).combine_chunks().to_batches()

        return run

    some = d.mapInArrow(kept(None), d.schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    some = some.repartition(*by, "_part").drop("_part").mapInArrow(kept(None), d.schema)
    some = some.repartition(*by) if by else some.coalesce(1)
    out = some.mapInArrow(kept(rank), T.StructType([*d.schema.fields, T.StructField(rank, T.IntegerType())]))
    return out if isinstance(k, str) else out.drop("_most")
