"""Genotypes as packed arrays: a variant is one row, with two bits a sample, in a fixed order of samples.

Statistics, filters, cells and scores are numpy kernels over Arrow batches of such rows. What concerns a variant
alone is a map: nothing is shuffled. Scores add up over variants: each task multiplies its dosages with its
weights, and only its sums for blocks of samples meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.columns import broadcast_if_few, broadcast_if_small, clip, finite
from helixmill.functions.ordering import counted
from helixmill.operators.cells import SUMS

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

MISSING = 3
#: Samples whose sums travel together.
BLOCK = 4096
#: Dosages that are unpacked at a time.
CHUNK = 4_000_000
STATS = "n_called long, missing_rate double, freq double, maf double, mean double, var double, sd double, polymorphic boolean"


def _packed(codes: np.ndarray) -> list[bytes]:
    """Rows of codes 0..3 (variants by samples), four a byte."""
    wide = np.zeros((len(codes), -(-codes.shape[1] // 4) * 4), np.uint8)
    wide[:, : codes.shape[1]] = codes
    four = wide.reshape(len(codes), -1, 4)
    return [x.tobytes() for x in four[..., 0] | four[..., 1] << 2 | four[..., 2] << 4 | four[..., 3] << 6]


def unpacked(rows: Sequence[bytes], n: int) -> np.ndarray:
    """The codes of packed rows of `n` samples: dosage 0, 1 or 2, or MISSING."""
    b = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], 2).reshape(len(rows), -1)[:, :n]


def pack(dosages: DataFrame) -> DataFrame:
    """`dosages` (variant_id, dosages: array of small numbers or null) with n and the packed `codes` in place of the arrays; further columns stay."""
    rest = [c for c in dosages.columns if c != "dosages"]
    kinds = {f.name: f.dataType.simpleString() for f in dosages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("dosages")
            n, codes = [], []
            for i in range(b.num_rows):
                row = lists[i].values.fill_null(MISSING).to_numpy(zero_copy_only=False).astype(np.uint8)
                n.append(len(row))
                codes += _packed(row[None])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int32()), pa.array(codes, pa.binary())], [*rest, "n", "codes"])

    return dosages.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "n int, codes binary"]))


def sample_order(people: DataFrame) -> DataFrame:
    """i and sample_id: the place of each sample, in order of sample_id."""
    return counted(people.select("sample_id").distinct(), "sample_id").select((F.col("upto_n") - 1).cast("int").alias("i"), "sample_id")


def pack_sparse(genotypes: DataFrame, samples: DataFrame, n_samples: int) -> DataFrame:
    """variant_id, n and codes of genotypes whose dosage 0 has no row; `samples` has i and sample_id."""
    d = genotypes.join(broadcast_if_few(samples), "sample_id")
    d = d.groupBy("variant_id").agg(F.collect_list(F.struct("i", F.coalesce("dosage", F.lit(MISSING)).cast("tinyint").alias("code"))).alias("seen"))
    kind = dict(genotypes.dtypes)["variant_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for i in range(b.num_rows):
                seen = b.column("seen")[i].values
                row = np.zeros((1, n_samples), np.uint8)
                row[0, seen.field("i").to_numpy()] = seen.field("code").to_numpy()
                codes += _packed(row)
            yield pa.RecordBatch.from_arrays([b.column("variant_id"), pa.array([n_samples] * b.num_rows, pa.int32()), pa.array(codes, pa.binary())], ["variant_id", "n", "codes"])

    return d.mapInArrow(run, f"variant_id {kind}, n int, codes binary")


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their codes; rows of one slice have equally many samples."""
    n = b.column("n").to_numpy()
    at = 0
    while at < len(n):
        size = max(1, CHUNK // max(1, int(n[at])))
        end = at + 1
        while end < min(len(n), at + size) and n[end] == n[at]:
            end += 1
        part = b.slice(at, end - at)
        yield part, unpacked(part.column("codes").to_pylist(), int(n[at]))
        at = end


def _measures(codes: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of the rows of codes."""
    one, two, lost = ((codes == k).sum(1) for k in (1, 2, MISSING))
    n = codes.shape[1]
    called = n - lost
    s, ss = one + 2 * two, one + 4 * two
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(called > 0, s / called, np.nan)
        var = np.where(called > 1, (ss - s * mean) / (called - 1), np.nan)
        missing = lost / n if n else np.full(len(codes), np.nan)
    zero = called - one - two
    return {"n_called": called, "missing_rate": missing, "freq": mean / 2, "maf": np.minimum(mean / 2, 1 - mean / 2), "mean": mean, "var": var, "sd": np.sqrt(var), "polymorphic": ((zero > 0).astype(int) + (one > 0) + (two > 0)) > 1}


def variant_stats(packed: DataFrame) -> DataFrame:
    """What `qc.variant_stats` gives, from packed rows and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, codes in _chunks(b):
                m = _measures(codes)
                yield pa.RecordBatch.from_arrays([part.column("variant_id"), *(pa.array(x, from_pandas=True) for x in m.values())], ["variant_id", *m])

    return packed.select("variant_id", "n", "codes").mapInArrow(run, f"variant_id {dict(packed.dtypes)['variant_id']}, {STATS}")


def _kept(packed: DataFrame, good: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, codes in _chunks(b):
                with np.errstate(invalid="ignore"):
                    yield part.filter(pa.array(good(_measures(codes))))

    return packed.mapInArrow(run, packed.schema)


def filter_maf_missing(packed: DataFrame, maf: float = 0.01, missing: float = 0.05) -> DataFrame:
    """Packed rows of variants with MAF of at least `maf` and at most `missing` calls missing; monomorphic ones go."""
    return _kept(packed, lambda m: (m["maf"] >= maf) & (m["missing_rate"] <= missing) & m["polymorphic"])


def filter_polymorphic(packed: DataFrame) -> DataFrame:
    return _kept(packed, lambda m: m["polymorphic"])


def pgs_score(packed: DataFrame, weights: DataFrame, samples: DataFrame, by: str = "trait") -> DataFrame:
    """sample_id, `by` and score: the sum of dosage times weight over the variants of each score.

    weights has variant_id, `by` and weight (what is not finite counts as 0); missing calls add nothing. A task sends one
    row for each block of BLOCK samples and score, whatever the number of its variants.
    """
    one = F.struct(F.col(by).cast("string").alias("by"), F.coalesce(finite(F.col("weight")), F.lit(0.0)).alias("weight"))
    w = weights.groupBy("variant_id").agg(F.collect_list(one).alias("weights"))
    d = packed.select("variant_id", "n", "codes").join(broadcast_if_small(w), "variant_id").select("n", "codes", "weights")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for part, codes in _chunks(b):
                g = np.where(codes == MISSING, 0, codes).astype(np.float64)
                lists = part.column("weights")
                kinds = sorted({k for k in lists.flatten().field("by").to_pylist()})
                m = np.zeros((len(g), len(kinds)))
                for i in range(len(g)):
                    for x in lists[i].as_py():
                        m[i, kinds.index(x["by"])] += x["weight"]
                for k, sums in zip(kinds, m.T @ g):
                    total[k] = total[k] + sums if k in total else sums
        yield from _blocks(total)

    def _blocks(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, sums in total.items():
            parts = [sums[x : x + BLOCK].tolist() for x in range(0, len(sums), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], ["by", "block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                key, sums = (b.column("by")[i].as_py(), b.column("block")[i].as_py()), b.column("sums")[i].values.to_numpy()
                total[key] = total[key] + sums if key in total else sums
        for (k, block), sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(sums), pa.string()), pa.array(block * BLOCK + np.arange(len(sums)), pa.int32()), pa.array(sums)], ["by", "i", "score"])

    sums = d.mapInArrow(multiply, "by string, block int, sums array<double>").repartition("by", "block").mapInArrow(add, "by string, i int, score double")
    kinds = weights.select(F.col(by).cast("string").alias("by"), F.lit(1).alias("_k")).distinct()
    every = samples.withColumn("_k", F.lit(1)).join(broadcast_if_small(kinds), "_k")  # a row for each person and score
    out = every.join(sums, ["by", "i"], "left")
    return out.select("sample_id", F.col("by").cast(dict(weights.dtypes)[by]).alias(by), F.coalesce("score", F.lit(0.0)).alias("score"))


def genotype_cells(packed: DataFrame, samples: DataFrame, people: DataFrame, clip_at: float = 50.0, most_people: int = 20_000_000) -> DataFrame:
    """What `cells.genotype_cells` gives, without a shuffle: people's covariates and outcomes go to every task.

    They are counted first; beyond `most_people`, use the long form.
    """
    y, c = F.col("y_quant").cast("double"), clip(F.col("y_quant"), -clip_at, clip_at)
    d = samples.join(people, "sample_id").select("i", "age", "sex", F.col("y_bin").cast("double").alias("cases"), y.alias("y"), c.alias("yc"))
    n = d.count()
    if n > most_people:
        raise ValueError(f"{n} people are too many to send to every task")
    t = d.orderBy("i").toArrow()
    covariates = np.stack([t.column(k).to_numpy() for k in ("age", "sex")], 1)
    known, group = np.unique(covariates, axis=0, return_inverse=True)
    v = {k: t.column(k).to_numpy() for k in ("cases", "y", "yc")}
    each = {"n": np.ones(n), "cases": v["cases"], "sum_y": v["y"], "sum_yy": v["y"] ** 2, "sum_yc": v["yc"], "sum_yyc": v["yc"] ** 2}
    held = packed.sparkSession.sparkContext.broadcast((known, group.ravel(), t.column("i").to_numpy(), each))
    kind = dict(packed.dtypes)["variant_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, group, place, each = held.value
        for b in batches:
            for part, codes in _chunks(b):
                for i, row in enumerate(codes):
                    code = row[place]
                    cell = code.astype(np.int64) * len(known) + group
                    sums = {k: np.bincount(cell, weights=x, minlength=MISSING * len(known))[: MISSING * len(known)] for k, x in each.items()}
                    there = np.flatnonzero(sums["n"])
                    out = {"variant_id": part.column("variant_id").take(pa.array(np.full(len(there), i))), "dosage": pa.array((there // len(known)).astype(np.int32))}
                    out |= {k: pa.array(known[there % len(known), j].astype(np.int32)) for j, k in enumerate(("age", "sex"))}
                    out |= {k: pa.array(sums[k][there].astype(np.int64) if k in ("n", "cases") else sums[k][there]) for k in SUMS}
                    yield pa.RecordBatch.from_pydict(out)

    return packed.select("variant_id", "n", "codes").mapInArrow(run, f"variant_id {kind}, dosage int, age int, sex int, n long, cases long, sum_y double, sum_yy double, sum_yc double, sum_yyc double")
