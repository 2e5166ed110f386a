"""Readers of score files, panels, VCF, GEN and haplotype text, as DataFrames in narrow tables.

Text formats are split by Spark; store them as Parquet (`functions.stored`) before the
scans, since a gzipped file is read by one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions.columns import broadcast_if_small
from helixmill.functions.stored import store
from helixmill.operators.qc import normalize_columns

TAB = re.compile(b"\t")


def read_pgs_weights(spark: SparkSession, path: str, trait: str) -> DataFrame:
    """trait, line, chr_name, rsid, effect_allele and effect_weight of tab-separated score files with comments; lines are counted over all files."""
    raw = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    names = {"chr_name": ["hm_chr"], "rsid": ["rsID", "hm_rsID"], "effect_allele": [], "effect_weight": []}
    d = normalize_columns(raw, names).select(*names, "_metadata")
    return number_lines(d).select(F.lit(trait).alias("trait"), "line", "chr_name", "rsid", "effect_allele", F.col("effect_weight").try_cast("double").alias("effect_weight"))


def read_sample_panel(spark: SparkSession, path: str) -> DataFrame:
    """sample_id and super_pop of a table separated by white space, whatever the case of its header."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    header = lines.first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = [c.lower().replace("-", "_") for c in header["value"].split()]
    cells = F.split(F.trim("value"), r"\s+")
    body = lines.where(F.col("value") != header["value"])
    pop = next((c for c in ("super_pop", "super_population") if c in names), None)
    if "sample" not in names or pop is None:
        raise ValueError("columns not found: sample, super_pop")
    return body.select(F.get(cells, names.index("sample")).alias("sample_id"), F.get(cells, names.index(pop)).alias("super_pop"))


def _fields(line: bytes | memoryview, skip: int, most: int = 1 << 20) -> Iterator[bytes | memoryview]:
    """The tab-separated fields after the first `skip`, in pieces of about `most` bytes that end with a field; nothing is copied."""
    at = -1
    for _ in range(skip):
        tab = TAB.search(line, at + 1)
        if tab is None:
            return
        at = tab.start()
    while at < len(line):
        tab = TAB.search(line, at + most)
        end = tab.start() if tab else len(line)
        yield line[at + 1 : end]
        at = end


def _alt_counts(calls: bytes) -> pa.Array:
    """ALT alleles of tab-separated calls such as 0|1:..; null if any allele is missing or another one."""
    data = np.frombuffer(calls, np.uint8)
    ends = np.append(np.flatnonzero(data == ord("\t")), len(data))
    starts = np.append(0, ends[:-1] + 1)
    colons = np.append(np.flatnonzero(data == ord(":")), len(data))
    size = np.minimum(colons[np.searchsorted(colons, starts)], ends) - starts
    good, count = size % 2 == 1, np.zeros(len(starts), np.int64)
    left = np.flatnonzero(good)
    for k in range(size.max()):
        left = left[size[left] > k]
        x = data[starts[left] + k]
        good[left] &= (x == ord("/")) | (x == ord("|")) if k % 2 else (x == ord("0")) | (x == ord("1"))
        count[left] += (x == ord("1")) & (k % 2 == 0)
    return pa.array(count, pa.int64(), mask=~good).cast(pa.int8())


def _vcf_dosages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            parts = [_alt_counts(x) for x in _fields(memoryview(b.column("value")[i].as_buffer()), 9)]
            flat = pa.concat_arrays(parts) if parts else pa.array([], pa.int8())
            yield pa.RecordBatch.from_arrays([b.column("variant_id").slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], ["variant_id", "dosages"])


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Variants, and their packed dosages (one array a variant), of the biallelic SNPs of a VCF.

    The order of the arrays is that of the samples in the header; `unpack` gives long rows. Calls are read from the bytes
    of a line, so a line of millions of samples takes the room of its text and no object a call.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    f = F.split(F.substring_index("value", "\t", 9), "\t")
    base = ["A", "C", "G", "T"]
    d = lines.select(F.regexp_replace(f[0], "^chr", "").alias("chr"), f[1].cast("int").alias("bp"), f[2].alias("rsid"), f[3].alias("ref"), f[4].alias("alt"), "value")
    d = d.where(F.upper("ref").isin(base) & F.upper("alt").isin(base))
    d = d.withColumn("variant_id", F.xxhash64("chr", "bp", "ref", "alt"))
    return d.select("variant_id", "chr", "bp", "rsid", "ref", "alt"), d.select("variant_id", "value").mapInArrow(_vcf_dosages, "variant_id long, dosages array<tinyint>")


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """i and sample_id: sample names in the order of the dosages, stored, as Spark cannot tell from one line how many there are; the header is one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = 0
                for x in _fields(memoryview(b.column("value")[i].as_buffer()), 9):
                    names = pc.split_pattern(pa.array([bytes(x).decode()]), "\t").flatten()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(names)), pa.int32()), names], ["i", "sample_id"])
                    at += len(names)

    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1)
    return store(head.mapInArrow(run, "i int, sample_id string"), "vcf-samples")


def unpack(packed: DataFrame, samples: DataFrame, sparse: bool = True, most: int = 1 << 16) -> DataFrame:
    """variant_id, sample_id and dosage; in sparse form without rows of dosage 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                values = b.column("dosages")[k].values
                for at in range(0, len(values) if values is not None else 0, most):
                    x = values.slice(at, most)
                    there = np.flatnonzero(x.fill_null(1).to_numpy(zero_copy_only=False)) if sparse else np.arange(len(x))
                    yield pa.RecordBatch.from_arrays([b.column("variant_id").take(pa.array(np.full(len(there), k))), pa.array(at + there, pa.int32()), x.take(pa.array(there))], ["variant_id", "i", "dosage"])

    kind = dict(packed.dtypes)
    element = kind["dosages"].removeprefix("array<").removesuffix(">")
    d = packed.select("variant_id", "dosages").mapInArrow(run, f"variant_id {kind['variant_id']}, i int, dosage {element}")
    return d.join(samples, "i").select("variant_id", "sample_id", "dosage")


def _gen_lines(call_threshold: float, most_bytes: int = 16_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """GEN lines as columns: all fields of some lines are split once and lie in one array, of which triplets are slices."""

    def parse(lines: pa.Array) -> pa.RecordBatch:
        fields = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lines))
        size, flat = pc.list_value_length(fields).to_numpy(), fields.flatten()
        if (size < 5).any():
            raise ValueError("a GEN line has fewer than five fields")
        start = np.cumsum(size) - size
        n = (size - 5) // 3
        first = np.cumsum(n) - n
        at = np.repeat(start + 5 - 3 * first, n) + 3 * np.arange(n.sum())
        p = np.stack([flat.take(pa.array(at + k)).cast(pa.float64()).to_numpy() for k in range(3)], 1)
        best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
        sure = p[np.arange(len(p)), best] >= call_threshold
        dosages = pa.ListArray.from_arrays(pa.array(np.append(first, n.sum()), pa.int32()), pa.array(best.astype(np.int8), mask=~sure))
        names = [flat.take(pa.array(start + k)) for k in range(5)]
        names[2] = names[2].cast(pa.int32())
        return pa.RecordBatch.from_arrays([*names, dosages], ["snp_id", "rsid", "bp", "ref", "alt", "dosages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.cumsum(pc.binary_length(b.column("value")).to_numpy()) // most_bytes
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    yield parse(b.column("value").slice(x, y - x))

    return run


def read_gen(spark: SparkSession, path: str, call_threshold: float = 0.9) -> DataFrame:
    """snp_id, rsid, bp, ref, alt and dosages of Oxford GEN lines: hard calls where a genotype is likely enough.

    A line of any number of samples takes time in proportion to them; probabilities after the last whole triplet are left out.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.mapInArrow(_gen_lines(call_threshold), "snp_id string, rsid string, bp int, ref string, alt string, dosages array<tinyint>")


def number_lines(rows: DataFrame) -> DataFrame:
    """`rows`, just read with _metadata, with `line` instead: their number over all files in order of their paths.

    A split is read in order, so a line's number is its place in its split and what the
    splits before it hold; only one row a split is ordered in a task.
    """
    d = rows.withColumns({"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}).drop("_metadata")
    sizes = d.groupBy("_path", "_start").agg(F.count("*").alias("c"), F.min("_at").alias("_first"))
    earlier = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_path", "_start", "_first", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("_before"))
    d = d.join(broadcast_if_small(sizes), ["_path", "_start"])
    return d.withColumn("line", F.col("_before") + F.col("_at") - F.col("_first")).drop("_path", "_start", "_at", "_first", "_before")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return number_lines(spark.read.text(path).select("value", "_metadata"))


def read_hap_legend(spark: SparkSession, hap: str, legend: str) -> DataFrame:
    """line, id, position, a0, a1, n_alt and n_haplotypes: line i of the haplotypes with line i of the legend."""
    f = F.split(F.trim("value"), r"\s+")
    left = text_lines(spark, legend).where("line > 0").select((F.col("line") - 1).alias("line"), f[0].alias("id"), f[1].cast("long").alias("position"), f[2].alias("a0"), f[3].alias("a1"))
    right = text_lines(spark, hap).select("line", F.size(F.filter(f, lambda x: x == "1")).alias("n_alt"), F.size(f).alias("n_haplotypes"))
    return left.join(right, "line")
