"""Variant and sample quality control: statistics, filters and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_stats(genotypes: DataFrame, n_samples: int, sparse: bool = True) -> DataFrame:
    """Per variant: calls, missing rate, allele frequency, MAF, mean, variance and deviation of dosage.

    One aggregation with map-side partial sums. In sparse data dosage 0 has no row, so the
    number of samples comes in from outside.
    """
    n_rows, called = F.count("*"), F.count("dosage")
    s, ss = F.coalesce(F.sum("dosage"), F.lit(0)), F.coalesce(F.sum(F.col("dosage") * F.col("dosage")), F.lit(0))
    d = genotypes.groupBy("variant_id").agg(n_rows.alias("n_rows"), called.alias("given"), s.alias("s"), ss.alias("ss"), F.min("dosage").alias("lo"), F.max("dosage").alias("hi"))
    total = F.lit(n_samples) if sparse else F.col("n_rows")
    d = d.withColumn("n_missing", F.col("n_rows") - F.col("given")).withColumn("n_called", (total - F.col("n_missing")).cast("long"))
    some = F.col("n_called") > 0
    d = d.withColumn("mean", F.when(some, F.col("s") / F.col("n_called")))
    d = d.withColumn("var", F.when(F.col("n_called") > 1, (F.col("ss") - F.col("s") * F.col("mean")) / (F.col("n_called") - 1)))
    d = d.withColumn("missing_rate", F.col("n_missing") / total).withColumn("freq", F.col("mean") / 2)
    zeros = (F.col("n_called") > F.col("given")) if sparse else F.lit(False)
    return d.select(
        "variant_id",
        "n_called",
        "missing_rate",
        "freq",
        F.least("freq", 1 - F.col("freq")).alias("maf"),
        "mean",
        "var",
        F.sqrt("var").alias("sd"),
        F.coalesce(F.least(F.col("lo"), F.when(zeros, F.lit(0))) < F.greatest(F.col("hi"), F.when(zeros, F.lit(0))), F.lit(False)).alias("polymorphic"),
    )


def filter_maf_missing(genotypes: DataFrame, stats: DataFrame, maf: float = 0.01, missing: float = 0.05) -> DataFrame:
    """Genotypes of variants with MAF of at least `maf` and at most `missing` calls missing; monomorphic ones go."""
    good = stats.where((F.col("maf") >= maf) & (F.col("missing_rate") <= missing) & F.col("polymorphic"))
    return genotypes.join(good.select("variant_id"), "variant_id", "left_semi")


def filter_polymorphic(genotypes: DataFrame, stats: DataFrame) -> DataFrame:
    return genotypes.join(stats.where("polymorphic").select("variant_id"), "variant_id", "left_semi")


def filter_population(rows: DataFrame, panel: DataFrame, population: str) -> DataFrame:
    """Rows of samples whose super-population is `population`."""
    return rows.join(panel.where(F.col("super_pop") == population).select("sample_id"), "sample_id", "left_semi")


def filter_biallelic_snps(variants: DataFrame) -> DataFrame:
    """Variants with exactly two alleles, each of one base."""
    base = lambda c: F.upper(c).isin("A", "C", "G", "T")
    return variants.where(base(F.col("ref")) & base(F.col("alt")))


def filter_chromosome(rows: DataFrame, chromosome: str, column: str = "chr_name") -> DataFrame:
    """Rows of a chromosome, whether coded as text or number."""
    return rows.where(F.col(column).cast("string") == chromosome)


def first_polymorphic_locus(haplotypes: DataFrame) -> DataFrame:
    """Of (line, position, n_alt, n_haplotypes): the first position with both alleles, else the first one."""
    both = (F.col("n_alt") > 0) & (F.col("n_alt") < F.col("n_haplotypes"))
    return haplotypes.agg(F.coalesce(F.min_by("position", F.when(both, F.col("line"))), F.min_by("position", "line")).alias("position"))


def normalize_columns(df: DataFrame, spec: dict[str, Sequence[str]]) -> DataFrame:
    """Rename, for each canonical name, the first candidate that `df` has (ignoring case); fail listing what is missing."""
    have = {}
    for c in df.columns:
        have.setdefault(c.lower(), c)
    found = {name: next((have[c.lower()] for c in (name, *candidates) if c.lower() in have), None) for name, candidates in spec.items()}
    missing = [k for k, v in found.items() if v is None]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.withColumnsRenamed({v: k for k, v in found.items()})


def ensure_columns(df: DataFrame, wanted: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Add the `wanted` columns that are absent, as nulls of their types, and drop helper columns."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}).drop(*drop)


def split_fit_status(fits: DataFrame) -> DataFrame:
    """status and reason of each fit, and their counts: attempted fits either succeed or fail as constant or in the model."""
    ok = F.col("beta").isNotNull() & F.col("se").isNotNull()
    status = F.when(ok, "succeeded").otherwise("failed")
    reason = F.when(ok, F.lit(None).cast("string")).when(~F.col("polymorphic"), "constant").otherwise("model_error")
    return fits.withColumns({"status": status, "reason": reason})


def fit_counts(fits: DataFrame) -> DataFrame:
    return split_fit_status(fits).groupBy("status", "reason").agg(F.count("*").alias("n"))


def variant_funnel(stats: DataFrame, weights: DataFrame, variants: DataFrame, maf: float = 0.01, missing: float = 0.05) -> DataFrame:
    """Step and number of variants left at each step; no pruning by linkage is done, so that step keeps its count."""
    good = (F.col("maf") >= maf) & (F.col("missing_rate") <= missing) & F.col("polymorphic")
    s = stats.join(variants.select("variant_id", "rsid"), "variant_id")
    scored = weights.select("rsid").distinct().withColumn("scored", F.lit(1))
    one = s.join(scored, "rsid", "left").agg(F.count("*").alias("raw"), F.count_if(good).alias("kept"), F.count_if(good & F.col("scored").isNotNull()).alias("overlap"))
    every = weights.agg(F.countDistinct("rsid").alias("score"))
    steps = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("ord"), F.lit(k).alias("step"), F.col(c).alias("variants"))
                for i, (k, c) in enumerate((("raw", "raw"), ("maf_missing", "kept"), ("ld_pruning", "kept"), ("score_all", "score"), ("score_overlap", "overlap")))
            )
        )
    )
    return one.withColumn("k", F.lit(1)).join(every.withColumn("k", F.lit(1)), "k").select(steps.alias("s")).select("s.*")


def is_hit(p: Column, line: float) -> Column:
    return p.isNotNull() & ~F.isnan(p) & (p < line)
