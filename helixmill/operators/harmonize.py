"""Matching score files, annotations and genotypes by variant, and bringing alleles to one orientation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.columns import broadcast_if_small, flip


def first_match(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; partial aggregation instead of a sort of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order))).alias("_row"))
    return first.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def overlap_weights(weights: DataFrame, variants: DataFrame) -> DataFrame:
    """Weights of the variants at hand."""
    return weights.join(variants.select("rsid").distinct(), "rsid", "left_semi")


def non_score_variants(variants: DataFrame, weights: DataFrame, least: int = 500) -> DataFrame:
    """Variants outside the score; all of them if that leaves `least` or fewer."""
    outside = variants.join(weights.select("rsid").distinct(), "rsid", "left_anti")
    return variants if outside.limit(least + 1).count() <= least else outside


def union_effect_alleles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (rsid, effect_allele, effect_weight) of two scores."""
    cols = ["rsid", "effect_allele", "effect_weight"]
    return a.select(*cols).unionByName(b.select(*cols)).distinct()


def shared_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("rsid").intersect(b.select("rsid"))


def annotate_rsid(variants: DataFrame, names: DataFrame) -> DataFrame:
    """Replace rsid by the name known for (chr, bp), where there is one."""
    known = names.select(F.col("chr").alias("n_chr"), F.col("bp").alias("n_bp"), F.col("rsid").alias("n_rsid"))
    d = variants.join(known, (F.col("chr") == F.col("n_chr")) & (F.col("bp") == F.col("n_bp")), "left")
    return d.withColumn("rsid", F.coalesce("n_rsid", "rsid")).drop("n_chr", "n_bp", "n_rsid")


def allele_flips(variants: DataFrame, weights: DataFrame, order: Sequence[str]) -> DataFrame:
    """variants with effect_allele (of the first matching weight, ALT if none), flipped, and status.

    A dosage is flipped when the effect allele is not ALT; status tells whether it is then
    REF (`flipped`) or neither (`mismatch`).
    """
    first = first_match(weights.select("rsid", "effect_allele", *order), "rsid", order).select("rsid", "effect_allele")
    d = variants.join(first, "rsid", "left").withColumn("effect_allele", F.coalesce("effect_allele", "alt"))
    same = F.col("effect_allele") == F.col("alt")
    return d.withColumn("flipped", ~same).withColumn("status", F.when(same, "same").when(F.col("effect_allele") == F.col("ref"), "flipped").otherwise("mismatch"))


def harmonize_alleles(genotypes: DataFrame, flips: DataFrame, drop_mismatch: bool = False) -> DataFrame:
    """Genotypes that count the effect allele. Sparse rows keep `flipped`, as their absent zeros become twos."""
    f = flips.where("status <> 'mismatch'") if drop_mismatch else flips
    f = broadcast_if_small(f.select("variant_id", "flipped"))
    return genotypes.join(f, "variant_id").withColumn("dosage", flip(F.col("dosage"), F.col("flipped")))


def align_results(a: DataFrame, b: DataFrame, columns: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b"), how: str = "inner") -> DataFrame:
    """Results of two methods side by side by rsid; of pairs, those where all columns are finite on both sides."""
    from helixmill.functions.columns import finite

    x, y = (d.select("rsid", *(finite(F.col(c)).alias(f"{c}{s}") for c in columns)) for d, s in ((a, suffixes[0]), (b, suffixes[1])))
    d = x.join(y, "rsid", how)
    return d.dropna(subset=[f"{c}{s}" for c in columns for s in suffixes]) if how == "inner" else d
