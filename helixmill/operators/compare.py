"""Comparison of methods: recall, rank correlation, agreement of effects, densities and variability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.columns import BIOBANK_LINE, finite, neg_log10_p
from helixmill.functions.ordering import beside, counted
from helixmill.operators.harmonize import align_results
from helixmill.operators.pgs import seeded_sample
from helixmill.operators.qc import is_hit


def hit_recall(method: DataFrame, base: DataFrame, by: Sequence[str] = (), line: float = BIOBANK_LINE, base_line: float | None = None) -> DataFrame:
    """by, true hits, those found, and recall (null without true hits)."""
    truth = base.select("rsid", is_hit(F.col("p"), base_line or line).alias("true"))
    d = method.select("rsid", *by, is_hit(F.col("p"), line).alias("found")).join(truth, "rsid")
    return d.groupBy(*by).agg(F.count_if("true").alias("true_hits"), F.count_if(F.col("true") & F.col("found")).alias("found")).withColumn("recall", F.try_divide("found", "true_hits"))


def average_rank(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """`df` with the mean rank of equal values; null has none. Values are ranked once, whoever has them."""
    c = counted(df, column, by)
    return df.join(c.select(*by, column, (F.col("upto_n") - (F.col("n") - 1) / 2).alias(out)), [*by, column], "left")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n and rho over complete pairs; null where a side is constant."""
    d = df.select(*by, finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).dropna(subset=["x", "y"])
    d = average_rank(average_rank(d, "x", "rx", by), "y", "ry", by)
    n, sx, sy = F.count("*"), F.sum("rx"), F.sum("ry")
    cov = F.sum(F.col("rx") * F.col("ry")) - sx * sy / n
    vx, vy = F.sum(F.col("rx") * F.col("rx")) - sx * sx / n, F.sum(F.col("ry") * F.col("ry")) - sy * sy / n
    return d.groupBy(*by).agg(n.alias("n"), F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)).alias("rho"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """by, bin (1..bins, the last one closed) and n."""
    x = finite(F.col(column))
    b = F.when(x == hi, bins).otherwise(F.floor((x - lo) / ((hi - lo) / bins)) + 1).cast("int")
    return df.where((x >= lo) & (x <= hi)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def density_2d(df: DataFrame, x: str, y: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """by, x_bin, y_bin and n over the range of each axis (of each group)."""
    d = df.select(*by, finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).dropna(subset=["x", "y"])
    span = d.groupBy(*by).agg(*(f(c).alias(f"{k}_{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))))
    d = beside(d, span, by)
    b = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.least(F.lit(bins), F.floor((F.col(c) - F.col(f"lo_{c}")) * bins / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))) + 1)).otherwise(1).cast("int")
    return d.groupBy(*by, b("x").alias("x_bin"), b("y").alias("y_bin")).agg(F.count("*").alias("n"))


def score_distribution(scores: DataFrame, by: Sequence[str] = ("method", "trait")) -> DataFrame:
    """by, number of finite scores, mean, least, greatest and deviation."""
    x = finite(F.col("score"))
    return scores.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd"))


def delta_betas(runs: DataFrame, base: DataFrame) -> DataFrame:
    """runs (method, run, trait, rsid, beta) with delta, the difference from the baseline effect."""
    b = base.select("trait", "rsid", F.col("beta").alias("base_beta"))
    return runs.join(b, ["trait", "rsid"]).withColumn("delta", finite(F.col("beta") - F.col("base_beta"))).where("delta is not null")


def delta_beta_summary(deltas: DataFrame) -> DataFrame:
    """Mean, least, greatest and deviation of delta for each method and trait, with margins (null) by cube."""
    return deltas.cube("method", "trait").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.min("delta").alias("lo"), F.max("delta").alias("hi"), F.stddev_samp("delta").alias("sd"))


def effect_agreement(base: DataFrame, other: DataFrame, bins: int = 30) -> DataFrame:
    """Density of pairs of finite effects of two methods."""
    return density_2d(align_results(base, other, ["beta"]), "beta_a", "beta_b", bins)


def concordance(fed: DataFrame, base: DataFrame) -> DataFrame:
    """rsid, -log10 p and effects of both methods, and i2 of the federated one."""
    d = align_results(fed, base, ["p", "beta"], ("_fed", "_base"))
    return d.join(fed.select("rsid", "i2"), "rsid").select("rsid", neg_log10_p(F.col("p_fed")).alias("logp_fed"), neg_log10_p(F.col("p_base")).alias("logp_base"), "beta_fed", "beta_base", "i2")


def per_person_pairs(scores: DataFrame, a: str = "base", b: str = "dp", most: int = 6000, seed: int = 1) -> DataFrame:
    """sample_id, trait and a person's scores by two methods, for a keyed sample of `most` people a trait."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("score")))
    d = scores.groupBy("sample_id", "trait").agg(pick(a).alias(f"score_{a}"), pick(b).alias(f"score_{b}"))
    return seeded_sample(d, most, seed, "sample_id", ["trait"])
