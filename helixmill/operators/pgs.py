"""Polygenic scores, phenotypes composed from them, and their evaluation by regression and bins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.columns import broadcast_if_small, clip, finite, gaussian, standard_score, uniform
from helixmill.functions.ordering import beside, quantiles, top_k
from helixmill.operators.harmonize import non_score_variants


def collapse_weights(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weights summed by rsid."""
    return weights.groupBy(*by, "rsid").agg(F.sum("effect_weight").alias("weight"))


def join_weights(genotypes: DataFrame, weights: DataFrame) -> DataFrame:
    """Genotypes with the weights of their variants; variants without weight go, a weight that is not finite is 0."""
    w = weights.withColumn("weight", F.coalesce(finite(F.col("weight")), F.lit(0.0)))
    return genotypes.join(broadcast_if_small(w), "variant_id")


def pgs_score(genotypes: DataFrame, weights: DataFrame, people: DataFrame, by: Sequence[str] = ("trait",)) -> DataFrame:
    """sample_id, by and score, the sum of dosage times weight, for all scores at once.

    weights has variant_id, weight and `by`. People without any weighted genotype score 0.
    If the genotypes have a column `flipped`, absent dosages of those variants are 2.
    """
    w = weights.select("variant_id", *by, "weight")
    flips = "flipped" in genotypes.columns
    term = (F.col("dosage") - F.when(F.col("flipped"), 2).otherwise(0) if flips else F.col("dosage")) * F.col("weight")
    if flips:  # an uncalled genotype adds nothing, so take back what its absence would have counted
        term = F.when(F.col("dosage").isNull() & F.col("flipped"), -2 * F.col("weight")).otherwise(term)
    sums = join_weights(genotypes, w).groupBy("sample_id", *by).agg(F.sum(term).alias("s"))
    kinds = broadcast_if_small(w.groupBy(*by).agg(F.lit(0.0).alias("base")))
    if flips:
        two = genotypes.where("flipped").select("variant_id").distinct()
        base = w.join(broadcast_if_small(two), "variant_id").groupBy(*by).agg(F.sum(2 * F.coalesce(finite(F.col("weight")), F.lit(0.0))).alias("b"))
        kinds = kinds.join(base, list(by), "left").withColumn("base", F.coalesce("b", F.lit(0.0))).drop("b")
    one = F.lit(1).alias("_k")
    every = people.select("sample_id", one).join(F.broadcast(kinds.withColumn("_k", F.lit(1))), "_k").drop("_k")
    d = every.join(sums, ["sample_id", *by], "left")
    return d.select("sample_id", *by, (F.coalesce("s", F.lit(0.0)) + F.col("base")).alias("score"))


def case_threshold(df: DataFrame, liability: str, prevalence: float = 0.119) -> DataFrame:
    """`df` with y_bin: liability above its (1 - prevalence) quantile (linear interpolation)."""
    cut = quantiles(df, liability, [1 - prevalence]).first()
    return df.withColumn("y_bin", (F.col(liability) > F.lit(cut["q"][0] if cut else None).cast("double")).cast("int"))


def compose_phenotype(scores: DataFrame, h2: float = 0.5, seed: int = 1, kind: str = "quant") -> DataFrame:
    """`scores` (sample_id, score_z, age, sex) with a phenotype: genetic part, covariates and keyed normal noise.

    quant: 25 + g + 0.02 age + 2 sex + e; liability: g + 0.05 age + 0.35 sex + e, with the
    variance of e at (1 - h2) / h2.
    """
    scale = float(np.sqrt((1 - h2) / h2))
    e = gaussian(uniform(seed, f"{kind}-u", F.col("sample_id")), uniform(seed, f"{kind}-v", F.col("sample_id")), scale)
    fixed = 25 + 0.02 * F.col("age") + 2 * F.col("sex") if kind == "quant" else 0.05 * F.col("age") + 0.35 * F.col("sex")
    return scores.withColumn("y_quant" if kind == "quant" else "liability", F.col("score_z") + fixed + e)


def seeded_sample(df: DataFrame, k: int, seed: int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """`k` rows (of each group), chosen by a keyed hash: the same on every run and plan."""
    u = uniform(seed, "sample", F.col(key))
    d = top_k(df.withColumn("_u", u), k, [("_u", False), (key, False)], by, rank="_r")
    return d.drop("_u", "_r")


def genetic_component(genotypes: DataFrame, variants: DataFrame, weights: DataFrame, people: DataFrame, mode: str, seed: int = 1, k: int = 300, least: int = 500) -> DataFrame:
    """sample_id and score_z: from catalog weights (PGS), `k` seeded variants outside the score (SPARSE), or nothing (NULL)."""
    if mode == "NULL":
        return people.select("sample_id", F.lit(0.0).alias("score_z"))
    if mode == "PGS":
        w = collapse_weights(weights).join(variants.select("rsid", "variant_id"), "rsid").select("variant_id", "weight")
    elif mode == "SPARSE":
        pool = seeded_sample(non_score_variants(variants, weights, least), k, seed, "variant_id").select("variant_id")
        w = pool.withColumn("weight", gaussian(uniform(seed, "effect-u", F.col("variant_id")), uniform(seed, "effect-v", F.col("variant_id")), 0.1))
    else:
        raise ValueError(f"no mode {mode}")
    s = pgs_score(genotypes, w.withColumn("trait", F.lit(mode)), people)
    return standard_score(s, "score", "score_z").select("sample_id", "score_z")


def quantile_edges(df: DataFrame, column: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """by and edges: n + 1 quantiles (linear interpolation), each kept once; a single one widens to the range."""
    # the first and the last quantile are the range, so a single edge is one value that all have
    return quantiles(df, column, [i / n for i in range(n + 1)], by).select(*by, F.array_distinct("q").alias("edges"))


def assign_bin(x: Column, edges: Column) -> Column:
    """Number of the right-closed interval between edges that x lies in, from 1; the first is closed on both sides."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.lit(0), F.size(edges) - 2))
    return F.when(x.isNotNull() & (x >= F.get(edges, 0)) & (x <= F.element_at(edges, -1)), 1 + F.size(F.filter(inner, lambda e: e < x)))


def with_bins(df: DataFrame, column: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """`df` with bin, by quantile edges (of each group); edges are one row a group, and broadcast only if few."""
    return beside(df, quantile_edges(df, column, n, by), by).withColumn("bin", assign_bin(F.col(column), F.col("edges")))


def binned_means(df: DataFrame, x: str, y: str, bins: int = 10, clip_at: float = 50.0) -> DataFrame:
    """bin, n, sum_y (clipped) and mean of y for each quantile bin of x; bins without people have n = 0."""
    d = with_bins(df, x, bins)
    every = d.select(F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin")).distinct()
    sums = d.groupBy("bin").agg(F.count("*").alias("n"), F.sum(clip(F.col(y), -clip_at, clip_at)).alias("sum_y"))
    out = every.join(sums, "bin", "left")
    return out.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sum_y", F.lit(0.0)).alias("sum_y"), F.try_divide("sum_y", "n").alias("mean_y"))


def ols_sufficient_stats(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, sums of products of (1, xs) and y: all that least squares needs, and sums add up over sites."""
    cols = {"1": F.lit(1.0), **{x: F.col(x).cast("double") for x in xs}}
    names = list(cols)
    d = df.where(F.col(y).isNotNull())
    out = [F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("sum_y")]
    out += [F.sum(cols[a] * F.col(y)).alias(f"t_{i}") for i, a in enumerate(names)]
    out += [F.sum(cols[a] * cols[b]).alias(f"s_{i}{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    return d.groupBy(*by).agg(*out)


def pool_stats(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of sites added up."""
    skip = {*by, "site"}
    return stats.groupBy(*by).agg(*(F.sum(c).alias(c) for c in stats.columns if c not in skip))


def r2_from_stats(stats: DataFrame, by: Sequence[str] = (), p: int = 4) -> DataFrame:
    """by, n, beta, sse, sst, r2 and r2_adj from sufficient statistics; nulls if singular or without variance."""
    schema = ", ".join([*(f"{k} {dict(stats.dtypes)[k]}" for k in by), "n long, beta array<double>, sse double, sst double, r2 double, r2_adj double"])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n = pdf["n"].to_numpy(np.int64)
            s = np.stack([pdf[f"s_{min(i, j)}{max(i, j)}"].to_numpy(float) for i in range(p) for j in range(p)], 1).reshape(-1, p, p)
            t, yy, sum_y = np.stack([pdf[f"t_{i}"].to_numpy(float) for i in range(p)], 1), pdf["yy"].to_numpy(float), pdf["sum_y"].to_numpy(float)
            sst = yy - sum_y**2 / np.maximum(n, 1)
            scale = np.sqrt(np.maximum(np.diagonal(s, axis1=1, axis2=2), 1e-300))
            scaled = s / (scale[:, :, None] * scale[:, None, :])
            fine = (n > p) & (sst > 0) & np.isfinite(scaled).all((1, 2))
            fine[fine] = np.linalg.cond(scaled[fine]) <= 1e10
            beta, out = np.full((len(n), p), np.nan), {c: np.full(len(n), np.nan) for c in ("sse", "sst", "r2", "r2_adj")}
            beta[fine] = np.linalg.solve(s[fine], t[fine][..., None])[..., 0]
            sse = yy - 2 * (beta * t).sum(1) + ((s @ beta[..., None])[..., 0] * beta).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                for c, v in (("sse", sse), ("sst", sst), ("r2", 1 - sse / sst), ("r2_adj", 1 - (sse / (n - p)) / (sst / (n - 1)))):
                    out[c] = np.where(fine, v, np.nan)
            lists = [b.tolist() if ok else None for b, ok in zip(beta, fine)]
            yield pd.DataFrame({**{k: pdf[k] for k in by}, "n": n, "beta": pd.Series(lists, pdf.index, object), **{c: pd.Series(v, pdf.index).astype(object).where(fine, None) for c, v in out.items()}})

    return stats.mapInPandas(solve, schema)


def regression_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of y on x."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
