"""Federated forms: the site is a column, and only cells and sums keyed by it are combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.columns import broadcast_if_small
from helixmill.functions.ordering import running_sums
from helixmill.operators.gwas import gwas_linear, gwas_linear_sparse, gwas_logistic, meta_fixed_effect, significant_hits
from helixmill.operators.pgs import ols_sufficient_stats, pgs_score, pool_stats, r2_from_stats
from helixmill.operators.roc import auc_trapezoid, monotone_roc, rates, roc_counts_at, site_quantiles, weighted_thresholds


def assign_sites(samples: DataFrame, k: int, seed: int = 1, exact: bool = True) -> DataFrame:
    """`samples` with site 1..k: a keyed shuffle cut into near-equal parts, the first ones larger by one.

    Ranks come from ranges of the keyed hash, each ordered by itself. With `exact` off, sites are
    the hash modulo k, of nearly equal size and without any shuffle.
    """
    if k < 2:
        raise ValueError("at least two sites")
    u = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("site"), F.col("sample_id").cast("string")))
    if not exact:
        return samples.withColumn("site", (F.pmod(F.xxhash64(u), F.lit(k)) + 1).cast("int"))
    d = samples.withColumns({"_u": F.struct(u, "sample_id"), "_one": F.lit(1)})
    d = running_sums(d, "_u", ["_one"], cut=F.conv(F.substring(u, 1, 3), 16, 10).cast("int"))
    few, more = F.floor(F.col("total__one") / k), F.col("total__one") % k
    at = F.col("upto__one") - 1
    site = F.when(at < more * (few + 1), F.floor(at / (few + 1))).otherwise(more + F.floor(F.try_divide(at - more * (few + 1), few)))
    return d.select(*samples.columns, (site + 1).cast("int").alias("site"))


def sites_for_grid(samples: DataFrame, ks: Sequence[int], seed: int = 1) -> DataFrame:
    """`samples` once for each k of the grid, with k and site."""
    out = None
    for k in ks:
        one = assign_sites(samples, k, seed).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def federated_gwas(cells: DataFrame, trait: str, by: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """variant_id, by and the meta-analysis of fits per site; trait is `quant` or `binary`."""
    keys = ["variant_id", *by]
    fits = gwas_linear(cells, [*keys, "site"]) if trait == "quant" else gwas_logistic(cells, [*keys, "site"], firth=True)
    return meta_fixed_effect(fits.select(*keys, "site", "beta", "se"), keys, p_values)


def federated_linear(genotypes: DataFrame, people: DataFrame, by: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """`federated_gwas` of y_quant straight from sparse genotypes: only sums by variant and site are shuffled."""
    fits = gwas_linear_sparse(genotypes, people, [*by, "site"])
    return meta_fixed_effect(fits.select("variant_id", *by, "site", "beta", "se"), ["variant_id", *by], p_values)


def federated_scores(fits: DataFrame, genotypes: DataFrame, people: DataFrame, by: Sequence[str] = (), line: float = 5e-8) -> DataFrame:
    """Scores from the effects of significant variants, to six digits, so that equal ones compare as such; everyone scores 0 where none is."""
    w = significant_hits(fits, line=line).select("variant_id", *by, F.col("beta").alias("weight"), F.lit("fed").alias("trait"))
    # a person may occur once for each value of `by`, but is scored once for all
    s = pgs_score(genotypes, w, people.select("sample_id").distinct(), ["trait", *by]).drop("trait")
    cols = ["sample_id", *by, "age", "sex", "y_bin", "y_quant", "site"]
    return people.select(*cols).join(s, ["sample_id", *by], "left").withColumn("score", F.coalesce(F.round("score", 6), F.lit(0.0)))


def federated_roc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pooled ROC points: counts at thresholds averaged from the sites' quantiles."""
    t = weighted_thresholds(site_quantiles(scores, by), by)
    return monotone_roc(rates(roc_counts_at(scores, t, by)), by)


def federated_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return auc_trapezoid(federated_roc(scores, by), by)


def federated_r2(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Regression of y_quant on score, age and sex from pooled site statistics."""
    return r2_from_stats(pool_stats(ols_sufficient_stats(scores, ["score", "age", "sex"], "y_quant", [*by, "site"]), by), by)


def site_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, site, size, cases and the site's own AUC at its 61 quantile thresholds."""
    keys = [*by, "site"]
    size = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y_bin").alias("cases"))
    c = roc_counts_at(scores, site_quantiles(scores, by).select(*keys, F.col("q").alias("thresholds")), keys)
    r = c.where("n_pos > 0 and n_neg > 0").select(*keys, (F.col("tp") / F.col("n_pos")).alias("tpr"), (F.col("fp") / F.col("n_neg")).alias("fpr"))
    return size.join(broadcast_if_small(auc_trapezoid(r, keys)), keys, "left")
