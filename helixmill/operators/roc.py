"""ROC curves and areas: exact, from thresholds, from histograms, and over sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.columns import broadcast_if_small, clip
from helixmill.functions.ordering import before, quantiles, running_sums


def _up_to(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _counts_down(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, score, pos and neg at each distinct score, with their sums from the highest score down and in all."""
    c = scores.where("score is not null and y_bin is not null").groupBy(*by, "score").agg(F.sum("y_bin").alias("pos"), F.sum(1 - F.col("y_bin")).alias("neg"))
    return running_sums(c, "score", ["pos", "neg"], by, down=True)


def roc_exact(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, score, fpr and tpr at each distinct score from the highest down, and the origin (null score).

    Ties are one point: people are counted by score before anything is ordered.
    """
    d = _counts_down(scores, by).select(*by, "score", F.try_divide("upto_neg", "total_neg").alias("fpr"), F.try_divide("upto_pos", "total_pos").alias("tpr"))
    origin = d.select(*by).distinct() if by else d.limit(1).select(F.lit(1).alias("_one"))
    origin = origin.select(*by, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return d.unionByName(origin)


def roc_counts_at(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, tp, fp, n_pos and n_neg: people with a score of at least each threshold.

    Thresholds are one array a group (column `thresholds`). People are counted by the number
    of thresholds that they reach, so nothing grows with people times thresholds.
    """
    t = thresholds.withColumn("thresholds", F.array_sort(F.array_distinct("thresholds")))
    t = t if by else t.withColumn("_k", F.lit(1))
    keys = list(by) if by else ["_k"]
    s = scores.where("score is not null and y_bin is not null")
    s = s if by else s.withColumn("_k", F.lit(1))
    d = s.join(broadcast_if_small(t), keys).withColumn("i", F.size(F.filter("thresholds", lambda x: x <= F.col("score"))))
    c = d.groupBy(*keys, "i").agg(F.sum("y_bin").alias("pos"), F.sum(1 - F.col("y_bin")).alias("neg"))
    every = t.select(*keys, F.posexplode(F.concat(F.array(F.lit(None).cast("double")), "thresholds")).alias("i", "threshold"))
    d = every.join(c, [*keys, "i"], "left").na.fill(0, ["pos", "neg"])
    part = Window.partitionBy(*keys)
    down = _up_to(part.orderBy(F.col("i").desc()))
    d = d.select(*keys, "i", "threshold", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(part).alias("n_pos"), F.sum("neg").over(part).alias("n_neg"))
    return d.where("i > 0").select(*by, "threshold", "tp", "fp", "n_pos", "n_neg")


def rates(counts: DataFrame) -> DataFrame:
    """Counts with fpr and tpr; 0 where there is nobody to count."""
    return counts.withColumns({"fpr": F.coalesce(F.try_divide("fp", "n_neg"), F.lit(0.0)), "tpr": F.coalesce(F.try_divide("tp", "n_pos"), F.lit(0.0))})


def roc_from_histogram(bins: DataFrame, by: Sequence[str] = (), pos: str = "pos", neg: str = "neg", n_pos: str = "n_pos", n_neg: str = "n_neg") -> DataFrame:
    """by, bin, fpr and tpr: counts cumulated from the highest bin down over the given totals."""
    down = _up_to(Window.partitionBy(*by).orderBy(F.col("bin").desc()))
    return bins.select(*by, "bin", (F.sum(neg).over(down) / F.col(n_neg)).alias("fpr"), (F.sum(pos).over(down) / F.col(n_pos)).alias("tpr"))


def monotone_roc(roc: DataFrame, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Points by (fpr, tpr), both raised to their running maximum and held within [0, 1].

    Points of one fpr follow by tpr, so only the greatest tpr of lower fprs matters, which is carried between parts.
    """
    top = before(roc.groupBy(*by, "fpr").agg(F.max("tpr").alias("tpr")), "fpr", by, greatest=["tpr"], rows=rows)
    d = roc.select(*by, "fpr", F.col("tpr").alias("_t")).join(broadcast_if_small(top.select(*by, "fpr", "max_tpr")), [*by, "fpr"])
    return d.select(*by, clip(F.col("fpr"), 0, 1).alias("fpr"), clip(F.greatest("_t", "max_tpr"), 0, 1).alias("tpr"))


def auc_trapezoid(roc: DataFrame, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """by and auc: the trapezoid rule over points by (fpr, tpr), held within [0, 1]; null for fewer than two points.

    Points of one fpr span no area, so each fpr is one row of its lowest and highest tpr; the last row of a part is carried to the next.
    """
    d = roc.where("fpr is not null and tpr is not null").select(*by, clip(F.col("fpr"), 0, 1).alias("f"), clip(F.col("tpr"), 0, 1).alias("t"))
    d = before(d.groupBy(*by, "f").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n")), "f", by, last=["f", "high"], rows=rows)
    area = F.coalesce(F.sum((F.col("f") - F.col("last_f")) * (F.col("low") + F.col("last_high")) / 2), F.lit(0.0))
    return d.groupBy(*by).agg(F.when(F.sum("n") > 1, clip(area, 0, 1)).alias("auc"))


def auc_rank(scores: DataFrame, by: Sequence[str] = (), auto_direction: bool = False) -> DataFrame:
    """by and auc: the chance that a case scores above a control, ties counting half; null without cases or controls."""
    won = F.sum(F.col("neg") * (F.col("upto_pos") - F.col("pos") / 2))
    d = _counts_down(scores, by).groupBy(*by).agg(F.try_divide(won, F.max("total_pos") * F.max("total_neg")).alias("auc"))
    return d.withColumn("auc", F.greatest("auc", 1 - F.col("auc"))) if auto_direction else d


def weighted_thresholds(site_quantiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by and thresholds: quantiles of the sites (arrays `q`), averaged by site size (`n`) at each probability.

    They are held to nine digits, so that the average of equal quantiles is no other value.
    """
    d = site_quantiles.select(*by, "n", F.posexplode("q").alias("pos", "v"))
    d = d.groupBy(*by, "pos").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 9).alias("v"))
    return d.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("thresholds"))


def site_quantiles(scores: DataFrame, by: Sequence[str] = (), points: int = 61) -> DataFrame:
    """by, site, n and q: quantiles of the scores of each site."""
    return quantiles(scores, "score", [i / (points - 1) for i in range(points)], [*by, "site"])
