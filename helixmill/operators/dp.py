"""Differentially private results: selection, noisy least squares, noisy tables, curves and bins.

Sums do not depend on the privacy budget, so they are reduced once; budgets are small grid
tables, and noise is keyed by seed and variant. Scaling, quantile edges and the variance
filter come from the data without noise and count as public. The seed must be secret in use.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import stats
from helixmill.functions.columns import broadcast_if_few, broadcast_if_small, clip, gaussian, gumbel, laplace, row_scale, split_budget, strong_composition, uniform, zcdp
from helixmill.functions.ordering import numbered, top_k
from helixmill.functions.stored import store
from helixmill.operators.cells import is_flipped
from helixmill.operators.gwas import chi2_p
from helixmill.operators.pgs import with_bins
from helixmill.operators.roc import roc_from_histogram

X = ("1", "g", "a", "x")


def budget_table(grid: DataFrame, accounting: str = "zcdp", share: float = 0.2) -> DataFrame:
    """grid (eps_total, delta_total, top_k) with eps_sel, eps_est and the parameters of each query.

    Half of delta is the trait's; the other half stays with the other trait.
    """
    sel, est = split_budget(F.col("eps_total"), share)
    d = grid.withColumns({"eps_sel": sel, "eps_est": est})
    delta, m = F.col("delta_total") * 0.5, F.greatest(F.lit(1), F.col("top_k"))
    if accounting == "zcdp":
        rho, per = zcdp(F.col("eps_est"), delta, m)
        none = F.lit(None).cast("double")
        return d.withColumns({"rho_total": rho, "rho_per": per, "eps_per": none, "delta_per": none})
    eps, small = strong_composition(F.col("eps_est"), delta, m)
    none = F.lit(None).cast("double")
    return d.withColumns({"rho_total": none, "rho_per": none, "eps_per": eps, "delta_per": small})


def utilities(cells: DataFrame, y_clip: float, binary: bool = False) -> DataFrame:
    """variant_id and utility: |sum of (dosage - 1) * y|, with y clipped (a 0/1 outcome needs no clipping)."""
    y = F.col("cases") if binary else F.col("sum_yc")
    return cells.groupBy("variant_id").agg(F.abs(F.sum((F.col("dosage") - 1) * y)).cast("double").alias("utility"))


def utilities_sparse(genotypes: DataFrame, people: DataFrame, y_clip: float, binary: bool = False) -> DataFrame:
    """As `utilities`, straight from sparse genotypes: carriers' dosage * y less the y of everybody who has a call.

    Flipping dosages only turns the sign, which a utility has not.
    """
    y = F.col("y_bin") if binary else clip(F.col("y_quant"), -y_clip, y_clip)
    y = F.coalesce(y.cast("double"), F.lit(0.0))
    flipped = is_flipped(genotypes)
    g = F.when(flipped, 2 - F.col("dosage")).otherwise(F.col("dosage"))
    of = people.select("sample_id", y.alias("y"))
    d = genotypes.join(broadcast_if_few(of), "sample_id").groupBy("variant_id").agg(F.coalesce(F.sum(g * F.col("y")), F.lit(0.0)).alias("gy"), F.coalesce(F.sum(F.when(F.col("dosage").isNull(), F.col("y"))), F.lit(0.0)).alias("lost"))
    total = of.agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("total"))
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")  # one row
    return d.select("variant_id", F.abs(F.col("gy") - F.col("total") + F.col("lost")).alias("utility"))


def noisy_utilities(u: DataFrame, budgets: DataFrame, y_clip: float, seed: int | str, by: Sequence[str] = ("eps_total",)) -> DataFrame:
    """variant_id, utility, by, top_k and noisy for each budget; the same uniform serves all of a variant's budgets."""
    b = F.broadcast(budgets.select(*by, "eps_sel", "top_k").withColumn("_k", F.lit(1)))
    d = u.withColumn("_k", F.lit(1)).join(b, "_k").drop("_k")
    return d.withColumn("noisy", F.col("utility") + gumbel(uniform(seed, "gumbel", F.col("variant_id")), y_clip / F.greatest(F.lit(1e-8), F.col("eps_sel"))))


def rank_by_noisy_utility(u: DataFrame, budgets: DataFrame, y_clip: float, seed: int | str, by: Sequence[str] = ("eps_total",)) -> DataFrame:
    """variant_id, by, noisy and rank of all variants for each budget; equal values follow by variant_id."""
    d = noisy_utilities(u, budgets, y_clip, seed, by)
    return numbered(d, [F.col("noisy").desc(), F.col("variant_id")], by, "rank").withColumn("rank", F.col("rank").cast("int")).drop("_n")


def first_by_noisy_utility(u: DataFrame, budgets: DataFrame, y_clip: float, seed: int | str, by: Sequence[str] = ("eps_total",)) -> DataFrame:
    """The first top_k of `rank_by_noisy_utility`, each task keeping top_k of a budget at most."""
    return top_k(noisy_utilities(u, budgets, y_clip, seed, by), "top_k", [("noisy", True), ("variant_id", False)], by)


def dp_topk(cells: DataFrame, budgets: DataFrame, y_clip: float, seed: int | str, binary: bool = False, by: Sequence[str] = ("eps_total",)) -> DataFrame:
    """The top_k variants of each budget by utility plus Gumbel noise of scale y_clip / eps_sel."""
    return first_by_noisy_utility(utilities(cells, y_clip, binary), budgets, y_clip, seed, by)


def dp_topk_sparse(genotypes: DataFrame, people: DataFrame, budgets: DataFrame, y_clip: float, seed: int | str, binary: bool = False, by: Sequence[str] = ("eps_total",)) -> DataFrame:
    """`dp_topk` straight from sparse genotypes."""
    return first_by_noisy_utility(utilities_sparse(genotypes, people, y_clip, binary), budgets, y_clip, seed, by)


def dp_ols_sums(cells: DataFrame, moments: DataFrame, age_mean: float, age_sd: float, length: float = 3.0, y: str = "sum_yc", yy: str = "sum_yyc") -> DataFrame:
    """variant_id, n and the sums of products of rows (1, g_z, age_z, sex) clipped to `length`, and of y.

    A row's length is a function of its cell, so cells give the clipped sums exactly.
    moments has variant_id, mean and sd of dosage.
    """
    d = cells.join(broadcast_if_small(moments.select("variant_id", "mean", "sd")), "variant_id")
    zero = F.lit(0.0)
    d = d.withColumns(
        {
            "x_1": F.lit(1.0),
            "x_g": F.when(F.col("sd") > 0, (F.col("dosage") - F.col("mean")) / F.col("sd")).otherwise(zero),
            "x_a": (F.col("age") - age_mean) / age_sd if age_sd else zero,
            "x_x": F.col("sex").cast("double"),
        }
    )
    d = d.withColumn("scale", row_scale([F.col(f"x_{k}") for k in X], length))
    d = d.withColumns({f"x_{k}": F.col(f"x_{k}") * F.col("scale") for k in X})
    out = [F.sum("n").alias("n"), F.sum(yy).cast("double").alias("yy")]
    out += [F.sum(F.col(f"x_{k}") * F.col(y)).alias(f"t_{i}") for i, k in enumerate(X)]
    out += [F.sum(F.col("n") * F.col(f"x_{a}") * F.col(f"x_{b}")).alias(f"s_{i}{j}") for i, a in enumerate(X) for j, b in enumerate(X) if j >= i]
    return d.groupBy("variant_id").agg(*out)


def noise_scales(length: float, y_clip: float, weights: tuple[float, float, float] = (0.2, 0.7, 0.1)) -> dict[str, Column]:
    """Deviations of the noise on S, t and yy, from rho_per where it is given, else from eps_per and delta_per."""
    sens = {"s": length**2, "t": length * y_clip, "yy": y_clip**2}
    share = dict(zip(sens, weights))
    whole = sum(weights)
    gauss = F.sqrt(2 * F.log(1.25 / F.col("delta_per"))) / F.col("eps_per")
    return {k: F.when(F.col("rho_per").isNotNull(), v / F.sqrt(2 * F.col("rho_per") * share[k])).otherwise(v * gauss * whole / share[k]) for k, v in sens.items()}


def dp_ols(sums: DataFrame, budgets: DataFrame, seed: int, ridge: float = 1.0, length: float = 3.0, y_clip: float = 50.0, by: Sequence[str] = ("eps_total",)) -> DataFrame:
    """variant_id, by, beta (of g_z), se, t and p: ridge regression on noisy sums, for each budget.

    budgets has `by`, rho_per, eps_per and delta_per.
    """
    b = F.broadcast(budgets.select(*by, "rho_per", "eps_per", "delta_per").withColumn("_k", F.lit(1)))
    d = sums.withColumn("_k", F.lit(1)).join(b, "_k").drop("_k")
    return solve_noisy(d, seed, ridge, length, y_clip, by)


def solve_noisy(d: DataFrame, seed: int | str, ridge: float, length: float, y_clip: float, by: Sequence[str]) -> DataFrame:
    """As `dp_ols`, for sums that already carry their budgets."""
    scale = noise_scales(length, y_clip)
    names = {c: "yy" if c == "yy" else c[0] for c in d.columns if c == "yy" or c[:2] in ("t_", "s_")}
    noisy = {}
    for c, kind in names.items():
        u, v = (uniform(seed, f"ols-{c}-{i}", F.col("variant_id")) for i in (0, 1))
        noisy[c] = F.col(c) + gaussian(u, v, scale[kind])
    d = d.withColumns(noisy).select("variant_id", *by, "n", *names)
    kinds = dict(d.dtypes)
    schema = ", ".join([f"variant_id {kinds['variant_id']}", *(f"{k} {kinds[k]}" for k in by), "n long, beta double, se double, t double, p double"])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n = pdf["n"].to_numpy()
            s = np.stack([pdf[f"s_{min(i, j)}{max(i, j)}"].to_numpy(float) for i in range(4) for j in range(4)], 1).reshape(-1, 4, 4)
            t = np.stack([pdf[f"t_{i}"].to_numpy(float) for i in range(4)], 1)
            beta, se, _ = stats.ridge(s, t, pdf["yy"].to_numpy(float), n, ridge)
            out = pdf[["variant_id", *by, "n"]].assign(beta=beta[:, 1], se=se[:, 1], t=beta[:, 1] / se[:, 1])
            out["p"] = stats.t_two_sided(out["t"].to_numpy(float), np.maximum(1, n - 4)) if len(out) else []
            yield out

    return d.mapInPandas(solve, schema)


def dp_gwas(variants: DataFrame, cells: DataFrame, sums: DataFrame, budgets: DataFrame, seed: int | str, ridge: float = 10.0, y_clip: float = 50.0, binary: bool = False, by: Sequence[str] = ("eps_total",)) -> DataFrame:
    """All variants with the private p of those selected, null elsewhere, for each budget."""
    chosen = broadcast_if_small(store(dp_topk(cells, budgets, y_clip, seed, binary, by).select("variant_id", *by), "chosen"))
    # the semi-join goes below the sums, which are then made of the chosen variants' cells alone
    own = sums.join(chosen.select("variant_id"), "variant_id", "left_semi").join(chosen, "variant_id").join(F.broadcast(budgets.select(*by, "rho_per", "eps_per", "delta_per")), list(by))
    fits = solve_noisy(own, seed, ridge, 3.0, y_clip, by)
    every = variants.withColumn("_k", F.lit(1)).join(F.broadcast(budgets.select(*by).distinct().withColumn("_k", F.lit(1))), "_k").drop("_k")
    return every.join(fits.select("variant_id", *by, "beta", "se", "p"), ["variant_id", *by], "left")


def dp_selection_summary(budgets: DataFrame, chosen: DataFrame, n_variants: int, by: Sequence[str] = ("eps_total",)) -> DataFrame:
    """One row a budget: variants, how many were selected, and the parameters of selection and queries."""
    k = chosen.groupBy(*by).agg(F.count("*").alias("selected"))
    return budgets.join(k, list(by), "left").select(*by, F.lit(n_variants).alias("m"), F.coalesce("selected", F.lit(0)).alias("selected"), "eps_sel", "eps_est", "rho_per", "eps_per", "delta_per")


def quant_betas(sums: DataFrame, moments: DataFrame, eps_total: float, delta_total: float, seed: int, y_clip: float = 80.0) -> DataFrame:
    """variant_id and beta per allele of every variant, each query with an equal part of epsilon and delta."""
    p = max(1, moments.count())
    spark = sums.sparkSession
    b = spark.createDataFrame([(eps_total, None, eps_total / p, delta_total / p)], "eps_total double, rho_per double, eps_per double, delta_per double")
    fits = dp_ols(sums, b, seed, ridge=1.0, y_clip=y_clip)
    return fits.join(moments.select("variant_id", "sd"), "variant_id").select("variant_id", (F.col("beta") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("beta"))


def case_table(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """variant_id, by and the six counts case_0..2 and ctrl_0..2; levels that nobody has are 0."""
    out = []
    for g in (0, 1, 2):
        here = F.col("dosage") == g
        out += [F.coalesce(F.sum(F.when(here, F.col("cases"))), F.lit(0)).cast("long").alias(f"case_{g}"), F.coalesce(F.sum(F.when(here, F.col("n") - F.col("cases"))), F.lit(0)).cast("long").alias(f"ctrl_{g}")]
    return cells.groupBy("variant_id", *by).agg(*out)


def noisy_case_table(table: DataFrame, eps: float, seed: int) -> DataFrame:
    """The table with Laplace noise of scale 1 / eps on each count, then held at 0 and raised by 1e-6."""
    cols = [c for c in table.columns if c[:5] in ("case_", "ctrl_")]
    return table.withColumns({c: F.greatest(F.lit(0.0), F.col(c) + laplace(uniform(seed, c, F.col("variant_id")), 1 / eps)) + 1e-6 for c in cols})


def case_betas(noisy: DataFrame, rounds: int = 12) -> DataFrame:
    """variant_id and the log odds ratio per allele of each 3x2 table, by Newton steps in columns.

    The model has two coefficients, so each step is a closed formula. Steps of 2 at most
    keep tables with nearly empty cells from running away.
    """
    cols = [f"{k}_{g}" for g in (0, 1, 2) for k in ("case", "ctrl")]
    d = noisy.select("variant_id", *cols, F.log((F.col("case_0") + F.col("case_1") + F.col("case_2")) / (F.col("ctrl_0") + F.col("ctrl_1") + F.col("ctrl_2"))).alias("b0"), F.lit(0.0).alias("b1"))
    # a fold over a range keeps the plan small whatever the number of rounds
    state = F.struct("b0", "b1")

    def step(acc: Column, _: Column) -> Column:
        p = [1 / (1 + F.exp(-(acc["b0"] + g * acc["b1"]))) for g in (0, 1, 2)]
        n = [F.col(f"case_{g}") + F.col(f"ctrl_{g}") for g in (0, 1, 2)]
        e = [F.col(f"case_{g}") - n[g] * p[g] for g in (0, 1, 2)]
        w = [n[g] * p[g] * (1 - p[g]) for g in (0, 1, 2)]
        u0, u1 = e[0] + e[1] + e[2], e[1] + 2 * e[2]
        h00, h01, h11 = w[0] + w[1] + w[2], w[1] + 2 * w[2], w[1] + 4 * w[2]
        det = F.greatest(h00 * h11 - h01 * h01, F.lit(1e-300))
        hold = lambda x: F.least(F.greatest(x, F.lit(-2.0)), F.lit(2.0))
        return F.struct((acc["b0"] + hold((h11 * u0 - h01 * u1) / det)).alias("b0"), (acc["b1"] + hold((h00 * u1 - h01 * u0) / det)).alias("b1"))

    return d.select("variant_id", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step)["b1"].alias("beta"))


def dp_chisq(table: DataFrame, eps: float, seed: int) -> DataFrame:
    """variant_id, the chi-square of the noisy 2x2 table of carriers against cases, and its p."""
    two = table.select(
        "variant_id", F.col("ctrl_0").alias("n00"), F.col("case_0").alias("n01"), (F.col("ctrl_1") + F.col("ctrl_2")).alias("n10"), (F.col("case_1") + F.col("case_2")).alias("n11")
    )
    cells = ("n00", "n01", "n10", "n11")
    d = two.withColumns({c: F.greatest(F.lit(0.0), F.col(c) + laplace(uniform(seed, f"chi-{c}", F.col("variant_id")), 1 / eps)) + 1e-6 for c in cells})
    total = sum((F.col(c) for c in cells[1:]), F.col(cells[0]))
    stat = F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            expected = (F.col(f"n{i}0") + F.col(f"n{i}1")) * (F.col(f"n0{j}") + F.col(f"n1{j}")) / total
            stat = stat + (F.col(f"n{i}{j}") - expected) * (F.col(f"n{i}{j}") - expected) / F.greatest(expected, F.lit(1e-12))
    return d.select("variant_id", stat.alias("chi2")).withColumn("p", chi2_p(F.col("chi2"), F.lit(1.0)))


def dp_roc(scores: DataFrame, eps: float, seed: int, points: int = 60, share: float = 0.1) -> DataFrame:
    """bin, fpr and tpr from noisy counts of cases and controls in quantile bins of the score.

    `share` of epsilon pays for the noisy totals. Rates may exceed 1; areas are held afterwards.
    """
    d = with_bins(scores.where("score is not null and y_bin is not null"), "score", points)
    counts = d.groupBy("bin").agg(F.sum("y_bin").alias("pos"), F.sum(1 - F.col("y_bin")).alias("neg"))
    total_eps, bin_eps = max(1e-12, eps * share), max(1e-12, eps - max(1e-12, eps * share))
    every = Window.partitionBy(F.lit(1))
    noisy = lambda c: F.greatest(F.lit(0.0), F.col(c) + laplace(uniform(seed, f"roc-{c}", F.col("bin")), 1 / bin_eps))
    total = lambda c: F.greatest(F.lit(1.0), F.round(F.sum(c).over(every) + laplace(uniform(seed, f"roc-total-{c}", F.lit(0)), 1 / total_eps)))
    b = counts.select("bin", noisy("pos").alias("pos"), noisy("neg").alias("neg"), total("pos").alias("n_pos"), total("neg").alias("n_neg"))
    return roc_from_histogram(b)


def dp_binned_means(binned: DataFrame, eps: float, seed: int, y_clip: float = 50.0, kappa: float = 5.0) -> DataFrame:
    """bin and mean: noisy clipped sums (60 % of epsilon) over noisy counts (40 %) plus `kappa`."""
    n = F.greatest(F.lit(1.0), F.round(F.col("n") + laplace(uniform(seed, "bin-n", F.col("bin")), 1 / (0.4 * eps))))
    s = F.col("sum_y") + laplace(uniform(seed, "bin-sum", F.col("bin")), y_clip / (0.6 * eps))
    return binned.select("bin", n.alias("n"), s.alias("sum_y"), (s / (n + kappa)).alias("mean_y"))
