"""The registered queries of private, federated and comparing operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import columns as K
from helixmill.functions.stored import fresh_path, store
from helixmill.jobs import studies
from helixmill.operators import cells as C
from helixmill.operators import compare, dp, federated, gwas, pgs, roc
from helixmill.queries import (
    CASES,
    DENSE,
    FED_ROC,
    FLIPS,
    META,
    OLS,
    OLS_COLUMNS,
    PGS,
    POOLED,
    QEDGES,
    RUNS,
    SEED,
    STATS,
    WTHR,
    area,
    cells_of,
    inflation_sql,
    linear_sql,
    query,
    r6,
    runs_of,
    scores_of,
    stats_of,
    uniform_sql,
    views,
)
from helixmill.sql_models import chi2_p, integral, least_squares, logistic, normal_p, private_ridge, significant, t_p
from helixmill.views import view

GRID = "grid AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0, 4.0])::DOUBLE AS eps_total, 1e-6::DOUBLE AS delta_total, 40 AS top_k)"
EPS = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
Y_CLIP = 50.0


def grid_of(s: SparkSession, top_k: int = 40) -> DataFrame:
    """A budget for each epsilon of the grid."""
    return s.createDataFrame([(e, 1e-6, top_k) for e in EPS], "eps_total double, delta_total double, top_k int")


#: Budgets of each trait, for as many queries as it has promising variants.
TRAIT_GRID = "tg AS (SELECT trait, k AS top_k, eps_total, delta_total FROM (SELECT trait, greatest(1, count(*) FILTER (WHERE p < 0.5)) AS k FROM results GROUP BY trait) c CROSS JOIN (SELECT eps_total, delta_total FROM grid) g)"


def trait_grid(s: SparkSession, d: str) -> DataFrame:
    k = gwas.hit_counts(view(s, d, "results"), line=0.5).where("trait is not null").select("trait", F.greatest(F.lit(1), "hits").alias("top_k"), F.lit(1e-6).alias("delta_total"))
    return studies.over_grid(k, "eps_total", ",".join(map(str, EPS)))


@query("""SELECT trait, eps_total, round(greatest((sqrt(b*b + 4*top_k*eps_total) - b) / (2*top_k), 1e-6), 6) AS eps_per, round(greatest(delta_total * 0.5 / top_k, 1e-12) * 1e9, 6) AS delta_per_1e9
  FROM (SELECT *, sqrt(2 * top_k * ln(1 / greatest(delta_total * 0.5, 1e-12))) AS b FROM tg) z""", GRID, TRAIT_GRID)
def x01_budget_strong(s: SparkSession, d: str) -> DataFrame:
    e, delta = K.strong_composition(F.col("eps_total"), F.col("delta_total"), F.col("top_k"))
    return trait_grid(s, d).select("trait", "eps_total", e.alias("eps_per"), (delta * 1e9).alias("delta_per_1e9"))


RHO = "greatest((sqrt(ln(1/{d}) + {e}) - sqrt(ln(1/{d}))) * (sqrt(ln(1/{d}) + {e}) - sqrt(ln(1/{d}))), 1e-16)"


@query(f"SELECT trait, eps_total, round({RHO.format(d='delta_total', e='eps_total')}, 6) AS rho_total, round({RHO.format(d='delta_total', e='eps_total')} / top_k, 6) AS rho_per FROM tg", GRID, TRAIT_GRID)
def x02_budget_zcdp(s: SparkSession, d: str) -> DataFrame:
    total, per = K.zcdp(F.col("eps_total"), F.col("delta_total"), F.col("top_k"))
    return trait_grid(s, d).select("trait", "eps_total", total.alias("rho_total"), per.alias("rho_per"))


@query("SELECT trait, eps_total, round(greatest(eps_total * 0.2, 1e-6), 6) AS eps_sel, round(greatest(eps_total - greatest(eps_total * 0.2, 1e-6), 1e-6), 6) AS eps_est FROM tg", GRID, TRAIT_GRID)
def x03_split_budget(s: SparkSession, d: str) -> DataFrame:
    sel, est = K.split_budget(F.col("eps_total"))
    return trait_grid(s, d).select("trait", "eps_total", sel.alias("eps_sel"), est.alias("eps_est"))


UTIL = f"""ut AS (SELECT variant_id, abs(sum((dosage - 1) * greatest(-50.0, least(50.0, y_quant)))) AS utility FROM dense WHERE dosage IS NOT NULL GROUP BY variant_id),
nz AS (SELECT eps_total, variant_id, utility, utility - 50.0 / greatest(1e-8, eps_total * 0.2) * ln(-ln({uniform_sql('gumbel', 'variant_id')})) AS noisy FROM ut CROSS JOIN grid),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eps_total ORDER BY noisy DESC, variant_id) AS rank FROM nz) z WHERE rank <= 40)"""


@query("SELECT eps_total, variant_id, round(utility, 4) AS utility, round(noisy, 4) AS noisy, rank::INT AS rank FROM tk", DENSE, GRID, UTIL)
def x04_dp_topk(s: SparkSession, d: str) -> DataFrame:
    t = dp.dp_topk_sparse(*views(s, d, "genotypes", "people"), dp.budget_table(grid_of(s)), Y_CLIP, SEED)
    return t.select("eps_total", "variant_id", F.round("utility", 4).alias("utility"), F.round("noisy", 4).alias("noisy"), "rank")


@query("SELECT eps_total, variant_id, rank::INT AS rank FROM (SELECT eps_total, variant_id, row_number() OVER (PARTITION BY eps_total ORDER BY noisy DESC, variant_id) AS rank FROM nz) z", DENSE, GRID, UTIL)
def w07_rank_by_noisy_utility(s: SparkSession, d: str) -> DataFrame:
    u = dp.utilities(cells_of(s, d), Y_CLIP)
    return dp.rank_by_noisy_utility(u, dp.budget_table(grid_of(s)), Y_CLIP, SEED).select("eps_total", "variant_id", "rank")


DP_SUMS = """rw AS (SELECT d.variant_id, y_bin AS case_y, greatest(-50.0, least(50.0, y_quant)) AS y, 1.0 AS x0, CASE WHEN t.sd > 0 THEN (dosage - t.mean) / t.sd ELSE 0 END AS x1, (age - m) / sd_a AS x2, sex::DOUBLE AS x3
  FROM dense d JOIN stats t ON d.variant_id = t.variant_id CROSS JOIN (SELECT avg(age) AS m, stddev_samp(age) AS sd_a FROM people) a WHERE dosage IS NOT NULL),
sc AS (SELECT *, least(1.0, 3.0 / (sqrt(x0*x0 + x1*x1 + x2*x2 + x3*x3) + 1e-12)) AS f FROM rw)"""
DP_NAMES = ["yy", *(f"t_{i}" for i in range(4)), *(f"s_{i}{j}" for i in range(4) for j in range(i, 4))]
DP_SELECT = "SELECT variant_id, count(*) AS n, round(sum(y*y), 3) + 0.0 AS yy, " + ", ".join(
    [*(f"round(sum(f*x{i}*y), 3) + 0.0 AS t_{i}" for i in range(4)), *(f"round(sum(f*f*x{i}*x{j}), 3) + 0.0 AS s_{i}{j}" for i in range(4) for j in range(i, 4))]
) + " FROM sc GROUP BY variant_id"


def dp_sums_of(s: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    m, sd = view(s, d, "people").agg(F.avg("age"), F.stddev_samp("age")).first()
    return dp.dp_ols_sums(cells_of(s, d) if cells is None else cells, stats_of(s, d), m, sd)


def both_sums_of(s: SparkSession, d: str, cells: DataFrame) -> dict[str, DataFrame]:
    m, sd = view(s, d, "people").agg(F.avg("age"), F.stddev_samp("age")).first()
    moments = store(stats_of(s, d), "moments")
    return {"BMI": dp.dp_ols_sums(cells, moments, m, sd), "T2D": dp.dp_ols_sums(cells, moments, m, sd, y="cases", yy="cases")}


@query(DP_SELECT, DENSE, STATS, DP_SUMS)
def x05_dp_ols_sums(s: SparkSession, d: str) -> DataFrame:
    return dp_sums_of(s, d).select("variant_id", "n", *(F.round(c, 3).alias(c) for c in DP_NAMES))


def dp_sum_rows(name: str, y: str = "y") -> str:
    """CTE `name` (variant_id, n, yy, t_i, s_ij) of the clipped rows, with `y` as the outcome."""
    rows = "sc" if y == "y" else f"(SELECT sc.* EXCLUDE (y), {y} AS y FROM sc) z"
    return f"{name} AS ({DP_SELECT.replace('round(', '(').replace(', 3) + 0.0', ')').replace('FROM sc', f'FROM {rows}')})"


def noisy_sums(name: str, sums: str, y_clip: float, seed: int | str = SEED, grid: str = "(SELECT eps_total, {rho} / top_k AS rho, top_k FROM (SELECT *, greatest(eps_total - greatest(eps_total * 0.2, 1e-6), 1e-6) AS eps_est, delta_total * 0.5 AS half FROM grid) q)") -> str:
    """CTE `name` (variant_id, eps_total, n and sums with their noise) for each budget by zero-concentrated privacy."""
    rho = RHO.format(d="half", e="eps_est")
    size = {"s": (9.0, 0.2), "t": (3 * y_clip, 0.7), "y": (y_clip**2, 0.1)}
    noise = lambda c: f"{size[c[0]][0]} / sqrt(2 * rho * {size[c[0]][1]}) * sqrt(-2 * ln({uniform_sql(f'ols-{c}-0', 'variant_id', seed=seed)})) * cos(2 * pi() * {uniform_sql(f'ols-{c}-1', 'variant_id', seed=seed)})"
    return f"{name} AS (SELECT variant_id, eps_total, n, {', '.join(f'{c} + {noise(c)} AS {c}' for c in DP_NAMES)} FROM {sums} CROSS JOIN {grid.format(rho=rho)} b)"


def private_p(t: str, df: str = "greatest(1, n - 4)") -> str:
    """As `t_p`, and exact to a share of the value where t is large: there the tail is an integral over 1 / t."""
    front = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    tail = integral(f"CASE WHEN @ > 0 THEN pow(1 + 1 / (({df}) * @ * @), -(({df}) + 1) / 2.0) / (@ * @) ELSE 0 END", f"1 / abs({t})")
    return f"CASE WHEN abs({t}) > 40 THEN 0.0 WHEN abs({t}) > 3 THEN 2 * {front} * {tail} ELSE {t_p(t, df)} END"


def significant_columns(d: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """As `sql_models.significant`."""
    return d.withColumns({c: F.when(F.abs(c) < 100, F.round(c, digits)).otherwise(F.format_string("%.4e", c).try_cast("double")) for c in columns})


PRIVATE_BMI = (dp_sum_rows("ds"), noisy_sums("dn", "ds", Y_CLIP), private_ridge("dr", "dn", ["variant_id", "eps_total"], 10.0))


@query(f"SELECT variant_id, eps_total, n, {significant('beta')} AS beta, {significant('se')} AS se, {significant('beta / se')} AS t, round({private_p('beta / se')}, 6) + 0.0 AS p FROM dr", DENSE, STATS, DP_SUMS, GRID, *PRIVATE_BMI)
def x05_dp_ols(s: SparkSession, d: str) -> DataFrame:
    fits = dp.dp_ols(dp_sums_of(s, d), dp.budget_table(grid_of(s)), SEED, ridge=10.0, y_clip=Y_CLIP)
    return significant_columns(fits, "beta", "se", "t")


def dp_gwas_of(s: SparkSession, d: str) -> DataFrame:
    v = view(s, d, "variants").select("variant_id", "rsid", "chr", "bp")
    cells = store(cells_of(s, d), "cells")
    return studies.private_gwas(v, cells, both_sums_of(s, d, cells), dp.budget_table(grid_of(s)), SEED)


UTIL_T2D = f"""ut2 AS (SELECT variant_id, abs(sum((dosage - 1) * y_bin)) AS utility FROM dense WHERE dosage IS NOT NULL GROUP BY variant_id),
tk2 AS (SELECT * FROM (SELECT eps_total, variant_id, row_number() OVER (PARTITION BY eps_total ORDER BY utility - 1.0 / greatest(1e-8, eps_total * 0.2) * ln(-ln({uniform_sql('gumbel', 'variant_id', seed=f'{SEED}-t2d')})) DESC, variant_id) AS rank FROM ut2 CROSS JOIN grid) z WHERE rank <= 40)"""
PRIVATE_T2D = (dp_sum_rows("ds2", "case_y"), noisy_sums("dn2", "ds2", 1.0, f"{SEED}-t2d"), private_ridge("dr2", "dn2", ["variant_id", "eps_total"], 10.0))
#: pr: trait, eps_total, variant_id, beta, se and p of the selected variants.
PRIVATE = (
    DENSE, STATS, DP_SUMS, GRID, UTIL, UTIL_T2D, *PRIVATE_BMI, *PRIVATE_T2D,
    f"""pr AS (SELECT 'BMI' AS trait, d.*, {private_p('beta / se')} AS p FROM dr d JOIN tk k ON k.variant_id = d.variant_id AND k.eps_total = d.eps_total
  UNION ALL SELECT 'T2D', d.*, {private_p('beta / se')} FROM dr2 d JOIN tk2 k ON k.variant_id = d.variant_id AND k.eps_total = d.eps_total)""",
)


@query(f"""SELECT v.variant_id, v.rsid, v.chr, v.bp, g.eps_total, t.trait, {significant('r.beta')} AS beta, {significant('r.se')} AS se, round(r.p, 6) + 0.0 AS p
  FROM variants v CROSS JOIN grid g CROSS JOIN (SELECT unnest(['BMI', 'T2D']) AS trait) t LEFT JOIN pr r ON r.trait = t.trait AND r.eps_total = g.eps_total AND r.variant_id = v.variant_id""", *PRIVATE)
def x06_dp_gwas(s: SparkSession, d: str) -> DataFrame:
    return significant_columns(dp_gwas_of(s, d), "beta", "se")


@query("""SELECT g.eps_total, (SELECT count(*) FROM variants)::INT AS m, count(*) AS selected, round(any_value(g.eps_total) * 0.2, 6) AS eps_sel, round(any_value(g.eps_total) * 0.8, 6) AS eps_est
  FROM grid g JOIN tk ON tk.eps_total = g.eps_total GROUP BY g.eps_total""", DENSE, GRID, UTIL)
def x07_dp_selection_summary(s: SparkSession, d: str) -> DataFrame:
    b = dp.budget_table(grid_of(s))
    return dp.dp_selection_summary(b, dp.dp_topk(cells_of(s, d), b, Y_CLIP, SEED), view(s, d, "variants").count()).select("eps_total", "m", "selected", "eps_sel", "eps_est")


def each_private(name: str, seed: int, stats: str = "stats", sums: str = "ds") -> tuple[str, ...]:
    """CTEs that end in `name` (variant_id, beta): private effects on y_quant of every variant, each with an equal part of epsilon and delta."""
    scale = f"(SELECT 2.5 AS eps_total, 0.5 / pow(sqrt(2 * ln(1.25 / (1e-6 / m))) / (2.5 / m), 2) AS rho FROM (SELECT count(*) AS m FROM {stats}) q)"
    # deviations are here a share of the noise, not of its square
    noisy = noisy_sums(f"{name}_n", sums, 80.0, seed, scale)
    for share in (0.2, 0.7, 0.1):
        noisy = noisy.replace(f"/ sqrt(2 * rho * {share})", f"/ sqrt(2 * rho) / {share}")
    fit = private_ridge(f"{name}_r", f"{name}_n", ["variant_id"], 1.0)
    return noisy, fit, f"{name} AS (SELECT r.variant_id, r.beta / CASE WHEN t.sd > 0 THEN t.sd ELSE 1 END AS beta FROM {name}_r r JOIN {stats} t ON t.variant_id = r.variant_id)"


EACH_BMI = each_private("qb", SEED)


@query(f"SELECT variant_id, {significant('beta')} AS beta FROM qb", DENSE, STATS, DP_SUMS, dp_sum_rows("ds"), *EACH_BMI)
def x08_dp_quant_betas(s: SparkSession, d: str) -> DataFrame:
    return significant_columns(dp.quant_betas(dp_sums_of(s, d), stats_of(s, d), 2.5, 1e-6, SEED), "beta")


def lap(purpose: str, key: str, scale: str, seed: int = SEED) -> str:
    u = uniform_sql(purpose, key, seed=seed)
    return f"(-({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


NOISY = "nt AS (SELECT variant_id, " + ", ".join(f"greatest(0.0, {c} + {lap(c, 'variant_id', '1 / 1.0')}) + 1e-6 AS {c}" for c in (f"{k}_{g}" for g in (0, 1, 2) for k in ("case", "ctrl"))) + " FROM ct)"
_B = "ln((case_0 + case_1 + case_2) / (ctrl_0 + ctrl_1 + ctrl_2))"
NEWTON = f"""nw AS (SELECT *, 0 AS i, {_B} AS b0, 0.0::DOUBLE AS b1 FROM nt UNION ALL
  SELECT variant_id, case_0, ctrl_0, case_1, ctrl_1, case_2, ctrl_2, i + 1, b0 + greatest(-2.0, least(2.0, (h11*u0 - h01*u1) / greatest(h00*h11 - h01*h01, 1e-300))), b1 + greatest(-2.0, least(2.0, (h00*u1 - h01*u0) / greatest(h00*h11 - h01*h01, 1e-300))) FROM (
    SELECT *, w0 + w1 + w2 AS h00, w1 + 2*w2 AS h01, w1 + 4*w2 AS h11, e0 + e1 + e2 AS u0, e1 + 2*e2 AS u1 FROM (
      SELECT *, (case_0+ctrl_0)*p0*(1-p0) AS w0, (case_1+ctrl_1)*p1*(1-p1) AS w1, (case_2+ctrl_2)*p2*(1-p2) AS w2, case_0 - (case_0+ctrl_0)*p0 AS e0, case_1 - (case_1+ctrl_1)*p1 AS e1, case_2 - (case_2+ctrl_2)*p2 AS e2 FROM (
        SELECT *, 1/(1+exp(-b0)) AS p0, 1/(1+exp(-(b0+b1))) AS p1, 1/(1+exp(-(b0+2*b1))) AS p2 FROM nw WHERE i < 12) a) b) c)"""


@query("SELECT variant_id, round(b1, 5) + 0.0 AS beta FROM nw WHERE i = 12", DENSE, CASES, NOISY, NEWTON)
def x09_dp_case_betas(s: SparkSession, d: str) -> DataFrame:
    return dp.case_betas(dp.noisy_case_table(dp.case_table(cells_of(s, d)), 1.0, SEED)).select("variant_id", F.round("beta", 5).alias("beta"))


CHI = "nc AS (SELECT variant_id, " + ", ".join(
    f"greatest(0.0, {e} + {lap('chi-' + c, 'variant_id', '1 / 1.0')}) + 1e-6 AS {c}" for c, e in (("n00", "ctrl_0"), ("n01", "case_0"), ("n10", "ctrl_1 + ctrl_2"), ("n11", "case_1 + case_2"))
) + " FROM ct), ne AS (SELECT *, n00 + n01 + n10 + n11 AS n FROM nc), nx AS (SELECT variant_id, " + " + ".join(f"(n{i}{j} - (n{i}0+n{i}1)*(n0{j}+n1{j})/n) * (n{i}{j} - (n{i}0+n{i}1)*(n0{j}+n1{j})/n) / greatest((n{i}0+n{i}1)*(n0{j}+n1{j})/n, 1e-12)" for i in (0, 1) for j in (0, 1)) + " AS chi2 FROM ne)"


@query(f"SELECT variant_id, round(chi2, 6) + 0.0 AS chi2, round({normal_p('sqrt(chi2)')}, 6) + 0.0 AS p FROM nx", DENSE, CASES, CHI)
def x10_dp_chisq(s: SparkSession, d: str) -> DataFrame:
    return dp.dp_chisq(dp.case_table(cells_of(s, d)), 1.0, SEED)


EDGES60 = "edges60 AS (SELECT list_sort(list_distinct(quantile_cont(score::DOUBLE, [" + ",".join(str(i / 60) for i in range(61)) + "]))) AS e FROM scores)"
DP_ROC = f"""db AS (SELECT (1 + len(list_filter(e[2:len(e) - 1], lambda x: x < score)))::INT AS bin, y_bin FROM scores CROSS JOIN edges60),
dc AS (SELECT bin, sum(y_bin) AS pos, sum(1 - y_bin) AS neg FROM db GROUP BY bin),
dn AS (SELECT bin, greatest(0.0, pos + {lap('roc-pos', 'bin', '1 / 0.9')}) AS pos, greatest(0.0, neg + {lap('roc-neg', 'bin', '1 / 0.9')}) AS neg, greatest(1.0, round(sum(pos) OVER () + {lap('roc-total-pos', '0', '1 / 0.1')})) AS n_pos, greatest(1.0, round(sum(neg) OVER () + {lap('roc-total-neg', '0', '1 / 0.1')})) AS n_neg FROM dc),
dr AS (SELECT bin, sum(neg) OVER (ORDER BY bin DESC) / n_neg AS fpr, sum(pos) OVER (ORDER BY bin DESC) / n_pos AS tpr FROM dn)"""


@query("SELECT bin, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM dr", EDGES60, DP_ROC)
def x11_dp_roc(s: SparkSession, d: str) -> DataFrame:
    return dp.dp_roc(view(s, d, "scores"), 1.0, SEED)


@query("""SELECT round(greatest(0, least(1, sum(a))), 6) + 0.0 AS auc FROM (SELECT (least(1, fpr) - lag(least(1, fpr)) OVER (ORDER BY least(1, fpr), least(1, tpr))) * (least(1, tpr) + lag(least(1, tpr)) OVER (ORDER BY least(1, fpr), least(1, tpr))) / 2 AS a FROM dr) z""", EDGES60, DP_ROC)
def x11_dp_auc(s: SparkSession, d: str) -> DataFrame:
    return roc.auc_trapezoid(dp.dp_roc(view(s, d, "scores"), 1.0, SEED))


BINNED = """bb AS (SELECT bin, count(*) AS n, sum(greatest(-50.0, least(50.0, y_quant))) AS sum_y FROM (SELECT y_quant, (1 + len(list_filter(e[2:len(e) - 1], lambda x: x < score)))::INT AS bin FROM scores CROSS JOIN edges) z GROUP BY bin)"""


@query(f"""SELECT bin, n, round(sum_y, 4) + 0.0 AS sum_y, round(sum_y / (n + 5), 6) + 0.0 AS mean_y FROM
  (SELECT bin, greatest(1.0, round(n + {lap('bin-n', 'bin', '1 / 0.4')})) AS n, sum_y + {lap('bin-sum', 'bin', '50 / 0.6')} AS sum_y FROM bb) z""", QEDGES, BINNED)
def x12_dp_binned_means(s: SparkSession, d: str) -> DataFrame:
    return dp.dp_binned_means(pgs.binned_means(view(s, d, "scores"), "score", "y_quant"), 1.0, SEED).withColumn("sum_y", F.round("sum_y", 4))


def base_p(s: SparkSession, d: str) -> DataFrame:
    v = view(s, d, "variants").select("variant_id", "rsid")
    return gwas.with_t_p(gwas.gwas_linear_sparse(*views(s, d, "genotypes", "people"))).join(v, "variant_id")


def both_p(s: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    """Baseline results of both traits, stored."""
    return store(studies.long_results(studies.baseline_gwas(cells_of(s, d) if cells is None else cells, view(s, d, "variants"))), "baseline")


# ---------------------------------------------------------------- federated

SITES = DENSE.replace("p.sample_id % 5 + 1 AS site", "p.site").replace("CROSS JOIN people p", "CROSS JOIN sited p")
SITED = "sited AS (SELECT *, ntile(5) OVER (ORDER BY md5('42|site|' || sample_id), sample_id)::INT AS site FROM people)"


def sited_cells(s: SparkSession, d: str) -> DataFrame:
    g, p = views(s, d, "genotypes", "people")
    return C.genotype_cells(g, federated.assign_sites(p, 5, SEED), ["site"])


def meta_sql(name: str, fits: str, *keys: str) -> str:
    """CTE `name` (keys, beta, se, z, p, q, i2, p_het, k): inverse-variance meta-analysis of `fits` (keys, beta, se)."""
    k = ", ".join(keys)
    return f"""{name} AS (SELECT *, beta / se AS z, {normal_p('beta / se')} AS p, CASE WHEN q <= df THEN 0.0 ELSE (q - df) / q END AS i2, {chi2_p('q', 'df')} AS p_het FROM
  (SELECT {k}, sum(w*b)/sum(w) AS beta, sqrt(1/sum(w)) AS se, CASE WHEN count(*) = 1 THEN 0.0 ELSE greatest(0, sum(w*b*b) - sum(w*b)*sum(w*b)/sum(w)) END AS q, count(*) AS k, greatest(1, count(*) - 1) AS df FROM
  (SELECT {k}, beta AS b, 1 / (se * se) AS w FROM {fits} WHERE se > 0 AND isfinite(se) AND isfinite(beta)) y GROUP BY {k}) z)"""


FED_CTES = (SITED, SITES, *linear_sql("variant_id, site")[1:], meta_sql("mt", "fit", "variant_id"))
FED_BINARY = (logistic("lg", ["variant_id", "site"], "dense", firth=True), meta_sql("mb", "lg", "variant_id"))
FED_SELECT = f"SELECT {{key}}, {r6('beta', 'se', 'z', 'p', 'q', 'i2', 'p_het')}, k FROM"


@query(f"{FED_SELECT.format(key='rsid')} (SELECT m.*, v.rsid FROM mt m JOIN variants v ON m.variant_id = v.variant_id) z", *FED_CTES)
def g01_federated_gwas(s: SparkSession, d: str) -> DataFrame:
    g, p = views(s, d, "genotypes", "people")
    f = federated.federated_linear(g, federated.assign_sites(p, 5, SEED))
    return f.join(view(s, d, "variants").select("variant_id", "rsid"), "variant_id").drop("variant_id")


@query(f"{FED_SELECT.format(key='variant_id')} mb", SITED, SITES, *FED_BINARY)
def g01_federated_gwas_binary(s: SparkSession, d: str) -> DataFrame:
    return federated.federated_gwas(sited_cells(s, d), "binary")


def fed_scores_of(s: SparkSession, d: str, trait: str) -> DataFrame:
    g, p = views(s, d, "genotypes", "people")
    dealt = store(federated.assign_sites(p, 5, SEED), "sites")
    fits = federated.federated_linear(g, dealt) if trait == "quant" else federated.federated_gwas(C.genotype_cells(g, dealt, ["site"]), trait)
    return store(federated.federated_scores(fits, g, dealt, line=0.05), "scores")


def scored_sql(name: str, fits: str) -> str:
    """CTE `name`: people with site and the score of the effects of significant variants."""
    return f"""{name} AS (SELECT p.*, coalesce(round(x.score, 6), 0) AS score FROM sited p LEFT JOIN
  (SELECT g.sample_id, sum(g.dosage * m.beta) AS score FROM genotypes g JOIN {fits} m ON m.variant_id = g.variant_id WHERE m.p < 0.05 GROUP BY g.sample_id) x ON x.sample_id = p.sample_id)"""


FED_PGS = (scored_sql("bs", "mb"), WTHR.replace("FROM scores", "FROM bs"), FED_ROC.replace("FROM scores", "FROM bs"), scored_sql("qs", "mt"), OLS.replace("FROM scores", "FROM qs"), POOLED, least_squares("rr", "po"))


@query(f"SELECT a.auc, r.n, {r6('r2', 'r2_adj')} FROM rr r CROSS JOIN ({area('mr')}) a", *FED_CTES, *FED_BINARY, *FED_PGS)
def g02_federated_pgs(s: SparkSession, d: str) -> DataFrame:
    auc, r2 = federated.federated_auc(fed_scores_of(s, d, "binary")).withColumn("_k", F.lit(1)), federated.federated_r2(fed_scores_of(s, d, "quant")).withColumn("_k", F.lit(1))
    return auc.join(r2, "_k").select("auc", "n", "r2", "r2_adj")


KS = (2, 3, 4, 5, 6, 8, 10)
P61 = "[" + ",".join(str(i / 60) for i in range(61)) + "]"
K_SITES = "ks AS (" + " UNION ALL ".join(f"SELECT p.*, {k} AS sites, ntile({k}) OVER (ORDER BY md5('42|site|' || sample_id), sample_id)::INT AS site FROM people p" for k in KS) + ")"
K_DENSE = DENSE.replace("dense AS", "kd AS").replace("p.sample_id % 5 + 1 AS site", "p.sites, p.site").replace("CROSS JOIN people p", "CROSS JOIN ks p")
K_FITS = (*(c.replace("dense", "kd") for c in linear_sql("variant_id, sites, site", tag="k")[1:]), logistic("kl", ["variant_id", "sites", "site"], "kd", firth=True), meta_sql("kq", "fitk", "variant_id", "sites"), meta_sql("kb", "kl", "variant_id", "sites"))
K_BOTH = "kr AS (SELECT variant_id, sites, 'BMI' AS trait, beta, p FROM kq UNION ALL SELECT variant_id, sites, 'T2D', beta, p FROM kb)"


def k_scores(name: str, fits: str) -> str:
    return f"""{name} AS (SELECT p.*, coalesce(round(x.score, 6), 0) AS score FROM ks p LEFT JOIN (SELECT g.sample_id, m.sites, sum(g.dosage * m.beta) AS score FROM genotypes g JOIN {fits} m ON m.variant_id = g.variant_id
  WHERE m.p < 0.05 GROUP BY g.sample_id, m.sites) x ON x.sample_id = p.sample_id AND x.sites = p.sites)"""


K_AUC = (
    k_scores("kbs", "kb"),
    f"kw AS (SELECT sites, site, count(*) AS n, quantile_cont(score::DOUBLE, {P61}) AS q FROM kbs GROUP BY sites, site)",
    "kt AS (SELECT DISTINCT sites, threshold FROM (SELECT sites, pos, round(sum(v * n) / sum(n), 9) AS threshold FROM (SELECT sites, n, unnest(range(0, 61)) AS pos, unnest(q) AS v FROM kw) z GROUP BY sites, pos) y)",
    "kp AS (SELECT s.sites, threshold, count(*) FILTER (WHERE y_bin = 1 AND score >= threshold) / count(*) FILTER (WHERE y_bin = 1)::DOUBLE AS tpr, count(*) FILTER (WHERE y_bin = 0 AND score >= threshold) / count(*) FILTER (WHERE y_bin = 0)::DOUBLE AS fpr FROM kbs s JOIN kt t ON t.sites = s.sites GROUP BY s.sites, threshold)",
    "km AS (SELECT sites, max(fpr) OVER w AS fpr, max(tpr) OVER w AS tpr FROM kp WINDOW w AS (PARTITION BY sites ORDER BY fpr, tpr ROWS UNBOUNDED PRECEDING))",
    "ka AS (SELECT sites, greatest(0, least(1, sum(a))) AS auc FROM (SELECT sites, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM km WINDOW w AS (PARTITION BY sites ORDER BY fpr, tpr)) z GROUP BY sites)",
)
K_R2 = (k_scores("kqs", "kq"), OLS.replace("st AS (SELECT site,", "ko AS (SELECT sites,").replace("FROM scores GROUP BY site)", "FROM kqs GROUP BY sites)"), least_squares("k2", "ko", ["sites"]))
K_RHO = """kx AS (SELECT r.sites, r.trait, rank() OVER (PARTITION BY r.sites, r.trait ORDER BY -r.p) + (count(*) OVER (PARTITION BY r.sites, r.trait, r.p) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY r.sites, r.trait ORDER BY -b.p) + (count(*) OVER (PARTITION BY r.sites, r.trait, b.p) - 1) / 2.0 AS ry FROM kr r JOIN br b ON b.variant_id = r.variant_id AND b.trait = r.trait WHERE r.p IS NOT NULL AND b.p IS NOT NULL),
kc AS (SELECT sites, trait, corr(rx, ry) AS rho FROM kx GROUP BY sites, trait)"""
BOTH_FITS = (*linear_sql("variant_id", tag="0")[1:], logistic("lb", ["variant_id"], "dense"))
BOTH_P = f"""br AS (SELECT variant_id, 'BMI' AS trait, {t_p('beta / se', 'n - 4')} AS p FROM fit0 UNION ALL SELECT variant_id, 'T2D', {normal_p('z')} FROM lb)"""


@query("""SELECT h.sites, h.trait, h.hits, round(l."lambda", 6) + 0.0 AS lambda, CASE WHEN h.trait = 'T2D' THEN round(a.auc, 6) + 0.0 END AS auc, CASE WHEN h.trait = 'BMI' THEN round(r2, 6) + 0.0 END AS r2, round(rho, 6) + 0.0 AS rho
  FROM (SELECT sites, trait, count(*) FILTER (WHERE p < 0.05) AS hits FROM kr GROUP BY sites, trait) h JOIN ml l ON l.sites = h.sites AND l.trait = h.trait JOIN ka a ON a.sites = h.sites JOIN k2 q ON q.sites = h.sites
  JOIN kc c ON c.sites = h.sites AND c.trait = h.trait""", DENSE, *BOTH_FITS, BOTH_P, K_SITES, K_DENSE, *K_FITS, K_BOTH, *inflation_sql("kr", "sites", "trait"), *K_AUC, *K_R2, K_RHO)
def g03_k_sweep(s: SparkSession, d: str) -> DataFrame:
    g, p, v = views(s, d, "genotypes", "people", "variants")
    return studies.k_sweep(g, p, KS, both_p(s, d), v, line=0.05, seed=SEED)


SWEEP = """xa AS (SELECT r.eps_total, r.trait, r.variant_id, greatest(2.220446e-16, least(r.p, 1 - 1e-15)) AS p, greatest(2.220446e-16, least(b.p, 1 - 1e-15)) AS q FROM pr r JOIN br b ON b.variant_id = r.variant_id AND b.trait = r.trait WHERE r.p IS NOT NULL AND b.p IS NOT NULL),
xk AS (SELECT eps_total, trait, rank() OVER (PARTITION BY eps_total, trait ORDER BY -p) + (count(*) OVER (PARTITION BY eps_total, trait, p) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY eps_total, trait ORDER BY -q) + (count(*) OVER (PARTITION BY eps_total, trait, q) - 1) / 2.0 AS ry FROM xa),
xo AS (SELECT eps_total, trait, count(*) AS k, CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM xk GROUP BY eps_total, trait),
xh AS (SELECT g.eps_total, b.trait, count(*) FILTER (WHERE b.p < 0.05) AS true_hits, count(*) FILTER (WHERE b.p < 0.05 AND r.p < 0.05) AS found FROM grid g CROSS JOIN br b LEFT JOIN pr r ON r.eps_total = g.eps_total AND r.trait = b.trait AND r.variant_id = b.variant_id GROUP BY g.eps_total, b.trait)"""


@query("SELECT h.eps_total, h.trait, o.k, h.true_hits, h.found, round(found / nullif(true_hits, 0)::DOUBLE, 6) + 0.0 AS recall, round(o.rho, 6) + 0.0 AS rho FROM xh h JOIN xo o ON o.eps_total = h.eps_total AND o.trait = h.trait", *PRIVATE, *BOTH_FITS, BOTH_P, SWEEP)
def x13_epsilon_sweep(s: SparkSession, d: str) -> DataFrame:
    cells = store(cells_of(s, d), "cells")
    return studies.epsilon_sweep(cells, both_sums_of(s, d, cells), both_p(s, d, cells), view(s, d, "variants"), EPS, 40, SEED, line=0.05)


BASE_FIT = linear_sql("variant_id", tag="0")[1:]


@query(f"""SELECT v.rsid, round(-log10(greatest(2.220446e-16, least(f.p, 1 - 1e-15))), 6) + 0.0 AS logp_fed, round(-log10(greatest(2.220446e-16, least(b.p, 1 - 1e-15))), 6) + 0.0 AS logp_base, round(f.beta, 6) + 0.0 AS beta_fed, round(b.beta, 6) + 0.0 AS beta_base, round(f.i2, 6) + 0.0 AS i2
  FROM mt f JOIN (SELECT variant_id, beta, {t_p('beta / se', 'n - 4')} AS p FROM fit0) b ON b.variant_id = f.variant_id JOIN variants v ON v.variant_id = f.variant_id""", *FED_CTES, *BASE_FIT)
def g04_concordance(s: SparkSession, d: str) -> DataFrame:
    g, p = views(s, d, "genotypes", "people")
    fed = federated.federated_linear(g, federated.assign_sites(p, 5, SEED)).join(view(s, d, "variants").select("variant_id", "rsid"), "variant_id")
    return compare.concordance(fed, base_p(s, d))


# ---------------------------------------------------------------- comparison

AGREE = """ab AS (SELECT a.beta AS x, b.beta AS y FROM results a JOIN results b ON a.rsid = b.rsid WHERE a.trait = 'BMI' AND b.trait = 'T2D'),
sp AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM ab)"""


@query("SELECT least(30, floor((x - lx) * 30 / (hx - lx)) + 1)::INT AS x_bin, least(30, floor((y - ly) * 30 / (hy - ly)) + 1)::INT AS y_bin, count(*) AS n FROM ab CROSS JOIN sp GROUP BY 1, 2", AGREE)
def m01_effect_agreement(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "results")
    return compare.effect_agreement(r.where("trait = 'BMI'"), r.where("trait = 'T2D'"))


METHODS = """mw AS (SELECT CASE WHEN m = 0 THEN 'base' WHEN m = 1 THEN 'dp' ELSE 'fed' END AS method, trait, variant_id, beta * (1 + m * (variant_id % 3) / 10.0) AS weight FROM results CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) g),
ms AS (SELECT p.sample_id, k.method, k.trait, coalesce(x.s, 0) AS score FROM people p CROSS JOIN (SELECT DISTINCT method, trait FROM mw) k LEFT JOIN
  (SELECT g.sample_id, method, trait, sum(g.dosage * weight) AS s FROM genotypes g JOIN mw ON g.variant_id = mw.variant_id GROUP BY g.sample_id, method, trait) x ON x.sample_id = p.sample_id AND x.method = k.method AND x.trait = k.trait)"""


def method_scores_of(s: SparkSession, d: str) -> DataFrame:
    g, p, r = views(s, d, "genotypes", "people", "results")
    m = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("method")) for i, k in enumerate(("base", "dp", "fed")))))
    w = r.select("trait", "variant_id", "beta", m.alias("m"))
    w = w.select("trait", "variant_id", "m.method", (F.col("beta") * (1 + F.col("m.i") * (F.col("variant_id") % 3) / 10)).alias("weight"))
    return pgs.pgs_score(g, w, p, ["trait", "method"])


@query("SELECT sample_id, method, trait, round(score, 6) + 0.0 AS score FROM ms", METHODS)
def m02_method_scores(s: SparkSession, d: str) -> DataFrame:
    return method_scores_of(s, d)


@query(f"""SELECT sample_id, trait, round(score_base, 6) + 0.0 AS score_base, round(score_dp, 6) + 0.0 AS score_dp FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY {uniform_sql('sample', 'sample_id', seed=1)}, sample_id) AS r FROM
  (SELECT sample_id, trait, max(score) FILTER (WHERE method = 'base') AS score_base, max(score) FILTER (WHERE method = 'dp') AS score_dp FROM ms GROUP BY sample_id, trait) z) y WHERE r <= 6000""", METHODS)
def m03_per_person_pairs(s: SparkSession, d: str) -> DataFrame:
    return compare.per_person_pairs(method_scores_of(s, d))


FITTED = f"""fe AS (SELECT 'base' AS method, 'BMI' AS trait, variant_id, beta FROM fit0 UNION ALL SELECT 'base', 'T2D', variant_id, beta FROM lb
  UNION ALL SELECT 'fed', 'BMI', variant_id, beta FROM mt UNION ALL SELECT 'fed', 'T2D', variant_id, beta FROM mb UNION ALL SELECT 'dp', 'T2D', variant_id, b1 FROM nw WHERE i = 12)"""
ALL_DENSE = DENSE.replace("dense AS", "everybody AS")
FITTED_CTES = (
    SITED, SITES, *linear_sql("variant_id, site")[1:], meta_sql("mt", "fit", "variant_id"), *FED_BINARY, ALL_DENSE, *(c.replace("dense", "everybody") for c in linear_sql("variant_id", tag="0")[1:]),
    logistic("lb", ["variant_id"], "everybody"), CASES, NOISY.replace("1 / 1.0", "(SELECT count(DISTINCT variant_id) FROM genotypes) / 2.5"), NEWTON, FITTED,
)


def effects_of(s: SparkSession, d: str) -> DataFrame:
    """The effects of all methods."""
    return store(studies.method_effects(*views(s, d, "genotypes", "people"), stats_of(s, d), seed=SEED), "effects")


@query("SELECT method, trait, variant_id, round(beta, 5) + 0.0 AS beta FROM fe", *FITTED_CTES)
def m02_fitted_effects(s: SparkSession, d: str) -> DataFrame:
    e = effects_of(s, d).where("not (method = 'dp' and trait = 'BMI')")
    return e.withColumn("beta", F.round("beta", 5))


@query("""SELECT k.method, k.trait, p.sample_id, round(coalesce(x.s, 0), 4) + 0.0 AS score FROM people p CROSS JOIN (SELECT DISTINCT method, trait FROM fe) k LEFT JOIN
  (SELECT g.sample_id, method, trait, sum(g.dosage * coalesce(fe.beta, 0)) AS s FROM genotypes g JOIN fe ON fe.variant_id = g.variant_id GROUP BY g.sample_id, method, trait) x
  ON x.sample_id = p.sample_id AND x.method = k.method AND x.trait = k.trait""", *FITTED_CTES)
def m02_fitted_scores(s: SparkSession, d: str) -> DataFrame:
    g, p = views(s, d, "genotypes", "people")
    w = effects_of(s, d).where("not (method = 'dp' and trait = 'BMI')").withColumnRenamed("beta", "weight")
    return pgs.pgs_score(g, w, p, ["method", "trait"]).withColumn("score", F.round("score", 4))


ALL_FITTED = ("fa AS (SELECT * FROM fe UNION ALL SELECT 'dp', 'BMI', variant_id, beta FROM qb)",)
#: All rows of everybody, as private sums take them, beside those dealt to sites.
ALL_PRIVATE = (STATS.replace("FROM dense", "FROM everybody"), DP_SUMS.replace("FROM dense", "FROM everybody"), dp_sum_rows("ds"), *EACH_BMI)


@query(f"""SELECT k.method, k.trait, p.sample_id, {significant('coalesce(x.s, 0)', 4)} AS score FROM people p CROSS JOIN (SELECT DISTINCT method, trait FROM fa) k LEFT JOIN
  (SELECT g.sample_id, method, trait, sum(g.dosage * coalesce(fa.beta, 0)) AS s FROM genotypes g JOIN fa ON fa.variant_id = g.variant_id GROUP BY g.sample_id, method, trait) x
  ON x.sample_id = p.sample_id AND x.method = k.method AND x.trait = k.trait""", *FITTED_CTES, *ALL_PRIVATE, *ALL_FITTED)
def m02_all_scores(s: SparkSession, d: str) -> DataFrame:
    """All six score vectors: three methods, two traits."""
    g, p = views(s, d, "genotypes", "people")
    all_of = pgs.pgs_score(g, effects_of(s, d).withColumnRenamed("beta", "weight"), p, ["method", "trait"])
    return significant_columns(all_of, "score", digits=4)


@query(f"""SELECT sample_id, trait, {significant('score_base', 4)} AS score_base, {significant('score_dp', 4)} AS score_dp FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY {uniform_sql('sample', 'sample_id', seed=1)}, sample_id) AS r FROM
  (SELECT p.sample_id, k.trait, coalesce(x.base, 0) AS score_base, coalesce(x.dp, 0) AS score_dp FROM people p CROSS JOIN (SELECT DISTINCT trait FROM fa) k LEFT JOIN
    (SELECT g.sample_id, trait, sum(g.dosage * coalesce(fa.beta, 0)) FILTER (WHERE method = 'base') AS base, sum(g.dosage * coalesce(fa.beta, 0)) FILTER (WHERE method = 'dp') AS dp FROM genotypes g JOIN fa ON fa.variant_id = g.variant_id GROUP BY g.sample_id, trait) x
    ON x.sample_id = p.sample_id AND x.trait = k.trait) z) y WHERE r <= 6000""", *FITTED_CTES, *ALL_PRIVATE, *ALL_FITTED)
def m03_fitted_pairs(s: SparkSession, d: str) -> DataFrame:
    """Each person's scores by the baseline's effects and by private ones, all fitted."""
    g, p = views(s, d, "genotypes", "people")
    w = effects_of(s, d).where("method <> 'fed'").withColumnRenamed("beta", "weight")
    pairs = compare.per_person_pairs(pgs.pgs_score(g, w, p, ["method", "trait"]))
    return significant_columns(pairs.select("sample_id", "trait", "score_base", "score_dp"), "score_base", "score_dp", digits=4)


@query("""SELECT least(30, floor((x - lx) * 30 / (hx - lx)) + 1)::INT AS x_bin, least(30, floor((y - ly) * 30 / (hy - ly)) + 1)::INT AS y_bin, count(*) AS n
  FROM fa CROSS JOIN (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM fa) z GROUP BY 1, 2""",
       *FITTED_CTES, "fa AS (SELECT b.beta AS x, f.beta AS y FROM fe b JOIN fe f ON f.variant_id = b.variant_id WHERE b.method = 'base' AND f.method = 'fed' AND b.trait = 'T2D' AND f.trait = 'T2D' AND b.beta IS NOT NULL AND f.beta IS NOT NULL)")
def m01_federated_agreement(s: SparkSession, d: str) -> DataFrame:
    """Baseline and federated effects of T2D."""
    e = effects_of(s, d).join(view(s, d, "variants").select("variant_id", "rsid"), "variant_id").where("trait = 'T2D'")
    return compare.effect_agreement(e.where("method = 'base'"), e.where("method = 'fed'"))


@query("""SELECT least(30, floor((x - lx) * 30 / (hx - lx)) + 1)::INT AS x_bin, least(30, floor((y - ly) * 30 / (hy - ly)) + 1)::INT AS y_bin, count(*) AS n
  FROM ap CROSS JOIN (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM ap) z GROUP BY 1, 2""",
       DENSE, STATS, DP_SUMS, dp_sum_rows("ds"), *EACH_BMI, *BASE_FIT, "ap AS (SELECT b.beta AS x, q.beta AS y FROM fit0 b JOIN qb q ON q.variant_id = b.variant_id WHERE b.beta IS NOT NULL)")
def m01_private_agreement(s: SparkSession, d: str) -> DataFrame:
    """Baseline and private effects of BMI."""
    e = effects_of(s, d).join(view(s, d, "variants").select("variant_id", "rsid"), "variant_id").where("trait = 'BMI'")
    return compare.effect_agreement(e.where("method = 'base'"), e.where("method = 'dp'"))


RUN_SEED = 1000
RUN_NOS = (1, 2, 3)
#: The names of the counts of a case table, and the scale of the noise on them.
COUNTS = [f"{k}_{g}" for g in (0, 1, 2) for k in ("case", "ctrl")]
RUN_SCALE = "(SELECT count(*) FROM sub WHERE trait = 'T2D') / 2.5"
RUN_SITES = "rs AS (" + " UNION ALL ".join(f"SELECT p.*, {r} AS run, ntile(5) OVER (ORDER BY md5('{RUN_SEED + r}|site|' || sample_id), sample_id)::INT AS site FROM people p" for r in RUN_NOS) + ")"
RUN_DENSE = DENSE.replace("dense AS", "rd AS").replace("p.sample_id % 5 + 1 AS site", "p.run, p.site").replace("CROSS JOIN people p", "CROSS JOIN rs p")
RUN_TABLES = " UNION ALL ".join(f"SELECT variant_id, {r} AS run, " + ", ".join(f"greatest(0.0, {c} + {lap(c, 'variant_id', RUN_SCALE, RUN_SEED + r)}) + 1e-6 AS {c}" for c in COUNTS) + " FROM ct" for r in RUN_NOS)
RUN_FITS = (
    f"sub AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY {uniform_sql('sample', 'variant_id', seed=RUN_SEED)}, variant_id) AS r FROM (SELECT DISTINCT w.trait, v.variant_id, v.rsid FROM variants v JOIN weights w ON w.rsid = v.rsid) z) y WHERE r <= 200)",
    DENSE, STATS, DP_SUMS, dp_sum_rows("ds"), "mo AS (SELECT t.* FROM stats t JOIN sub b ON b.variant_id = t.variant_id AND b.trait = 'BMI')",
    *(c for r in RUN_NOS for c in each_private(f"q{r}", RUN_SEED + r, "mo")), CASES, f"ntr AS ({RUN_TABLES})",
    NEWTON.replace("nw AS", "nwr AS").replace("FROM nw", "FROM nwr").replace("FROM nt ", "FROM ntr ").replace("SELECT variant_id, case_0", "SELECT variant_id, run, case_0"),
    RUN_SITES, RUN_DENSE, *(c.replace("dense", "rd") for c in linear_sql("variant_id, run, site", tag="r")[1:]), logistic("rl", ["variant_id", "run", "site"], "rd", firth=True),
    meta_sql("rq", "fitr", "variant_id", "run"), meta_sql("rb", "rl", "variant_id", "run"), *BOTH_FITS,
    "ra AS (SELECT 'BASE' AS method, 0 AS run, 'BMI' AS trait, variant_id, beta FROM fit0 UNION ALL SELECT 'BASE', 0, 'T2D', variant_id, beta FROM lb"
    + "".join(f" UNION ALL SELECT 'DP', {r}, 'BMI', variant_id, beta FROM q{r}" for r in RUN_NOS)
    + " UNION ALL SELECT 'DP', run, 'T2D', variant_id, b1 FROM nwr WHERE i = 12 UNION ALL SELECT 'FED', run, 'BMI', variant_id, beta FROM rq UNION ALL SELECT 'FED', run, 'T2D', variant_id, beta FROM rb)",
)


@query(f"SELECT method, run::INT AS run, a.trait, b.rsid, {significant('beta', 5)} AS beta FROM ra a JOIN sub b ON b.variant_id = a.variant_id AND b.trait = a.trait", *RUN_FITS)
def m04_run_to_run(s: SparkSession, d: str) -> DataFrame:
    g, p, v, w = views(s, d, "genotypes", "people", "variants", "weights")
    return significant_columns(studies.run_to_run(g, p, v, w, RUN_NOS, stats_of(s, d), fresh_path(s, "runs"), seed=RUN_SEED), "beta", digits=5)


@query("SELECT method, trait, rsid, round(u.beta - r.beta, 6) + 0.0 AS delta FROM runs u JOIN results r USING (rsid, trait)", RUNS)
def m04_delta_betas(s: SparkSession, d: str) -> DataFrame:
    return compare.delta_betas(runs_of(s, d), view(s, d, "results")).select("method", "trait", "rsid", "delta")


@query("SELECT CASE WHEN beta IS NULL OR se IS NULL THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN beta IS NOT NULL AND se IS NOT NULL THEN NULL WHEN NOT polymorphic THEN 'constant' ELSE 'model_error' END AS reason, count(*) AS n FROM fit GROUP BY 1, 2", *linear_sql("variant_id"))
def f09_fit_counts(s: SparkSession, d: str) -> DataFrame:
    from helixmill.operators import qc

    return qc.fit_counts(gwas.gwas_linear(cells_of(s, d)))


LINE = 0.05
ROC_POINTS = "rp AS (SELECT g.sample_id, round(g.score, 9) AS score, p.y_bin FROM pg g JOIN people p ON p.sample_id = g.sample_id WHERE g.trait = 'T2D')"
RUN_EDGES = EDGES60.replace("edges60", "run_edges").replace("FROM scores", "FROM rp")
RUN_DP = DP_ROC.replace("FROM scores CROSS JOIN edges60", "FROM rp CROSS JOIN run_edges")
RUN_OLS = (OLS.replace("FROM scores", "FROM (SELECT p.*, g.score, 1 AS site FROM pg g JOIN people p ON p.sample_id = g.sample_id WHERE g.trait = 'BMI')"), POOLED, least_squares("rr", "po"))
EXACT_AUC = "(sum(r) FILTER (WHERE y_bin = 1) - sum(y_bin) * (sum(y_bin) + 1) / 2.0) / (sum(y_bin) * sum(1 - y_bin))"


@query(f"""SELECT (SELECT count(*) FROM people) AS n_people, 5 AS n_sites, {LINE}::DOUBLE AS line, round(-log10({LINE}), 6) AS logp_line, (SELECT count(DISTINCT variant_id) FROM br) AS n_variants,
  {', '.join(f"(SELECT {e} FROM {t} WHERE trait = '{k}') AS \"{k}_{c}\"" for k in ('BMI', 'T2D') for c, e, t in (('lambda', 'round("lambda", 6) + 0.0', 'ml'), ('hits', f'count(*) FILTER (WHERE p < {LINE})', 'br'), ('tested', 'count(*)', 'br')))},
  40::BIGINT AS "BMI_selected", 40::BIGINT AS "T2D_selected",
  (SELECT round({EXACT_AUC}, 6) + 0.0 FROM (SELECT y_bin, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM rp) z) AS auc,
  (SELECT round(greatest(0, least(1, sum(a))), 6) + 0.0 FROM (SELECT (least(1, fpr) - lag(least(1, fpr)) OVER (ORDER BY least(1, fpr), least(1, tpr))) * (least(1, tpr) + lag(least(1, tpr)) OVER (ORDER BY least(1, fpr), least(1, tpr))) / 2 AS a FROM dr) z) AS private_auc,
  (SELECT round(r2_adj, 6) + 0.0 FROM rr) AS r2_adj""", DENSE, *BOTH_FITS, BOTH_P, *inflation_sql("br", "trait"), PGS, ROC_POINTS, RUN_EDGES, RUN_DP, *RUN_OLS)
def a31_run_metrics(s: SparkSession, d: str) -> DataFrame:
    v, p = views(s, d, "variants", "people")
    cells = store(cells_of(s, d), "cells")
    private = studies.private_gwas(v.select("variant_id", "rsid", "chr", "bp"), cells, both_sums_of(s, d, cells), dp.budget_table(grid_of(s)).where("eps_total = 1"), SEED)
    scores = store(scores_of(s, d).withColumn("score", F.round("score", 9)).join(p, "sample_id"), "scores")
    return studies.run_metrics(both_p(s, d, cells), scores, private, sites=5, line=LINE, eps=1.0, seed=SEED)


FLIPPED = DENSE.replace("CASE WHEN g.sample_id IS NULL THEN 0 ELSE g.dosage END AS dosage", "CASE WHEN f.effect_allele <> f.alt THEN 2 - CASE WHEN g.sample_id IS NULL THEN 0 ELSE g.dosage END WHEN g.sample_id IS NULL THEN 0 ELSE g.dosage END AS dosage").replace(
    "LEFT JOIN genotypes g", "JOIN flips f ON f.variant_id = v.variant_id LEFT JOIN genotypes g"
)


@query(f"SELECT variant_id, n, {r6('beta', 'se')}, round(beta / se, 6) + 0.0 AS t FROM fit WHERE variant_id IN (SELECT variant_id FROM stats WHERE maf >= 0.01 AND missing_rate <= 0.05 AND polymorphic)",
       FLIPS, FLIPPED, STATS, *linear_sql("variant_id")[1:])
def flagship_linear_scan(s: SparkSession, d: str) -> DataFrame:
    """Per-variant linear association after quality control and allele harmonisation."""
    g, v, w, p = views(s, d, "genotypes", "variants", "weights", "people")
    return studies.linear_study(g, p, v, w).select("variant_id", "n", "beta", "se", "t")


@query(f"""SELECT f.variant_id, v.rsid, v.chr, v.bp, round(f.beta, 6) + 0.0 AS beta_bmi, round({t_p('f.beta / f.se', 'f.n - 4')}, 6) + 0.0 AS p_bmi, round(l.beta, 6) + 0.0 AS beta_t2d, round({normal_p('l.z')}, 6) + 0.0 AS p_t2d
  FROM fit0 f JOIN lb l ON l.variant_id = f.variant_id JOIN variants v ON v.variant_id = f.variant_id WHERE f.variant_id IN (SELECT variant_id FROM stats WHERE maf >= 0.01 AND missing_rate <= 0.05 AND polymorphic)""", FLIPS, FLIPPED, STATS, *BOTH_FITS)
def baseline_study(s: SparkSession, d: str) -> DataFrame:
    """Quality control, harmonised alleles, cells, and both scans with p-values."""
    g, v, w, p = views(s, d, "genotypes", "variants", "weights", "people")
    kept, _ = studies.qc_genotypes(g, p)
    return studies.baseline_gwas(store(studies.baseline_cells(kept, v, w, p), "cells"), v)
