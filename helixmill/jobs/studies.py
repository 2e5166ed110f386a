"""Whole studies: baseline scan, federated scan, sweeps over sites and budgets, and run-to-run variability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.columns import BIOBANK_LINE, broadcast_if_small, neg_log10_p
from helixmill.functions.ordering import beside
from helixmill.functions.stored import store
from helixmill.operators import cells as C
from helixmill.operators import compare, dp, federated, gwas, harmonize, pgs, qc, roc
from helixmill.sources.writers import write_or_reuse


def qc_genotypes(genotypes: DataFrame, people: DataFrame, maf: float = 0.01, missing: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Genotypes that pass quality control, and the statistics of all variants."""
    stats = qc.variant_stats(genotypes, people.count())
    return qc.filter_maf_missing(genotypes, stats, maf, missing), stats


def over_grid(df: DataFrame, column: str, values: str, kind: str = "double") -> DataFrame:
    """`df` once for each of the comma-separated `values`, in `column`; repeated values count once, and there must be one."""
    cells = [v.strip() for v in values.split(",") if v.strip()]
    if not cells:
        raise ValueError("empty grid")
    return df.withColumn(column, F.explode(F.array_distinct(F.array(*(F.lit(v).cast(kind) for v in cells)))))


def harmonized(genotypes: DataFrame, variants: DataFrame, weights: DataFrame) -> DataFrame:
    """Genotypes that count the effect alleles of the scores."""
    return harmonize.harmonize_alleles(genotypes, harmonize.allele_flips(variants, weights, ["trait", "line"]))


def linear_study(genotypes: DataFrame, people: DataFrame, variants: DataFrame, weights: DataFrame, maf: float = 0.01, missing: float = 0.05) -> DataFrame:
    """variant_id, n, beta, se, t and polymorphic of the variants that pass quality control, for the scores' effect alleles.

    Genotypes are read once: both the control and the fit follow from one reduction, and flips turn sums of variants.
    """
    sums = gwas.passing_sums(gwas.sparse_linear_sums(genotypes, people), maf, missing)
    flips = harmonize.allele_flips(variants, weights, ["trait", "line"]).select("variant_id", "flipped")
    return gwas.linear_fit(gwas.turned(sums.join(broadcast_if_small(flips), "variant_id")))


def baseline_cells(genotypes: DataFrame, variants: DataFrame, weights: DataFrame, people: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells of harmonised genotypes."""
    return C.genotype_cells(harmonized(genotypes, variants, weights), people, by)


def baseline_gwas(cells: DataFrame, variants: DataFrame) -> DataFrame:
    """rsid, chr, bp and effects and p-values of both traits; constant variants have none."""
    lin = gwas.with_t_p(gwas.gwas_linear(cells)).select("variant_id", F.col("beta").alias("beta_bmi"), F.col("p").alias("p_bmi"))
    log = gwas.gwas_logistic(cells).select("variant_id", F.col("beta").alias("beta_t2d"), F.col("p").alias("p_t2d"))
    return variants.select("variant_id", "rsid", "chr", "bp").join(lin, "variant_id").join(log, "variant_id")


def long_results(results: DataFrame) -> DataFrame:
    """One row a trait: rsid, chr, bp, trait, beta and p."""
    parts = [results.select("variant_id", "rsid", "chr", "bp", F.lit(t.upper()).alias("trait"), F.col(f"beta_{t}").alias("beta"), F.col(f"p_{t}").alias("p")) for t in ("bmi", "t2d")]
    return parts[0].unionByName(parts[1])


def trait_columns(d: DataFrame, *columns: str) -> DataFrame:
    """One row of the columns of both traits (of each row's trait), as BMI_column and T2D_column."""
    return d.agg(*(F.max(F.when(F.col("trait") == t, F.col(c))).alias(f"{t}_{c}") for t in ("BMI", "T2D") for c in columns))


def run_metrics(results: DataFrame, scores: DataFrame, private: DataFrame | None = None, sites: int = 1, line: float = BIOBANK_LINE, eps: float = 1.0, seed: int = 1) -> DataFrame:
    """One row: people, variants, sites, the line, lambda, hits and (if there are `private` results) selected variants of each trait, AUC, private AUC and adjusted R2 of the scores.

    results and private have trait and p; scores has trait, sample_id, score, age, sex, y_bin and y_quant.
    """
    of = lambda t: scores.where(F.col("trait") == t)
    fixed = scores.agg(F.countDistinct("sample_id").alias("n_people")).withColumns({"n_sites": F.lit(sites), "line": F.lit(line), "logp_line": F.lit(-1.0) * F.log10(F.lit(line))})
    variants = results.agg(F.countDistinct("variant_id").alias("n_variants"))
    parts = [variants, trait_columns(gwas.genomic_inflation(results, ["trait"]).join(gwas.hit_counts(results, line=line).where("trait is not null"), "trait"), "lambda", "hits", "tested")]
    if private is not None:
        parts.append(trait_columns(private.groupBy("trait").agg(F.count("p").alias("selected")), "selected"))
    parts.append(roc.auc_rank(of("T2D").select("score", "y_bin")))
    parts.append(roc.auc_trapezoid(dp.dp_roc(of("T2D").select("score", "y_bin"), eps, seed)).withColumnRenamed("auc", "private_auc"))
    parts.append(pgs.r2_from_stats(pgs.ols_sufficient_stats(of("BMI"), ["score", "age", "sex"], "y_quant")).select("r2_adj"))
    return reduce(beside, parts, fixed)


def private_gwas(variants: DataFrame, cells: DataFrame, sums: dict[str, DataFrame], budgets: DataFrame, seed: int, y_clip: float = 50.0) -> DataFrame:
    """`dp.dp_gwas` of both traits, with trait; T2D is a linear model of 0/1 clipped at 1, and draws noise of its own.

    sums has `dp.dp_ols_sums` of y_quant as BMI and of cases as T2D.
    """
    bmi = dp.dp_gwas(variants, cells, sums["BMI"], budgets, seed, y_clip=y_clip)
    t2d = dp.dp_gwas(variants, cells, sums["T2D"], budgets, f"{seed}-t2d", y_clip=1.0, binary=True)
    return bmi.withColumn("trait", F.lit("BMI")).unionByName(t2d.withColumn("trait", F.lit("T2D")))


def rank_agreement(results: DataFrame, base: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, trait and rho, the rank correlation of -log10 p with the baseline's."""
    both = results.select(*by, "trait", "rsid", "p").join(base.select("trait", "rsid", F.col("p").alias("p_base")), ["trait", "rsid"])
    return compare.spearman(both.withColumns({"x": neg_log10_p(F.col("p")), "y": neg_log10_p(F.col("p_base"))}), "x", "y", [*by, "trait"]).select(*by, "trait", "rho")


def epsilon_sweep(cells: DataFrame, sums: dict[str, DataFrame], base: DataFrame, variants: DataFrame, grid: Sequence[float], top_k: int, seed: int, line: float, y_clip: float = 50.0) -> DataFrame:
    """eps_total, trait, k, recall of baseline hits and rank correlation of -log10 p, from one reduction for all budgets.

    base has trait, rsid and p.
    """
    spark = cells.sparkSession
    budgets = dp.budget_table(spark.createDataFrame([(float(e), 1e-6, top_k) for e in grid], "eps_total double, delta_total double, top_k int"))
    res = store(private_gwas(variants.select("variant_id", "rsid"), cells, sums, budgets, seed, y_clip), "epsilon-sweep")
    keys = ["eps_total", "trait"]
    of = lambda d, t: d.where(F.col("trait") == t)
    recall = reduce(DataFrame.unionByName, [compare.hit_recall(of(res, t), of(base, t), keys, line) for t in ("BMI", "T2D")])
    k = res.groupBy(*keys).agg(F.count("p").alias("k"))
    return k.join(recall, keys).join(rank_agreement(res, base, ["eps_total"]), keys, "left").orderBy(*keys)


def k_sweep(genotypes: DataFrame, people: DataFrame, ks: Sequence[int], base: DataFrame, variants: DataFrame, line: float, seed: int = 1) -> DataFrame:
    """sites, trait, hits and lambda of the federated scans, AUC of the T2D scores, R2 of the BMI scores, rank correlation with the baseline.

    base has trait, rsid and p. The number of sites is one more key: every person occurs once for each, and one pass serves all.
    """
    genotypes, dealt = store(genotypes, "genotypes"), store(federated.sites_for_grid(people, ks, seed).withColumnRenamed("k", "sites"), "sites")
    fits = {"BMI": federated.federated_linear(genotypes, dealt, ["sites"]), "T2D": federated.federated_gwas(C.genotype_cells(genotypes, dealt, ["sites", "site"]), "binary", ["sites"])}
    both = reduce(DataFrame.unionByName, [f.withColumn("trait", F.lit(t)) for t, f in fits.items()])
    both = store(both.join(variants.select("variant_id", "rsid"), "variant_id"), "k-sweep")
    scores = {t: federated.federated_scores(both.where(F.col("trait") == t).drop("trait"), genotypes, dealt, ["sites"], line) for t in fits}
    keys = ["sites", "trait"]
    d = gwas.hit_counts(both, keys, line=line).where("trait is not null").select(*keys, "hits")
    d = d.join(gwas.genomic_inflation(both, keys).select(*keys, "lambda"), keys)
    d = d.join(federated.federated_auc(scores["T2D"], ["sites"]).withColumn("trait", F.lit("T2D")), keys, "left")
    d = d.join(federated.federated_r2(scores["BMI"], ["sites"]).select("sites", F.lit("BMI").alias("trait"), "r2"), keys, "left")
    return d.join(rank_agreement(both, base, ["sites"]), keys, "left").orderBy(*keys)


def run_to_run(genotypes: DataFrame, people: DataFrame, variants: DataFrame, causal: DataFrame, runs: Sequence[int], stats: DataFrame, path: str, most: int = 200, seed: int = 1000) -> DataFrame:
    """method, run, trait, rsid and beta for repeated runs over a subset of causal variants.

    Each (method, run) is stored below `path` when it is done, and a rerun makes only what is
    missing there. Private runs differ by noise alone, so their sums are shared; federated
    runs by the split into sites, which is one more key. causal has trait and rsid: each trait has a subset
    of its own; without trait, the same variants serve both.
    """
    if "trait" not in causal.columns:
        causal = over_grid(causal, "trait", "BMI,T2D", "string")
    subset = pgs.seeded_sample(variants.join(causal.select("trait", "rsid").distinct(), "rsid"), most, seed, "variant_id", ["trait"])
    small = broadcast_if_small(store(subset.select("trait", "variant_id", "rsid"), "subset"))
    of = {t: small.where(F.col("trait") == t).select("variant_id") for t in ("BMI", "T2D")}
    g = store(genotypes.join(small.select("variant_id"), "variant_id", "left_semi"), "subset-genotypes")
    row = lambda d, method, trait, run: d.select(F.lit(method).alias("method"), run.cast("int").alias("run"), F.lit(trait).alias("trait"), "variant_id", "beta")

    def build(missing: DataFrame) -> DataFrame:
        todo: dict[str, list[int]] = {}
        for r in missing.orderBy("method", "run").collect():  # the grid of runs
            todo.setdefault(r["method"], []).append(r["run"])
        out = []
        if "BASE" in todo or "DP" in todo:
            cells = store(C.genotype_cells(g, people), "run-cells")
        if "BASE" in todo:
            out += [row(f(cells), "BASE", t, F.lit(0)) for t, f in (("BMI", gwas.gwas_linear), ("T2D", gwas.gwas_logistic))]
        if "DP" in todo:
            moments = store(stats.join(of["BMI"], "variant_id", "left_semi"), "run-moments")
            age = people.agg(F.avg("age"), F.stddev_samp("age")).first()
            sums, table = store(dp.dp_ols_sums(cells, moments, age[0] or 0.0, age[1] or 0.0), "run-sums"), store(dp.case_table(cells.join(of["T2D"], "variant_id", "left_semi")), "run-tables")
            each = 2.5 / max(1, table.count())
            for r in todo["DP"]:
                out.append(row(dp.quant_betas(sums, moments, 2.5, 1e-6, seed + r), "DP", "BMI", F.lit(r)))
                out.append(row(dp.case_betas(dp.noisy_case_table(table, each, seed + r)), "DP", "T2D", F.lit(r)))
        if "FED" in todo:
            dealt = store(reduce(DataFrame.unionByName, [federated.assign_sites(people, 5, seed + r).withColumn("run", F.lit(r)) for r in todo["FED"]]), "run-sites")
            out.append(row(federated.federated_linear(g, dealt, ["run"], p_values=False), "FED", "BMI", F.col("run")))
            out.append(row(federated.federated_gwas(C.genotype_cells(g, dealt, ["run", "site"]), "binary", ["run"], p_values=False), "FED", "T2D", F.col("run")))
        return reduce(DataFrame.unionByName, out)

    grid = people.sparkSession.createDataFrame([("BASE", 0), *((m, int(r)) for r in runs for m in ("DP", "FED"))], "method string, run int")
    rows = write_or_reuse(people.sparkSession, path, grid, ["method", "run"], build)
    return rows.join(small, ["trait", "variant_id"]).select("method", "run", "trait", "rsid", "beta")


def method_effects(genotypes: DataFrame, people: DataFrame, stats: DataFrame, eps_total: float = 2.5, delta_total: float = 1e-6, sites: int = 5, seed: int = 1) -> DataFrame:
    """method (base, dp, fed), trait, variant_id and beta of every variant: the baseline's fits, private ones and federated ones."""
    genotypes, people = store(genotypes, "genotypes"), store(people, "people")
    cells = store(C.genotype_cells(genotypes, people), "cells")
    dealt = store(federated.assign_sites(people, sites, seed), "sites")
    age = people.agg(F.avg("age"), F.stddev_samp("age")).first()
    sums = dp.dp_ols_sums(cells, stats, age[0] or 0.0, age[1] or 0.0)
    each = eps_total / max(1, stats.count())
    fits = {
        ("base", "BMI"): gwas.gwas_linear(cells),
        ("base", "T2D"): gwas.gwas_logistic(cells),
        ("dp", "BMI"): dp.quant_betas(sums, stats, eps_total, delta_total, seed),
        ("dp", "T2D"): dp.case_betas(dp.noisy_case_table(dp.case_table(cells), each, seed)),
        ("fed", "BMI"): federated.federated_linear(genotypes, dealt, p_values=False),
        ("fed", "T2D"): federated.federated_gwas(C.genotype_cells(genotypes, dealt, ["site"]), "binary", p_values=False),
    }
    return reduce(DataFrame.unionByName, [d.select(F.lit(m).alias("method"), F.lit(t).alias("trait"), "variant_id", "beta") for (m, t), d in fits.items()])
