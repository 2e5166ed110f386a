"""Association scans from cells: linear and logistic fits per variant (and site), and their reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.functions import stats
from helixmill.functions.columns import BIOBANK_LINE, broadcast_if_few, broadcast_if_small, clip_p, finite, neg_log10_p
from helixmill.functions.ordering import neighbours, numbered
from helixmill.operators.cells import is_flipped
from helixmill.operators.qc import is_hit

MEDIAN_CHI2 = 0.4549364231195724


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(stats.t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(2 * stats.norm_sf(np.abs(z.to_numpy(float))))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(stats.chi2_sf(x.to_numpy(float), df.to_numpy()))


def _covariance(names: Sequence[str]) -> dict[str, Column]:
    """Centred sums of products from raw sums s_x and s_xy."""
    return {f"c_{a}{b}": F.col(f"s_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n") for i, a in enumerate(names) for b in names[i:]}


def linear_sums(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n and the sums of products of dosage, age, sex and y (names g, a, x, y)."""
    v = {"g": F.col("dosage"), "a": F.col("age"), "x": F.col("sex")}
    sums = {f"s_{k}": F.sum(F.col("n") * e) for k, e in v.items()} | {"s_y": F.sum("sum_y"), "s_yy": F.sum("sum_yy")}
    for i, (k, e) in enumerate(v.items()):
        sums |= {f"s_{k}{m}": F.sum(F.col("n") * e * f) for m, f in list(v.items())[i:]}
        sums[f"s_{k}y"] = F.sum(e * F.col("sum_y"))
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), *(e.cast("double").alias(c) for c, e in sums.items()))


def sparse_linear_sums(genotypes: DataFrame, people: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What `linear_sums` gives by variant and `by`, straight from sparse genotypes, and n_all, the people with or without a call.

    Dosage 0 adds nothing to sums with dosage, and the other sums are those of all people
    less missing calls, so nothing finer than a variant (and `by`) is ever shuffled. A flipped
    variant is summed as it was before, and dosage g then read as 2 - g.
    """
    flipped = is_flipped(genotypes)
    g = F.when(flipped, 2 - F.col("dosage")).otherwise(F.col("dosage"))
    v = {"a": F.col("age"), "x": F.col("sex"), "y": F.col("y_quant")}
    pairs = [(i, k) for n, i in enumerate(v) for k in list(v)[n:]]
    base = {"n": F.lit(1)} | {f"s_{k}": e for k, e in v.items()} | {f"s_{i}{k}": v[i] * v[k] for i, k in pairs}
    seen = genotypes.join(broadcast_if_few(people.select("sample_id", *by, "age", "sex", "y_quant")), "sample_id")
    missing = F.col("dosage").isNull()
    lost = {f"lost_{c}": F.sum(F.when(missing, e).otherwise(0)) for c, e in base.items()}
    with_g = {"s_g": F.sum(g), "s_gg": F.sum(g * g)} | {f"s_g{k}": F.sum(g * e) for k, e in v.items()}
    sums = {c: F.coalesce(e, F.lit(0)).cast("double") for c, e in (lost | with_g).items()}
    d = seen.groupBy("variant_id", *by).agg(F.bool_or(flipped).alias("flipped"), *(e.alias(c) for c, e in sums.items()))
    totals = people.groupBy(*by).agg(*(F.sum(e).cast("double").alias(c) for c, e in base.items()))
    if by:  # one row a variant takes on a row for each value of `by`, also where nobody carries it
        d = d.groupBy("variant_id").agg(F.bool_or("flipped").alias("flipped"), F.collect_list(F.struct(*by, *sums)).alias("given"))
    d = d.withColumn("_k", F.lit(1)).join(broadcast_if_small(totals.withColumn("_k", F.lit(1))), "_k")
    if by:
        own = F.get(F.filter("given", lambda r: reduce(lambda a, b: a & b, [r[k] == F.col(k) for k in by])), 0)
        d = d.withColumn("own", own).select("variant_id", *by, "flipped", *base, *(F.coalesce(F.col(f"own.{c}"), F.lit(0.0)).alias(c) for c in sums))
    d = d.select("variant_id", *by, "flipped", *with_g, F.col("n").cast("long").alias("n_all"), *((F.col(c) - F.col(f"lost_{c}")).alias(c) for c in base))
    return turned(d.withColumn("n", F.col("n").cast("long")))


def turned(sums: DataFrame) -> DataFrame:
    """`sums` with dosage g read as 2 - g where `flipped`, which goes."""
    n, s, ss = (F.col(c) for c in ("n", "s_g", "s_gg"))
    turn = {"s_g": 2 * n - s, "s_gg": 4 * n - 4 * s + ss} | {f"s_g{k}": 2 * F.col(f"s_{k}") - F.col(f"s_g{k}") for k in "axy"}
    return sums.select(*(c for c in sums.columns if c not in (*turn, "flipped")), *(F.when(F.col("flipped"), e).otherwise(F.col(c)).alias(c) for c, e in turn.items()))


def passing_sums(sums: DataFrame, maf: float = 0.01, missing: float = 0.05) -> DataFrame:
    """`sums` of variants that pass `qc.filter_maf_missing`: the sums of dosage, of its square and of calls say all that it asks for."""
    n, s = F.col("n"), F.col("s_g")
    two = (F.col("s_gg") - s) / 2
    levels = [n - s + two, s - 2 * two, two]
    freq = F.when(n > 0, s / n / 2)
    kinds = reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in levels])
    return sums.where((F.least(freq, 1 - freq) >= maf) & ((F.col("n_all") - n) / F.col("n_all") <= missing) & (kinds > 1))


def gwas_linear(cells: DataFrame, keys: Sequence[str] = ("variant_id",)) -> DataFrame:
    """`linear_fit` of cells."""
    return linear_fit(linear_sums(cells, keys), keys)


def gwas_linear_sparse(genotypes: DataFrame, people: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`linear_fit` of sparse genotypes, without cells."""
    return linear_fit(sparse_linear_sums(genotypes, people, by), ["variant_id", *by])


def linear_fit(sums: DataFrame, keys: Sequence[str] = ("variant_id",)) -> DataFrame:
    """keys, n, beta, se, t and polymorphic of y ~ dosage + age + sex, from `linear_sums`.

    Dosage and y are freed of age and sex by the closed 2x2 solution on centred sums, all in
    columns; null where the model has no unique solution. p follows with `with_t_p`.
    """
    d = sums.select(*keys, "n", *(e.alias(c) for c, e in _covariance("gaxy").items()))
    det = F.col("c_aa") * F.col("c_xx") - F.col("c_ax") * F.col("c_ax")
    d = d.withColumn("det", F.when(det > 1e-9 * F.col("c_aa") * F.col("c_xx"), det))
    for v in "gy":
        a, x = (F.col("c_ga"), F.col("c_gx")) if v == "g" else (F.col("c_ay"), F.col("c_xy"))
        d = d.withColumn(f"{v}_a", (a * F.col("c_xx") - x * F.col("c_ax")) / F.col("det")).withColumn(f"{v}_x", (x * F.col("c_aa") - a * F.col("c_ax")) / F.col("det"))
    gg = F.col("c_gg") - F.col("g_a") * F.col("c_ga") - F.col("g_x") * F.col("c_gx")
    gy = F.col("c_gy") - F.col("g_a") * F.col("c_ay") - F.col("g_x") * F.col("c_xy")
    yy = F.col("c_yy") - F.col("y_a") * F.col("c_ay") - F.col("y_x") * F.col("c_xy")
    d = d.withColumns({"gg": F.when(gg > 1e-9 * F.col("c_gg"), gg), "gy": gy, "yy": yy, "polymorphic": F.col("c_gg") > 1e-9})
    d = d.withColumn("beta", F.col("gy") / F.col("gg"))
    rss = F.greatest(F.lit(0.0), F.col("yy") - F.col("beta") * F.col("gy"))
    d = d.withColumn("se", F.when(F.col("n") > 4, F.sqrt(rss / (F.col("n") - 4) / F.col("gg"))))
    return d.select(*keys, "n", "beta", "se", F.try_divide("beta", "se").alias("t"), "polymorphic")


def with_t_p(fits: DataFrame) -> DataFrame:
    return fits.withColumn("p", t_p(F.col("t"), (F.col("n") - 4).cast("double")))


def _design(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of each model as arrays of equal length, filled up with cells of nobody: x (1, dosage, age / 50, sex), n and cases."""
    size = pc.list_value_length(lists).to_numpy()
    flat = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    x = np.zeros((len(size), max(1, size.max(initial=0)), 6))
    for i, (c, unit) in enumerate((("dosage", 1), ("age", 50), ("sex", 1), ("n", 1), ("cases", 1))):
        x[row, at, i + 1] = flat.field(c).to_numpy(zero_copy_only=False) / unit
    x[..., 0] = x[..., 4] > 0
    return x[..., :4], x[..., 4], x[..., 5]


def _fit_lists(lists: pa.ListArray, firth: bool) -> dict[str, list | np.ndarray]:
    """n, beta, se and status of each model."""
    x, n, cases = _design(lists)
    people, ill = n.sum(1), cases.sum(1)
    low, high = np.where(n > 0, x[..., 1], np.inf).min(1), np.where(n > 0, x[..., 1], -np.inf).max(1)
    status = np.where(high <= low, "constant", np.where((ill == 0) | (ill == people), "one_class", "model_error")).astype(object)
    beta, se = np.full(len(n), np.nan), np.full(len(n), np.nan)
    for how in ("plain", "firth") if firth else ("plain",):
        left = np.flatnonzero(status == "model_error")
        b, e, ok = stats.irls(x[left], n[left], cases[left], firth=how == "firth")
        ok &= e[:, 1] < 1e3
        beta[left[ok]], se[left[ok]], status[left[ok]] = b[ok, 1], e[ok, 1], how
    return {"n": people.astype(np.int64), "beta": beta, "se": se, "status": status}


def gwas_logistic(cells: DataFrame, keys: Sequence[str] = ("variant_id",), firth: bool = False, most: int = 500) -> DataFrame:
    """keys, n, beta, se, z, p and status of the logistic model case ~ dosage + age + sex.

    Cells carry all the likelihood needs, so a model is a few hundred of them at most, and
    `most` models at a time are fitted together in numpy. With `firth`, penalised estimates
    stand in where the plain ones are not finite.
    """
    more = "n long, beta double, se double, status string"
    schema = T.StructType([*(cells.schema[k] for k in keys), *T.StructType.fromDDL(more).fields])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                b = whole.slice(at, most)
                f = _fit_lists(b.column("cells"), firth)
                new = [pa.array(f["n"]), *(pa.array(f[c], from_pandas=True) for c in ("beta", "se")), pa.array(f["status"], pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *new], schema.names)

    d = cells.groupBy(*keys).agg(F.collect_list(F.struct("dosage", "age", "sex", "n", "cases")).alias("cells")).mapInArrow(fit, schema)
    d = d.withColumn("z", F.try_divide("beta", "se"))
    return d.withColumn("p", F.when(F.col("z").isNotNull(), normal_p(F.coalesce("z", F.lit(0.0)))))


def meta_fixed_effect(fits: DataFrame, keys: Sequence[str] = ("variant_id",), p_values: bool = True) -> DataFrame:
    """Inverse-variance meta-analysis over sites: beta, se, z, q, i2, k and, on request, p and p_het.

    Only finite fits with se > 0 count; a single one has q = 0 and i2 = 0.
    """
    b, s = finite(F.col("beta")), finite(F.col("se"))
    f = fits.select(*keys, b.alias("b"), F.when(s > 0, 1 / (s * s)).alias("w")).select(*keys, F.when(F.col("w").isNotNull(), F.col("b")).alias("b"), F.when(F.col("b").isNotNull(), F.col("w")).alias("w"))
    d = f.groupBy(*keys).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("b")).alias("swb"), F.sum(F.col("w") * F.col("b") * F.col("b")).alias("swbb"), F.count("w").alias("k"))
    d = d.withColumns({"beta": F.col("swb") / F.col("sw"), "se": F.sqrt(1 / F.col("sw"))})
    q = F.when(F.col("k") == 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("swbb") - F.col("swb") * F.col("swb") / F.col("sw")))
    d = d.withColumn("q", F.when(F.col("k") > 0, q)).withColumn("df", F.greatest(F.lit(1), F.col("k") - 1))
    i2 = F.when(F.col("q") <= F.col("df"), F.lit(0.0)).otherwise((F.col("q") - F.col("df")) / F.col("q"))
    d = d.withColumns({"z": F.col("beta") / F.col("se"), "i2": F.when(F.col("q").isNotNull(), i2)})
    if not p_values:
        return d.select(*keys, "beta", "se", "z", "q", "i2", "k")
    p = F.when(F.col("z").isNotNull(), normal_p(F.coalesce("z", F.lit(0.0))))
    het = F.when(F.col("q").isNotNull(), chi2_p(F.coalesce("q", F.lit(0.0)), F.col("df")))
    return d.withColumn("p", p).withColumn("p_het", het).select(*keys, "beta", "se", "z", "p", "q", "i2", "p_het", "k")


def finite_pvalues(results: DataFrame, p: str = "p") -> DataFrame:
    """Rows with finite chr, bp and p; p clipped away from 0 and 1."""
    return results.where(F.col("chr").isNotNull() & F.col("bp").isNotNull() & finite(F.col(p)).isNotNull()).withColumn(p, clip_p(F.col(p)))


def significant_hits(results: DataFrame, p: str = "p", line: float = BIOBANK_LINE) -> DataFrame:
    return results.where(is_hit(F.col(p), line))


def hit_counts(results: DataFrame, by: Sequence[str] = ("trait",), p: str = "p", line: float = BIOBANK_LINE) -> DataFrame:
    """Hits by each of `by`, with totals (null) by rollup."""
    return results.rollup(*by).agg(F.count_if(is_hit(F.col(p), line)).alias("hits"), F.count("*").alias("tested"))


def genomic_inflation(results: DataFrame, by: Sequence[str] = (), p: str = "p") -> DataFrame:
    """by, n, median p and lambda: the median chi-square of the p-values over its expectation."""
    # chi-square falls as p rises, so its median is the mean of the chi-squares of the two middle p's
    d = neighbours(results.select(*by, clip_p(finite(F.col(p))).alias("p")), "p", [0.5], by)
    chi2 = (chi2_of(F.col("lo")) + chi2_of(F.col("hi"))) / 2
    return d.select(*by, "n", ((F.col("lo") + F.col("hi")) / 2).alias("median_p"), (chi2 / MEDIAN_CHI2).alias("lambda"))


@F.pandas_udf(T.DoubleType())
def chi2_of(p: pd.Series) -> pd.Series:
    """The chi-square value (one degree of freedom) with upper tail p."""
    return pd.Series(stats.norm_ppf(np.asarray(p, float) / 2) ** 2)


def qq_points(results: DataFrame, by: Sequence[str] = (), p: str = "p") -> DataFrame:
    """by, rank, observed and expected -log10 p; ties are ranked by rsid.

    Plotting positions are (i - a) / (n + 1 - 2a) with a of 3/8 for up to ten points, else 1/2.
    """
    ok = results.select(*by, "rsid", clip_p(finite(F.col(p))).alias("p")).where("p is not null")
    d = numbered(ok, [F.col("p"), F.col("rsid")], by, "rank", "n").withColumn("rank", F.col("rank").cast("int"))
    a = F.when(F.col("n") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    return d.select(*by, "rsid", "rank", neg_log10_p(F.col("p")).alias("observed"), (-F.log10((F.col("rank") - a) / (F.col("n") + 1 - 2 * a))).alias("expected"))


def manhattan_points(results: DataFrame, p: str = "p", line: float = BIOBANK_LINE) -> DataFrame:
    """chr as a number, bp, p, -log10 p, whether above the line, and the span of bp of the chromosome."""
    d = finite_pvalues(results, p).withColumn("chr", F.col("chr").cast("int"))
    span = d.groupBy("chr").agg(F.min("bp").alias("bp_from"), F.max("bp").alias("bp_to"))
    return d.join(span, "chr").select("chr", "bp", "rsid", F.col(p).alias("p"), neg_log10_p(F.col(p)).alias("neg_log10_p"), (F.col(p) < line).alias("above"), "bp_from", "bp_to")


def top_highlights(results: DataFrame, weights: DataFrame, most: int = 1000, p: str = "p") -> DataFrame:
    """The score's variants of lowest p, `most` at most; ties by rsid."""
    d = results.where(finite(F.col(p)).isNotNull()).join(weights.select("rsid").distinct(), "rsid", "left_semi")
    return d.orderBy(p, "rsid").limit(most)


def stack_results(frames: dict[str, DataFrame], label: str) -> DataFrame:
    """Rows of all frames under a label; columns that one lacks are null."""
    it: Iterator[DataFrame] = (d.withColumn(label, F.lit(k)) for k, d in frames.items())
    out = next(it)
    for d in it:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
