"""Column expressions: alleles, dosages, p-values, clipping, keyed noise and privacy budgets."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of p-values before logarithms.
LEAST_P, MOST_P = 2.220446e-16, 1 - 1e-15
BIOBANK_LINE = 5e-8


def finite(x: Column) -> Column:
    """`x`, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), None).otherwise(x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """`x` held within [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def clip_p(p: Column) -> Column:
    return clip(p, LEAST_P, MOST_P)


def neg_log10_p(p: Column) -> Column:
    return -F.log10(clip_p(p))


def row_scale(columns: list[Column], most: float) -> Column:
    """Factor that brings the row vector of `columns` to a length of `most` at most."""
    return F.least(F.lit(1.0), F.lit(float(most)) / (F.sqrt(reduce(lambda a, b: a + b, [c * c for c in columns])) + F.lit(1e-12)))


def split_alleles(alleles: Column) -> tuple[Column, Column]:
    """The parts of `A/B`; null where there is no second one."""
    parts = F.split(alleles, "/")
    return F.get(parts, 0), F.get(parts, 1)


def flip(dosage: Column, flipped: Column) -> Column:
    return F.when(flipped, 2 - dosage).otherwise(dosage)


def variant_key(chr_: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """CHR:POS_REF_ALT."""
    return F.concat(chr_.cast("string"), F.lit(":"), F.concat_ws("_", pos.cast("string"), ref, alt))


def parse_variant_key(key: Column) -> list[Column]:
    """chr, pos, ref and alt of a variant key."""
    rest = F.split(F.substring_index(key, ":", -1), "_")
    return [F.substring_index(key, ":", 1).alias("chr"), F.get(rest, 0).cast("int").alias("pos"), F.get(rest, 1).alias("ref"), F.get(rest, 2).alias("alt")]


def uniform(seed: int | str, purpose: str, *keys: Column) -> Column:
    """In (0, 1): a function of seed, purpose and keys alone, so retries and plans never change it."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *(k.cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace noise from a uniform value, by the inverse distribution function."""
    c = u - 0.5
    return -(scale if isinstance(scale, Column) else F.lit(float(scale))) * F.signum(c) * F.log(1 - 2 * F.abs(c))


def gumbel(u: Column, scale: Column | float) -> Column:
    return -(scale if isinstance(scale, Column) else F.lit(float(scale))) * F.log(-F.log(u))


def gaussian(u: Column, v: Column, scale: Column | float) -> Column:
    """Normal noise from two uniform values."""
    return (scale if isinstance(scale, Column) else F.lit(float(scale))) * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def strong_composition(eps: Column, delta: Column, m: Column) -> tuple[Column, Column]:
    """Epsilon and delta of each of `m` queries by advanced composition; half of delta pays for it."""
    b = F.sqrt(2 * m * F.log(1 / F.greatest(delta * 0.5, F.lit(1e-12))))
    return F.greatest((F.sqrt(b * b + 4 * m * eps) - b) / (2 * m), F.lit(1e-6)), F.greatest(delta * 0.5 / m, F.lit(1e-12))


def zcdp(eps: Column, delta: Column, m: Column) -> tuple[Column, Column]:
    """Total rho, and rho of each of `m` queries, that (eps, delta) allows under zCDP."""
    l = F.log(1 / delta)
    root = F.sqrt(l + eps) - F.sqrt(l)
    total = F.greatest(root * root, F.lit(1e-16))
    return total, total / m


def split_budget(eps: Column, share: float = 0.2) -> tuple[Column, Column]:
    """Epsilon of selection and of estimation."""
    select = F.greatest(eps * share, F.lit(1e-6))
    return select, F.greatest(eps - select, F.lit(1e-6))


def broadcast_if_small(df: DataFrame, most_bytes: int = 64_000_000) -> DataFrame:
    """`df` with a broadcast hint if Spark's estimate for its plan is at most `most_bytes`.

    The estimate errs on the large side for joins and aggregates, and knows nothing of how many rows arrays
    explode into, so plans that do that get no hint; what it misses, adaptive execution still finds
    out from the sizes that it measures. Nothing is run to find the size.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    known = "Generate " not in plan.toString()
    return F.broadcast(df) if known and int(str(plan.stats().sizeInBytes())) <= most_bytes else df


def broadcast_if_few(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """`df` with a broadcast hint if Spark's estimate allows one and it has at most `rows` rows, which are counted.

    For tables of a row a person: the estimate of a stored table is the size of its files, which may hold a row in a few
    bytes, while the table that the driver builds from it takes a hundred.
    """
    hinted = broadcast_if_small(df)
    return hinted if hinted is not df and df.count() <= rows else df


def standard_score(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """`df` with the z-score of `column` (sample deviation); constant or missing gives 0."""
    stats = df.groupBy(*(by or [])).agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd"))
    z = F.coalesce(F.when(F.col("_sd") > 0, (F.col(column) - F.col("_mean")) / F.col("_sd")), F.lit(0.0))
    if by:
        return df.join(stats, by, "left").withColumn(out, z).drop("_mean", "_sd")
    mean, sd = stats.first() or (None, None)
    return df.withColumn(out, F.coalesce((F.col(column) - mean) / sd, F.lit(0.0)) if sd else F.lit(0.0))
