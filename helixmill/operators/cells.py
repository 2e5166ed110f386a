"""The central reduction: people who share dosage and covariates are one cell of counts and sums.

Linear and logistic fits, case tables, private selection and private least squares all
follow from cells, whose number a variant is bounded by the covariate levels, whatever the
number of people. Partial cells are built before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.columns import broadcast_if_few, broadcast_if_small, clip

SUMS = ("n", "cases", "sum_y", "sum_yy", "sum_yc", "sum_yyc")


def _sums(clip_at: float) -> dict:
    y, c = F.col("y_quant"), clip(F.col("y_quant"), -clip_at, clip_at)
    return {"n": F.lit(1), "cases": F.col("y_bin"), "sum_y": y, "sum_yy": y * y, "sum_yc": c, "sum_yyc": c * c}


def is_flipped(genotypes: DataFrame) -> Column:
    return F.col("flipped") if "flipped" in genotypes.columns else F.lit(False)


def genotype_cells(genotypes: DataFrame, people: DataFrame, by: Sequence[str] = (), sparse: bool = True, clip_at: float = 50.0, parts: int = 16) -> DataFrame:
    """variant_id, by, dosage, age, sex and sums, for each combination that occurs.

    `people` has sample_id, age, sex, y_bin, y_quant and the columns `by` (such as site or
    grid value; a person may occur once for each). In sparse data dosage 0 has no row: its
    cells are the totals of all people less carriers and missing calls. If the genotypes
    have a column `flipped`, the absent rows of those variants count as dosage 2.

    Totals meet variants by `parts` hashed parts of the covariate levels, so their number has no bound.
    """
    keys = [*by, "age", "sex"]
    small = broadcast_if_few(people.select("sample_id", *keys, "y_bin", "y_quant"))
    seen = genotypes.join(small, "sample_id")
    seen = seen.groupBy("variant_id", is_flipped(genotypes).alias("flipped"), "dosage", *keys).agg(*(F.sum(e).alias(c) for c, e in _sums(clip_at).items()))
    if not sparse:
        return seen.drop("flipped").where("dosage is not null")
    absent = F.when(F.col("flipped"), F.lit(2)).otherwise(F.lit(0))
    totals = people.groupBy(*keys).agg(*(F.sum(e).alias(c) for c, e in _sums(clip_at).items()))
    totals = totals.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    every = genotypes.select("variant_id", is_flipped(genotypes).alias("flipped")).distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    zero = every.join(broadcast_if_small(totals), "part").select("variant_id", absent.alias("dosage"), *keys, *SUMS)
    # each row counts for its own dosage, unless that is missing, and against the absent one
    row = lambda dosage, sign: F.struct(dosage.cast("int").alias("dosage"), *((sign * F.col(c)).alias(c) for c in SUMS))
    both = F.filter(F.array(row(F.col("dosage"), 1), row(absent, -1)), lambda r: r["dosage"].isNotNull())
    moved = seen.select("variant_id", *keys, F.explode(both).alias("r")).select("variant_id", "r.dosage", *keys, *(f"r.{c}" for c in SUMS))
    return moved.unionByName(zero).groupBy("variant_id", *by, "dosage", "age", "sex").agg(*(F.sum(c).alias(c) for c in SUMS)).where("n > 0")
