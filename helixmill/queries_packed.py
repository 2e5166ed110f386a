"""The registered queries over packed genotypes and stored layouts: the same results as the long form, by the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.stored import fresh_path, store
from helixmill.operators import gwas, packed
from helixmill.sources import landing
from helixmill.queries import DENSE, PGS, STATS, linear_sql, query, r6, views, weights_by_variant


def packed_of(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Packed genotypes and the order of their samples, both stored."""
    g, p = views(s, d, "genotypes", "people")
    samples = store(packed.sample_order(p), "samples")
    return store(packed.pack_sparse(g, samples, samples.count()), "packed"), samples


@query(f"SELECT variant_id, n_called, {r6('missing_rate', 'freq', 'maf', 'mean', 'var', 'sd')}, polymorphic FROM stats", DENSE, STATS)
def a03_packed_stats(s: SparkSession, d: str) -> DataFrame:
    return packed.variant_stats(packed_of(s, d)[0])


def called(d: DataFrame) -> DataFrame:
    """variant_id and the calls of each dosage."""
    codes = packed.variant_stats(d)
    return codes.select("variant_id", "n_called", F.round("mean", 6).alias("mean"))


@query("SELECT variant_id, n_called, round(mean, 6) + 0.0 AS mean FROM stats WHERE maf >= 0.06 AND missing_rate <= 0.05 AND polymorphic", DENSE, STATS)
def f03_packed_filter(s: SparkSession, d: str) -> DataFrame:
    return called(packed.filter_maf_missing(packed_of(s, d)[0], maf=0.06))


@query("SELECT variant_id, n_called, round(mean, 6) + 0.0 AS mean FROM stats WHERE polymorphic", DENSE, STATS)
def f05_packed_polymorphic(s: SparkSession, d: str) -> DataFrame:
    return called(packed.filter_polymorphic(packed_of(s, d)[0]))


@query("SELECT sample_id, trait, round(score, 6) + 0.0 AS score FROM pg", PGS)
def a15_packed_scores(s: SparkSession, d: str) -> DataFrame:
    rows, samples = packed_of(s, d)
    return packed.pgs_score(rows, weights_by_variant(s, d), samples)


@query("""SELECT variant_id, dosage, age, sex, count(*) AS n, sum(y_bin)::BIGINT AS cases, round(sum(y_quant), 4) + 0.0 AS sum_y, round(sum(y_quant * y_quant), 3) + 0.0 AS sum_yy
  FROM dense WHERE dosage IS NOT NULL GROUP BY variant_id, dosage, age, sex""", DENSE)
def a06_packed_cells(s: SparkSession, d: str) -> DataFrame:
    rows, samples = packed_of(s, d)
    c = packed.genotype_cells(rows, samples, views(s, d, "people")[0])
    return c.select("variant_id", "dosage", "age", "sex", "n", "cases", F.round("sum_y", 4).alias("sum_y"), F.round("sum_yy", 3).alias("sum_yy"))


@query(f"SELECT variant_id, n, {r6('beta', 'se')}, round(beta / se, 6) + 0.0 AS t, polymorphic FROM fit", *linear_sql("variant_id"))
def a07_packed_linear(s: SparkSession, d: str) -> DataFrame:
    rows, samples = packed_of(s, d)
    return gwas.gwas_linear(packed.genotype_cells(rows, samples, views(s, d, "people")[0]))


@query("SELECT variant_id, rsid, chr, bp FROM variants WHERE chr = '22' AND bp BETWEEN 150000 AND 230000")
def s03_region(s: SparkSession, d: str) -> DataFrame:
    """Variants stored by chromosome and range of positions, and those of a region read back."""
    path = fresh_path(s, "variants")
    landing.land_by_region(views(s, d, "variants")[0], path, width=20_000)
    return landing.read_region(s, path, "22", 150_000, 230_000).select("variant_id", "rsid", "chr", "bp")


@query("SELECT v.rsid, count(*) AS n, sum(g.dosage)::BIGINT AS alleles FROM genotypes g JOIN variants v ON v.variant_id = g.variant_id GROUP BY v.rsid")
def s03_stored_join(s: SparkSession, d: str) -> DataFrame:
    """Genotypes and variants stored in buckets of variant_id, and joined where they are."""
    g, v = (landing.land_bucketed(t, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets=8) for t, path in ((t, fresh_path(s, n)) for t, n in zip(views(s, d, "genotypes", "variants"), ("genotypes", "variants"))))
    return g.join(v, "variant_id").groupBy("rsid").agg(F.count("*").alias("n"), F.sum("dosage").alias("alleles"))
