"""Association-study tables derived from the supplied tables, by the same rules in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Views that both engines read; each may use those before it.
VIEWS = {
    "samples": "SELECT c_custkey AS sample_id, CAST(18 + c_custkey % 73 AS INT) AS age, CAST((c_custkey % 7) % 2 AS INT) AS sex FROM customer",
    "phenotypes": "SELECT c_custkey AS sample_id, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS INT) AS y_bin, c_acctbal / 100 AS y_quant FROM customer",
    "people": "SELECT s.sample_id, s.age, s.sex, p.y_bin, p.y_quant FROM samples s JOIN phenotypes p ON s.sample_id = p.sample_id",
    "part_variants": """SELECT p_partkey, p_retailprice, p_size, CAST(substr(p_brand, 7) AS BIGINT) * 10 + CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1
        WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 ELSE 5 END AS variant_id FROM part""",
    "carried": """SELECT v.variant_id, o.o_custkey AS sample_id, CAST(least(2, count(*)) AS INT) AS dosage FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part_variants v ON l.l_partkey = v.p_partkey GROUP BY v.variant_id, o.o_custkey""",
    # a few calls are missing; dosage 0 has no row
    "genotypes": "SELECT variant_id, sample_id, CASE WHEN (sample_id * 7 + variant_id) % 97 = 0 THEN NULL ELSE dosage END AS dosage FROM carried",
    "variants": """SELECT variant_id, concat('rs', variant_id) AS rsid, CASE WHEN variant_id % 5 = 0 THEN '21' ELSE '22' END AS chr, CAST(variant_id * 1000 + 7 AS INT) AS bp,
        'A' AS ref, CASE WHEN variant_id % 2 = 0 THEN 'C' ELSE 'G' END AS alt FROM (SELECT DISTINCT variant_id FROM part_variants) d""",
    # a third of the variants goes by names that the genotypes do not have, so that scores overlap in part
    "weights": """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'T2D' ELSE 'BMI' END AS trait, p_partkey AS line, '22' AS chr_name,
        concat(CASE WHEN variant_id % 10 < 4 THEN 'rs' ELSE 'other' END, variant_id) AS rsid,
        CASE WHEN p_partkey % 3 = 0 THEN 'A' WHEN variant_id % 2 = 0 THEN 'C' ELSE 'G' END AS effect_allele, (p_retailprice - 1000) / 1000 AS effect_weight
        FROM part_variants""",
    # carriers against everyone: the difference of means, and a bound on its normal tail as p; means come from whole
    # ten-thousandths and effects are cut to five digits, so that no order of a sum can move a value that another rounds
    "everyone": "SELECT CAST(sum(CAST(round(y_quant * 10000) AS BIGINT)) AS DOUBLE) / 10000e0 / count(*) AS m, stddev_samp(y_quant) AS s, avg(y_bin) AS mb, stddev_samp(y_bin) AS sb FROM people",
    "carriers": """SELECT g.variant_id, count(*) AS n, CAST(sum(CAST(round(p.y_quant * 10000) AS BIGINT)) AS DOUBLE) / 10000e0 / count(*) AS m, avg(p.y_bin) AS mb FROM genotypes g JOIN people p ON g.sample_id = p.sample_id
        WHERE g.dosage > 0 GROUP BY g.variant_id""",
    "results": """SELECT v.variant_id, v.rsid, v.chr, v.bp, 'BMI' AS trait, floor((c.m - e.m) * 100000e0) / 100000e0 AS beta, exp(-4 * c.n * (c.m - e.m) * (c.m - e.m) / (e.s * e.s)) AS p
        FROM carriers c JOIN variants v ON c.variant_id = v.variant_id JOIN everyone e ON 1 = 1 UNION ALL
        SELECT v.variant_id, v.rsid, v.chr, v.bp, 'T2D' AS trait, floor((c.mb - e.mb) * 100000e0) / 100000e0 AS beta, exp(-4 * c.n * (c.mb - e.mb) * (c.mb - e.mb) / (e.sb * e.sb)) AS p
        FROM carriers c JOIN variants v ON c.variant_id = v.variant_id JOIN everyone e ON 1 = 1""",
    # a score of each person: the weighted dosages of all variants
    "scores": """SELECT p.sample_id, p.age, p.sex, p.y_bin, p.y_quant, CAST(p.sample_id % 5 + 1 AS INT) AS site, round(coalesce(s.score, 0), 4) AS score FROM people p LEFT JOIN
        (SELECT g.sample_id, sum(g.dosage * (g.variant_id % 7 - 3)) / 10.0 AS score FROM genotypes g GROUP BY g.sample_id) s ON p.sample_id = s.sample_id""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of `sf_dir`."""
    sql = re.sub(r"\b(FROM|JOIN) (customer|orders|lineitem|part)\b", r"\1 {\2}", prelude().replace("RECURSIVE ", "", 1))
    return spark.sql(f"{sql} SELECT * FROM {name}", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem", "part")})


def prelude(*more: str) -> str:
    """WITH clause for DuckDB that defines all views, and the `name AS (...)` items given."""
    return "WITH RECURSIVE " + ",\n".join([*(f"{k} AS ({v})" for k, v in VIEWS.items()), *more])
