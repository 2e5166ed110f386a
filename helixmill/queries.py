"""The registered queries of the association-study operators, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import columns as K
from helixmill.jobs import studies
from helixmill.operators import cells as C
from helixmill.operators import compare, dp, federated, gwas, harmonize, pgs, qc, roc
from helixmill.sql_models import chi2_of_p, least_squares, logistic, normal_p, t_p
from helixmill.views import prelude, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 42


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0.0 as 0.0, so that two engines can be held against each other."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = f"{prelude(*ctes)} {sql}"
        return f

    return register


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def stats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = views(spark, sf_dir, "genotypes", "people")
    return qc.variant_stats(g, p.count())


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.genotype_cells(*views(spark, sf_dir, "genotypes", "people"))


# all person-level genotypes, which the Spark side never builds
DENSE = """dense AS (SELECT v.variant_id, p.sample_id, p.age, p.sex, p.y_bin, p.y_quant, p.sample_id % 5 + 1 AS site, CASE WHEN g.sample_id IS NULL THEN 0 ELSE g.dosage END AS dosage
  FROM (SELECT DISTINCT variant_id FROM genotypes) v CROSS JOIN people p LEFT JOIN genotypes g ON g.variant_id = v.variant_id AND g.sample_id = p.sample_id)"""
STATS = """stats AS (SELECT variant_id, count(dosage) AS n_called, 1 - count(dosage) / count(*)::DOUBLE AS missing_rate, avg(dosage) / 2 AS freq,
  least(avg(dosage) / 2, 1 - avg(dosage) / 2) AS maf, avg(dosage) AS mean, var_samp(dosage) AS var, stddev_samp(dosage) AS sd, min(dosage) <> max(dosage) AS polymorphic FROM dense GROUP BY variant_id)"""


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


# ---------------------------------------------------------------- quality control


@query(f"SELECT variant_id, n_called, {r6('missing_rate', 'freq', 'maf', 'mean', 'var', 'sd')}, polymorphic FROM stats", DENSE, STATS)
def a03_variant_stats(s: SparkSession, d: str) -> DataFrame:
    return stats_of(s, d)


@query("SELECT g.variant_id, g.sample_id, g.dosage FROM genotypes g JOIN stats t ON g.variant_id = t.variant_id WHERE t.maf >= 0.06 AND t.missing_rate <= 0.05 AND polymorphic", DENSE, STATS)
def f03_filter_maf_missing(s: SparkSession, d: str) -> DataFrame:
    return qc.filter_maf_missing(view(s, d, "genotypes"), stats_of(s, d), maf=0.06)


@query("SELECT g.variant_id, count(*) AS n FROM genotypes g JOIN stats t ON g.variant_id = t.variant_id WHERE polymorphic GROUP BY g.variant_id", DENSE, STATS)
def f05_filter_polymorphic(s: SparkSession, d: str) -> DataFrame:
    return qc.filter_polymorphic(view(s, d, "genotypes"), stats_of(s, d)).groupBy("variant_id").agg(F.count("*").alias("n"))


@query("SELECT variant_id, count(*) AS n FROM genotypes g JOIN customer c ON g.sample_id = c.c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY variant_id")
def f01_filter_population(s: SparkSession, d: str) -> DataFrame:
    panel = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("super_pop"))
    return qc.filter_population(view(s, d, "genotypes"), panel, "MACHINERY").groupBy("variant_id").agg(F.count("*").alias("n"))


@query("SELECT variant_id, ref, a AS alt FROM (SELECT variant_id, ref, CASE WHEN variant_id % 4 = 0 THEN alt || ',T' WHEN variant_id % 4 = 1 THEN 'AT' ELSE alt END AS a FROM variants) x WHERE a IN ('A','C','G','T')")
def f02_filter_biallelic_snps(s: SparkSession, d: str) -> DataFrame:
    v = view(s, d, "variants")
    alt = F.when(F.col("variant_id") % 4 == 0, F.concat("alt", F.lit(",T"))).when(F.col("variant_id") % 4 == 1, "AT").otherwise(F.col("alt"))
    return qc.filter_biallelic_snps(v.withColumn("alt", alt)).select("variant_id", "ref", "alt")


@query("SELECT variant_id, chr FROM variants WHERE chr = '22'")
def f04_filter_chromosome(s: SparkSession, d: str) -> DataFrame:
    return qc.filter_chromosome(view(s, d, "variants").withColumn("chr", F.col("chr").cast("int")), "22", "chr").select("variant_id", F.col("chr").cast("string").alias("chr"))


@query("SELECT coalesce((SELECT position FROM h WHERE n_alt > 0 AND n_alt < n_haplotypes ORDER BY line LIMIT 1), (SELECT position FROM h ORDER BY line LIMIT 1)) AS position",
       "h AS (SELECT variant_id AS line, variant_id * 1000 AS position, count(*) FILTER (WHERE dosage = 2) AS n_alt, count(*) AS n_haplotypes FROM genotypes GROUP BY variant_id)")
def f06_first_polymorphic_locus(s: SparkSession, d: str) -> DataFrame:
    h = view(s, d, "genotypes").groupBy(F.col("variant_id").alias("line")).agg((F.first("variant_id") * 1000).alias("position"), F.count_if(F.col("dosage") == 2).alias("n_alt"), F.count("*").alias("n_haplotypes"))
    return qc.first_polymorphic_locus(h)


@query("SELECT rsid, trait, round(greatest(2.220446e-16, least(p, 1 - 1e-15)), 6) + 0.0 AS p FROM results WHERE p IS NOT NULL AND isfinite(p)")
def f07_finite_pvalues(s: SparkSession, d: str) -> DataFrame:
    return gwas.finite_pvalues(view(s, d, "results")).select("rsid", "trait", "p")


@query("SELECT rsid, trait FROM results WHERE p < 0.01")
def f08_significant_hits(s: SparkSession, d: str) -> DataFrame:
    return gwas.significant_hits(view(s, d, "results"), line=0.01).select("rsid", "trait")


@query("""SELECT 'raw' AS step, (SELECT count(*) FROM stats) AS variants UNION ALL SELECT 'maf_missing', (SELECT count(*) FROM good) UNION ALL SELECT 'ld_pruning', (SELECT count(*) FROM good)
  UNION ALL SELECT 'score_all', (SELECT count(DISTINCT rsid) FROM weights) UNION ALL SELECT 'score_overlap', (SELECT count(*) FROM good g WHERE concat('rs', g.variant_id) IN (SELECT rsid FROM weights))""",
       DENSE, STATS, "good AS (SELECT variant_id FROM stats WHERE maf >= 0.06 AND missing_rate <= 0.05 AND polymorphic)")
def a02_variant_funnel(s: SparkSession, d: str) -> DataFrame:
    w, v = views(s, d, "weights", "variants")
    return qc.variant_funnel(stats_of(s, d), w, v, maf=0.06).select("step", "variants")


# ---------------------------------------------------------------- projections and scalar functions


@query("SELECT variant_id, split_part(ref || '/' || alt, '/', 1) AS ref, split_part(ref || '/' || alt, '/', 2) AS alt FROM variants")
def p01_split_alleles(s: SparkSession, d: str) -> DataFrame:
    a, b = K.split_alleles(F.concat_ws("/", "ref", "alt"))
    return view(s, d, "variants").select("variant_id", a.alias("ref"), b.alias("alt"))


@query("SELECT variant_id, sample_id, CASE WHEN variant_id % 2 = 0 THEN 2 - dosage ELSE dosage END AS dosage FROM genotypes")
def p02_flip_dosage(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "genotypes").withColumn("dosage", K.flip(F.col("dosage"), F.col("variant_id") % 2 == 0))


@query("SELECT rsid AS \"SNP\", chr AS \"CHR\", bp AS \"BP\", trait, round(p, 6) + 0.0 AS \"P\" FROM results")
def p03_normalize_columns(s: SparkSession, d: str) -> DataFrame:
    return qc.normalize_columns(view(s, d, "results").select("rsid", "chr", "bp", "trait", "p"), {"SNP": ["rsid", "marker"], "CHR": ["chrom"], "BP": ["pos", "position"], "P": ["pval"]})


@query("SELECT rsid, trait, NULL::DOUBLE AS se FROM results")
def p04_ensure_columns(s: SparkSession, d: str) -> DataFrame:
    return qc.ensure_columns(view(s, d, "results"), {"se": "double", "trait": "string"}, ["variant_id", "chr", "bp", "beta", "p"])


@query("SELECT rsid, trait, round(-log10(greatest(2.220446e-16, least(p, 1 - 1e-15))), 6) + 0.0 AS logp FROM results")
def p05_neg_log10_p(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "results").select("rsid", "trait", K.neg_log10_p(F.col("p")).alias("logp"))


@query("SELECT sample_id, round(greatest(-5.0, least(50.0, y_quant)), 6) + 0.0 AS y FROM people")
def p06_clip(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "people").select("sample_id", K.clip(F.col("y_quant"), -5, 50).alias("y"))


@query("SELECT sample_id, round(least(1.0, 3.0 / (sqrt(1 + age * age / 100.0 + sex) + 1e-12)), 6) + 0.0 AS scale FROM people")
def p07_clip_row_l2(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "people").select("sample_id", K.row_scale([F.lit(1.0), F.col("age") / 10, F.col("sex").cast("double")], 3.0).alias("scale"))


@query("SELECT chr || ':' || bp || '_' || ref || '_' || alt AS key, chr, bp AS pos, ref, alt FROM variants")
def p08_variant_key(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "variants").select(K.variant_key(*(F.col(c) for c in ("chr", "bp", "ref", "alt"))).alias("key")).select("key", *K.parse_variant_key(F.col("key")))


def uniform_sql(purpose: str, *keys: str, seed: int | str = SEED) -> str:
    key = " || '|' || ".join([f"'{seed}|{purpose}'", *(f"({k})" for k in keys)])
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


@query(f"""SELECT variant_id, round(u, 6) AS u, round(-2.0 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 6) + 0.0 AS laplace, round(-2.0 * ln(-ln(u)), 6) + 0.0 AS gumbel,
  round(2.0 * sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) + 0.0 AS gaussian FROM (SELECT variant_id, {uniform_sql('u', 'variant_id')} AS u, {uniform_sql('v', 'variant_id')} AS v FROM variants) x""")
def p09_keyed_noise(s: SparkSession, d: str) -> DataFrame:
    u, v = (K.uniform(SEED, k, F.col("variant_id")) for k in "uv")
    return view(s, d, "variants").select("variant_id", u.alias("u"), K.laplace(u, 2.0).alias("laplace"), K.gumbel(u, 2.0).alias("gumbel"), K.gaussian(u, v, 2.0).alias("gaussian"))


@query(f"""SELECT sample_id, round(score + 25 + 0.02 * age + 2 * sex + sqrt(-2 * ln({uniform_sql('quant-u', 'sample_id')})) * cos(2 * pi() * {uniform_sql('quant-v', 'sample_id')}), 6) AS y_quant FROM scores""")
def p10_compose_phenotype(s: SparkSession, d: str) -> DataFrame:
    sc = view(s, d, "scores").select("sample_id", F.col("score").alias("score_z"), "age", "sex")
    return pgs.compose_phenotype(sc, 0.5, SEED).select("sample_id", "y_quant")


# ---------------------------------------------------------------- joins and set operations


@query("SELECT trait, line, rsid FROM weights WHERE rsid IN (SELECT rsid FROM variants WHERE chr = '22')")
def j01_overlap_weights(s: SparkSession, d: str) -> DataFrame:
    w, v = views(s, d, "weights", "variants")
    return harmonize.overlap_weights(w, qc.filter_chromosome(v, "22", "chr")).select("trait", "line", "rsid")


FLIPS = """firsts AS (SELECT rsid, arg_min(effect_allele, (trait, line)) AS ea FROM weights GROUP BY rsid),
flips AS (SELECT v.variant_id, v.rsid, v.ref, v.alt, coalesce(f.ea, v.alt) AS effect_allele FROM variants v LEFT JOIN firsts f ON v.rsid = f.rsid)"""


@query("""SELECT g.variant_id, g.sample_id, CASE WHEN f.effect_allele <> f.alt THEN 2 - g.dosage ELSE g.dosage END AS dosage, f.effect_allele <> f.alt AS flipped
  FROM genotypes g JOIN flips f ON g.variant_id = f.variant_id""", FLIPS)
def j02_harmonize_alleles(s: SparkSession, d: str) -> DataFrame:
    g, v, w = views(s, d, "genotypes", "variants", "weights")
    return harmonize.harmonize_alleles(g, harmonize.allele_flips(v, w, ["trait", "line"])).select("variant_id", "sample_id", "dosage", "flipped")


@query("""SELECT variant_id, CASE WHEN chr = '22' AND variant_id % 3 = 0 THEN 'known' || bp ELSE rsid END AS rsid FROM variants""")
def j03_annotate_rsid(s: SparkSession, d: str) -> DataFrame:
    v = view(s, d, "variants")
    names = v.where((F.col("chr") == "22") & (F.col("variant_id") % 3 == 0)).select("chr", "bp", F.concat(F.lit("known"), F.col("bp")).alias("rsid"))
    return harmonize.annotate_rsid(v, names).select("variant_id", "rsid")


@query("SELECT a.rsid, round(a.p, 6) + 0.0 AS p_a, round(b.p, 6) + 0.0 AS p_b FROM results a JOIN results b ON a.rsid = b.rsid WHERE a.trait = 'BMI' AND b.trait = 'T2D' AND a.p IS NOT NULL AND b.p IS NOT NULL")
def j04_align_results(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "results")
    return harmonize.align_results(r.where("trait = 'BMI'"), r.where("trait = 'T2D'"), ["p"])


@query("SELECT g.sample_id, count(*) AS n, round(sum(w.weight), 6) + 0.0 AS total FROM genotypes g JOIN w ON g.variant_id = w.variant_id GROUP BY g.sample_id",
       "w AS (SELECT variant_id, coalesce(CASE WHEN variant_id % 3 = 0 THEN NULL ELSE variant_id / 100.0 END, 0) AS weight FROM variants WHERE chr = '22')")
def j05_join_weights(s: SparkSession, d: str) -> DataFrame:
    g, v = views(s, d, "genotypes", "variants")
    w = v.where("chr = '22'").select("variant_id", F.when(F.col("variant_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("variant_id") / 100.0).alias("weight"))
    return pgs.join_weights(g, w).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


@query("SELECT variant_id FROM variants WHERE rsid NOT IN (SELECT rsid FROM weights)")
def j06_non_score_variants(s: SparkSession, d: str) -> DataFrame:
    v, w = views(s, d, "variants", "weights")
    return harmonize.non_score_variants(v, w, least=10).select("variant_id")


THRESHOLDS = "thr AS (SELECT unnest(range(-40, 41)) / 10.0 AS threshold)"


@query("""SELECT t.threshold, count(*) FILTER (WHERE s.y_bin = 1 AND s.score >= t.threshold) AS tp, count(*) FILTER (WHERE s.y_bin = 0 AND s.score >= t.threshold) AS fp,
  count(*) FILTER (WHERE s.y_bin = 1) AS n_pos, count(*) FILTER (WHERE s.y_bin = 0) AS n_neg FROM scores s CROSS JOIN thr t GROUP BY t.threshold""", THRESHOLDS)
def j07_roc_counts(s: SparkSession, d: str) -> DataFrame:
    sc = view(s, d, "scores")
    t = sc.select(F.lit([i / 10 for i in range(-40, 41)]).alias("thresholds")).limit(1)
    return roc.roc_counts_at(sc, t)


@query("SELECT k, count(*) AS n, sum((sample_id % k)::BIGINT)::BIGINT AS s FROM people CROSS JOIN (SELECT unnest([2, 3, 5]) AS k) g GROUP BY k")
def j08_param_grid(s: SparkSession, d: str) -> DataFrame:
    p = studies.over_grid(view(s, d, "people"), "k", "2, 3,5,3", "int")
    return p.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("sample_id") % F.col("k")).alias("s"))


QEDGES = "edges AS (SELECT list_sort(list_distinct(quantile_cont(score::DOUBLE, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM scores)"


@query("SELECT sample_id, (1 + len(list_filter(e[2:len(e) - 1], lambda x: x < score)))::INT AS bin FROM scores CROSS JOIN edges", QEDGES)
def j09_assign_quantile_bin(s: SparkSession, d: str) -> DataFrame:
    return pgs.with_bins(view(s, d, "scores"), "score", 10).select("sample_id", "bin")


@query("SELECT DISTINCT rsid, effect_allele, round(effect_weight, 6) + 0.0 AS effect_weight FROM weights")
def u01_union_effect_alleles(s: SparkSession, d: str) -> DataFrame:
    w = view(s, d, "weights")
    return harmonize.union_effect_alleles(w.where("trait = 'T2D'"), w.where("trait = 'BMI'"))


@query("SELECT rsid FROM weights WHERE trait = 'T2D' INTERSECT SELECT rsid FROM weights WHERE trait = 'BMI'")
def u02_shared_variants(s: SparkSession, d: str) -> DataFrame:
    w = view(s, d, "weights")
    return harmonize.shared_variants(w.where("trait = 'T2D'"), w.where("trait = 'BMI'"))


@query("""SELECT 'a' AS method, rsid, round(p, 6) + 0.0 AS p, NULL::DOUBLE AS beta FROM results WHERE trait = 'BMI'
  UNION ALL SELECT 'b', rsid, NULL, round(beta, 6) + 0.0 FROM results WHERE trait = 'T2D'""")
def u03_stack_results(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "results")
    return gwas.stack_results({"a": r.where("trait = 'BMI'").select("rsid", "p"), "b": r.where("trait = 'T2D'").select("rsid", "beta")}, "method").select("method", "rsid", "p", "beta")


@query("SELECT rsid, arg_min(effect_allele, (trait, line)) AS effect_allele, min(trait) AS trait FROM weights GROUP BY rsid")
def w10_first_match(s: SparkSession, d: str) -> DataFrame:
    return harmonize.first_match(view(s, d, "weights"), "rsid", ["trait", "line"]).select("rsid", "effect_allele", "trait")


# ---------------------------------------------------------------- aggregations


@query("SELECT trait, rsid, round(sum(effect_weight), 6) + 0.0 AS weight FROM weights GROUP BY trait, rsid")
def a01_collapse_weights(s: SparkSession, d: str) -> DataFrame:
    return pgs.collapse_weights(view(s, d, "weights"), ["trait"])


@query("SELECT sample_id, round((score - m) / sd, 6) + 0.0 AS z FROM scores CROSS JOIN (SELECT avg(score) AS m, stddev_samp(score) AS sd FROM scores) x")
def a04_standardize(s: SparkSession, d: str) -> DataFrame:
    return K.standard_score(view(s, d, "scores"), "score", "z").select("sample_id", "z")


@query("SELECT sample_id, (y_quant > q)::INT AS y_bin FROM people CROSS JOIN (SELECT quantile_cont(y_quant, 1 - 0.119) AS q FROM people) x")
def a05_case_threshold(s: SparkSession, d: str) -> DataFrame:
    return pgs.case_threshold(view(s, d, "people").drop("y_bin"), "y_quant").select("sample_id", "y_bin")


@query("""SELECT variant_id, dosage, age, sex, count(*) AS n, sum(y_bin)::BIGINT AS cases, round(sum(y_quant), 4) + 0.0 AS sum_y, round(sum(y_quant * y_quant), 3) + 0.0 AS sum_yy
  FROM dense WHERE dosage IS NOT NULL GROUP BY variant_id, dosage, age, sex""", DENSE)
def a06_genotype_cells(s: SparkSession, d: str) -> DataFrame:
    c = cells_of(s, d)
    return c.select("variant_id", "dosage", "age", "sex", "n", "cases", F.round("sum_y", 4).alias("sum_y"), F.round("sum_yy", 3).alias("sum_yy"))


def linear_sql(keys: str, tag: str = "") -> tuple[str, ...]:
    """Person-level least squares on dosage, age and sex, freed of age and sex in closed form; `tag` tells two such sets of CTEs apart."""
    return (
        DENSE,
        f"""m{tag} AS (SELECT {keys}, count(*)::DOUBLE AS n, avg(dosage) AS mg, avg(age) AS ma, avg(sex) AS mx, avg(y_quant) AS my FROM dense WHERE dosage IS NOT NULL GROUP BY {keys})""",
        f"""c{tag} AS (SELECT {', '.join(f'm.{k.strip()}' for k in keys.split(','))}, any_value(m.n) AS n, sum((dosage-mg)*(dosage-mg)) AS gg, sum((dosage-mg)*(age-ma)) AS ga, sum((dosage-mg)*(sex-mx)) AS gx, sum((dosage-mg)*(y_quant-my)) AS gy,
  sum((age-ma)*(age-ma)) AS aa, sum((age-ma)*(sex-mx)) AS ax, sum((age-ma)*(y_quant-my)) AS ay, sum((sex-mx)*(sex-mx)) AS xx, sum((sex-mx)*(y_quant-my)) AS xy, sum((y_quant-my)*(y_quant-my)) AS yy
  FROM dense d JOIN m{tag} m ON {' AND '.join(f'm.{k.strip()} = d.{k.strip()}' for k in keys.split(','))} WHERE dosage IS NOT NULL GROUP BY {', '.join(f'm.{k.strip()}' for k in keys.split(','))})""",
        f"""b{tag} AS (SELECT {keys}, n, gg, gg - ((ga*xx-gx*ax)*ga + (gx*aa-ga*ax)*gx)/(aa*xx-ax*ax) AS rgg, gy - ((ga*xx-gx*ax)*ay + (gx*aa-ga*ax)*xy)/(aa*xx-ax*ax) AS rgy,
  yy - ((ay*xx-xy*ax)*ay + (xy*aa-ay*ax)*xy)/(aa*xx-ax*ax) AS ryy FROM c{tag})""",
        f"""fit{tag} AS (SELECT {keys}, n::BIGINT AS n, rgy / rgg AS beta, sqrt(greatest(0, ryy - rgy * rgy / rgg) / (n - 4) / rgg) AS se, gg > 1e-9 AS polymorphic FROM b{tag})""",
    )


@query(f"SELECT variant_id, n, {r6('beta', 'se')}, round(beta / se, 6) + 0.0 AS t, polymorphic FROM fit", *linear_sql("variant_id"))
def a07_gwas_linear(s: SparkSession, d: str) -> DataFrame:
    return gwas.gwas_linear(cells_of(s, d))


@query(f"SELECT variant_id, n, {r6('beta', 'se')}, round(beta / se, 6) + 0.0 AS t, polymorphic, round({t_p('beta / se', 'n - 4')}, 6) + 0.0 AS p FROM fit", *linear_sql("variant_id"))
def a07_gwas_linear_p(s: SparkSession, d: str) -> DataFrame:
    return gwas.with_t_p(gwas.gwas_linear(cells_of(s, d)))


LOGISTIC = f"{r6('beta', 'se', 'z')}, round({normal_p('z')}, 6) + 0.0 AS p, status"


@query(f"SELECT variant_id, n, {LOGISTIC} FROM lg", DENSE, logistic("lg", ["variant_id"], "dense"))
def a08_gwas_logistic(s: SparkSession, d: str) -> DataFrame:
    return gwas.gwas_logistic(cells_of(s, d))


def site_cells(s: SparkSession, d: str) -> DataFrame:
    g, p = views(s, d, "genotypes", "people")
    return C.genotype_cells(g, p.withColumn("site", (F.col("sample_id") % 5 + 1).cast("int")), ["site"])


@query(f"SELECT variant_id, site::INT AS site, n, {r6('beta', 'se')}, round(beta / se, 6) + 0.0 AS t, polymorphic FROM fit", *linear_sql("variant_id, site"))
def a09_site_gwas_linear(s: SparkSession, d: str) -> DataFrame:
    return gwas.gwas_linear(site_cells(s, d), ["variant_id", "site"])


@query(f"SELECT variant_id, site::INT AS site, n, {LOGISTIC} FROM lg", DENSE, logistic("lg", ["variant_id", "site"], "dense", firth=True))
def a10_site_gwas_logistic(s: SparkSession, d: str) -> DataFrame:
    return gwas.gwas_logistic(site_cells(s, d), ["variant_id", "site"], firth=True)


META = """w AS (SELECT variant_id, beta AS b, 1 / (se * se) AS w FROM fit WHERE se > 0 AND isfinite(se) AND isfinite(beta)),
mt AS (SELECT variant_id, sum(w*b)/sum(w) AS beta, sqrt(1/sum(w)) AS se, CASE WHEN count(*) = 1 THEN 0.0 ELSE greatest(0, sum(w*b*b) - sum(w*b)*sum(w*b)/sum(w)) END AS q, count(*) AS k FROM w GROUP BY variant_id)"""
META_SELECT = f"SELECT variant_id, {r6('beta', 'se')}, round(beta / se, 6) + 0.0 AS z, {r6('q')}, round(CASE WHEN q <= greatest(1, k - 1) THEN 0.0 ELSE (q - greatest(1, k - 1)) / q END, 6) + 0.0 AS i2, k FROM mt"


@query(META_SELECT, *linear_sql("variant_id, site"), META)
def a11_meta_fixed_effect(s: SparkSession, d: str) -> DataFrame:
    fits = gwas.gwas_linear(site_cells(s, d), ["variant_id", "site"])
    return gwas.meta_fixed_effect(fits, p_values=False)


@query("SELECT trait, count(*) AS n, round(median(greatest(2.220446e-16, least(p, 1 - 1e-15))), 6) + 0.0 AS median_p FROM results GROUP BY trait")
def a12_median_p(s: SparkSession, d: str) -> DataFrame:
    return gwas.genomic_inflation(view(s, d, "results"), ["trait"]).select("trait", "n", "median_p")

def inflation_sql(source: str, *keys: str) -> tuple[str, ...]:
    """CTEs: the two middle p-values of each group of `source`, and ml with lambda from their chi-squares."""
    k = ", ".join(keys)
    return (
        f"md AS (SELECT {k}, n, p FROM (SELECT {k}, greatest(2.220446e-16, least(p, 1 - 1e-15)) AS p, row_number() OVER (PARTITION BY {k} ORDER BY p) AS r, count(*) OVER (PARTITION BY {k}) AS n FROM {source} WHERE p IS NOT NULL) z WHERE r IN ((n + 1) // 2, n // 2 + 1))",
        chi2_of_p("mc", "md", [*keys, "n"]),
        f"ml AS (SELECT {k}, any_value(n) AS n, avg(chi2) / 0.4549364231195724 AS lambda FROM mc GROUP BY {k})",
    )


@query("SELECT l.trait, l.n, round(m.median_p, 6) + 0.0 AS median_p, round(l.lambda, 6) + 0.0 AS lambda FROM ml l JOIN (SELECT trait, avg(p) AS median_p FROM md GROUP BY trait) m ON m.trait = l.trait", *inflation_sql("results", "trait"))
def a12_genomic_inflation(s: SparkSession, d: str) -> DataFrame:
    return gwas.genomic_inflation(view(s, d, "results"), ["trait"])


@query("SELECT trait, count(*) FILTER (WHERE p < 0.01) AS hits, count(*) AS tested FROM results GROUP BY ROLLUP (trait)")
def a13_hit_counts(s: SparkSession, d: str) -> DataFrame:
    return gwas.hit_counts(view(s, d, "results"), line=0.01)


CASES = "ct AS (SELECT variant_id, " + ", ".join(f"count(*) FILTER (WHERE dosage = {g} AND y_bin = {y}) AS {k}_{g}" for g in (0, 1, 2) for y, k in ((1, "case"), (0, "ctrl"))) + " FROM dense GROUP BY variant_id)"


@query("SELECT variant_id, case_0, ctrl_0, case_1, ctrl_1, case_2, ctrl_2 FROM ct", DENSE, CASES)
def a14_case_table(s: SparkSession, d: str) -> DataFrame:
    return dp.case_table(cells_of(s, d))


PGS = """cw AS (SELECT trait, v.variant_id, sum(effect_weight) AS weight FROM weights w JOIN variants v ON w.rsid = v.rsid GROUP BY trait, v.variant_id),
pg AS (SELECT p.sample_id, t.trait, coalesce(x.s, 0) AS score FROM people p CROSS JOIN (SELECT DISTINCT trait FROM cw) t LEFT JOIN
  (SELECT g.sample_id, cw.trait, sum(g.dosage * cw.weight) AS s FROM genotypes g JOIN cw ON g.variant_id = cw.variant_id GROUP BY g.sample_id, cw.trait) x ON x.sample_id = p.sample_id AND x.trait = t.trait)"""


def weights_by_variant(s: SparkSession, d: str) -> DataFrame:
    w, v = views(s, d, "weights", "variants")
    return pgs.collapse_weights(w, ["trait"]).join(v.select("rsid", "variant_id"), "rsid").select("trait", "variant_id", "weight")


def scores_of(s: SparkSession, d: str) -> DataFrame:
    g, p = views(s, d, "genotypes", "people")
    return pgs.pgs_score(g, weights_by_variant(s, d), p)


@query("SELECT sample_id, trait, round(score, 6) + 0.0 AS score FROM pg", PGS)
def a15_pgs_score(s: SparkSession, d: str) -> DataFrame:
    return scores_of(s, d)


OLS = """st AS (SELECT site, count(*) AS n, sum(y_quant*y_quant) AS yy, sum(y_quant) AS sum_y, sum(y_quant) AS t_0, sum(score*y_quant) AS t_1, sum(age*y_quant) AS t_2, sum(sex*y_quant) AS t_3,
  count(*)::DOUBLE AS s_00, sum(score) AS s_01, sum(age)::DOUBLE AS s_02, sum(sex)::DOUBLE AS s_03, sum(score*score) AS s_11, sum(score*age) AS s_12, sum(score*sex) AS s_13, sum(age*age)::DOUBLE AS s_22, sum(age*sex)::DOUBLE AS s_23, sum(sex*sex)::DOUBLE AS s_33
  FROM scores GROUP BY site)"""
OLS_COLUMNS = ["yy", "sum_y", *(f"t_{i}" for i in range(4)), *(f"s_{i}{j}" for i in range(4) for j in range(i, 4))]


def ols_of(s: SparkSession, d: str) -> DataFrame:
    return pgs.ols_sufficient_stats(view(s, d, "scores"), ["score", "age", "sex"], "y_quant", ["site"])


#: Squares of y have eight decimals, other products five at most, so none ends half-way between two rounded values.
OLS_DIGITS = {c: 3 if c == "yy" else 6 for c in OLS_COLUMNS}


@query(f"SELECT site, n, {', '.join(f'round({c}, {k}) + 0.0 AS {c}' for c, k in OLS_DIGITS.items())} FROM st", OLS)
def a16_ols_sufficient_stats(s: SparkSession, d: str) -> DataFrame:
    return ols_of(s, d).select("site", "n", *(F.round(c, k).alias(c) for c, k in OLS_DIGITS.items()))


@query(f"SELECT sum(n)::BIGINT AS n, {', '.join(f'round(sum({c}), {k}) + 0.0 AS {c}' for c, k in OLS_DIGITS.items())} FROM st", OLS)
def a17_pool_stats(s: SparkSession, d: str) -> DataFrame:
    return pgs.pool_stats(ols_of(s, d)).select("n", *(F.round(c, k).alias(c) for c, k in OLS_DIGITS.items()))


R2_DIGITS = {"b0": 5, "b1": 5, "b2": 5, "b3": 5, "sse": 3, "sst": 3, "r2": 6, "r2_adj": 6}
POOLED = f"po AS (SELECT sum(n)::BIGINT AS n, {', '.join(f'sum({c}) AS {c}' for c in OLS_COLUMNS)} FROM st)"


@query(f"SELECT n, {', '.join(f'round({c}, {k}) + 0.0 AS {c}' for c, k in R2_DIGITS.items())} FROM rr", OLS, POOLED, least_squares("rr", "po"))
def a18_r2_from_stats(s: SparkSession, d: str) -> DataFrame:
    r = pgs.r2_from_stats(pgs.pool_stats(ols_of(s, d)))
    r = r.select("n", *(F.get("beta", i).alias(f"b{i}") for i in range(4)), "sse", "sst", "r2", "r2_adj")
    return r.select("n", *(F.round(c, k).alias(c) for c, k in R2_DIGITS.items()))


@query("""SELECT bin, n, sum_y, floor(round(sum_y * 10000) * 100 / n) / 1e6 + 0.0 AS mean_y FROM
  (SELECT bin, count(*) AS n, round(sum(greatest(-50.0, least(50.0, y_quant))), 4) + 0.0 AS sum_y
  FROM (SELECT y_quant, (1 + len(list_filter(e[2:len(e) - 1], lambda x: x < score)))::INT AS bin FROM scores CROSS JOIN edges) z GROUP BY bin) y""", QEDGES)
def a19_binned_means(s: SparkSession, d: str) -> DataFrame:
    """Sums have four decimals, so means are cut, not rounded, from whole numbers: a quotient can lie half-way between two rounded values."""
    b = pgs.binned_means(view(s, d, "scores"), "score", "y_quant").withColumn("sum_y", F.round("sum_y", 4))
    return b.withColumn("mean_y", F.floor(F.round(F.col("mean_y") * F.col("n") * 10000) * 100 / F.col("n")) / 1e6)


@query("""SELECT count(*) FILTER (WHERE b.p < 0.05) AS true_hits, count(*) FILTER (WHERE b.p < 0.05 AND a.p < 0.5) AS found,
  round(count(*) FILTER (WHERE b.p < 0.05 AND a.p < 0.5) / nullif(count(*) FILTER (WHERE b.p < 0.05), 0)::DOUBLE, 6) AS recall FROM results a JOIN results b ON a.rsid = b.rsid WHERE a.trait = 'T2D' AND b.trait = 'BMI'""")
def a20_hit_recall(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "results")
    return compare.hit_recall(r.where("trait = 'T2D'"), r.where("trait = 'BMI'"), line=0.5, base_line=0.05)


RANKS = """pairs AS (SELECT a.rsid, -log10(greatest(2.220446e-16, least(a.p, 1 - 1e-15))) AS x, -log10(greatest(2.220446e-16, least(b.p, 1 - 1e-15))) AS y FROM results a JOIN results b ON a.rsid = b.rsid WHERE a.trait = 'BMI' AND b.trait = 'T2D'),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pairs)"""


@query("SELECT count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM rk", RANKS)
def a21_spearman(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "results")
    pairs = harmonize.align_results(r.where("trait = 'BMI'"), r.where("trait = 'T2D'"), ["p"])
    return compare.spearman(pairs.select(K.neg_log10_p(F.col("p_a")).alias("x"), K.neg_log10_p(F.col("p_b")).alias("y")), "x", "y")


P61 = "[" + ",".join(str(i / 60) for i in range(61)) + "]"
SITE_ROC = f"""sq AS (SELECT site, unnest(list_distinct(quantile_cont(score::DOUBLE, {P61}))) AS th FROM scores GROUP BY site),
sr AS (SELECT sq.site, th, count(*) FILTER (WHERE y_bin = 1 AND score >= th) / count(*) FILTER (WHERE y_bin = 1)::DOUBLE AS tpr, count(*) FILTER (WHERE y_bin = 0 AND score >= th) / count(*) FILTER (WHERE y_bin = 0)::DOUBLE AS fpr FROM sq JOIN scores s ON s.site = sq.site GROUP BY sq.site, th),
sa AS (SELECT site, sum(a) AS auc FROM (SELECT site, (fpr - lag(fpr) OVER (PARTITION BY site ORDER BY fpr, tpr)) * (tpr + lag(tpr) OVER (PARTITION BY site ORDER BY fpr, tpr)) / 2 AS a FROM sr) z GROUP BY site)"""


@query("SELECT s.site, count(*) AS n, sum(y_bin)::BIGINT AS cases, round(any_value(sa.auc), 6) + 0.0 AS auc FROM scores s JOIN sa ON s.site = sa.site GROUP BY s.site", SITE_ROC)
def a22_site_summary(s: SparkSession, d: str) -> DataFrame:
    return federated.site_summary(view(s, d, "scores"))


RUNS = "runs AS (SELECT CASE WHEN r.variant_id % 2 = 0 THEN 'DP' ELSE 'FED' END AS method, 1 AS run, r.trait, r.rsid, r.beta * (1 + (r.variant_id % 5) / 10.0) AS beta FROM results r)"


def runs_of(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "results")
    return r.select(F.when(F.col("variant_id") % 2 == 0, "DP").otherwise("FED").alias("method"), F.lit(1).alias("run"), "trait", "rsid", (F.col("beta") * (1 + (F.col("variant_id") % 5) / 10)).alias("beta"))


@query("""SELECT method, trait, count(*) AS n, round(avg(delta), 6) + 0.0 AS mean, round(min(delta), 6) + 0.0 AS lo, round(max(delta), 6) + 0.0 AS hi, round(stddev_samp(delta), 6) + 0.0 AS sd
  FROM (SELECT u.method, u.trait, u.beta - r.beta AS delta FROM runs u JOIN results r ON u.rsid = r.rsid AND u.trait = r.trait) z GROUP BY CUBE (method, trait)""", RUNS)
def a23_delta_beta_summary(s: SparkSession, d: str) -> DataFrame:
    return compare.delta_beta_summary(compare.delta_betas(runs_of(s, d), view(s, d, "results")))


@query("SELECT unnest(range(1, len(e) + 1))::INT AS i, round(unnest(e), 6) + 0.0 AS edge FROM edges", QEDGES)
def a24_quantile_edges(s: SparkSession, d: str) -> DataFrame:
    return pgs.quantile_edges(view(s, d, "scores"), "score", 10).select(F.posexplode("edges").alias("i", "edge")).withColumn("i", F.col("i") + 1)


WTHR = f"""wq AS (SELECT site, count(*) AS n, quantile_cont(score::DOUBLE, {P61}) AS q FROM scores GROUP BY site),
wt AS (SELECT pos, round(sum(v * n) / sum(n), 9) AS threshold FROM (SELECT n, unnest(range(0, 61)) AS pos, unnest(q) AS v FROM wq) z GROUP BY pos)"""


@query("SELECT pos::INT AS pos, round(threshold, 6) + 0.0 AS threshold FROM wt", WTHR)
def a25_weighted_thresholds(s: SparkSession, d: str) -> DataFrame:
    return roc.weighted_thresholds(roc.site_quantiles(view(s, d, "scores"))).select(F.posexplode("thresholds").alias("pos", "threshold"))


@query("SELECT trait, CASE WHEN p = 1 THEN 30 ELSE floor(p / (1.0 / 30)) + 1 END::INT AS bin, count(*) AS n FROM results WHERE p BETWEEN 0 AND 1 GROUP BY 1, 2")
def a26_histogram(s: SparkSession, d: str) -> DataFrame:
    return compare.histogram(view(s, d, "results"), "p", 0.0, 1.0, 30, ["trait"])


@query("""SELECT least(20, floor((age - la) * 20.0 / (ha - la)) + 1)::INT AS x_bin, least(20, floor((y_quant - ly) * 20.0 / (hy - ly)) + 1)::INT AS y_bin, count(*) AS n
  FROM people CROSS JOIN (SELECT min(age) AS la, max(age) AS ha, min(y_quant) AS ly, max(y_quant) AS hy FROM people) z GROUP BY 1, 2""")
def a27_density_2d(s: SparkSession, d: str) -> DataFrame:
    return compare.density_2d(view(s, d, "people"), "age", "y_quant", 20)


@query("SELECT trait, count(*) AS n, round(avg(score), 6) + 0.0 AS mean, round(min(score), 6) + 0.0 AS lo, round(max(score), 6) + 0.0 AS hi, round(stddev_samp(score), 6) + 0.0 AS sd FROM pg GROUP BY trait", PGS)
def a28_score_distribution(s: SparkSession, d: str) -> DataFrame:
    return compare.score_distribution(scores_of(s, d), ["trait"])


@query("SELECT round(regr_slope(y_quant, score), 6) + 0.0 AS slope, round(regr_intercept(y_quant, score), 6) + 0.0 AS intercept, count(*) AS n FROM scores")
def a29_regression_line(s: SparkSession, d: str) -> DataFrame:
    return pgs.regression_line(view(s, d, "scores"), "score", "y_quant")


@query(f"""SELECT sample_id, round((s - avg(s) OVER ()) / stddev_samp(s) OVER (), 6) + 0.0 AS score_z FROM
  (SELECT p.sample_id, coalesce(sum(g.dosage * e.weight), 0) AS s FROM people p LEFT JOIN (genotypes g JOIN e ON g.variant_id = e.variant_id) ON g.sample_id = p.sample_id GROUP BY p.sample_id) z""",
       f"""pool AS (SELECT variant_id FROM variants WHERE rsid NOT IN (SELECT rsid FROM weights) ORDER BY {uniform_sql('sample', 'variant_id')}, variant_id LIMIT 20),
e AS (SELECT variant_id, 0.1 * sqrt(-2 * ln({uniform_sql('effect-u', 'variant_id')})) * cos(2 * pi() * {uniform_sql('effect-v', 'variant_id')}) AS weight FROM pool)""")
def a30_genetic_component(s: SparkSession, d: str) -> DataFrame:
    v, w, g, p = views(s, d, "variants", "weights", "genotypes", "people")
    return pgs.genetic_component(g, v, w, p, "SPARSE", SEED, k=20, least=10)


COMPONENT = "SELECT sample_id, round(coalesce((s - avg(s) OVER ()) / nullif(stddev_samp(s) OVER (), 0), 0), 6) + 0.0 AS score_z FROM (SELECT sample_id, score AS s FROM pgc) z"


@query(COMPONENT, """cwc AS (SELECT v.variant_id, sum(effect_weight) AS weight FROM weights w JOIN variants v ON w.rsid = v.rsid GROUP BY v.variant_id),
pgc AS (SELECT p.sample_id, coalesce(sum(g.dosage * c.weight), 0) AS score FROM people p LEFT JOIN (genotypes g JOIN cwc c ON g.variant_id = c.variant_id) ON g.sample_id = p.sample_id GROUP BY p.sample_id)""")
def a30_catalog_component(s: SparkSession, d: str) -> DataFrame:
    v, w, g, p = views(s, d, "variants", "weights", "genotypes", "people")
    return pgs.genetic_component(g, v, w, p, "PGS", SEED)


@query("SELECT sample_id, 0.0::DOUBLE AS score_z FROM people")
def a30_no_component(s: SparkSession, d: str) -> DataFrame:
    v, w, g, p = views(s, d, "variants", "weights", "genotypes", "people")
    return pgs.genetic_component(g, v, w, p, "NULL", SEED)


# ---------------------------------------------------------------- windows, sorts and samples

ROC = """rc AS (SELECT score, sum(y_bin) AS pos, sum(1 - y_bin) AS neg FROM scores GROUP BY score),
rx AS (SELECT score, sum(neg) OVER (ORDER BY score DESC) / sum(neg) OVER ()::DOUBLE AS fpr, sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER ()::DOUBLE AS tpr FROM rc UNION ALL SELECT NULL, 0.0, 0.0)"""


@query("SELECT round(score, 6) + 0.0 AS score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM rx", ROC)
def w01_roc_exact(s: SparkSession, d: str) -> DataFrame:
    return roc.roc_exact(view(s, d, "scores"))


HIST = """hb AS (SELECT (1 + len(list_filter(e[2:len(e) - 1], lambda x: x < score)))::INT AS bin, y_bin FROM scores CROSS JOIN edges),
hc AS (SELECT bin, sum(y_bin) AS pos, sum(1 - y_bin) AS neg FROM hb GROUP BY bin)"""


@query("SELECT bin, round(sum(neg) OVER (ORDER BY bin DESC) / sum(neg) OVER ()::DOUBLE, 6) AS fpr, round(sum(pos) OVER (ORDER BY bin DESC) / sum(pos) OVER ()::DOUBLE, 6) AS tpr FROM hc", QEDGES, HIST)
def w02_roc_from_histogram(s: SparkSession, d: str) -> DataFrame:
    b = pgs.with_bins(view(s, d, "scores"), "score", 10).groupBy("bin").agg(F.sum("y_bin").alias("pos"), F.sum(1 - F.col("y_bin")).alias("neg"))
    total = b.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).withColumn("_k", F.lit(1))
    return roc.roc_from_histogram(b.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k"))


FED_ROC = """fr AS (SELECT threshold, count(*) FILTER (WHERE y_bin = 1 AND score >= threshold) / count(*) FILTER (WHERE y_bin = 1)::DOUBLE AS tpr, count(*) FILTER (WHERE y_bin = 0 AND score >= threshold) / count(*) FILTER (WHERE y_bin = 0)::DOUBLE AS fpr
  FROM scores CROSS JOIN (SELECT DISTINCT threshold FROM wt) t GROUP BY threshold),
mr AS (SELECT max(fpr) OVER (ORDER BY fpr, tpr ROWS UNBOUNDED PRECEDING) AS fpr, max(tpr) OVER (ORDER BY fpr, tpr ROWS UNBOUNDED PRECEDING) AS tpr FROM fr)"""


@query("SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM mr", WTHR, FED_ROC)
def w03_monotone_roc(s: SparkSession, d: str) -> DataFrame:
    return federated.federated_roc(view(s, d, "scores"))


def area(points: str) -> str:
    return f"SELECT round(greatest(0, least(1, sum(a))), 6) + 0.0 AS auc FROM (SELECT (fpr - lag(fpr) OVER (ORDER BY fpr, tpr)) * (tpr + lag(tpr) OVER (ORDER BY fpr, tpr)) / 2 AS a FROM {points}) z"


@query(area("mr"), WTHR, FED_ROC)
def w04_auc_trapezoid(s: SparkSession, d: str) -> DataFrame:
    return federated.federated_auc(view(s, d, "scores"))


@query("""SELECT round((sum(r) FILTER (WHERE y_bin = 1) - sum(y_bin) * (sum(y_bin) + 1) / 2.0) / (sum(y_bin) * sum(1 - y_bin)), 6) + 0.0 AS auc FROM
  (SELECT y_bin, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scores) z""")
def w05_auc_rank(s: SparkSession, d: str) -> DataFrame:
    return roc.auc_rank(view(s, d, "scores"))


@query("SELECT sample_id, ntile(5) OVER (ORDER BY md5('42|site|' || sample_id), sample_id)::INT AS site FROM people")
def w06_assign_sites(s: SparkSession, d: str) -> DataFrame:
    return federated.assign_sites(view(s, d, "people"), 5, SEED).select("sample_id", "site")


@query("SELECT trait, rsid, rank, round(-log10(p), 6) + 0.0 AS observed, round(-log10((rank - 0.5) / n), 6) + 0.0 AS expected FROM (SELECT trait, rsid, greatest(2.220446e-16, least(p, 1 - 1e-15)) AS p, row_number() OVER (PARTITION BY trait ORDER BY p, rsid)::INT AS rank, count(*) OVER (PARTITION BY trait) AS n FROM results) z")
def w08_qq_points(s: SparkSession, d: str) -> DataFrame:
    return gwas.qq_points(view(s, d, "results"), ["trait"])


@query("SELECT sample_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scores")
def w09_average_rank(s: SparkSession, d: str) -> DataFrame:
    return compare.average_rank(view(s, d, "scores"), "score", "r").select("sample_id", "r")


@query("SELECT rsid, round(p, 6) + 0.0 AS p FROM results WHERE trait = 'BMI' AND rsid IN (SELECT rsid FROM weights) ORDER BY results.p, rsid LIMIT 25")
def t01_top_highlights(s: SparkSession, d: str) -> DataFrame:
    r, w = views(s, d, "results", "weights")
    return gwas.top_highlights(r.where("trait = 'BMI'"), w, 25).select("rsid", "p")


@query("""SELECT chr::INT AS chr, bp, rsid, round(greatest(2.220446e-16, least(p, 1 - 1e-15)), 6) + 0.0 AS p, round(-log10(greatest(2.220446e-16, least(p, 1 - 1e-15))), 6) + 0.0 AS neg_log10_p, greatest(2.220446e-16, least(p, 1 - 1e-15)) < 5e-8 AS above,
  min(bp) OVER (PARTITION BY chr) AS bp_from, max(bp) OVER (PARTITION BY chr) AS bp_to FROM results WHERE trait = 'BMI'""")
def t02_manhattan_points(s: SparkSession, d: str) -> DataFrame:
    return gwas.manhattan_points(view(s, d, "results").where("trait = 'BMI'"))


@query(f"SELECT trait, rsid FROM (SELECT trait, rsid, row_number() OVER (PARTITION BY trait ORDER BY {uniform_sql('sample', 'rsid')}, rsid) AS r FROM results) z WHERE r <= 30")
def t03_seeded_sample(s: SparkSession, d: str) -> DataFrame:
    return pgs.seeded_sample(view(s, d, "results"), 30, SEED, "rsid", ["trait"]).select("trait", "rsid")
