import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import columns as K
from helixmill.functions import ordering
from helixmill.functions.stored import store
from helixmill.operators import cells as C
from helixmill.operators import compare, dp, federated, gwas, harmonize, pgs, qc, roc
from helixmill.sources import readers, writers
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def study(spark):
    r = np.random.default_rng(3)
    n = 400
    age, sex, y = r.integers(18, 91, n), r.integers(0, 2, n), r.normal(20, 5, n)
    people = [(i, int(age[i]), int(sex[i]), int(r.random() < 0.3), float(y[i])) for i in range(n)]
    g = {v: r.binomial(2, f, n) for v, f in ((1, 0.4), (2, 0.1), (3, 0.02))}
    rows = [(v, i, None if (i + v) % 40 == 0 else int(d)) for v, x in g.items() for i, d in enumerate(x) if d or (i + v) % 40 == 0]
    return spark.createDataFrame(people, "sample_id long, age int, sex int, y_bin int, y_quant double"), spark.createDataFrame(rows, "variant_id long, sample_id long, dosage int"), people, g


def test_linear_fit_equals_least_squares_on_people(study):
    people, gt, rows, g = study
    for r in gwas.with_t_p(gwas.gwas_linear(C.genotype_cells(gt, people))).collect():
        keep = [i for i in range(len(rows)) if (i + r["variant_id"]) % 40]
        x = np.array([[1, g[r["variant_id"]][i], rows[i][1], rows[i][2]] for i in keep], float)
        y = np.array([rows[i][4] for i in keep])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ beta
        se = math.sqrt(e @ e / (len(y) - 4) * np.linalg.inv(x.T @ x)[1, 1])
        assert (r["n"], r["beta"], r["se"]) == (len(y), pytest.approx(beta[1], rel=1e-7), pytest.approx(se, rel=1e-7))
        assert 0 < r["p"] <= 1


def test_flipping_negates_effects_and_keeps_errors(study):
    people, gt, _, _ = study
    a = {r["variant_id"]: r for r in gwas.gwas_linear(C.genotype_cells(gt, people)).collect()}
    flipped = gt.withColumn("flipped", F.lit(True)).withColumn("dosage", 2 - F.col("dosage"))
    for r in gwas.gwas_linear(C.genotype_cells(flipped, people)).collect():
        assert (r["beta"], r["se"]) == (pytest.approx(-a[r["variant_id"]]["beta"], rel=1e-7), pytest.approx(a[r["variant_id"]]["se"], rel=1e-7))


def test_meta_of_one_site_is_that_site(study):
    people, gt, _, _ = study
    fits = gwas.gwas_linear(C.genotype_cells(gt, people.withColumn("site", F.lit(1)), ["site"]), ["variant_id", "site"])
    both = gwas.meta_fixed_effect(fits).join(fits.select("variant_id", F.col("beta").alias("b"), F.col("se").alias("s")), "variant_id")
    for r in both.collect():
        assert (r["beta"], r["se"], r["q"], r["i2"], r["k"]) == (pytest.approx(r["b"]), pytest.approx(r["s"]), 0, 0, 1)


def test_constant_variant_and_one_class_have_no_fit(spark):
    cells = spark.createDataFrame([(1, 0, 30, 0, 10, 3, 5.0, 9.0), (1, 0, 40, 1, 9, 2, 4.0, 8.0), (2, 0, 30, 0, 9, 0, 1.0, 2.0), (2, 1, 50, 1, 9, 0, 1.0, 2.0)], "variant_id int, dosage int, age int, sex int, n long, cases long, sum_y double, sum_yy double")
    assert {r["variant_id"]: r["status"] for r in gwas.gwas_logistic(cells).collect()} == {1: "constant", 2: "one_class"}
    assert gwas.gwas_linear(cells).where("variant_id = 1").first()["beta"] is None


def test_sites_are_of_near_equal_size(spark):
    s = federated.assign_sites(spark.range(23).withColumnRenamed("id", "sample_id"), 5, 7)
    assert sorted(r["count"] for r in s.groupBy("site").count().collect()) == [4, 4, 5, 5, 5]
    with pytest.raises(ValueError):
        federated.assign_sites(s, 1)


def test_noise_does_not_depend_on_partitions(spark):
    f = lambda n: sorted(r["u"] for r in spark.range(0, 500, 1, n).select(K.uniform(1, "x", F.col("id")).alias("u")).collect())
    assert f(1) == f(7)
    d = spark.range(20000).select(K.laplace(K.uniform(1, "l", F.col("id")), 2.0).alias("l"), K.gaussian(K.uniform(1, "a", F.col("id")), K.uniform(1, "b", F.col("id")), 3.0).alias("g"))
    m = d.agg(F.avg("l"), F.var_samp("l"), F.avg("g"), F.stddev_samp("g")).first()
    assert abs(m[0]) < 0.1 and abs(m[1] - 8) < 0.6 and abs(m[2]) < 0.1 and abs(m[3] - 3) < 0.1


def test_auc_is_the_chance_of_ordering(spark):
    s = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (0.5, 0)], "score double, y_bin int")
    rows = [tuple(r) for r in s.collect()]
    pairs = [(a, b) for a, x in rows if x for b, y in rows if not y]
    expected = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert roc.auc_rank(s).first()["auc"] == pytest.approx(expected)
    same = spark.createDataFrame([(1.0, 0), (1.0, 1)], "score double, y_bin int")
    assert roc.auc_rank(same).first()["auc"] == pytest.approx(0.5)
    assert compare.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()["rho"] is None


def test_budgets(spark):
    b = dp.budget_table(spark.createDataFrame([(1.0, 1e-6, 50)], "eps_total double, delta_total double, top_k int")).first()
    assert b["rho_per"] * 50 == pytest.approx(b["rho_total"]) and b["eps_sel"] + b["eps_est"] == pytest.approx(1.0)


def test_no_selection_scores_nobody(study):
    people, gt, _, _ = study
    none = gt.sparkSession.createDataFrame([], "variant_id long, trait string, weight double")
    assert pgs.pgs_score(gt, none, people).count() == 0
    fits = gt.select("variant_id").distinct().withColumn("beta", F.lit(1.0)).withColumn("p", F.lit(0.5))
    s = federated.federated_scores(fits, gt, people.withColumn("site", F.lit(1)))
    assert s.where("score <> 0").count() == 0 and s.count() == people.count()
    assert federated.federated_auc(s).first()["auc"] in (None, 0.5) and federated.federated_r2(s).first()["r2"] is None


def test_columns_by_candidate_names(spark):
    d = spark.createDataFrame([(1, 2)], "Pos int, CHROM int")
    assert qc.normalize_columns(d, {"BP": ["pos"], "CHR": ["chrom"]}).columns == ["BP", "CHR"]
    with pytest.raises(ValueError, match="P"):
        qc.normalize_columns(d, {"P": ["pval"]})


def test_first_match_and_mismatch(spark):
    v = spark.createDataFrame([(1, "rs1", "A", "C"), (2, "rs2", "A", "G"), (3, "rs3", "A", "T")], "variant_id int, rsid string, ref string, alt string")
    w = spark.createDataFrame([("rs1", "A", 2), ("rs1", "C", 1), ("rs2", "A", 1), ("rs3", "G", 1)], "rsid string, effect_allele string, line int")
    f = {r["rsid"]: r["status"] for r in harmonize.allele_flips(v, w, ["line"]).collect()}
    assert f == {"rs1": "same", "rs2": "flipped", "rs3": "mismatch"}


def test_readers(spark, tmp_path):
    vcf = tmp_path / "a.vcf"
    vcf.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\nchr22\t10\trs1\tA\tG\t.\t.\t.\tGT\t0|0\t0/1:9\t./.\n22\t11\trs2\tA\tG,T\t.\t.\t.\tGT\t0|0\t0|1\t1|2\n")
    variants, packed = readers.read_vcf(spark, str(vcf))
    names = readers.vcf_samples(spark, str(vcf))
    assert [r["sample_id"] for r in names.orderBy("i").collect()] == ["s1", "s2", "s3"]
    assert [(r["chr"], r["bp"], r["alt"]) for r in variants.collect()] == [("22", 10, "G")]
    assert sorted((r["sample_id"], r["dosage"]) for r in readers.unpack(packed, names).collect()) == [("s2", 1), ("s3", None)]
    gen = tmp_path / "a.gen"
    gen.write_text("s1 rs1 10 A G 0.95 0.05 0 0 0.5 0.5 0 0 1\n")
    assert readers.read_gen(spark, str(gen)).first()["dosages"] == [0, None, 2]
    (tmp_path / "h").write_text("0 1 0\n0 0 0\n1 1 1\n")
    (tmp_path / "l").write_text("id position a0 a1\nx 5 A G\ny 6 A G\nz 7 A G\n")
    h = readers.read_hap_legend(spark, str(tmp_path / "h"), str(tmp_path / "l"))
    assert sorted((r["position"], r["n_alt"]) for r in h.collect()) == [(5, 1), (6, 0), (7, 3)]
    assert qc.first_polymorphic_locus(h).first()["position"] == 5
    # many files, cut into splits and packed by size: lines keep their order
    rows = spark.range(500).select(F.concat_ws(" ", F.lit("r"), "id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("value"), "id")
    rows.repartitionByRange(7, "id").sortWithinPartitions("id").select("value").write.text(str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert [r["value"].split()[1] for r in readers.text_lines(spark, str(tmp_path / "many")).orderBy("line").collect()] == [str(i) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "p").write_text("Sample POP Super-Pop\na x EUR\nb y AFR\n")
    assert sorted(tuple(r) for r in readers.read_sample_panel(spark, str(tmp_path / "p")).collect()) == [("a", "EUR"), ("b", "AFR")]
    (tmp_path / "w.tsv").write_text("#c\nrsID\tchr_name\teffect_allele\teffect_weight\nrs1\t22\tA\t0.5\nrs2\t22\tC\tx\n")
    assert sorted((r["rsid"], r["effect_weight"]) for r in readers.read_pgs_weights(spark, str(tmp_path / "w.tsv"), "T").collect()) == [("rs1", 0.5), ("rs2", None)]


def test_stored_runs_are_reused(spark, tmp_path):
    built = []

    def build(missing):
        built.append(missing.count())
        return missing.withColumn("beta", F.lit(1.0))

    grid = spark.createDataFrame([("a", 1), ("a", 2)], "method string, run int")
    path = str(tmp_path / "runs")
    writers.write_or_reuse(spark, path, grid, ["method", "run"], build)
    more = grid.unionByName(spark.createDataFrame([("b", 1)], "method string, run int"))
    assert writers.write_or_reuse(spark, path, more, ["method", "run"], build).count() == 3 and built == [2, 1]


def test_streamed_cells_equal_batch_cells(spark, study, tmp_path):
    from helixmill.streaming.cells_stream import stored_cells, stream_cells

    people, gt, _, _ = study
    gt.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream_cells(spark.readStream.schema(gt.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), people, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    key = lambda d: sorted(tuple(r) for r in d.select("variant_id", "dosage", "age", "sex", "n", "cases").collect())
    assert key(stored_cells(spark.read.parquet(str(tmp_path / "out")))) == key(C.genotype_cells(gt, people, sparse=False))


def test_sums_ranks_and_quantiles_of_ranges(spark):
    r = np.random.default_rng(8)
    rows = [("a", float(v)) for v in r.integers(0, 300, 2000)] + [("b", float(v)) for v in r.normal(size=777)] + [("c", 1.0)] * 400 + [("d", 2.5), ("a", None)]
    d = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = [i / 60 for i in range(61)]
    q = {v["g"]: v for v in ordering.quantiles(d, "x", probs, ["g"]).collect()}
    ranks = compare.average_rank(d, "x", "r", ["g"]).collect()
    for g in "abcd":
        x = np.array([v for k, v in rows if k == g and v is not None])
        assert (q[g]["n"], q[g]["q"]) == (len(x), pytest.approx(np.quantile(x, probs)))
        assert {v["x"]: v["r"] for v in ranks if v["g"] == g and v["x"] is not None} == {v: (x < v).sum() + ((x == v).sum() + 1) / 2 for v in x}
    down = ordering.running_sums(ordering.counted(d, "x", ["g"]).select("g", "x", "n"), "x", ["n"], ["g"], down=True)
    assert all(v["upto_n"] == sum(k == v["g"] and x is not None and x >= v["x"] for k, x in rows) for v in down.where("g <> 'b'").collect())


def test_sparse_sums_equal_sums_of_cells(study):
    people, gt, _, _ = study
    sited = people.withColumn("site", F.col("sample_id") % 3)
    for by in ([], ["site"]):
        for flipped in (False, True):
            g = gt.withColumn("flipped", F.col("variant_id") == 2).withColumn("dosage", F.when(F.col("flipped"), 2 - F.col("dosage")).otherwise(F.col("dosage"))) if flipped else gt
            key = lambda df: {(r["variant_id"], *(r[k] for k in by)): (r["n"], pytest.approx(r["beta"]), pytest.approx(r["se"])) for r in df.collect()}
            assert key(gwas.gwas_linear_sparse(g, sited, by)) == key(gwas.gwas_linear(C.genotype_cells(g, sited, by), ["variant_id", *by]))
    b = dp.budget_table(people.sparkSession.createDataFrame([(1.0, 1e-6, 2)], "eps_total double, delta_total double, top_k int"))
    pick = lambda d: sorted((r["variant_id"], round(r["utility"], 6), r["rank"]) for r in d.collect())
    assert pick(dp.dp_topk_sparse(gt, people, b, 50.0, 1)) == pick(dp.dp_topk(C.genotype_cells(gt, people), b, 50.0, 1))


def test_private_fits_equal_numpy_at_every_scale(study):
    """Noise is a function of seed and variant, so the same noisy sums solved one by one must give the same fits."""
    people, gt, rows, _ = study
    cells, moments = C.genotype_cells(gt, people), qc.variant_stats(gt, len(rows))
    m, sd = people.agg(F.avg("age"), F.stddev_samp("age")).first()
    sums = dp.dp_ols_sums(cells, moments, m, sd)
    for eps in (0.01, 1.0, 1e9):
        b = dp.budget_table(people.sparkSession.createDataFrame([(eps, 1e-6, 3)], "eps_total double, delta_total double, top_k int"))
        scale = {k: F.lit(1.0) * v for k, v in dp.noise_scales(3.0, 50.0).items()}
        names = [c for c in sums.columns if c == "yy" or c[:2] in ("t_", "s_")]
        noisy = sums.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k")
        draw = lambda c, i: K.uniform(1, f"ols-{c}-{i}", F.col("variant_id"))
        noisy = {r["variant_id"]: r for r in noisy.select("variant_id", "n", *((F.col(c) + K.gaussian(draw(c, 0), draw(c, 1), scale["yy" if c == "yy" else c[0]])).alias(c) for c in names)).collect()}
        for r in dp.dp_ols(sums, b, 1, ridge=10.0, y_clip=50.0).collect():
            v = noisy[r["variant_id"]]
            k = np.array([[v[f"s_{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)]) + 10 * np.eye(4)
            low = np.linalg.eigvalsh(k)[0]
            lift = next((x for x in 10.0 ** np.arange(-6, 2) if low + x > 0), None)
            if lift is None:
                w, u = np.linalg.eigh(k)
                k = u @ np.diag(np.maximum(w, 1e-8)) @ u.T
            else:
                k = k + lift * np.eye(4)
            t = np.array([v[f"t_{i}"] for i in range(4)])
            beta = np.linalg.solve(k, t)
            assert r["beta"] == pytest.approx(beta[1], rel=1e-3, abs=1e-9)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and SMALL


def test_scan_plan_has_partial_aggregation_and_broadcast(study):
    people, gt = (store(d, "plan-test") for d in study[:2])  # tables whose size is known
    plan = gwas.gwas_linear(C.genotype_cells(gt, people))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "partial_sum" in plan and "CartesianProduct" not in plan


def test_studies_hold_both_traits(spark, study, tmp_path):
    from helixmill.jobs import studies

    people, gt, rows, g = study
    variants = spark.createDataFrame([(v, f"rs{v}", 22, v) for v in g], "variant_id long, rsid string, chr int, bp long")
    cells, moments = C.genotype_cells(gt, people).persist(), qc.variant_stats(gt, len(rows))
    base = studies.long_results(studies.baseline_gwas(cells, variants)).persist()
    beta = {(r["trait"], r["rsid"]): r["beta"] for r in base.collect()}
    m, sd = people.agg(F.avg("age"), F.stddev_samp("age")).first()
    sums = {t: dp.dp_ols_sums(cells, moments, m, sd, **how) for t, how in (("BMI", {}), ("T2D", {"y": "cases", "yy": "cases"}))}
    sweep = studies.epsilon_sweep(cells, sums, base, variants, (1.0, 1e9), 3, 1, line=0.5).collect()
    assert sorted((r["eps_total"], r["trait"], r["k"]) for r in sweep) == [(e, t, 3) for e in (1.0, 1e9) for t in ("BMI", "T2D")]
    k = {r["trait"]: r for r in studies.k_sweep(gt, people, (2,), base, variants, line=1.0).collect()}
    fed = federated.federated_gwas(C.genotype_cells(gt, federated.assign_sites(people, 2, 1), ["site"]), "binary")
    auc = federated.federated_auc(federated.federated_scores(fed, gt, federated.assign_sites(people, 2, 1), line=1.0)).first()["auc"]
    assert sorted(k) == ["BMI", "T2D"] and k["T2D"]["auc"] == pytest.approx(auc) and k["T2D"]["r2"] is None and k["BMI"]["r2"] is not None
    path = str(tmp_path / "runs")
    studies.run_to_run(gt, people, variants, variants, (1,), moments, path)
    files = {f for f in (tmp_path / "runs").rglob("*.parquet")}
    runs = studies.run_to_run(gt, people, variants, variants, (1, 2), moments, path).collect()
    assert files <= set((tmp_path / "runs").rglob("*.parquet"))  # stored runs stay as they are
    assert sorted((r["method"], r["run"], r["trait"], r["rsid"]) for r in runs) == sorted((x, n, t, f"rs{v}") for x, ns in (("BASE", [0]), ("DP", [1, 2]), ("FED", [1, 2])) for n in ns for t in ("BMI", "T2D") for v in g)
    assert all(r["beta"] == pytest.approx(beta[r["trait"], r["rsid"]]) for r in runs if r["method"] == "BASE")
