"""How work grows: linear readers, map-only kernels, files and shuffles that plans leave out, bounded top-k."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import ordering
from helixmill.functions.stored import fresh_path
from helixmill.operators import cells as C
from helixmill.operators import gwas, packed, pgs, qc, roc
from helixmill.sources import landing, readers, writers
from tests.conftest import SMALL
from tests.test_operators import study  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def gen_file(spark, samples, lines=4):
    r = random.Random(samples)
    path = fresh_path(spark, "gen")
    triplets = ("1 0 0", "0 0.95 0.05", "0 0.1 0.9", "0.4 0.3 0.3")
    made = [f"s{i} rs{i} {i} A C " + " ".join(r.choices(triplets, k=samples)) for i in range(lines)]
    spark.createDataFrame([(x,) for x in made], "value string").coalesce(1).write.text(path)
    return path


def test_gen_lines_take_time_in_proportion_to_samples(spark):
    def took(samples):
        path = gen_file(spark, samples)
        best = []
        for _ in range(3):
            began = time.time()
            assert readers.read_gen(spark, path).select(F.sum(F.size("dosages"))).first()[0] == 4 * samples
            best.append(time.time() - began)
        return min(best)

    took(1_000)
    assert took(40_000) <= 2.5 * max(took(20_000), 0.2)


def test_gen_calls(spark):
    path = fresh_path(spark, "gen")
    rows = [("a rs1 5 A C 1 0 0  0.05 0.95 0\t0 0 1 0.4 0.3 0.3 0.7",), ("  b rs2 6 G T ",), ("",)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(path)
    got = {r["rsid"]: (r["snp_id"], r["bp"], r["ref"], r["alt"], r["dosages"]) for r in readers.read_gen(spark, path).collect()}
    assert got == {"rs1": ("a", 5, "A", "C", [0, 1, 2, None]), "rs2": ("b", 6, "G", "T", [])}


def test_packed_genotypes_are_a_map(spark, study):  # noqa: F811
    people, genotypes, rows, _ = study
    samples = packed.sample_order(people)
    p = spark.createDataFrame(packed.pack_sparse(genotypes, samples, len(rows)).collect(), "variant_id long, n int, codes binary")
    s = packed.variant_stats(p)
    assert "Exchange" not in plan(s) and "Exchange" not in plan(packed.filter_maf_missing(p)) and "Exchange" not in plan(packed.genotype_cells(p, samples, people))
    key = lambda d: {r["variant_id"]: [r[c] if isinstance(r[c], (bool, int)) else pytest.approx(r[c]) for c in s.columns] for r in d.select(s.columns).collect()}
    assert key(s) == key(qc.variant_stats(genotypes, len(rows)))
    cell = lambda d: {tuple(r)[:4]: [pytest.approx(x) for x in tuple(r)[4:]] for r in d.select("variant_id", "dosage", "age", "sex", *C.SUMS).collect()}
    assert cell(packed.genotype_cells(p, samples, people)) == cell(C.genotype_cells(genotypes, people))
    w = spark.createDataFrame([(1, "a", 0.5), (2, "a", -1.0), (3, "b", 2.0), (3, "c", float("nan")), (9, "d", 1.0)], "variant_id long, trait string, weight double")
    score = lambda d: {(r["sample_id"], r["trait"]): pytest.approx(r["score"]) for r in d.collect()}
    assert score(packed.pgs_score(p, w, samples)) == score(pgs.pgs_score(genotypes, w, people))


def test_arrays_of_dosages_are_packed_and_unpacked(spark):
    r = np.random.default_rng(2)
    rows = [(i, [None if x == 3 else int(x) for x in r.integers(0, 4, n)]) for i, n in enumerate((0, 1, 3, 4, 9, 4097, 4097))]
    d = packed.pack(spark.createDataFrame(rows, "variant_id long, dosages array<tinyint>"))
    for x in d.collect():
        back = packed.unpacked([bytes(x["codes"])], x["n"])[0] if x["n"] else []
        assert [None if v == packed.MISSING else int(v) for v in back] == rows[x["variant_id"]][1]
    got = {x["variant_id"]: x for x in packed.variant_stats(d).collect()}
    for i, row in rows:
        known = [v for v in row if v is not None]
        assert got[i]["n_called"] == len(known) and got[i]["polymorphic"] == (len(set(known)) > 1)
        assert got[i]["mean"] == (pytest.approx(np.mean(known)) if known else None)


def files_read(df):
    """Files that are left once folders are ruled out."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().totalNumberOfFiles()


def test_regions_read_few_files(spark):
    r = random.Random(8)
    rows = [(i, str(r.choice((1, 2, "X"))), r.randrange(2_000_000)) for i in range(3000)]
    path = fresh_path(spark, "variants")
    landing.land_by_region(spark.createDataFrame(rows, "variant_id long, chr string, bp int"), path, width=100_000)
    part = landing.read_region(spark, path, "2", 150_000, 260_000)
    assert {x["variant_id"] for x in part.collect()} == {i for i, c, b in rows if c == "2" and 150_000 <= b <= 260_000}
    assert 0 < files_read(part) <= files_read(spark.read.parquet(path)) / 10
    assert landing.read_region(spark, path, "7", 0, 10).count() == 0


def test_bucketed_tables_join_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paths = [fresh_path(spark, n) for n in ("left", "right")]
        a, b = (landing.land_bucketed(spark.range(n).select(F.col("id").alias("variant_id"), F.lit(n).alias(f"v{n}")), p.rsplit("/", 1)[1].replace("-", "_"), p, buckets=4) for n, p in zip((500, 300), paths))
        both = a.join(b, "variant_id")
        assert "Exchange" not in plan(both) and both.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("k", [1, 7, 2500])
def test_top_k_by_group(spark, k):
    r = random.Random(k)
    rows = [(i, r.choice(["a", "b", None]), float(r.randrange(1000)), r.choice([k, k]), f"x{i}") for i in range(9000)]
    d = spark.createDataFrame(rows, "id long, g string, v double, k int, more string").repartition(6)
    got = ordering.top_k(d, "k", [("v", True), ("id", False)], ["g"])
    assert "Window" not in plan(got)
    want = set()
    for g in ("a", "b", None):
        best = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0]))[:k]
        want |= {(g, n + 1, x[0], x[4]) for n, x in enumerate(best)}
    assert {(x["g"], x["rank"], x["id"], x["more"]) for x in got.collect()} == want
    alone = ordering.top_k(d.drop("k"), k, [("v", False), ("id", False)])
    assert [x["id"] for x in alone.orderBy("rank").collect()] == [x[0] for x in sorted(rows, key=lambda x: (x[2], x[0]))[:k]]
    assert ordering.top_k(d.where("false"), "k", [("v", True)], ["g"]).count() == 0


@pytest.fixture
def many_scores(spark):
    """Scores of 30,000 people, all distinct but for some ties, in two groups; one fpr in three is shared by many."""
    r = np.random.default_rng(5)
    y = r.random(30_000) < 0.3
    score = np.round(r.normal(0, 1, len(y)) + y, 6)
    rows = [(int(i % 2), float(s), int(c)) for i, (s, c) in enumerate(zip(score, y))]
    return spark.createDataFrame(rows, "g int, score double, y_bin int"), rows


def test_ranges_are_about_as_large_as_asked_for(spark, many_scores):
    d, rows = many_scores
    p = ordering.ranged(d.select("score"), [F.col("score")], rows=2_000)
    sizes = [x["count"] for x in p.groupBy("_part").count().collect()]
    assert max(sizes) <= 4_000 and len(sizes) >= len(rows) / 4_000
    ends = sorted(tuple(x) for x in p.groupBy("_part").agg(F.min("score"), F.max("score")).collect())
    assert all(a[2] < b[1] or a[2] == b[1] for a, b in zip(ends, ends[1:]))


def test_areas_over_many_points_are_carried_between_ranges(spark, many_scores, monkeypatch):
    d, rows = many_scores
    monkeypatch.setattr(ordering, "ROWS_A_RANGE", 3_000)
    points = roc.roc_exact(d, ["g"]).drop("score")
    area = {x["g"]: x["auc"] for x in roc.auc_trapezoid(points, ["g"]).collect()}
    ranks = {x["g"]: x["auc"] for x in roc.auc_rank(d, ["g"]).collect()}
    assert area == {g: pytest.approx(a, abs=1e-9) for g, a in ranks.items()} and all(0.6 < a < 0.9 for a in area.values())
    alone = roc.auc_trapezoid(points.where("g = 0").drop("g")).first()["auc"]
    assert alone == pytest.approx(ranks[0], abs=1e-9)
    assert roc.auc_trapezoid(points.limit(1).drop("g")).first()["auc"] is None


def test_running_maximum_by_ranges(spark, monkeypatch):
    r = random.Random(6)
    rows = [(g, round(r.random(), 2), r.random() * 1.1) for g in ("a", "b") for _ in range(3000)]
    monkeypatch.setattr(ordering, "ROWS_A_RANGE", 20)
    got = sorted(tuple(x) for x in roc.monotone_roc(spark.createDataFrame(rows, "g string, fpr double, tpr double"), ["g"]).collect())
    want = []
    for g in ("a", "b"):
        top = 0.0
        for _, f, t in sorted(x for x in rows if x[0] == g):
            top = max(top, t)
            want.append((g, f, min(1.0, top)))
    assert got == sorted(want)


def test_one_p_value_for_all_is_no_hot_spot(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_A_RANGE", 500)
    rows = [(f"rs{i:06d}", 1e-300 if i % 3 else 0.5, "x" if i % 5 else None) for i in range(8000)]
    d = spark.createDataFrame(rows, "rsid string, p double, trait string").repartition(5).where("trait is not null")
    got = {x["rsid"]: x["rank"] for x in gwas.qq_points(d, ["trait"]).collect()}
    some = sorted((max(p, 2.220446e-16), s) for s, p, t in rows if t)
    assert got == {s: n + 1 for n, (_, s) in enumerate(some)}
    parts = ordering.ranged(d, [F.col("p"), F.col("rsid")], ["trait"], rows=500).groupBy("_part").count()
    assert parts.agg(F.max("count")).first()[0] <= 1000


def test_a_run_that_broke_off_is_made_again(spark):
    path = fresh_path(spark, "runs")
    made = []

    def build(missing):
        keys = sorted(x["k"] for x in missing.collect())
        made.append(keys)
        return spark.createDataFrame([(k, i) for k in keys for i in range(3)], "k int, v int")

    wanted = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    spark.createDataFrame([(1, 7)], "k int, v int").write.partitionBy("k").parquet(f"{path}/batch-broken")  # written, but never recorded
    read = lambda *ks: sorted(tuple(x) for x in writers.write_or_reuse(spark, path, wanted(*ks), ["k"], build).select("k", "v").collect())
    assert read(1, 2) == [(k, v) for k in (1, 2) for v in range(3)] and read(1, 2, 3) == [(k, v) for k in (1, 2, 3) for v in range(3)]
    assert made == [[1, 2], [3]]
    # the files of a key are lost: its record counts for nothing
    batch = next(r["batch"] for r in spark.read.parquet(f"{path}/commits").collect() if r["k"] == 2)
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{batch}/k=2")
    gone.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(gone, True)
    assert read(1, 2, 3) == [(k, v) for k in (1, 2, 3) for v in range(3)] and made[-1] == [2]


def test_control_and_fit_from_one_reduction(spark, study):  # noqa: F811
    people, genotypes, _, _ = study
    sums = gwas.sparse_linear_sums(genotypes, people)
    for maf, missing in ((0.01, 0.05), (0.05, 0.05), (0.3, 1.0), (0.0, 0.01)):
        kept = {x["variant_id"] for x in qc.filter_maf_missing(genotypes, qc.variant_stats(genotypes, people.count()), maf, missing).select("variant_id").distinct().collect()}
        assert {x["variant_id"] for x in gwas.passing_sums(sums, maf, missing).collect()} == kept
    lines = plan(gwas.linear_fit(gwas.passing_sums(sums))).count("Scan ExistingRDD")
    assert lines == plan(gwas.linear_fit(sums)).count("Scan ExistingRDD")


def test_vcf_calls_are_read_from_bytes(spark, tmp_path):
    """A line of many samples is read piece by piece, and people whose numbers have gaps keep their places."""
    from helixmill import queries_sources  # noqa: F401
    from helixmill.queries import QUERIES
    from helixmill.views import view

    r = random.Random(1)
    calls = [r.choice(["0|0", "0/1", "1|1:9", "./.", "1", "", "1|2", "0|1:0/1:x", "1/1/1", "0|", "|", ":", "10", "1|1|0|1"]) for _ in range(3000)]
    want = [c.split(":")[0].count("1") if re.fullmatch("[01]([/|][01])*", c.split(":")[0]) else None for c in calls]
    line = "\t".join(["c"] * 9 + calls).encode()
    for most in (1, 50, 1 << 20):
        assert [x for part in readers._fields(line, 9, most) for x in readers._alt_counts(part).to_pylist()] == want
    assert list(readers._fields(b"1\t2", 9)) == []
    for name in ("customer", "orders", "lineitem", "part"):
        d = spark.read.parquet(f"{SMALL}/{name}.parquet")
        key = {"customer": "c_custkey", "orders": "o_custkey"}.get(name)
        (d.withColumn(key, F.col(key) * 1000 + 7) if key else d).write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["s03_read_vcf"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no line is split into one object a call
    expected = view(spark, str(tmp_path), "genotypes").select(F.concat(F.lit("rs"), "variant_id").alias("rsid"), F.col("sample_id").cast("string"), "dosage")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_people_are_broadcast_by_their_number(spark):
    """A stored table of a row a person takes a few bytes of file each, and no hint sends hundreds of thousands to the driver."""
    from helixmill.functions.stored import store
    from helixmill.operators import dp

    people = lambda n: store(spark.range(n).selectExpr("id as sample_id", "40 as age", "1 as sex", "1 as site", "0 as y_bin", "1.0d as y_quant"), "people")
    g = spark.createDataFrame([(1, 5, 2)], "variant_id long, sample_id long, dosage int")
    for n, hinted in ((500_001, False), (1000, True)):
        p = people(n)
        for d in (C.genotype_cells(g, p), C.genotype_cells(g, p, ["site"]), gwas.sparse_linear_sums(g, p, ["site"]), dp.utilities_sparse(g, p, 50.0)):
            joins = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner, (sample_id" in x]
            assert joins and all(("strategy=broadcast" in x) == hinted for x in joins)


@pytest.mark.parametrize("name", ["m02_all_scores", "m03_fitted_pairs"])
def test_scores_of_more_people_than_are_sent(name, agree, monkeypatch):
    """Where people are too many for a broadcast, joins that shuffle give what the SQL gives."""
    from helixmill import queries, queries_studies  # noqa: F401

    for module in (C, gwas):
        monkeypatch.setattr(module, "broadcast_if_few", lambda df: df.hint("merge"))
    agree(queries.QUERIES[name], queries.ORACLES[name])
