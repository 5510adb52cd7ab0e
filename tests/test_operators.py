"""Operators against known answers and plain Python."""

import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import markdown
from helixframe.functions import variants as V
from helixframe.operators import bootstrap, cohort, joins, metrics, models, panels, results, splits, studies
from helixframe.sources import tables
from helixframe.streaming import scores as streaming


def one(df):
    return df.collect()[0].asDict()


def brute_auroc(pairs):
    pos, neg = [s for y, s in pairs if y == 1], [s for y, s in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def scored(spark, n=300, seed=1, levels=20):
    r = random.Random(seed)
    rows = [(i, r.choice("ab"), int(r.random() < 0.4), None if r.random() < 0.1 else r.randrange(levels) / levels) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, y int, s double")


def test_auroc_and_auprc_against_definitions(spark):
    rows, df = scored(spark)
    used = [(y, s) for _, _, y, s in rows if s is not None]
    assert math.isclose(one(metrics.auroc(df, "y", "s"))["estimate"], brute_auroc(used))
    for g in "ab":
        got = metrics.auroc(df, "y", "s", ["g"]).where(F.col("g") == g)
        assert math.isclose(one(got)["estimate"], brute_auroc([(y, s) for _, k, y, s in rows if s is not None and k == g]))
    total, best, seen = sum(y for y, _ in used), 0.0, 0
    for t in sorted({s for _, s in used}, reverse=True):
        tp, k = sum(y for y, s in used if s >= t), sum(s >= t for _, s in used)
        best += (tp - seen) / total * tp / k
        seen = tp
    assert math.isclose(one(metrics.auprc(df, "y", "s"))["estimate"], best)


def test_perfect_separation_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert one(metrics.auroc(df, "y", "s"))["estimate"] == 1.0
    assert one(metrics.auroc(df.where("y = 1"), "y", "s"))["estimate"] is None
    assert metrics.auroc(df.where("y = 7"), "y", "s").collect()[0]["estimate"] is None


def test_spearman_has_mean_ranks_of_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "y double, p double")
    want = np.corrcoef([1.5, 1.5, 3, 4], [2, 1, 3.5, 3.5])[0, 1]
    assert math.isclose(one(metrics.spearman(df, "y", "p"))["estimate"], want)


def test_small_pearson_is_zero(spark):
    assert one(metrics.pearson(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "y double, p double"), "y", "p"))["estimate"] == 0


def test_coverage_counts_missing(spark):
    df = spark.createDataFrame([(1, 0.1), (0, None), (1, 0.3), (0, 0.2), (1, None), (0, 0.9)], "y int, s double")
    got = one(metrics.coverage(df, "y", "s"))
    assert (got["total"], got["scored"]) == (6, 4) and math.isclose(got["coverage"], 4 / 6)


def test_calibration_line_recovers_a_logistic_curve(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, 1 / (1 + np.exp(-x)))], "y int, p double")
    slope, intercept = metrics.calibration_line(df, "y", "p")
    assert abs(slope - 2) < 0.25 and abs(intercept - 0.5) < 0.15


def test_bootstrap_covers_and_agrees_with_resampling(spark):
    rows, df = scored(spark, 400, levels=400)
    got = one(bootstrap.auroc_interval(df, "id", "y", "s", replicates=300))
    used = np.array([(y, s) for _, _, y, s in rows if s is not None])
    r, values = np.random.default_rng(0), []
    for _ in range(200):
        values.append(brute_auroc([tuple(x) for x in used[r.integers(0, len(used), len(used))]]))
    lo, hi = np.percentile(values, [2.5, 97.5])
    assert got["ci_lower"] < got["estimate"] < got["ci_upper"]
    assert abs(got["ci_lower"] - lo) < 0.03 and abs(got["ci_upper"] - hi) < 0.03
    part = bootstrap.ratio_interval(df.where("s IS NOT NULL"), "id", F.col("s"), F.lit(1.0), ["g"], replicates=400).collect()
    for p in part:
        own = [s for _, g, _, s in rows if g == p["g"] and s is not None]
        half = 1.96 * np.std(own) / math.sqrt(len(own))
        assert math.isclose(p["estimate"], np.mean(own)) and abs((p["ci_upper"] - p["ci_lower"]) / 2 - half) < 0.35 * half


def test_bootstrap_ranks_exact_scores(spark):
    rows, df = scored(spark, 400, levels=40)
    plain = bootstrap.auroc_interval(df, "id", "y", "s", ["g"], replicates=60, cap=None)
    order = lambda got: sorted((r["g"], r["estimate"], r["ci_lower"], r["ci_upper"]) for r in got.collect())
    want = order(plain)
    for g, _, lo, hi in want:
        own = [(i, y, s) for i, k, y, s in rows if k == g and s is not None]
        ids = spark.createDataFrame([(x[0],) for x in own], df.select("id").schema).select(F.xxhash64("id")).collect()
        w = bootstrap.weights(np.array([r[0] for r in ids]), 60, 1.0, 42)
        values = [brute_auroc([(y, s) for (_, y, s), k in zip(own, w[:, b]) for _ in range(k)]) for b in range(60)]
        assert np.allclose([lo, hi], np.percentile(values, [2.5, 97.5]))
    # Ranks alone count: heavy tails, infinite scores and slots change nothing.
    tail = df.withColumn("s", F.when(F.col("s") == df.agg(F.max("s")).first()[0], F.lit(float("inf"))).otherwise(F.exp(F.col("s") * 100)))
    for got in (bootstrap.auroc_interval(tail, "id", "y", "s", ["g"], replicates=60, cap=None), bootstrap.auroc_interval(df, "id", "y", "s", ["g"], replicates=60, cap=None, slot_rows=3)):
        assert np.allclose([x[1:] for x in order(got)], [x[1:] for x in want])


def test_incremental_r2_from_two_predictions(spark):
    r = np.random.default_rng(4)
    y, full, base = (r.normal(size=50) for _ in range(3))
    rows = [("a", *map(float, x)) for x in zip(y, full, base)] + [("a", None, 1.0, 1.0), ("b", 2.0, 1.0, 3.0), ("b", 2.0, 0.0, 2.0)]
    got = {x["g"]: x for x in metrics.incremental_r2(spark.createDataFrame(rows, "g string, y double, f double, b double"), "y", "f", "b", ["g"]).collect()}
    want = (((y - base) ** 2).sum() - ((y - full) ** 2).sum()) / ((y - y.mean()) ** 2).sum()
    assert math.isclose(got["a"]["estimate"], want) and got["a"]["n"] == 50 and got["b"]["estimate"] == 0.0


def test_poisson_weights_have_their_mean_and_variance():
    w = bootstrap.weights(np.arange(2000), 50, 0.7, 3)
    assert abs(w.mean() - 0.7) < 0.02 and abs(w.var() - 0.7) < 0.03


def test_interval_boundaries(spark):
    points = spark.createDataFrame([("chr1", p) for p in (100, 101, 200, 201, 251, 16384, 16385)], "chrom string, pos long")
    bed = spark.createDataFrame([("chr1", 100, 200), ("chr1", 150, 160), ("chr1", 16383, 16385), ("chr1", 300, 300)], "chrom string, bed_start long, bed_end long")
    assert sorted(r["pos"] for r in joins.in_intervals(points, bed).collect()) == [101, 200, 16384, 16385]


def test_overlaps_count_once_across_bins(spark):
    svs = spark.createDataFrame([(1, "c", 0, 100_000), (2, "c", 10_000, 100_000), (3, "c", 99_999, 120_000)], "sv_id int, chrom string, sv_start long, sv_end long")
    pairs = joins.reciprocal_overlap(svs, svs).where("a_sv_id < b_sv_id").collect()
    assert [(p["a_sv_id"], p["b_sv_id"], p["share"]) for p in pairs] == [(1, 2, 0.9)]


def test_set_comparison(spark):
    k = lambda ps: spark.createDataFrame([("chr1", p, "A", "C") for p in ps], "chrom string, pos long, ref string, alt string")
    got = one(joins.compare_sets(k([1, 2, 3]), k([2, 3, 4, 4])))
    assert (got["tp"], got["fp"], got["fn"]) == (2, 1, 1) and math.isclose(got["f1"], 2 / 3)
    assert one(joins.compare_sets(k([1]).limit(0), k([1])))["precision"] == 0.0


def test_vcf_and_bed_lines(spark):
    lines = ["##x", "#CHROM\tPOS", "1\t10\trs1\tA\tC,*\t.\tPASS\tSpliceAI=C|G|0.27|0.1||0.0|1|2|3|4\tDP:GT\t3:0/1", "chr2\t20\t.\tAT\tA,.\t.\tq10\t.\tGT\t./1", "3\t30\t.\tG\tT\t.\t.\t.", "short\t1", "4\tx\t.\tA\tC\t.\tPASS"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted((r["chrom"], r["pos"], r["alt"]) for r in tables.vcf_variants(df).collect()) == [("chr1", 10, "C"), ("chr3", 30, "T")]
    assert tables.vcf_variants(df, pass_only=False).count() == 3
    assert [(r["chrom"], r["alleles"]) for r in tables.vcf_genotypes(df).collect()] == [("1", ["A", "C"])]
    rec = tables.vcf_records(df).where("pos = 10").select(V.splice_score(F.col("info")).alias("s"))
    assert one(rec)["s"] == 0.27
    bed = spark.createDataFrame([("track x",), ("#c",), ("1\t5\t9",), ("chr2 1 2 n",), ("1\t5",)], "value string")
    assert sorted(map(tuple, tables.bed_intervals(bed).collect())) == [("chr1", 5, 9), ("chr2", 1, 2)]


@pytest.mark.parametrize("value, want", [(None, "not_found"), (0.1, "low"), (0.27, "moderate"), (0.62, "high")])
def test_splice_classes(spark, value, want):
    assert one(spark.createDataFrame([(value,)], "s double").select(V.splice_impact(F.col("s")).alias("c")))["c"] == want


def test_expressions(spark):
    df = spark.range(1)
    text = lambda c: one(df.select(c.alias("x")))["x"]
    assert text(V.protein_change(F.lit("A/B"), F.lit("10-12"))) == "A10B" and text(V.protein_change(F.lit("A"), F.lit("10"))) is None
    assert text(V.mutation_parts(F.lit("A12T"))).asDict() == {"wild": "A", "position": 12, "mutant": "T"}
    assert text(V.parsed_date(F.lit("Jan 05, 2020"))) == date(2020, 1, 5) and text(V.parsed_date(F.lit("soon"))) is None
    assert text(V.shifted_position(F.lit(100))) == 1_848_083
    assert text(V.is_interesting(F.lit("likely benign"))) is False and text(V.is_interesting(F.lit("pathogenicity"))) is True
    assert text(V.trait_category(F.lit("Type 2 Diabetes"))) == "health" and text(V.trait_category(F.lit("LDL cholesterol"))) == "biomarker"
    assert text(V.valid_phenotype_term(F.lit("HP:0001250"))) is True and text(V.valid_phenotype_term(F.lit("HP:12"))) is False
    assert text(V.task_id(F.lit("a"), F.lit("default"))) == "a" and text(V.task_id(F.lit("a"), F.lit("b"))) == "a/b"
    assert text(V.component_count(F.lit(20), F.lit(55))) == 5


def test_splits(spark):
    df = spark.createDataFrame([(i, datetime(2022, 1, 1 + i % 28), f"chr{i % 22 + 1}") for i in range(60)] + [(99, None, "8")], "id int, d timestamp, chrom string")
    t = splits.temporal(df, "d", datetime(2022, 1, 14))
    assert t.where("split IS NULL").count() == 1 and one(splits.check_temporal(t, "d", datetime(2022, 1, 14)))["passed"]
    moved = t.withColumn("split", F.lit("train"))
    assert not one(splits.check_temporal(moved, "d", datetime(2022, 1, 14)))["passed"]
    with pytest.raises(ValueError, match="empty"):
        splits.ensure_test(moved)
    with pytest.raises(ValueError, match="temporal"):
        splits.verify([splits.check_temporal(moved, "d", datetime(2022, 1, 14))])
    c = splits.by_chromosome(df)
    assert {r["chrom"] for r in c.where("split = 'test'").collect()} == {"chr8", "chr21", "8"}
    with pytest.raises(ValueError, match="sum to 1"):
        splits.individuals(df, "id", "chrom", (0.5, 0.1, 0.1))


def test_repair_leaves_no_pair_between_moved_and_train(spark):
    people = spark.createDataFrame([(1, "train"), (2, "test"), (3, "val"), (4, "val"), (5, "test")], "id int, split string")
    kin = spark.createDataFrame([(1, 2, 0.2), (3, 2, 0.2), (4, 5, 0.01)], "id_a int, id_b int, kinship double")
    got = {r["id"]: r["split"] for r in splits.repair_related(people, "id", kin).collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "val", 5: "test"}


def test_quotas_add_up(spark):
    for n in (1, 7, 10, 33):
        g = spark.createDataFrame([("a", 5), ("b", 5), ("c", 31), ("d", 1)], "g string, n long")
        rows = splits.stratified_quotas(g, "g", n).collect()
        assert sum(r["quota"] for r in rows) == n and all(0 <= r["quota"] <= r["n"] for r in rows)


def test_store_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([(1, "clinvar/all", "m", datetime(2024, 1, 1), "temporal", {"auroc": (0.9, 0.8, 1.0, 5)}, {"all": 5}, None, {"tier": "1"})], tables.RUN_SCHEMA)
    tables.append_runs(runs, str(tmp_path / "runs"))
    tables.append_runs(runs.withColumn("model_name", F.lit("k")), str(tmp_path / "runs"))
    got = tables.read_runs(spark, str(tmp_path / "runs"), "clinvar", "m")
    assert one(got.select(results.flat_metrics(F.col("metrics")).alias("f")))["f"] == {"auroc": 0.9}


def test_readers(spark, tmp_path):
    (tmp_path / "assays").mkdir()
    (tmp_path / "assays" / "a1.csv").write_text("mutant,DMS_score\nA1T,0.5\nA2T,bad\n")
    got = tables.read_assays(spark, str(tmp_path / "assays")).collect()
    assert [(r["assay_id"], r["mutant"], r["dms_score"]) for r in got] == [("a1", "A1T", 0.5)]
    (tmp_path / "m.tsv").write_text("probe\ts1\ts2\ncg1\t0.1\t\n")
    assert sorted((r["sample"], r["beta"]) for r in tables.read_matrix(spark, str(tmp_path / "m.tsv")).collect()) == [("s1", 0.1), ("s2", None)]
    (tmp_path / "c.json").write_text('{"chr1:5": [{"trait": "t", "pvalue": 0.1}, {"trait": "u"}]}')
    assert tables.read_catalog(spark, str(tmp_path / "c.json"), "place").count() == 2
    (tmp_path / "s.sscore").write_text("#IID\tSCORE1_AVG\nx\t0.25\n")
    assert one(tables.read_sscore(spark, str(tmp_path / "s.sscore"))) == {"IID": "x", "SCORE1_AVG": 0.25, "SCORE1_SUM": None, "ALLELE_CT": None}
    wanted = spark.createDataFrame([("m.tsv",), ("none",)], "file_name string")
    states = {r["file_name"]: r["state"] for r in tables.fingerprints(spark, str(tmp_path), wanted).collect()}
    assert states == {"m.tsv": "present", "none": "missing"}
    with pytest.raises(ValueError, match="score"):
        tables.named_columns(wanted, {"score": ("score",)})


def test_models(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + r.normal(size=200) * 0.1
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double")
    fit = models.ridge(df, "y", ["a", "b", "c"], 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(fit.coefficients.toArray(), want, atol=1e-6)
    net = models.elastic_net(df, "y", ["a", "b", "c"], 0.1, 0.5).coefficients.toArray()
    slope = -xc.T @ (yc - xc @ net) / 200 + 0.05 * net
    assert np.allclose(slope, -0.05 * np.sign(net), atol=2e-3)  # where the penalised error is least
    assert models.incremental_r2(df, "y", "b", ["a", "c"]) > 0.5
    got = models.with_predictions(df, lambda f: f["a"] + f["b"], ["a", "b"]).select(F.max(F.abs(F.col("prediction") - F.col("a") - F.col("b"))).alias("d"))
    assert one(got)["d"] < 1e-12
    assert abs(one(models.residuals(df, "y", ["a"]).agg(F.corr("residual", "a").alias("r")))["r"]) < 1e-9
    assert len(one(models.principal_components(df, df.limit(1), ["a", "b", "c"], 2))["pc"]) == 2


def test_spectrum_folds_strands(spark):
    df = spark.createDataFrame([("s", "C", "T", "ACG"), ("s", "G", "A", "CGT"), ("s", "C", "C", "ACG")], "sample string, ref string, alt string, context string")
    assert [(r["channel"], r["n"]) for r in cohort.mutation_spectrum(df, "sample").collect()] == [("A[C>T]G", 2)]


def test_stream_scores_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text("#h\n1\t10\t.\tA\tC\t.\tPASS\t.\n1\t11\t.\tA\tC\t.\tPASS\t.\n")
    table = spark.createDataFrame([("chr1", 10, "A", "C", 0.9)], "chrom string, pos long, ref string, alt string, score double")
    q = streaming.write_annotated(streaming.annotate_stream(spark, str(tmp_path / "in"), table), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r["pos"]: r["class"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {10: "likely_pathogenic", 11: "not_found"}


def test_reports(spark):
    from helixframe.functions import reports

    call = '{"geneSymbol": "CYP2D6", "recommendationDiplotypes": [{"label": "*1/*4", "activityScore": 0.5}, {"label": "x"}], "phenotypes": {"term": "IM"}}'
    pgx = spark.createDataFrame(
        [
            (1, '{"calls": [], "reportContext": {"geneReports": [' + call + ', {"phenotype": "nameless"}]}, "geneCalls": [{"gene": "no"}]}'),
            (2, "no json"),
            (3, '{"geneCalls": [{"gene": "G", "recommendationDiplotypes": [], "diplotype": "*2/*2"}, {"gene": "H"}], "drugReports": [{"drugName": "d", "source": "s", "prescribingInfo": "' + "y" * 600 + '"}, {"source": "nameless"}]}'),
            (4, '{"drugs": [{"drug": "e", "classification": "strong", "recommendation": "less"}], "drugReports": [{"drug": "no"}]}'),
        ],
        "id int, report string",
    )
    assert sorted(map(tuple, reports.diplotype_calls(pgx, ("$.calls", "$.reportContext.geneReports", "$.geneCalls")).collect())) == [(1, "CYP2D6", "*1/*4", "0.5", "IM"), (3, "G", "*2/*2", None, ""), (3, "H", "", None, "")]
    assert sorted(map(tuple, reports.drug_recommendations(pgx).collect())) == [(3, "d", "s", "", "y" * 500), (4, "e", "", "strong", "less")]
    star = spark.createDataFrame([(1, '{"s1": {"Genotype": "*1/*2", "Filter": null}, "s2": {}}'), (2, "{}"), (3, '{"s": {"Diplotype": "*4/*4", "Activity_Score": 0, "Phenotype": "PM", "Filter": "More"}}')], "id int, report string")
    assert [tuple(r) for r in reports.star_alleles(star).orderBy("id").collect()] == [(1, "s1", "No call", "*1/*2", None, "", "PASS"), (3, "s", "*4/*4", "", "0", "PM", "More")]
    lines = spark.createDataFrame([(1, "Tumor Fraction:\t0.25"), (1, "Ploidy\t2.1\textra"), (2, "Tumor Fraction\tnan?"), (2, "Ploidy\t?"), (3, "nothing")], "id int, value string")
    assert sorted(map(tuple, reports.tumour_fractions(lines, "id").collect())) == [(1, 0.25, 2.1, False), (2, None, None, True)]
    typed = spark.createDataFrame([("x", 1, "A", "1", "2"), ("x", 2, "A", "3", "4"), ("x", 3, "B", "5", "6")], "id string, n int, locus string, allele_1 string, allele_2 string")
    assert one(reports.hla_types(typed, "id", "n")) == {"id": "x", "types": {"A": ["3", "4"], "B": ["5", "6"]}, "n_loci": 2}
    item = '{"variants": [{"molecular_profiles": [{"evidence_items": [{"status": "ACCEPTED", "level": "B"}, {"status": "accepted", "level": "A"}, {"status": "submitted", "level": "0"}]}]}, {}]}'
    found = spark.createDataFrame([(1, item), (2, '{"variants": [{}]}'), (3, '{"variants": []}'), (4, "")], "id int, report string")
    assert sorted(tuple(r) for r in reports.accepted_evidence(found).collect()) == [(1, "found", 2, "A"), (2, "no_accepted_evidence", 0, None), (3, "not_found", 0, None), (4, "not_found", 0, None)]


def test_assays_are_read_by_their_own_headers(spark, tmp_path):
    for name, text in {"a": "mutant,DMS_score\nA1T,0.5\n", "b": "DMS_score,mutant\n1.5,C2D\n-1,x\n", "c": "mutant,other\nG3H,9.9\n", "d": "mutant,note,DMS_score\nK4L,text,bad\nM5N,DMS_score,2\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = sorted(map(tuple, tables.read_assays(spark, str(tmp_path)).collect()))
    assert got == [("a", "A1T", 0.5), ("b", "C2D", 1.5), ("b", "x", -1.0), ("d", "M5N", 2.0)]
    for name in "abd":
        (tmp_path / f"{name}.csv").unlink()
    with pytest.raises(ValueError):
        tables.read_assays(spark, str(tmp_path))


def test_files_that_are_there(spark, tmp_path):
    import hashlib

    (tmp_path / "v2").mkdir()
    big = b"x" * 20_000 + b"end"
    (tmp_path / "v2" / "scores.tsv").write_bytes(big)
    assert tables.first_that_exists(spark, f"{tmp_path}/v1/*.tsv", f"{tmp_path}/v2/*.tsv", f"{tmp_path}/*") == f"{tmp_path}/v2/*.tsv"
    with pytest.raises(FileNotFoundError):
        tables.first_that_exists(spark, f"{tmp_path}/none*")
    wanted = spark.createDataFrame([("scores.tsv",), ("gone.tsv",)], "file_name string")
    rows = {r["file_name"]: r for r in tables.fingerprints(spark, str(tmp_path), wanted).collect()}
    assert rows["scores.tsv"]["digest"] == hashlib.sha256(big[:16384]).hexdigest()[:16] and rows["scores.tsv"]["size"] == len(big) and rows["gone.tsv"]["state"] == "missing"
    expected = spark.createDataFrame([("scores", "v2"), ("index", "v3")], "name string, part string")
    assert sorted((r["name"], r["n_files"], r["bytes"], r["available"]) for r in tables.availability(spark, str(tmp_path), expected).collect()) == [("index", 0, 0, False), ("scores", 1, len(big), True)]
    (tmp_path / "s" / "chrom=chr1").mkdir(parents=True)
    (tmp_path / "s" / "chrom=chr1" / "a.tsv").write_text("pos\tref\talt\tscore\n5\tA\tC\t0.7\n")
    found = joins.lookup(spark.createDataFrame([("chr1", 5, "A", "C"), ("chr2", 5, "A", "C")], "chrom string, pos long, ref string, alt string"), tables.read_partitioned_scores(spark, f"{tmp_path}/s"))
    assert sorted((r["chrom"], r["score"]) for r in found.collect()) == [("chr1", 0.7), ("chr2", None)]
    tables.write_report(expected, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2


def test_intervals_of_sums_agree_with_resampling(spark):
    r = np.random.default_rng(4)
    y = r.normal(size=400)
    p = y * 0.6 + r.normal(size=400) * 0.8
    df = spark.createDataFrame([(i, float(a), float(b), int(a > 0), int(b > 0), float(b - 0.3)) for i, (a, b) in enumerate(zip(y, p))], "id long, y double, p double, label int, called int, old double")
    draws = [r.integers(0, 400, 400) for _ in range(1500)]
    def spearman(i):
        rank = lambda x: np.argsort(np.argsort(x))
        return np.corrcoef(rank(y)[i], rank(p)[i])[0, 1]
    cases = {
        bootstrap.pearson_interval(df, "id", "y", "p"): lambda i: np.corrcoef(y[i], p[i])[0, 1],
        bootstrap.spearman_interval(df, "id", "y", "p"): spearman,
        bootstrap.r_squared_interval(df, "id", "y", "p"): lambda i: 1 - ((y[i] - p[i]) ** 2).mean() / y[i].var(),
        bootstrap.direction_interval(df, "id", "y", "p"): lambda i: (np.sign(y[i]) == np.sign(p[i])).mean(),
        bootstrap.balanced_accuracy_interval(df, "id", "label", "called"): lambda i: np.mean([((p[i] > 0) == k)[(y[i] > 0) == k].mean() for k in (0, 1)]),
        bootstrap.incremental_r2_interval(df, "id", "y", "p", "old"): lambda i: (((y[i] - p[i] + 0.3) ** 2).mean() - ((y[i] - p[i]) ** 2).mean()) / y[i].var(),
    }
    for got, of in cases.items():
        row = one(got)
        assert math.isclose(row["estimate"], of(np.arange(400)), abs_tol=1e-9)
        low, high = np.quantile([of(i) for i in draws], [0.025, 0.975])
        assert abs(row["ci_lower"] - low) < 0.25 * (high - low) and abs(row["ci_upper"] - high) < 0.25 * (high - low)


def test_impossible_ceilings_and_small_folds(spark):
    found = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "k string, estimate double")
    ceilings = spark.createDataFrame([("a", 0.0)], "k string, ceiling double")
    assert {r["k"]: r["normalised"] for r in metrics.ceiling_normalised(found, ceilings, ["k"], "zero").collect()} == {"a": 0.0, "b": None}
    with pytest.raises(Exception, match="must be positive"):
        metrics.ceiling_normalised(found, ceilings, ["k"], "error").collect()
    ids = spark.range(5).withColumnRenamed("id", "s")
    with pytest.raises(ValueError):
        splits.leave_n_out(ids, "s", 5)
    assert splits.leave_n_out(ids, "s", 4, 2).count() == 8
    with pytest.raises(ValueError):
        splits.ensure_any(ids.where("s > 9"))
    assert {r["split"] for r in splits.zero_shot(ids).collect()} == {"test"}


def test_signatures_are_recovered(spark):
    catalogue = spark.createDataFrame([("a", "x", 0.7), ("a", "y", 0.3), ("b", "y", 0.2), ("b", "z", 0.8)], "signature string, context string, share double")
    spectra = spark.createDataFrame([("s", "x", 70.0), ("s", "y", 30.0), ("s", "y", 10.0), ("s", "z", 40.0), ("s", "other", 9.0), ("t", "z", 8.0), ("t", "y", 2.0)], "sample string, context string, n double")
    got = {(r["sample"], r["signature"]): r["count"] for r in panels.fit_signatures(spectra, catalogue).collect()}
    for key, want in {("s", "a"): 100, ("s", "b"): 50, ("t", "a"): 0, ("t", "b"): 10}.items():
        assert got[key] == pytest.approx(want, abs=1e-3)


def test_curated_genotypes_by_id_then_place(spark):
    curated = spark.createDataFrame([("rs1", "chr1", 5, "effect", {"GA": "text"}), ("rs2", "chr2", 6, None, {})], "rsid string, chrom string, pos long, effect string, texts map<string,string>")
    rows = [("rs1", "chr9", 1, "AG"), (None, "chr1", 5, "AA"), (None, "chr2", 6, "CT"), ("rs9", "chr3", 7, "CC"), (None, None, None, None)]
    called = spark.createDataFrame(rows, "rsid string, chrom string, pos long, genotype string")
    assert sorted((r["genotype"], r["interpretation"]) for r in panels.interpret_genotypes(called, curated).collect()) == [("AA", "effect"), ("AG", "text"), ("CT", "Genotype: CT")]


def test_markdown_and_studies(spark):
    one = spark.createDataFrame([(1, None), (2, 0.5)], "n int, x double")
    lines = [r[0] for r in one.orderBy("n").select(markdown.table_row(F.col("n"), markdown.number(F.col("x"), 2))).collect()]
    assert lines == ["| 1 | — |", "| 2 | 0.50 |"]
    assert markdown.header("a", "b") == "| a | b |\n|---|---|"
    truth = spark.createDataFrame([(1, "g", "*1/*2", "im"), (2, "g", "*1/*1", "nm")], "s int, gene string, diplotype string, phenotype string")
    calls = spark.createDataFrame([(1, "*2/*1", "im")], "s int, diplotype string, phenotype string")
    got = studies.diplotype_accuracy(truth, calls, ["s"], ["gene"]).first()
    assert (got["exact"], got["phenotype_match"], got["n"]) == (0.5, 0.5, 2)
    treated = studies.medication_adjusted(one, "x", F.col("n") == 2, 15)
    assert sorted((r["n"], r["x"]) for r in treated.collect()) == [(1, None), (2, 15.5)]
