"""Seeded ranks, nested bins, exact quantiles and grouped calibration against plain versions, and their plans."""

import math
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import cohort, joins, metrics, splits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Seeded ranks


def test_ranks_by_digest(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None])) for i in range(3000)] + [(7, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "id long, g string")
    digest = F.md5(F.col("id").cast("string"))
    for most in (None, 40):
        got = sorted((str(x["g"]), x["__at"], x["id"], x["__n"]) for x in splits.ranked(df, ["g"], digest, ["id"], most).collect())
        want = []
        for g in ("a", "b", None):
            own = sorted((i for i, k in rows if k == g), key=lambda i: (md5(str(i).encode()).hexdigest(), i))
            want += [(str(g), at, i, len(own)) for at, i in enumerate(own[:most], 1)]
        assert got == sorted(want)
    assert splits.ranked(df.limit(0), [], digest, ["id"]).count() == 0
    assert sorted(x["__at"] for x in splits.ranked(df, [], digest, ["id"]).collect()) == list(range(1, len(rows) + 1))


def test_splits_are_those_of_whole_windows(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["EUR", "AFR", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, anc string")
    got = {x["id"]: x["split"] for x in splits.individuals(df, "id", "anc", (0.7, 0.2, 0.1), 5).collect()}
    for g in ("EUR", "AFR", None):
        own = sorted((i for i, k in rows if k == g), key=lambda i: md5(f"{i}:5".encode()).hexdigest())
        a, b = math.floor(len(own) * 0.7), math.floor(len(own) * 0.2)
        assert [got[i] for i in own] == ["train"] * a + ["val"] * b + ["test"] * (len(own) - a - b)
    out = splits.leave_n_out(df, "id", 9, 4, 5).collect()
    for k in range(4):
        assert {x["id"] for x in out if x["repeat"] == k} == set(sorted((i for i, _ in rows), key=lambda i: md5(f"{i}:{k}:5".encode()).hexdigest())[:9])
    controls = cohort.matched_controls(df.where("id < 20"), df.where("id >= 20"), ["anc"], "id", 3, 5).collect()
    for g in ("EUR", "AFR"):
        wanted = 3 * sum(k == g for i, k in rows if i < 20)
        own = sorted((i for i, k in rows if k == g and i >= 20), key=lambda i: md5(f"{i}:5".encode()).hexdigest())
        assert sorted(x["id"] for x in controls if x["anc"] == g) == sorted(own[:wanted])


def test_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame([(1, "a")], "id long, anc string")
    for made in (splits.individuals(df, "id", "anc"), splits.ranked(df, ["anc"], F.md5("anc"), ["id"])):
        windows = [x for x in plan(made).splitlines() if "Window [" in x]
        assert windows and all("__bin" in x for x in windows if "row_number" in x)


# Bins


def brute_inside(points, spans):
    return sorted(p for p in points if any(c == p[0] and s <= p[1] - 1 < e for c, s, e in spans if e > s))


def test_points_in_intervals_of_any_length(spark):
    r = random.Random(4)
    spans = [(r.choice("xy"), s, s + r.choice([1, 50, 16384, 16385, 200_000, 5_000_000, 0, -3])) for s in (r.randrange(10_000_000) for _ in range(200))]
    spans += [("z", 0, 248_956_422), ("w", 5, 40_000_000_000)]
    points = [(r.choice("xyzwq"), r.randrange(1, 20_000_000), i) for i in range(4000)] + [("w", 39_999_999_999, -1), ("w", 40_000_000_001, -2), ("x", 77, -3), ("x", 77, -3)]
    df = spark.createDataFrame([*points, (None, 5, 0), ("x", None, 0)], "chrom string, pos long, id int")
    bed = spark.createDataFrame([*spans, (None, 1, 9)], "chrom string, bed_start long, bed_end long")
    assert sorted(map(tuple, joins.in_intervals(df, bed).collect())) == brute_inside(points, spans)
    assert joins.in_intervals(df, bed.limit(0)).count() == 0 and joins.in_intervals(df.limit(0), bed).count() == 0


def test_overlaps_of_any_length(spark):
    r = random.Random(5)
    make = lambda n, at: [(at + i, r.choice("xy"), s, s + r.choice([1, 300, 16384, 70_000, 3_000_000, 240_000_000, 0])) for i, s in enumerate(r.randrange(10_000_000) for _ in range(n))]
    left, right = make(60, 0), make(80, 1000)
    schema = "id int, chrom string, s long, e long"
    got = joins.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "chrom", "s", "e")
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and max(a[2], b[2]) < min(a[3], b[3]) and a[2] < a[3] and b[2] < b[3])
    assert sorted((x["a_id"], x["b_id"]) for x in got.collect()) == want
    assert got.columns == ["a_id", "a_chrom", "a_s", "a_e", "b_id", "b_chrom", "b_s", "b_e"]


def test_rows_of_an_interval_are_bounded(spark):
    lengths = spark.range(0, 36).select((F.pow(F.lit(2.0), F.col("id")).cast("long") + 1).alias("n"))
    level = joins._level(F.col("n"))
    rows = lengths.select(F.size(joins._bins(F.lit(12_345).cast("long"), F.lit(12_345) + F.col("n"), level)).alias("bins"), level.alias("level")).collect()
    assert max(x["bins"] for x in rows if x["level"] < joins.LEVELS - 1) == 2 and max(x["bins"] for x in rows) <= 10


# Quantiles


def test_quantiles_equal_numpy(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.gauss(0, 3), float(r.randrange(4)), -1e300, 1e-300])) for _ in range(800)] + [("one", 2.5), ("inf", float("inf")), ("inf", 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: x for x in metrics.quantiles(df, "v", {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.97, "q10": 1.0}, ["g"]).collect()}
    assert set(got) == {"a", "b", None, "one", "inf"}
    for g in ("a", "b", None, "one"):
        own = [v for k, v in rows if k == g and v is not None]
        np.testing.assert_allclose([got[g][q] for q in ("q0", "q1", "q5", "q9", "q10")], np.quantile(own, [0, 0.1, 0.5, 0.97, 1]), rtol=1e-12)
    assert got["inf"]["q0"] == 1.0 and got["inf"]["q10"] == float("inf")
    whole = metrics.quantiles(df, "v", {"m": 0.5}).collect()
    assert whole[0]["m"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert metrics.quantiles(df.limit(0), "v", {"m": 0.5}).collect()[0]["m"] is None
    assert "percentile" not in plan(metrics.summary(df, "v")) and "percentile" not in plan(metrics.residual_summary(df.withColumn("p", F.lit(0.0)), "v", "p"))


def test_summary_of_nothing_and_of_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), (None, 2.0)], "g string, v double")
    got = {x["g"]: x for x in metrics.summary(df, "v", ["g"]).collect()}
    assert (got["a"]["median"], got["a"]["p25"], got["a"]["n"], got[None]["most"]) == (2.5, 1.75, 2, 2.0)
    nothing = metrics.summary(df.limit(0), "v").collect()[0]
    assert nothing["n"] == 0 and nothing["median"] is None and nothing["half_width"] is None


# Calibration


def newton(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    w = np.array([0.0, 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (y - p))
        loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-13:
            step = step / 2
        w = w + step
    return w


def test_calibration_in_groups(spark):
    r = np.random.default_rng(7)
    rows = []
    for g, (a, b) in {"a": (0.5, 1.7), "b": (-2.0, 0.3), None: (0.0, 1.0)}.items():
        p = r.uniform(0.001, 0.999, 400)
        y = r.random(400) < 1 / (1 + np.exp(-(a + b * np.log(p / (1 - p)))))
        rows += [(g, float(q), int(k)) for q, k in zip(p, y)]
    rows += [("tied", q, y) for q, y, n in ((0.2, 0, 30), (0.2, 1, 10), (0.9, 0, 5), (0.9, 1, 15)) for _ in range(n)]
    rows += [("one class", 0.2, 1), ("one class", 0.4, 1), ("one level", 0.3, 0), ("one level", 0.3, 1)] + [("apart", 0.1, 0), ("apart", 0.9, 1)] + [("a", None, 1), ("a", 0.3, None), ("edge", 0.0, 0), ("edge", 1.0, 1), ("edge", 0.5, 1), ("edge", 0.5, 0), ("edge", 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    got = {x["g"]: x for x in metrics.calibration_lines(df, "y", "p", ["g"]).collect()}
    for g in ("a", "b", None):
        own = np.array([(p, y) for k, p, y in rows if k == g and p is not None and y is not None])
        want = newton(np.log(own[:, 0] / (1 - own[:, 0])), own[:, 1])
        assert got[g]["converged"] and (got[g]["intercept"], got[g]["slope"]) == pytest.approx(tuple(want), abs=1e-7) and got[g]["n"] == len(own)
    lo, hi, low, high = (math.log(x / (1 - x)) for x in (0.25, 0.75, 0.2, 0.9))
    slope = (hi - lo) / (high - low)
    assert (got["tied"]["slope"], got["tied"]["intercept"]) == pytest.approx((slope, lo - slope * low), abs=1e-8)
    assert all(got[g]["slope"] is None and not got[g]["converged"] for g in ("one class", "one level"))
    assert not got["apart"]["converged"] and got["edge"]["slope"] is not None
    whole = metrics.calibration_lines(df.where("g = 'a'"), "y", "p").collect()
    assert len(whole) == 1 and whole[0]["slope"] == pytest.approx(got["a"]["slope"])
    assert metrics.calibration_line(df.where("g = 'a'"), "y", "p") == pytest.approx((got["a"]["slope"], got["a"]["intercept"]))
    assert metrics.calibration_lines(df.limit(0), "y", "p", ["g"]).count() == 0


# Models that fail, leave-one-out, report facts


def test_a_model_that_fails_in_one_batch(spark):
    from helixframe.operators import models

    df = spark.range(40).select("id", (F.col("id") * 0.5).alias("x"), F.when(F.col("id") % 9 != 0, F.lit(1.0)).alias("maybe")).coalesce(1)

    def sometimes(frame):
        if (frame["id"] == 13).any():
            raise RuntimeError("cannot do 13")
        return frame["x"]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = models.run_models(df, {"fine": lambda f: f["x"] + 1, "sometimes": sometimes, "short": lambda f: f["x"][:1], "holes": lambda f: f["maybe"]}, ["id", "x", "maybe"], ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = {(r["model"], r["id"]): r for r in rows}
    assert len(rows) == 160 and all(by["fine", i]["score"] == i / 2 + 1 and by["fine", i]["error"] is None for i in range(40))
    failed = {i for i in range(40) if by["sometimes", i]["error"] is not None}
    assert failed == set(range(10, 20)) and all(by["sometimes", i]["score"] is None for i in failed) and by["sometimes", 20]["score"] == 10.0
    assert by["short", 0]["error"] == "ValueError: 1 predictions for 10 rows"
    assert by["holes", 9]["score"] is None and by["holes", 9]["error"] is None and by["holes", 8]["score"] == 1.0
    counts = {r["model"]: r for r in models.model_failures(spark.createDataFrame(rows)).collect()}
    assert (counts["fine"]["n_failed"], counts["sometimes"]["n_failed"], counts["sometimes"]["error"], counts["short"]["n_failed"]) == (0, 10, "RuntimeError: cannot do 13", 40)


def test_leave_one_out_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), (None, 2.0), (None, 4.0)], "g string, v double")
    got = sorted(((str(r["g"]), str(r["v"]), r["expected"]) for r in splits.leave_one_out_means(df, "v", ["g"]).collect()))
    assert got == [("None", "2.0", 4.0), ("None", "4.0", 2.0), ("a", "1.0", 3.0), ("a", "3.0", 1.0), ("a", "None", 2.0), ("b", "5.0", None)]


def test_facts_of_a_sanity_check(spark):
    from helixframe.operators import results

    runs = spark.createDataFrame([(1, "m", "temporal", 10, True), (1, "m", "temporal", 10, False), (2, None, "zero_shot", None, None)], "run_no int, model_name string, split_type string, n_samples long, leakage_passed boolean")
    assert sorted(map(tuple, results.tier0_facts(runs).collect())) == [(1, 0, "Model", "m"), (1, 1, "Split", "temporal"), (1, 2, "N", "10"), (1, 3, "Anti-leakage", "FAILED"), (2, 0, "Model", ""), (2, 1, "Split", "zero_shot"), (2, 2, "N", ""), (2, 3, "Anti-leakage", "FAILED")]


def test_copy_number_columns_by_the_callers_names(spark):
    df = spark.createDataFrame([("Pathogenic", "A;B", "DEL"), ("benign", "C", "DUP")], "Classification string, Loci string, kind string")
    got = {(r["part"], r["name"]): r["n"] for r in cohort.cnv_summary(df, {"gene": ("loci",), "type": ("kind",)}).collect()}
    assert got == {("all", ""): 2, ("class", "Pathogenic"): 1, ("class", "benign"): 1, ("pathogenic", ""): 1, ("type", "DEL"): 1, ("type", "DUP"): 1, ("pathogenic loci", ""): 1}


def test_too_few_shared_positions_are_an_error(spark):
    from helixframe.operators import panels

    points = spark.range(50).select(F.lit("chr1").alias("chrom"), F.col("id").alias("pos"))
    assert panels.require_overlap(points, points, 50).collect()[0]["n_shared"] == 50
    with pytest.raises(ValueError, match="50 shared positions; at least 100"):
        panels.require_overlap(points, points)
