"""Intervals of curve metrics and of least squares against resampling in numpy with the same weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import bootstrap, metrics


def data(spark, n=400, levels=40, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "b", None]), int(r.random() < 0.3), None if r.random() < 0.1 else r.randrange(levels) / levels) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, y int, s double")


def weights_of(spark, ids, replicates, rate=1.0):
    hashes = spark.createDataFrame([(i,) for i in ids], "id long").select(F.xxhash64("id")).collect()
    return bootstrap.weights(np.array([r[0] for r in hashes]), replicates, rate, 42)


def curve(y, s):
    """(tp, fp) of each distinct score, from the highest."""
    for t in sorted(set(s.tolist()), reverse=True):
        yield ((y == 1) & (s >= t)).sum(), ((y == 0) & (s >= t)).sum()


def average_precision(y, s):
    total, best, seen = (y == 1).sum(), 0.0, 0
    if not total:
        return np.nan
    for tp, fp in curve(y, s):
        best += (tp - seen) / total * tp / (tp + fp)
        seen = tp
    return best


def ppv(y, s, target):
    total = (y == 1).sum()
    return next((tp / (tp + fp) for tp, fp in curve(y, s) if total and tp >= target * total), 0.0)


def npv(y, s, target):
    total = (y == 0).sum()
    for t in sorted(set(s.tolist())):
        tn, fn = ((y == 0) & (s <= t)).sum(), ((y == 1) & (s <= t)).sum()
        if total and tn >= target * total:
            return tn / (tn + fn)
    return 0.0


DEFINED = {"auprc": average_precision, "ppv": lambda y, s: ppv(y, s, 0.7), "npv": lambda y, s: npv(y, s, 0.8)}


@pytest.mark.parametrize("slot_rows", [2048, 7, 40])
def test_curve_intervals_equal_resampling(spark, slot_rows):
    rows, df = data(spark)
    found = bootstrap.curve_intervals(df, "id", "y", "s", ["g"], sensitivity=0.7, specificity=0.8, replicates=50, cap=None, slot_rows=slot_rows).collect()
    assert len(found) == 9
    for r in found:
        own = [(i, y, s) for i, g, y, s in rows if g == r["g"] and s is not None]
        y, s = np.array([x[1] for x in own]), np.array([x[2] for x in own])
        assert r["estimate"] == pytest.approx(DEFINED[r["metric"]](y, s), abs=1e-12) and r["n"] == len(own)
        w = weights_of(spark, [x[0] for x in own], 50)
        values = [DEFINED[r["metric"]](np.repeat(y, k), np.repeat(s, k)) for k in w.T]
        np.testing.assert_allclose([r["ci_lower"], r["ci_upper"]], np.percentile(values, [2.5, 97.5]), atol=1e-9)


def test_single_metrics_caps_and_extremes(spark):
    rows, df = data(spark, 200)
    own = [(i, y, s) for i, _, y, s in rows if s is not None]
    y, s = np.array([x[1] for x in own]), np.array([x[2] for x in own])
    w = weights_of(spark, [x[0] for x in own], 40, 100 / len(own))
    for got, f in ((bootstrap.auprc_interval(df, "id", "y", "s", replicates=40, cap=100), average_precision), (bootstrap.ppv_interval(df, "id", "y", "s", 0.5, replicates=40, cap=100), lambda y, s: ppv(y, s, 0.5)), (bootstrap.npv_interval(df, "id", "y", "s", 1.0, replicates=40, cap=100), lambda y, s: npv(y, s, 1.0))):
        r = got.collect()[0]
        np.testing.assert_allclose([r["ci_lower"], r["ci_upper"]], np.percentile([f(np.repeat(y, k), np.repeat(s, k)) for k in w.T], [2.5, 97.5]), atol=1e-9)
    # All rows with one score, one class, no rows.
    flat = df.withColumn("s", F.lit(0.5))
    assert bootstrap.auprc_interval(flat, "id", "y", "s", replicates=20, slot_rows=8).collect()[0]["estimate"] == pytest.approx(np.mean([r[2] for r in rows]))
    only = {r["metric"]: r for r in bootstrap.curve_intervals(df.where("y = 0"), "id", "y", "s", replicates=20).collect()}
    assert only["auprc"]["estimate"] is None and only["auprc"]["ci_lower"] is None and only["ppv"]["ci_upper"] == 0.0 and only["npv"]["ci_lower"] == 1.0
    assert bootstrap.curve_intervals(df.limit(0), "id", "y", "s", ["g"], replicates=20).count() == 0
    assert bootstrap.auroc_interval(df.limit(0), "id", "y", "s", replicates=20).collect()[0]["ci_lower"] is None


def test_both_rules_for_resamples_that_fail(spark):
    """Two rows: about a quarter of the resamples hold both classes, too few for one rule and enough for the other."""
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1)], "id long, y int, s double")
    one = bootstrap.auroc_interval(df, "id", "y", "s", replicates=200, least_valid=0.9).collect()[0]
    assert one["ci_lower"] == one["ci_upper"] == one["estimate"] == 1.0
    none = bootstrap.auroc_interval(df.where("y = 1"), "id", "y", "s", replicates=50, **bootstrap.WITHOUT_CAP).collect()[0]
    assert none["estimate"] is None and none["ci_lower"] is None
    some = bootstrap.auroc_interval(df, "id", "y", "s", replicates=200, **bootstrap.WITHOUT_CAP).collect()[0]
    assert (some["ci_lower"], some["ci_upper"]) == (1.0, 1.0)
    void = bootstrap.sums_interval(df, "id", {"a": F.lit(1.0), "b": F.lit(0.0)}, F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), replicates=20, **bootstrap.WITHOUT_CAP).collect()[0]
    assert void["estimate"] is None and void["ci_upper"] is None


def fit_r2(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    return 1 - ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("covariates", [1, 3])
def test_covariate_r2_equals_resampled_fits(spark, covariates):
    r = np.random.default_rng(5)
    n = 240
    c, p = r.normal(1000, 3, (n, covariates)), r.normal(size=n)
    y = c @ r.normal(size=covariates) + 2 * p + r.normal(size=n)
    groups = r.choice(["a", "b"], n)
    names = [f"c{i}" for i in range(covariates)]
    rows = [(i, str(g), float(a), float(b), *map(float, k)) for i, (g, a, b, k) in enumerate(zip(groups, y, p, c))]
    df = spark.createDataFrame([*rows, (999, "a", None, 1.0, *[1.0] * covariates)], "id long, g string, y double, p double, " + ", ".join(f"{x} double" for x in names))
    for got in bootstrap.covariate_r2_interval(df, "id", "y", "p", names, ["g"], replicates=40, cap=None).collect():
        at = np.flatnonzero(groups == got["g"])
        gain = lambda i: fit_r2(np.column_stack([c[i], p[i]]), y[i]) - fit_r2(c[i], y[i])
        assert got["estimate"] == pytest.approx(gain(at), abs=1e-9) and got["n"] == len(at)
        w = weights_of(spark, at.tolist(), 40)
        np.testing.assert_allclose([got["ci_lower"], got["ci_upper"]], np.percentile([gain(np.repeat(at, k)) for k in w.T], [2.5, 97.5]), atol=1e-8)
    # A copy of a covariate and a constant add nothing; a constant y has 0.
    twice = bootstrap.covariate_r2_interval(df.withColumns({"copy": F.col("c0"), "one": F.lit(7.0)}), "id", "y", "p", [*names, "copy", "one"], ["g"], replicates=5).collect()
    once = bootstrap.covariate_r2_interval(df, "id", "y", "p", names, ["g"], replicates=5).collect()
    assert {x["g"]: pytest.approx(x["estimate"], abs=1e-8) for x in twice} == {x["g"]: x["estimate"] for x in once}
    assert bootstrap.covariate_r2_interval(df.withColumn("y", F.lit(3.0)), "id", "y", "p", names, replicates=5).collect()[0]["estimate"] == 0.0
    assert bootstrap.covariate_r2_interval(df.limit(0), "id", "y", "p", names, ["g"], replicates=5).count() == 0


def test_sums_are_handed_on_in_many_groups(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 300).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    want = {r["g"]: r for r in bootstrap.ratio_interval(df, "id", F.col("v"), F.lit(1.0), ["g"], replicates=10).collect()}
    monkeypatch.setattr(bootstrap, "HELD", 500)
    got = {r["g"]: r for r in bootstrap.ratio_interval(df, "id", F.col("v"), F.lit(1.0), ["g"], replicates=10).collect()}
    assert len(got) == 300 and all(got[g]["estimate"] == pytest.approx(want[g]["estimate"]) and got[g]["ci_lower"] == pytest.approx(want[g]["ci_lower"]) for g in got)


def test_points_of_threshold_metrics_count_rows(spark):
    rows, df = data(spark, 60)
    used = [r for r in rows if r[3] is not None]
    assert metrics.ppv_at_sensitivity(df, "y", "s").collect()[0]["n"] == metrics.npv_at_specificity(df, "y", "s").collect()[0]["n"] == len(used)
