"""Ridge and components over long genotypes against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import genomic, models

GENOTYPES = "sample string, marker string, dosage double"


def panel(seed=1, n=40, m=150, missing=0.03):
    r = np.random.default_rng(seed)
    x = r.binomial(2, r.uniform(0.1, 0.5, m), (n, m)).astype(float)
    x[:, 5] = 1.0  # varies nowhere
    gone = r.random((n, m)) < missing
    rows = [(f"s{i:03}", f"m{j}", None if gone[i, j] else float(x[i, j])) for i in range(n) for j in range(m) if x[i, j] or gone[i, j]]
    return np.where(gone, np.nan, x), rows


def centred(x, train):
    means = np.nanmean(x[train], axis=0)
    return np.where(np.isnan(x), 0.0, x - means)


def test_ridge_equals_the_primal_solution(spark):
    x, rows = panel()
    n = len(x)
    r = np.random.default_rng(2)
    y = np.nan_to_num(x) @ r.normal(size=x.shape[1]) + r.normal(size=n)
    train = np.arange(n) % 4 != 0
    genotypes = spark.createDataFrame([*rows, rows[0], ("zz", "m1", 1.0), (None, "m1", 2.0), ("s000", None, 2.0)], GENOTYPES)
    phenotypes = spark.createDataFrame([(f"s{i:03}", float(y[i]) if train[i] else None) for i in range(n)], "sample string, y double")
    c = centred(x, train)
    w = np.linalg.solve(c[train].T @ c[train] + 2.5 * np.eye(c.shape[1]), c[train].T @ (y[train] - y[train].mean()))
    want = {f"s{i:03}": p for i, p in enumerate(c @ w + y[train].mean())}
    for options in ({"tolerance": 1e-11}, {"block_rows": 300, "tolerance": 1e-9}):
        got = {r["sample"]: r["prediction"] for r in genomic.ridge_predictions(genotypes, phenotypes, 2.5, **options).collect()}
        assert got.keys() == want.keys() and max(abs(got[s] - want[s]) for s in want) < 1e-6


def test_ridge_equals_the_wide_model(spark):
    """The same fit as models.ridge over one column for each marker."""
    x, rows = panel(3, 60, 6, 0.0)
    y = x @ np.arange(6) + np.random.default_rng(1).normal(size=60)
    wide = spark.createDataFrame([(f"s{i:03}", float(y[i]), *map(float, x[i])) for i in range(60)], "sample string, y double, " + ", ".join(f"m{j} double" for j in range(6)))
    features = [f"m{j}" for j in range(6)]
    want = {r["sample"]: r["prediction"] for r in models.predict(models.ridge(wide, "y", features, 1.0), wide, features).collect()}
    got = {r["sample"]: r["prediction"] for r in genomic.ridge_predictions(spark.createDataFrame(rows, GENOTYPES), wide.select("sample", "y"), 1.0).collect()}
    assert max(abs(got[s] - want[s]) for s in want) < 1e-6


@pytest.mark.parametrize("share", [0.02, 0.6])
def test_products_of_rows_and_of_dense_parts(share):
    r = np.random.default_rng(9)
    x = np.where(r.random((30, 12)) < share, r.integers(1, 3, (30, 12)), 0).astype(float)
    x[3], x[4, 2] = 1.0, np.nan
    train = r.random(30) < 0.7
    at = np.argwhere(np.nan_to_num(x, nan=1.0).T != 0)
    part = genomic.Part([str(j) for j in range(12)], np.searchsorted(at[:, 0], np.arange(12)), at[:, 1].astype(np.int32), x.T[at[:, 0], at[:, 1]], train)
    assert (part.dense is None) == (share < 0.1)
    c, q, t = centred(x, train), r.normal(size=(30, 3)), r.normal(size=(12, 2))
    np.testing.assert_allclose(part.onto_markers(q), c.T @ q, atol=1e-10)
    np.testing.assert_allclose(part.onto_samples(t), c @ t, atol=1e-10)
    np.testing.assert_allclose(part.deviations, np.sqrt((c[train] ** 2).mean(0)), atol=1e-10)


def test_ridge_edges(spark):
    genotypes = spark.createDataFrame([("a", "m", 1.0)], GENOTYPES)
    some = spark.createDataFrame([("a", None), ("b", None), (None, 1.0)], "sample string, y double")
    assert {tuple(r) for r in genomic.ridge_predictions(genotypes, some).collect()} == {("a", None), ("b", None)}
    one = spark.createDataFrame([("a", 3.0), ("b", None), ("b", None)], "sample string, y double")
    assert {tuple(r) for r in genomic.ridge_predictions(genotypes, one).collect()} == {("a", 3.0), ("b", 3.0)}
    assert {tuple(r) for r in genomic.ridge_predictions(genotypes.limit(0), one).collect()} == {("a", 3.0), ("b", 3.0)}
    assert genomic.ridge_predictions(genotypes, one.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than 1 samples"):
        genomic.ridge_predictions(genotypes, one, most=1)


def test_components_equal_the_decomposition(spark, monkeypatch):
    monkeypatch.setattr(genomic, "DRIVER_NUMBERS", 0)  # Spark adds up the tasks' sums
    x, rows = panel(4, 50, 200)
    x = x + 0.0
    whole = np.ones(50, bool)
    c = centred(x, whole)
    deviation = np.sqrt((c**2).mean(0))
    z = np.where(deviation > 0, c / np.where(deviation > 0, deviation, 1), 0.0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    samples = spark.createDataFrame([(f"s{i:03}",) for i in range(50)], "sample string")
    genotypes = spark.createDataFrame(rows, GENOTYPES)
    found = genomic.principal_components(genotypes, samples, 6, spare=10, block_rows=500)
    np.testing.assert_allclose(found.values, s[:6] ** 2 / 50, rtol=1e-8)
    own = {r["sample"]: np.array(r[1:]) for r in found.scores.collect()}
    got = np.array([own[f"s{i:03}"] for i in range(50)])
    signs = np.sign((got * u[:, :6]).sum(0))
    np.testing.assert_allclose(got * signs, u[:, :6] * s[:6], atol=1e-5)
    loads = {r["marker"]: np.array(r["load"]) for r in found.loadings.collect()}
    assert "m5" not in loads and len(loads) == 199
    np.testing.assert_allclose([loads[f"m{j}"] * signs for j in range(200) if j != 5], vt[:6].T[np.arange(200) != 5], atol=1e-6)
    # The panel's own samples land where they are; so does a stranger.
    again = {r["sample"]: np.array(r[1:]) for r in genomic.project(genotypes, samples, found).collect()}
    np.testing.assert_allclose([again[k] for k in own], [own[k] for k in own], atol=1e-7)
    stranger = spark.createDataFrame([("new", "m1", 2.0), ("new", "m7", None), ("new", "unknown", 1.0)], GENOTYPES)
    at = genomic.project(stranger, spark.createDataFrame([("new",), ("none",)], "sample string"), found).collect()
    means = np.nanmean(x, axis=0)
    row = -means
    row[1], row[7] = 2 - means[1], 0.0
    want = {"new": row, "none": -means}
    for r in at:
        np.testing.assert_allclose(np.array(r[1:]) * signs, np.where(deviation > 0, want[r["sample"]] / np.where(deviation > 0, deviation, 1), 0) @ vt[:6].T, atol=1e-5)


def test_components_edges(spark):
    genotypes = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 1.0)], GENOTYPES)
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    flat = genomic.principal_components(genotypes, samples, 3)
    assert len(flat.values) == 0 and flat.scores.columns == ["sample"] and flat.loadings.count() == 0
    assert genomic.principal_components(genotypes.limit(0), samples, 3).scores.count() == 2
    assert genomic.principal_components(genotypes, samples.limit(0), 3).scores.count() == 0
    one = genomic.principal_components(spark.createDataFrame([("a", "m", 1.0)], GENOTYPES), samples, 3)
    assert one.values.tolist() == pytest.approx([1.0]) and {r["sample"]: round(abs(r["pc1"]), 6) for r in one.scores.collect()} == {"a": 1.0, "b": 1.0}


def wide_genotypes(spark, n, m, share):
    """(sample, marker, dosage) of a hash: about the given share of cells has a dosage of 1 or 2."""
    cells = spark.range(m).select(F.col("id").alias("marker"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
    h = F.pmod(F.xxhash64("marker", "sample"), F.lit(1_000_000))
    return cells.where(h < int(share * 1_000_000)).select("sample", "marker", (F.when(h % 5 == 0, 2.0).otherwise(1.0)).alias("dosage"))


def test_a_hundred_thousand_markers(spark):
    """2,000 samples: the residual of the dual system, checked with a Gram matrix made apart."""
    n, m = 2000, 100_000
    rows = wide_genotypes(spark, n, m, 0.005)
    y = np.random.default_rng(8).normal(size=n)
    train = np.arange(n) % 5 != 0
    phenotypes = spark.createDataFrame([(i, float(y[i]) if train[i] else None) for i in range(n)], "sample int, y double")
    got = {r["sample"]: r["prediction"] for r in genomic.ridge_predictions(rows, phenotypes, 50.0, tolerance=1e-10).collect()}
    table = rows.toPandas()
    gram = np.zeros((n, n))
    order = table.sort_values("marker")
    for start in range(0, m, 4000):
        own = order[(order["marker"] >= start) & (order["marker"] < start + 4000)]
        x = np.zeros((n, 4000))
        x[own["sample"], own["marker"] - start] = own["dosage"]
        x -= x[train].mean(0)
        gram += x @ x.T
    a = np.linalg.solve(gram[np.ix_(train, train)] + 50.0 * np.eye(train.sum()), y[train] - y[train].mean())
    want = gram[:, train] @ a + y[train].mean()
    assert max(abs(got[i] - want[i]) for i in range(n)) < 1e-7


def test_ridge_of_more_samples_than_the_driver_keeps(spark, monkeypatch):
    """Blocks of samples and markers give what the driver's numbers give; some samples have no rows, some markers no spread."""
    from helixframe.operators import genotype_grid

    x, rows = panel(8, 40, 60)
    genotypes = spark.createDataFrame([*rows, rows[0], ("zz", "m1", 1.0), (None, "m1", 2.0), ("s000", None, 2.0), ("s001", "nan", float("nan"))], GENOTYPES)
    phenotypes = spark.createDataFrame([(f"s{i:03}", float(i % 7) if i % 4 else None) for i in range(45)], "sample string, y double")
    want = {r["sample"]: r["prediction"] for r in genomic.ridge_predictions(genotypes, phenotypes, 400.0, 1e-9).collect()}
    monkeypatch.setattr(genomic, "MOST_SAMPLES", 5)
    for side, block_rows in ((16, 1 << 20), (1 << 16, 300)):
        monkeypatch.setattr(genotype_grid, "SIDE", side)
        monkeypatch.setattr(genotype_grid, "BLOCK_ROWS", block_rows)
        got = {r["sample"]: r["prediction"] for r in genomic.ridge_predictions(genotypes, phenotypes, 400.0, 1e-9).collect()}
        assert got.keys() == want.keys() and max(abs(got[s] - want[s]) for s in want) < 1e-5
    none = genomic.ridge_predictions(genotypes.limit(0), phenotypes, 2.5)
    assert {round(r["prediction"], 9) for r in none.collect()} == {round(float(np.mean([i % 7 for i in range(45) if i % 4])), 9)}


def test_components_of_more_samples_than_the_driver_keeps(spark, monkeypatch):
    from helixframe.operators import genotype_grid

    _, rows = panel(6, 50, 12)
    samples = spark.createDataFrame([(f"s{i:03}",) for i in range(55)] + [(None,), ("s000",)], "sample string")
    genotypes = spark.createDataFrame([*rows, ("zz", "m1", 1.0)], GENOTYPES)
    want = genomic.principal_components(genotypes, samples, 3)
    monkeypatch.setattr(genomic, "MOST_SAMPLES", 15)
    monkeypatch.setattr(genotype_grid, "SIDE", 7)
    got = genomic.principal_components(genotypes, samples, 3)
    np.testing.assert_allclose(got.values, want.values, rtol=1e-9)
    for side, key in (("scores", "sample"), ("loadings", "marker")):
        a, b = ({r[key]: np.hstack(r[1:]) for r in getattr(x, side).collect()} for x in (got, want))
        assert a.keys() == b.keys() and max(np.abs(a[s] - b[s]).max() for s in a) < 1e-7
    monkeypatch.setattr(genomic, "MOST_SAMPLES", 5)
    with pytest.raises(ValueError, match="more than 5 samples and more than 5 markers"):
        genomic.principal_components(genotypes, samples, 3)
