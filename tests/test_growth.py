"""Steps whose work must follow the input: what a line, a sample or an interval costs, beside the results."""

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import joins, metrics, panels
from helixframe.sources import tables

SMALL = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_are_fitted_for_many_samples_at_once(spark, monkeypatch):
    catalogue = spark.createDataFrame([("a", "c1", 1.0), ("b", "c2", 0.75), ("b", "c3", 0.25)], "signature string, context string, share double")
    spectra = spark.createDataFrame([(s, c, float(1 + (s * k) % 9)) for s in range(50) for k, c in enumerate(["c1", "c2", "c3", "other"])] + [(77, "other", 1.0), (None, "c1", 4.0)], "s int, context string, n double")
    found = panels.fit_signatures(spectra, catalogue, "s", 100)
    assert "FlatMapGroups" not in optimized(found)  # no Python call for each sample
    shares = np.array([[1.0, 0.0], [0.0, 0.75], [0.0, 0.25]])
    want = {(None, "a"): 4.0, (None, "b"): 0.0}
    for s in range(50):
        counts = np.array([1.0 + (s * k) % 9 for k in range(3)])
        w = np.full(2, counts.sum() / 2)
        for _ in range(100):
            w *= (shares.T @ counts) / np.maximum(shares.T @ (shares @ w), 1e-12)
        want[s, "a"], want[s, "b"] = w
    for numbers in (panels.BATCH_NUMBERS, 1):
        monkeypatch.setattr(panels, "BATCH_NUMBERS", numbers)
        got = {(r["s"], r["signature"]): r["count"] for r in panels.fit_signatures(spectra, catalogue, "s", 100).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_line_of_predictions_is_split_and_searched_once(spark):
    entry = "SpliceAI=C|G1|0.2|0.1||x|1|2|3|4"
    lines = spark.createDataFrame([("#head\ta\tb\tc\td",), (f"1\t5\t.\tA\tC\t.\t.\tDP=1;{entry},T|G2|0.9|0|0|0|1|2|3|4;AF=1",), ("1\tx\t.\tA\tC\t.\t.\t" + entry,), ("1\t6\t.\tA\tC\t.\t.\tDP=1",), ("1\t7\t.\tA",), (None,), ("1\t8\t.\tA\tC",)], "value string")
    found = tables.splice_scan(lines, lines.limit(0))
    assert {tuple(r) for r in found.collect()} == {("chr1", 5, "A", "C", "G1", 0.2)}
    plan = optimized(tables.splice_scan(lines, spark.createDataFrame([("1\t5\t.\tA\tC\t.\t.\t" + entry,)], "value string").where(F.rand() >= 0)))
    assert plan.count("SpliceAI=") <= 2 and plan.count("split(value") <= 2, plan


def test_distinct_variants_are_looked_up_once(spark):
    from helixframe.plans import catalog_tables  # noqa: F401
    from helixframe.plans.catalog import QUERIES

    assert "split(" not in optimized(QUERIES["splice_snv_and_indel"](spark, SMALL))  # lines are parsed once, before


def test_calibration_of_many_rows_ends_at_the_bottom(spark):
    """The loss of many rows is rounded to more than a step changes it."""
    rows = spark.range(3_000_000).select(((F.col("id") * 7919) % 10007 / 10007.0 * 0.98 + 0.01).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(100)) < 50).cast("int").alias("y"))
    slope, intercept = metrics.calibration_line(rows, "y", "p")
    x = F.ln(F.col("p") / (1 - F.col("p")))
    error = F.col("y") - 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * x)))
    sums = rows.agg(F.sum(error), F.sum(error * x)).first()
    assert max(map(abs, sums)) < 2e-5


def test_totals_of_overlaps_need_no_pairs(spark, monkeypatch):
    r = np.random.default_rng(5)
    side = lambda n: [(int(r.integers(3)), "xyz"[r.integers(2)], int(s := r.integers(-40, 40)), int(s + r.integers(-1, 30))) for _ in range(n)]
    left, right = [*side(60), (9, "x", -300, 500), (1, None, 0, 5)], [*side(50), (8, "x", 500, 900), (8, "z", 0, 5)]
    want = {}
    for ka, ca, sa, ea in left:
        for kb, cb, sb, eb in right:
            if ca == cb and ca and ea > sa and eb > sb and min(ea, eb) > max(sa, sb):
                n, shared = want.get((ka, kb), (0, 0))
                want[ka, kb] = n + 1, shared + min(ea, eb) - max(sa, sb)
    frames = [spark.createDataFrame(x, "k int, c string, s bigint, e bigint") for x in (left, right)]
    for width in (1 << 16, 7):
        monkeypatch.setattr(joins, "TOTAL_BIN", width)
        got = {(x["a"], x["b"]): (x["n"], x["shared"]) for x in joins.overlap_totals(*frames, F.col("k"), F.col("k"), "c", "s", "e").collect()}
        assert got == want


def test_copies_of_an_interval_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "CHUNK_ROWS", 20)
    rows = [(i, "c", 10 * (i % 2), 10 * (i % 2) + 100) for i in range(300)]
    svs = spark.createDataFrame([*rows, (300, "c", 90, 400), (301, "d", 0, 100), (301, "d", 0, 100)], "id int, chrom string, sv_start bigint, sv_end bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = joins.reciprocal_overlap(svs, svs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(pairs) == 300 * 300 + 1 + 4
    assert {(x["a_id"], x["b_id"]) for x in pairs} == {(i, j) for i in range(300) for j in range(300)} | {(300, 300), (301, 301)}
    assert {x["share"] for x in pairs} == {1.0, 0.9}
    _, sizes = np.unique([x["task"] for x in pairs], return_counts=True)
    assert len(sizes) == 4 and sizes.max() < 0.5 * len(pairs)


def test_rounds_of_many_samples_move_no_blocks(spark, monkeypatch):
    """A round sends the vector's pieces to the blocks, which hold two bytes for a place and one for a whole dosage."""
    from helixframe.operators import genomic, genotype_grid

    r = np.random.default_rng(4)
    cells = [(f"s{i}", j, float(r.integers(1, 3))) for i in range(60) for j in range(25) if r.random() < 0.4]
    phenotypes = spark.createDataFrame([(f"s{i}", float(i % 9) if i % 5 else None) for i in range(60)], "sample string, y double")
    g = genotype_grid.grid(spark.createDataFrame(cells, "sample string, marker int, dosage double"), phenotypes)
    assert g.blocks.agg(F.sum(F.length("si") + F.length("mi") + F.length("dosage"))).first()[0] == 5 * len(cells)
    for onto, pieces in (("m", g.own_samples), ("s", g.own_markers)):
        plan = genotype_grid._product(g, pieces.select("piece", F.element_at("own", 1).alias("v")), onto, 1)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan, plan
    # Dosages between whole numbers, missing ones, and pieces that are too large to be broadcast.
    odd = [(s, j, None if (j, s) == (3, "s7") else x * 0.1 if j % 2 else x * 0.5) for s, j, x in cells]
    genotypes, found = spark.createDataFrame(odd, "sample string, marker int, dosage double"), []
    for most, held in ((genomic.MOST_SAMPLES, 1), (5, genotype_grid.BROADCAST_BYTES), (5, 0)):
        monkeypatch.setattr(genomic, "MOST_SAMPLES", most)
        monkeypatch.setattr(genotype_grid, "BROADCAST_BYTES", held)
        monkeypatch.setattr(genotype_grid, "SIDE", 16)
        found.append({x["sample"]: x["prediction"] for x in genomic.ridge_predictions(genotypes, phenotypes, 2000.0, 1e-9).collect()})
    assert found[0].keys() == found[1].keys() == found[2].keys()
    assert max(abs(found[0][s] - f[s]) for f in found[1:] for s in found[0]) < 1e-7
