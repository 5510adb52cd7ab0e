"""Registered queries of intervals, fits, quantiles and joins in the forms that hold for any group size, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import bootstrap, genomic, joins, metrics, models, results, splits
from helixframe.plans.catalog import counted, query, r6

# Intervals


@query("assertions", sql=f"""{counted('SELECT * FROM assertions', 'gene_symbol')},
e AS (SELECT gene_symbol, 'auprc' AS metric, sum(CAST(pos AS DOUBLE) / p * (p - pb) / ((p - pb) + (n - nb))) AS estimate, sum(pos + neg) AS n FROM c GROUP BY 1
UNION ALL SELECT gene_symbol, 'ppv', coalesce(max_by(CAST(p - pb AS DOUBLE) / ((p - pb) + (n - nb)), score) FILTER (WHERE p - pb >= 0.9 * p AND p > 0), 0), sum(pos + neg) FROM c GROUP BY 1
UNION ALL SELECT gene_symbol, 'npv', coalesce(min_by(CAST(nb + neg AS DOUBLE) / ((nb + neg) + (pb + pos)), score) FILTER (WHERE nb + neg >= 0.95 * CAST(n AS DOUBLE) AND n > 0), 0), sum(pos + neg) FROM c GROUP BY 1)
SELECT gene_symbol, metric, round(estimate, 6) AS estimate, CAST(n AS BIGINT) AS n, true AS around FROM e""")
def curve_intervals(assertions: DataFrame) -> DataFrame:
    """Estimates by gene, and whether their intervals are in order and near them."""
    found = bootstrap.curve_intervals(assertions, "variation_id", "clinsig_simple", "score", ["gene_symbol"], specificity=0.95, replicates=100)
    around = (F.col("ci_lower") <= F.col("ci_upper")) & (F.col("ci_lower") - 0.25 <= F.col("estimate")) & (F.col("estimate") <= F.col("ci_upper") + 0.25)
    return found.select("gene_symbol", "metric", r6("estimate"), "n", around.alias("around"))


@query("assays", sql="""z AS (SELECT assay_id, CAST(dms_score AS DOUBLE) AS y, score AS s, CAST(row_id % 11 AS DOUBLE) AS c, CAST((row_id * 31) % 17 AS DOUBLE) AS d FROM assays),
a AS (SELECT *, regr_slope(y, c) OVER w AS yc, regr_slope(s, c) OVER w AS sc, regr_slope(d, c) OVER w AS dc, avg(y) OVER w AS my, avg(s) OVER w AS ms, avg(c) OVER w AS mc, avg(d) OVER w AS md FROM z WINDOW w AS (PARTITION BY assay_id)),
b AS (SELECT assay_id, y, (y - my) - yc * (c - mc) AS y1, (s - ms) - sc * (c - mc) AS s1, (d - md) - dc * (c - mc) AS d1 FROM a),
k AS (SELECT *, regr_slope(y1, d1) OVER w AS yd, regr_slope(s1, d1) OVER w AS sd FROM b WINDOW w AS (PARTITION BY assay_id))
SELECT assay_id, round(regr_r2(y1, s1) * var_pop(y1) / var_pop(y), 6) AS one, round(regr_r2(y1 - yd * d1, s1 - sd * d1) * var_pop(y1 - yd * d1) / var_pop(y), 6) AS two, count(*) AS n FROM k GROUP BY 1""")
def covariate_r2_by_assay(assays: DataFrame) -> DataFrame:
    """What a score adds to one and to two covariates, by assay: in SQL from residuals of residuals."""
    rows = assays.select("assay_id", "row_id", F.col("dms_score").cast("double").alias("y"), "score", (F.col("row_id") % 11).alias("c"), (F.col("row_id") * 31 % 17).alias("d"))
    fit = lambda covariates: bootstrap.covariate_r2_interval(rows, "row_id", "y", "score", covariates, ["assay_id"], replicates=50)
    one, two = fit(["c"]), fit(["c", "d"])
    return one.select("assay_id", r6("one", F.col("estimate"))).join(two.select("assay_id", r6("two", F.col("estimate")), "n"), "assay_id")


@query("assertions", sql="""t AS (SELECT gene_symbol, CASE WHEN score < 0.6 THEN 0.2 ELSE 0.7 END AS q, clinsig_simple AS y FROM assertions WHERE clinsig_simple IN (0, 1)),
l AS (SELECT gene_symbol, avg(CAST(y AS DOUBLE)) FILTER (WHERE q < 0.5) AS lo, avg(CAST(y AS DOUBLE)) FILTER (WHERE q > 0.5) AS hi, count(*) AS n FROM t GROUP BY 1),
g AS (SELECT gene_symbol, ln(lo / (1 - lo)) AS a, ln(hi / (1 - hi)) AS b, n, lo > 0 AND lo < 1 AND hi > 0 AND hi < 1 AS inner_rates FROM l)
SELECT gene_symbol, round((b - a) / (ln(0.7 / 0.3) - ln(0.2 / 0.8)), 5) + 0.0 AS slope, round(a - (b - a) / (ln(0.7 / 0.3) - ln(0.2 / 0.8)) * ln(0.2 / 0.8), 5) + 0.0 AS intercept, n FROM g WHERE inner_rates""")
def calibration_by_gene(assertions: DataFrame) -> DataFrame:
    """With two probabilities the line goes through the logits of both observed rates; loci whose rates are 0 or 1 have none."""
    rows = assertions.where(F.col("clinsig_simple").isin(0, 1)).select("gene_symbol", "clinsig_simple", F.when(F.col("score") < 0.6, 0.2).otherwise(0.7).alias("q"))
    found = metrics.calibration_lines(rows, "clinsig_simple", "q", ["gene_symbol"]).where("converged")
    return found.select("gene_symbol", (F.round("slope", 5) + 0.0).alias("slope"), (F.round("intercept", 5) + 0.0).alias("intercept"), "n")


@query("samples", sql="SELECT ancestry, round(avg(CASE WHEN sign(round(phenotype, -3)) = sign(sample_id % 3 - 1) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS with_zeros, count(*) AS n FROM samples GROUP BY 1")
def direction_with_zeros(samples: DataFrame) -> DataFrame:
    """Equal signs among all rows; an effect of 0 has the sign 0."""
    rows = samples.select("ancestry", F.round(F.col("phenotype").cast("double"), -3).alias("effect"), (F.col("sample_id") % 3 - 1).alias("predicted"))
    return metrics.direction_accuracy(rows, "effect", "predicted", ["ancestry"], keep_zeros=True).select("ancestry", r6("with_zeros", F.col("estimate")), "n")


# Quantiles


@query("assays", sql="SELECT assay_id, round(quantile_cont(CAST(dms_score AS DOUBLE) * score, 0.05), 6) AS low, round(quantile_cont(CAST(dms_score AS DOUBLE) * score, 0.5), 6) AS middle, round(quantile_cont(CAST(dms_score AS DOUBLE) * score, 0.999), 6) AS high FROM assays GROUP BY 1 UNION ALL SELECT NULL, round(quantile_cont(CAST(dms_score AS DOUBLE) * score, 0.05), 6), round(quantile_cont(CAST(dms_score AS DOUBLE) * score, 0.5), 6), round(quantile_cont(CAST(dms_score AS DOUBLE) * score, 0.999), 6) FROM assays")
def exact_quantiles(assays: DataFrame) -> DataFrame:
    """Quantiles of each assay and of all rows."""
    rows, shares = assays.withColumn("v", F.col("dms_score").cast("double") * F.col("score")), {"low": 0.05, "middle": 0.5, "high": 0.999}
    whole = metrics.quantiles(rows, "v", shares).withColumn("assay_id", F.lit(None).cast("string"))
    both = metrics.quantiles(rows, "v", shares, ["assay_id"]).unionByName(whole)
    return both.select("assay_id", *(F.round(k, 6).alias(k) for k in shares))


# Intervals on chromosomes


def long_length(longest: int) -> Column:
    """Lengths of five kinds, by sv_id."""
    kind = F.col("sv_id") % 5
    return F.when(kind == 0, longest).when(kind == 1, 16_384).when(kind == 2, 3_000_000).when(kind == 3, 1).otherwise(700)


LONG = "SELECT sv_id, chrom, sv_start * 9000 AS s, sv_start * 9000 + CASE sv_id % 5 WHEN 0 THEN 240000000 WHEN 1 THEN 16384 WHEN 2 THEN 3000000 WHEN 3 THEN 1 ELSE 700 END AS e FROM svs"


@query("svs", sql=f"l AS ({LONG}) SELECT a.sv_id % 5 AS kind_a, b.sv_id % 5 AS kind_b, count(*) AS n, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS shared FROM l a JOIN l b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e GROUP BY 1, 2")
def overlaps_of_long_intervals(svs: DataFrame) -> DataFrame:
    """Overlaps of all pairs of intervals from one base to a whole chromosome."""
    rows = svs.select("sv_id", "chrom", (F.col("sv_start") * 9000).alias("s")).withColumn("e", F.col("s") + long_length(240_000_000))
    kind = F.col("sv_id") % 5
    found = joins.overlap_totals(rows, rows, kind, kind, "chrom", "s", "e")
    return found.select(F.col("a").alias("kind_a"), F.col("b").alias("kind_b"), "n", "shared")


@query("variants", "svs", sql="l AS (SELECT chrom, sv_start * 9000 AS s, sv_start * 9000 + CASE sv_id % 5 WHEN 0 THEN 20000000 WHEN 1 THEN 16384 WHEN 2 THEN 3000000 WHEN 3 THEN 1 ELSE 700 END AS e FROM svs) SELECT chrom, count(*) AS n FROM variants v WHERE EXISTS (SELECT 1 FROM l WHERE l.chrom = v.chrom AND v.pos * 9000 - 1 >= s AND v.pos * 9000 - 1 < e) GROUP BY 1")
def points_in_long_intervals(variants: DataFrame, svs: DataFrame) -> DataFrame:
    """Points inside intervals from one base to twenty million."""
    bed = svs.select("chrom", (F.col("sv_start") * 9000).alias("bed_start"), (F.col("sv_start") * 9000 + long_length(20_000_000)).alias("bed_end"))
    return joins.in_intervals(variants.withColumn("pos", F.col("pos") * 9000), bed).groupBy("chrom").agg(F.count("*").alias("n"))


# Models over many markers

TWO = """x AS (SELECT s.sample_id, CAST(s.phenotype AS DOUBLE) AS y, s.sample_id % 5 <> 0 AS train, coalesce(sum(dosage) FILTER (WHERE variant_id % 2 = 0), 0)::DOUBLE AS a, coalesce(sum(dosage) FILTER (WHERE variant_id % 2 = 1), 0)::DOUBLE AS b
FROM samples s LEFT JOIN genotypes USING (sample_id) GROUP BY ALL)"""


def two_markers(genotypes: DataFrame) -> DataFrame:
    """Even and odd variants as two markers."""
    return genotypes.groupBy(F.col("sample_id").alias("sample"), (F.col("variant_id") % 2).alias("marker")).agg(F.sum("dosage").alias("dosage"))


@query("samples", "genotypes", sql=f"""{TWO}, m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(a, a) + 100 AS aa, regr_sxx(b, b) + 100 AS bb, regr_sxy(a, b) AS ab, regr_sxy(y, a) AS ya, regr_sxy(y, b) AS yb FROM x WHERE train)
SELECT sample_id, round(my + (a - ma) * (bb * ya - ab * yb) / (aa * bb - ab * ab) + (b - mb) * (aa * yb - ab * ya) / (aa * bb - ab * ab), 4) AS prediction FROM x, m""")
def genomic_ridge(samples: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Ridge on two markers, whose solution SQL has in closed form; a fifth of the samples is predicted unseen."""
    phenotypes = samples.select(F.col("sample_id").alias("sample"), F.when(F.col("sample_id") % 5 != 0, F.col("phenotype").cast("double")).alias("y"))
    found = genomic.ridge_predictions(two_markers(genotypes), phenotypes, 100.0)
    return found.select(F.col("sample").alias("sample_id"), F.round("prediction", 4).alias("prediction"))


@query("samples", "genotypes")
def genomic_prediction(samples: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Ridge on all markers; four of five samples have a phenotype."""
    phenotypes = samples.select(F.col("sample_id").alias("sample"), F.when(F.col("sample_id") % 5 != 0, F.col("phenotype").cast("double")).alias("y"))
    rows = genotypes.select(F.col("sample_id").alias("sample"), F.col("variant_id").alias("marker"), "dosage")
    return genomic.ridge_predictions(rows, phenotypes, 50.0, tolerance=1e-8).select(F.col("sample").alias("sample_id"), F.round("prediction", 3).alias("prediction"))


@query("samples", "genotypes", sql=f"{TWO}, m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, sign(corr(a, b)) AS r FROM x) SELECT sample_id, round(abs((a - ma) / sa + r * (b - mb) / sb) / sqrt(2), 5) AS component FROM x, m")
def panel_component(samples: DataFrame, genotypes: DataFrame) -> DataFrame:
    """The first component of two standardised markers, and the samples projected on it again."""
    panel, rows = samples.select(F.col("sample_id").alias("sample")), two_markers(genotypes)
    found = genomic.principal_components(rows, panel, 1)
    return genomic.project(rows, panel, found).select(F.col("sample").alias("sample_id"), F.round(F.abs("pc1"), 5).alias("component"))


@query("assays", sql="SELECT model, count(*) AS n, count(*) FILTER (WHERE model = 'breaks') AS n_failed, CASE WHEN model = 'breaks' THEN 'ValueError: no model for this' END AS error, round(coalesce(avg(CASE model WHEN 'twice' THEN score * 2 WHEN 'row' THEN CAST(row_id AS DOUBLE) END), 0.0), 4) AS mean FROM assays, (VALUES ('twice'), ('row'), ('breaks')) m(model) GROUP BY 1")
def all_models(assays: DataFrame) -> DataFrame:
    """Three models in one pass, one of which fails."""

    def breaks(frame: pd.DataFrame) -> pd.Series:
        raise ValueError("no model for this")

    found = models.run_models(assays, {"twice": lambda x: x["score"] * 2, "row": lambda x: x["row_id"].astype(float), "breaks": breaks}, ["score", "row_id"], ["row_id"])
    means = found.groupBy("model").agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("mean"))
    return models.model_failures(found).join(means, "model")


@query("samples", sql="k AS (SELECT ancestry, CAST(phenotype AS DOUBLE) AS v, sum(CAST(phenotype AS DOUBLE)) OVER (PARTITION BY ancestry) AS t, count(*) OVER (PARTITION BY ancestry) AS n FROM samples) SELECT ancestry, round(avg(abs(v - (t - v) / nullif(n - 1, 0))), 4) AS mae, count(*) AS n FROM k GROUP BY 1")
def leave_one_out_error(samples: DataFrame) -> DataFrame:
    """How far a sample is from the mean of its group's others."""
    rows = splits.leave_one_out_means(samples.withColumn("v", F.col("phenotype").cast("double")), "v", ["ancestry"])
    return rows.groupBy("ancestry").agg(F.round(F.avg(F.abs(F.col("v") - F.col("expected"))), 4).alias("mae"), F.count("*").alias("n"))


# Reports


@query("tool_results", sql="SELECT tool_name, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'partial' ELSE 'ok' END AS status, count(*) AS n FROM tool_results GROUP BY ALL")
def statuses_of_tools(tool_results: DataFrame) -> DataFrame:
    errors = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    warnings = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
    return tool_results.groupBy("tool_name", results.tool_status(errors, warnings).alias("status")).agg(F.count("*").alias("n"))


@query("runs", sql="""r AS (SELECT run_no, model_name, CASE WHEN task_id LIKE '%all_snv' THEN 'temporal' ELSE 'zero_shot' END AS split_type, run_no % 90 AS n_samples, run_no % 4 <> 0 AS passed FROM runs),
f AS (SELECT run_no, 0 AS place, 'Model' AS field, model_name AS value FROM r UNION ALL SELECT run_no, 1, 'Split', split_type FROM r UNION ALL SELECT run_no, 2, 'N', CAST(n_samples AS STRING) FROM r UNION ALL SELECT run_no, 3, 'Anti-leakage', CASE WHEN passed THEN 'all passed' ELSE 'FAILED' END FROM r) SELECT * FROM f""")
def tier0_facts(runs: DataFrame) -> DataFrame:
    rows = runs.select("run_no", "model_name", F.when(F.col("task_id").endswith("all_snv"), "temporal").otherwise("zero_shot").alias("split_type"), (F.col("run_no") % 90).alias("n_samples"), (F.col("run_no") % 4 != 0).alias("leakage_passed"))
    return results.tier0_facts(rows)
