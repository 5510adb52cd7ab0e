"""Registered queries of readers over text, and of models whose fits have a closed form, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import variants as V
from helixframe.operators import joins, metrics, models, results, splits
from helixframe.plans.catalog import RANKS, query, r6
from helixframe.sources import tables

# Readers


@query("variants", "scores", sql="SELECT chrom, count(*) AS n, round(sum(round(score, 6)), 4) AS total FROM scores WHERE pos % 5 <> 0 GROUP BY 1")
def pathogenicity_lines(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """A score table as lines: a comment, broken lines, and scores that are no numbers are left out."""
    score = F.when(F.col("pos") % 5 == 0, "score").otherwise(F.round("score", 6).cast("string"))
    line = F.concat_ws("\t", "chrom", "pos", "ref", "alt", F.lit("a"), F.lit("b"), F.lit("ENST1"), score, F.lit("class"))
    lines = scores.select(F.explode(F.array(line, F.lit("#chrom"), F.lit("short\tline"))).alias("value"))
    return tables.delimited(lines, tables.PATHOGENICITY_FIELDS, 8).groupBy("chrom").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("assertions", sql="SELECT CAST(variation_id % 22 + 1 AS STRING) AS chrom, count(*) AS n, count(*) FILTER (WHERE variation_id % 2 = 0) AS n_explained, round(sum(CASE WHEN variation_id % 3 = 0 THEN NULL ELSE round(score, 6) END), 4) AS total FROM assertions GROUP BY 1")
def clinical_index_lines(assertions: DataFrame) -> DataFrame:
    """An index with eight fields and sometimes a ninth; a score may be empty."""
    ident = F.col("variation_id")
    score = F.when(ident % 3 == 0, "").otherwise(F.round("score", 6).cast("string"))
    line = F.concat_ws("\t", ident % 22 + 1, ident, F.lit("A"), F.lit("C"), "gene_symbol", F.lit("missense"), score, F.lit("benign"), F.when(ident % 2 == 0, "text"))
    rows = tables.delimited(assertions.select(line.alias("value")), tables.INDEX_FIELDS, 8)
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), F.count("explanation").alias("n_explained"), F.round(F.sum(F.col("score").try_cast("double")), 4).alias("total"))


@query("assertions", sql="SELECT gene_symbol, count(*) AS n, CAST(min(CAST(last_evaluated AS DATE)) AS STRING) AS first_day FROM assertions WHERE variation_id % 3 <> 0 AND variation_id % 4 <> 0 GROUP BY 1")
def variant_summaries(assertions: DataFrame) -> DataFrame:
    """One assembly of two, dates in two forms or none."""
    ident = F.col("variation_id")
    day = F.when(ident % 4 == 0, "-").when(ident % 4 == 1, F.date_format("last_evaluated", "MMM dd, yyyy")).otherwise(F.date_format("last_evaluated", "yyyy-MM-dd"))
    rows = assertions.select("gene_symbol", F.when(ident % 3 == 0, "GRCh37").otherwise("GRCh38").alias("Assembly"), day.alias("LastEvaluated"))
    return tables.variant_summaries(rows).groupBy("gene_symbol").agg(F.count("*").alias("n"), F.min("last_evaluated").cast("string").alias("first_day"))


@query("vcf_lines", sql="""e AS (SELECT string_split(value, chr(9)) AS p, regexp_extract(value, 'SpliceAI=([^|;]*)[|]([^|]*)[|]([^|]*)[|]([^|]*)[|]([^|]*)[|]([^|]*)[|]', ['a', 'g', 's1', 's2', 's3', 's4']) AS m FROM vcf_lines)
SELECT 'chr' || p[1] AS chrom, m.a AS alt, count(*) AS n, round(sum(greatest(CAST(m.s1 AS DOUBLE), CAST(m.s2 AS DOUBLE), CAST(m.s3 AS DOUBLE), CAST(m.s4 AS DOUBLE))), 4) AS total FROM e GROUP BY ALL""")
def splice_scan(vcf_lines: DataFrame) -> DataFrame:
    """Two files of predictions as one table."""
    one, two = vcf_lines.where("line_no % 3 = 0").select("value"), vcf_lines.where("line_no % 3 <> 0").select("value")
    return tables.splice_scan(one, two).groupBy("chrom", "alt").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("assertions", sql="SELECT CAST(variation_id % 22 + 1 AS STRING) AS chrom, count(*) AS n, CAST(sum(variation_id) AS BIGINT) AS positions FROM assertions GROUP BY 1")
def fuzzy_columns(assertions: DataFrame) -> DataFrame:
    """Columns found by words in their names."""
    rows = assertions.select((F.col("variation_id") % 22 + 1).cast("string").alias("Chromosome (hg19)"), F.col("variation_id").alias("Position [bp]"), F.lit("x").alias("func.class"))
    named = tables.named_columns(rows, {"chrom": ("chrom",), "pos": ("position", "pos"), "label": ("class",)})
    return named.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


@query("variants", sql="k AS (SELECT chrom, pos, ref, min(alt) AS alt FROM variants GROUP BY ALL HAVING count(DISTINCT alt) = 1) SELECT chrom, pos, concat_ws(':', chrom, CAST(pos AS STRING), ref, alt) AS variant_id FROM k WHERE length(ref) = 1 AND length(alt) = 1")
def biallelic_sites(variants: DataFrame) -> DataFrame:
    return V.biallelic_sites(variants).select("chrom", "pos", "variant_id")


@query("variants", sql="SELECT chrom, count(*) AS n, CAST(sum(l + 1847983) AS BIGINT) AS shifted FROM (SELECT v.chrom, v.pos AS l FROM variants v WHERE length(ref) = 1) GROUP BY 1")
def lifted_positions(variants: DataFrame) -> DataFrame:
    return variants.where(V.is_snv()).groupBy("chrom").agg(F.count("*").alias("n"), F.sum(V.shifted_position(F.col("pos"))).alias("shifted"))


@query("runs", sql="SELECT 'm' || CAST(k AS STRING) AS model_name, CASE k WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.6 WHEN 3 THEN 0.7 END AS best FROM range(1, 4) t(k) WHERE EXISTS (SELECT 1 FROM runs)")
def upserted_baselines(runs: DataFrame) -> DataFrame:
    """Best known values by model: one changed, one added, one left."""
    make = runs.sparkSession.createDataFrame
    known = runs.where("model_name IN ('m1', 'm2')").select("model_name").distinct().withColumn("best", F.when(F.col("model_name") == "m1", 0.5).otherwise(0.1))
    return results.upsert(known, make([("m2", 0.6), ("m3", 0.7)], "model_name string, best double"), ["model_name"])


@query("runs", sql="k AS (SELECT task_id, model_name, avg(estimate) FILTER (WHERE run_no % 2 = 0) AS old, max(estimate) FILTER (WHERE run_no % 3 = 0) AS new FROM runs GROUP BY ALL) SELECT task_id, model_name, round(coalesce(new, old), 6) AS best FROM k WHERE coalesce(new, old) IS NOT NULL")
def upserted_results(runs: DataFrame) -> DataFrame:
    """Means of the even runs, replaced or joined by the best of every third run."""
    keys = ["task_id", "model_name"]
    known = runs.where("run_no % 2 = 0").groupBy(*keys).agg(F.avg("estimate").alias("best"))
    return results.upsert(known, runs.where("run_no % 3 = 0").groupBy(*keys).agg(F.max("estimate").alias("best")), keys).select(*keys, r6("best"))


@query("runs", sql="SELECT 'model_name' AS \"column\", model_name AS value FROM runs UNION SELECT 'task_id', task_id FROM runs")
def distinct_values(runs: DataFrame) -> DataFrame:
    return results.distinct_values(runs, ["model_name", "task_id"])


@query("tool_results", sql="SELECT 'population_source' AS \"check\", count(*) FILTER (WHERE run_id LIKE '%7') = 0 AS passed, count(*) FILTER (WHERE run_id LIKE '%7') AS violations FROM tool_results")
def population_source_check(tool_results: DataFrame) -> DataFrame:
    source = F.when(F.col("run_id").endswith("7"), "Self-Reported").when(F.col("run_id").endswith("3"), "PCA").otherwise("other")
    return splits.check_population_source(tool_results.withColumn("source", source), "source")


@query("variants", "scores", sql="""q AS (SELECT DISTINCT chrom, pos, ref, alt FROM variants WHERE filter IS NULL OR filter = 'PASS'), j AS (SELECT s.chrom IS NOT NULL AS t, q.chrom IS NOT NULL AS q, coalesce(s.ref, q.ref) AS ref FROM scores s FULL JOIN q ON q.chrom = s.chrom AND q.pos = s.pos AND q.ref = s.ref AND q.alt = s.alt),
c AS (SELECT ref, CAST(count(*) FILTER (WHERE t AND q) AS DOUBLE) AS tp, count(*) FILTER (WHERE NOT t) AS fp, count(*) FILTER (WHERE NOT q) AS fn FROM j GROUP BY 1)
SELECT ref AS base, 'precision' AS metric, round(tp / (tp + fp), 6) AS value FROM c UNION ALL SELECT ref, 'recall', round(tp / (tp + fn), 6) FROM c UNION ALL SELECT ref, 'f1', round(2 * tp / (2 * tp + fp + fn), 6) FROM c""")
def prf_as_rows(variants: DataFrame, scores: DataFrame) -> DataFrame:
    found = joins.compare_sets(scores.select(*V.KEY), variants.where(V.passes(F.col("filter"))).select(*V.KEY), by={"base": F.col("ref")})
    return results.unpivot_counts(found, "base").select("base", "metric", r6("value"))


@query("assays", sql=f"{RANKS}, e AS (SELECT min(rho) AS lo, max(rho) AS hi FROM s), k AS (SELECT assay_id, rho, row_number() OVER (ORDER BY rho, assay_id) AS up, row_number() OVER (ORDER BY rho DESC, assay_id) AS down FROM s) SELECT assay_id, round(rho, 6) AS rho, up <= 10 AS bottom, CAST(least(floor((rho - lo) / ((hi - lo) / 8)), 7) AS BIGINT) AS bin FROM k, e WHERE up <= 10 OR down <= 10")
def assay_extremes(assays: DataFrame) -> DataFrame:
    """The ten least and the ten greatest correlations, and the bin of a histogram of all that each falls in."""
    rho = metrics.spearman(assays, "dms_score", "score", ["assay_id"]).select("assay_id", F.col("estimate").alias("rho"))
    low, high = rho.orderBy("rho", "assay_id").limit(10), rho.orderBy(F.col("rho").desc(), "assay_id").limit(10)
    both = low.withColumn("bottom", F.lit(True)).unionByName(high.withColumn("bottom", F.lit(False))).groupBy("assay_id", "rho").agg(F.bool_or("bottom").alias("bottom"))
    ends = rho.agg(F.min("rho").alias("lo"), F.max("rho").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 8
    return both.crossJoin(F.broadcast(ends)).select("assay_id", r6("rho"), "bottom", F.least(F.floor((F.col("rho") - F.col("lo")) / width), F.lit(7)).alias("bin"))  # ends is one row


# Models


@query("assays", sql="SELECT assay_id, row_id, round(score * 2 + row_id % 3, 6) AS prediction FROM assays")
def callable_model(assays: DataFrame) -> DataFrame:
    """Any function of batches as a model."""

    def predict(frame: pd.DataFrame) -> pd.Series:
        return frame["score"] * 2 + frame["row_id"] % 3

    return models.with_predictions(assays, predict, ["score", "row_id"]).select("assay_id", "row_id", r6("prediction"))


@query("assays", sql="m AS (SELECT regr_sxy(CAST(dms_score AS DOUBLE) / 1000, score) / (regr_sxx(CAST(dms_score AS DOUBLE) / 1000, score) + 1) AS slope, avg(CAST(dms_score AS DOUBLE) / 1000) AS my, avg(score) AS mx FROM assays) SELECT round(slope, 4) AS slope, round(my - slope * mx, 4) AS intercept FROM m")
def ridge_line(assays: DataFrame) -> DataFrame:
    """Ridge of one feature, whose solution is Sxy / (Sxx + alpha)."""
    model = models.ridge(assays.select((F.col("dms_score") / 1000).alias("y"), "score"), "y", ["score"], 1.0)
    made = assays.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    return made.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("assays", sql="c AS (SELECT corr(CAST(dms_score AS DOUBLE), score) AS ys, corr(CAST(dms_score AS DOUBLE), CAST(row_id % 11 AS DOUBLE)) AS yc, corr(score, CAST(row_id % 11 AS DOUBLE)) AS sc FROM assays) SELECT round((ys * ys + yc * yc - 2 * ys * yc * sc) / (1 - sc * sc) - yc * yc, 6) AS incremental FROM c")
def incremental_r2_with_covariate(assays: DataFrame) -> DataFrame:
    """With one covariate, R2 follows from three correlations."""
    rows = assays.select(F.col("dms_score").cast("double").alias("y"), "score", (F.col("row_id") % 11).cast("double").alias("c"))
    return assays.sparkSession.createDataFrame([(round(models.incremental_r2(rows, "y", "score", ["c"]), 6),)], "incremental double")


@query("assays", sql="m AS (SELECT regr_slope(CAST(dms_score AS DOUBLE), score) AS s, regr_intercept(CAST(dms_score AS DOUBLE), score) AS i FROM assays) SELECT row_id, round(CAST(dms_score AS DOUBLE) - s * score - i, 3) AS residual FROM assays, m")
def residuals_on_a_covariate(assays: DataFrame) -> DataFrame:
    found = models.residuals(assays.withColumn("dms_score", F.col("dms_score").cast("double")), "dms_score", ["score"])
    return found.select("row_id", F.round("residual", 3).alias("residual"))


@query("assays", sql="m AS (SELECT avg(score) AS ma, stddev_samp(score) AS sa, avg(CAST(dms_score AS DOUBLE)) AS mb, stddev_samp(CAST(dms_score AS DOUBLE)) AS sb, sign(corr(score, CAST(dms_score AS DOUBLE))) AS r FROM assays) SELECT row_id, round(abs((score - ma) / sa + r * (dms_score - mb) / sb) / sqrt(2), 5) AS first_component FROM assays, m")
def first_component(assays: DataFrame) -> DataFrame:
    """The first component of two standardised features is their sum or difference over the root of 2."""
    rows = assays.withColumn("dms_score", F.col("dms_score").cast("double"))
    from pyspark.ml.functions import vector_to_array

    found = models.principal_components(rows, rows, ["score", "dms_score"], 1)
    return found.select("row_id", F.round(F.abs(vector_to_array("pc")[0]), 5).alias("first_component"))


@query("assertions", sql="SELECT 0.0::DOUBLE AS sum_of_errors, 0.0::DOUBLE AS sum_of_weighted_errors")
def calibration_line(assertions: DataFrame) -> DataFrame:
    """Where the fit is best, its errors sum to 0, and so do errors times the logit."""
    rows = assertions.where(F.col("clinsig_simple").isin(0, 1)).select("clinsig_simple", F.least(F.greatest(F.col("score"), F.lit(0.01)), F.lit(0.99)).alias("score"))
    slope, intercept = metrics.calibration_line(rows, "clinsig_simple", "score")
    x = V.logit(F.col("score"))
    error = F.col("clinsig_simple") - 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * x)))
    return rows.agg(F.abs(F.round(F.sum(error), 4)).alias("sum_of_errors"), F.abs(F.round(F.sum(error * x), 4)).alias("sum_of_weighted_errors"))
