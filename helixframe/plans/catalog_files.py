"""Registered queries of readers, writers and report parsers: views are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import reports
from helixframe.functions import variants as V
from helixframe.operators import joins, panels, results, splits
from helixframe.plans.catalog import query, r6
from helixframe.shared import shared_dir
from helixframe.sources import tables


def fresh(df: DataFrame, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"


# Stores and tables


@query("runs", sql="SELECT run_no, model_name, round(estimate, 9) AS estimate, run_no * 2 AS n FROM runs WHERE task_id LIKE 'clinvar/all%'")
def stored_runs(runs: DataFrame) -> DataFrame:
    """Runs appended in two goes, read by the prefix of their task."""
    path = fresh(runs, "runs")
    value = F.struct(F.round("estimate", 9).alias("estimate"), F.lit(None).cast("double").alias("ci_lower"), F.lit(None).cast("double").alias("ci_upper"), (F.col("run_no") * 2).alias("n"))
    rows = runs.select("run_no", "task_id", "model_name", "ts", F.create_map(F.col("metric"), value).alias("metrics"))
    for odd in (0, 1):
        tables.append_runs(rows.where(F.col("run_no") % 2 == odd), path)
    found = tables.read_runs(runs.sparkSession, path, "clinvar/all")
    return found.select("run_no", "model_name", F.col("metrics")["auroc"]["estimate"].alias("estimate"), F.col("metrics")["auroc"]["n"].alias("n"))


@query("runs", sql="SELECT model_name, 'p/' || model_name AS path, count(*) AS n FROM runs GROUP BY 1")
def runs_with_predictions(runs: DataFrame) -> DataFrame:
    """Where predictions are, among other metadata."""
    rows = runs.select("model_name", F.create_map(F.lit("predictions_path"), F.lit("old"), F.lit("seed"), F.lit("1")).alias("metadata"))
    parts = [tables.with_predictions_path(rows.where(F.col("model_name") == m), f"p/{m}") for m in (f"m{i}" for i in range(6))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("model_name", F.col("metadata")["predictions_path"].alias("path")).agg(F.count("*").alias("n"))


@query("runs", sql="SELECT task_id, model_name, count(*) AS n, round(sum(estimate), 5) AS total FROM runs GROUP BY ALL")
def stored_predictions(runs: DataFrame) -> DataFrame:
    """Predictions in folders by task and model."""
    path = fresh(runs, "predictions")
    tables.save_predictions(runs.select("run_no", "task_id", "model_name", "estimate"), path)
    return runs.sparkSession.read.parquet(path).groupBy("task_id", "model_name").agg(F.count("*").alias("n"), F.round(F.sum("estimate"), 5).alias("total"))


@query("variants", "scores", sql="k AS (SELECT DISTINCT chrom, pos, ref, alt FROM variants) SELECT k.chrom, count(*) AS n, count(s.score) AS n_scored, round(sum(round(s.score, 6)), 4) AS total FROM k LEFT JOIN (SELECT * FROM scores WHERE chrom <> 'chr7') s USING (chrom, pos, ref, alt) GROUP BY 1")
def scores_by_chromosome(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """Score files in a folder for each chromosome; one chromosome has none."""
    path = fresh(scores, "scores")
    scores.where("chrom <> 'chr7'").withColumn("score", F.round("score", 6)).write.partitionBy("chrom").option("sep", "\t").option("header", True).csv(path)
    found = joins.lookup(variants.select(*V.KEY).distinct(), tables.read_partitioned_scores(scores.sparkSession, path))
    return found.groupBy("chrom").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"), F.round(F.sum("score"), 4).alias("total"))


@query("scores", sql="SELECT chrom, CASE WHEN llr <= -3 THEN 'deleterious' WHEN llr >= 0 THEN 'benign' ELSE 'uncertain' END AS class, count(*) AS n FROM (SELECT chrom, round(score * 8 - 5, 4) AS llr FROM scores WHERE pos % 7 <> 0) GROUP BY ALL")
def log_ratio_files(scores: DataFrame) -> DataFrame:
    """Log-ratio scores as text with comments and lines that are no numbers."""
    path = fresh(scores, "llr")
    value = F.when(F.col("pos") % 7 == 0, "llr").otherwise(F.round(F.col("score") * 8 - 5, 4).cast("string"))
    line = F.concat_ws("\t", *V.KEY, value)
    scores.select(F.explode(F.array(line, F.lit("#chrom\tpos"))).alias("value")).write.text(path)
    return tables.read_llr(scores.sparkSession, path).groupBy("chrom", V.llr_class(F.col("llr")).alias("class")).agg(F.count("*").alias("n"))


@query("scores", sql="SELECT chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions, min(class) AS least FROM (SELECT chrom, pos, CASE WHEN score >= 0.5 THEN 'high' ELSE 'low' END AS class FROM scores) GROUP BY 1")
def score_tables(scores: DataFrame) -> DataFrame:
    """A score table with classes, written and read as text columns."""
    path = fresh(scores, "table")
    tables.write_scores(scores.select(*V.KEY, "score", F.when(F.col("score") >= 0.5, "high").otherwise("low").alias("class")), path)
    found = tables.read_strings(scores.sparkSession, path)
    return found.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("positions"), F.min("class").alias("least"))


@query("scores", sql="SELECT chrom, count(*) AS n FROM scores WHERE score >= 0.25 GROUP BY 1")
def report_rows(scores: DataFrame) -> DataFrame:
    """A report as JSON lines."""
    path = fresh(scores, "report")
    tables.write_report(scores.where("score >= 0.25").groupBy("chrom").agg(F.count("*").alias("n")), path)
    return scores.sparkSession.read.schema("chrom string, n long").json(path)


@query("assays", sql="SELECT 's' || CAST(k AS STRING) AS sample, count(*) AS n, round(sum(round(score * k, 4)), 2) AS total FROM assays, range(1, 4) t(k) WHERE row_id % 5 <> 0 OR k <> 2 GROUP BY 1")
def beta_matrix(assays: DataFrame) -> DataFrame:
    """A wide matrix of probes and samples, one of which lacks values."""
    path = fresh(assays, "matrix")
    wide = [F.when((F.col("row_id") % 5 != 0) | F.lit(k != 2), F.round(F.col("score") * k, 4)).alias(f"s{k}") for k in (1, 2, 3)]
    assays.select(F.col("row_id").alias("probe"), *wide).write.option("header", True).option("sep", "\t").csv(path)
    found = tables.read_matrix(assays.sparkSession, path, sep="\t").where("beta IS NOT NULL")
    return found.groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("beta"), 2).alias("total"))


@query("samples", sql="SELECT CAST(sample_id AS STRING) AS IID, round(CAST(phenotype AS DOUBLE) / 100, 4) AS SCORE1_AVG, NULL::DOUBLE AS SCORE1_SUM, CASE WHEN sample_id % 3 <> 0 THEN sample_id * 2 END AS ALLELE_CT FROM samples")
def sample_scores(samples: DataFrame) -> DataFrame:
    """Scores of samples whose file lacks a column and some values."""
    path = fresh(samples, "sscore")
    rows = samples.select(F.col("sample_id").alias("#IID"), F.round(F.col("phenotype").cast("double") / 100, 4).alias("SCORE1_AVG"), F.when(F.col("sample_id") % 3 != 0, F.col("sample_id") * 2).alias("ALLELE_CT"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_sscore(samples.sparkSession, path)


@query("catalog", sql="SELECT rsid AS place, trait, round(pvalue, 12) AS pvalue FROM catalog UNION ALL SELECT rsid, upper(trait), NULL FROM catalog WHERE pos % 2 = 0")
def catalog_objects(catalog: DataFrame) -> DataFrame:
    """JSON objects from ids to lists of associations, read in parts of 2,000 bytes."""
    path = fresh(catalog, "catalog")
    one = F.struct("trait", F.round("pvalue", 12).alias("pvalue"))
    two = F.struct(F.upper("trait").alias("trait"), F.lit(None).cast("double").alias("pvalue"))
    entry = F.struct("rsid", F.when(F.col("pos") % 2 == 0, F.array(one, two)).otherwise(F.array(one)))
    # Some 500 ids to an object, however many there are, and an object to a file.
    objects = catalog.groupBy(F.floor(F.regexp_extract("rsid", r"(\d+)", 1).cast("long") / 500).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    objects.write.partitionBy("part").text(path)
    return tables.read_catalog(catalog.sparkSession, path, "place", 2000).select("place", "trait", F.round("pvalue", 12).alias("pvalue"))


# Report parsers


@query("samples", sql="SELECT sample_id, 'S' || CAST(sample_id AS STRING) AS sample, CASE sample_id % 3 WHEN 0 THEN 'No call' ELSE '*1/*2' END AS diplotype, CASE sample_id % 2 WHEN 0 THEN 'More' ELSE 'PASS' END AS filter FROM samples")
def star_alleles(samples: DataFrame) -> DataFrame:
    """Reports of one sample each; calls and filters may be missing."""
    ident = F.col("sample_id")
    call = F.when(ident % 3 != 0, "*1/*2")
    text = F.to_json(F.create_map(F.concat(F.lit("S"), ident.cast("string")), F.struct(call.alias("Diplotype"), F.when(ident % 2 == 0, "More").alias("Filter"))))
    return reports.star_alleles(samples.select("sample_id", text.alias("report"))).select("sample_id", "sample", "diplotype", "filter")


@query("variants", sql="l AS (SELECT l_orderkey AS id, 'L' || CAST(l_linenumber % 3 AS STRING) AS locus, arg_max(ref, row(l_linenumber, l_partkey, ref, alt)) AS one, arg_max(alt, row(l_linenumber, l_partkey, ref, alt)) AS two FROM variants GROUP BY ALL) SELECT id, locus, one, two, count(*) OVER (PARTITION BY id) AS n_loci FROM l")
def hla_types(variants: DataFrame) -> DataFrame:
    """Two alleles of each locus, the last line's."""
    lines = variants.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("L"), (F.col("l_linenumber") % 3).cast("string")).alias("locus"), F.col("ref").alias("allele_1"), F.col("alt").alias("allele_2"), F.struct("l_linenumber", "l_partkey", "ref", "alt").alias("line"))
    found = reports.hla_types(lines, "id", "line").select("id", "n_loci", F.explode("types").alias("locus", "a"))
    return found.select("id", "locus", F.col("a")[0].alias("one"), F.col("a")[1].alias("two"), "n_loci")


@query("samples", sql="SELECT sample_id, CASE sample_id % 3 WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'no_accepted_evidence' END AS state, CASE sample_id % 3 WHEN 1 THEN 2 ELSE 0 END AS n_accepted, CASE sample_id % 3 WHEN 1 THEN 'A' END AS best_level FROM samples")
def accepted_evidence(samples: DataFrame) -> DataFrame:
    ident = F.col("sample_id")
    item = lambda status, level: F.struct(F.lit(status).alias("status"), F.lit(level).alias("level"))
    items = F.when(ident % 3 == 1, F.array(item("accepted", "B"), item("ACCEPTED", "A"), item("rejected", "A"))).otherwise(F.array(item("submitted", "A")))
    variant = F.struct(F.array(F.struct(items.alias("evidence_items"))).alias("molecular_profiles"))
    text = F.to_json(F.struct(F.when(ident % 3 != 0, F.array(variant)).alias("variants")))
    return reports.accepted_evidence(samples.select("sample_id", text.alias("report"))).select("sample_id", "state", F.col("n_accepted").cast("int").alias("n_accepted"), "best_level")


@query("samples", sql="SELECT sample_id, 'D' || CAST(sample_id % 7 AS STRING) AS drug, CASE WHEN sample_id % 2 = 0 THEN 'strong' ELSE '' END AS classification, CAST(least(length(CAST(sample_id AS STRING)) * 200, 500) AS INTEGER) AS n_chars FROM samples")
def drug_recommendations(samples: DataFrame) -> DataFrame:
    """Advice in two forms, cut to its length."""
    ident = F.col("sample_id")
    advice = F.repeat(F.lit("x"), F.length(ident.cast("string")) * 200)
    name = F.concat(F.lit("D"), (ident % 7).cast("string"))
    one = F.to_json(F.struct(F.array(F.struct(name.alias("drug"), F.lit("strong").alias("classification"), advice.alias("recommendation"))).alias("drugs")))
    two = F.to_json(F.struct(F.array(F.struct(name.alias("drugName"), advice.alias("prescribingInfo"))).alias("drugReports")))
    found = reports.drug_recommendations(samples.select("sample_id", F.when(ident % 2 == 0, one).otherwise(two).alias("report")))
    return found.select("sample_id", "drug", "classification", F.length("recommendation").alias("n_chars"))


@query("runs", sql="SELECT run_no, 'auroc' AS metric, round(estimate, 9) AS value FROM runs UNION ALL SELECT run_no, 'half', round(estimate / 2, 9) FROM runs WHERE run_no % 2 = 0")
def flat_metrics(runs: DataFrame) -> DataFrame:
    """Metrics as a map of numbers, without those that are missing."""
    value = lambda v: F.struct(F.round(v, 9).alias("estimate"), F.lit(5).alias("n"))
    half = F.when(F.col("run_no") % 2 == 0, F.col("estimate") / 2)
    made = F.create_map(F.lit("auroc"), value(F.col("estimate")), F.lit("half"), value(half))
    return runs.select("run_no", F.explode(results.flat_metrics(made)).alias("metric", "value"))


@query("samples", sql="SELECT count(*) AS n, min('HP:' || lpad(CAST(sample_id AS STRING), 7, '0')) AS least FROM samples")
def phenotype_terms(samples: DataFrame) -> DataFrame:
    terms = samples.select(F.concat(F.lit("HP:"), F.lpad(F.col("sample_id").cast("string"), 7, "0")).alias("term"))
    return V.require_phenotype_terms(terms, "term").agg(F.count("*").alias("n"), F.min("term").alias("least"))


@query("assertions", sql="SELECT 'test' AS split, clinsig_simple, count(*) AS n FROM assertions GROUP BY ALL")
def zero_shot_split(assertions: DataFrame) -> DataFrame:
    return splits.zero_shot(assertions).groupBy("split", "clinsig_simple").agg(F.count("*").alias("n"))


@query("samples", sql="SELECT sample_id, signature, round(CASE signature WHEN 'a' THEN sample_id % 10 + 1 ELSE sample_id % 7 END, 2)::DOUBLE AS weight FROM samples, (VALUES ('a'), ('b')) s(signature)")
def fitted_signatures(samples: DataFrame) -> DataFrame:
    """Spectra made of two signatures: the fit finds how much of each."""
    spark = samples.sparkSession
    shares = [("a", "c1", 1.0), ("b", "c2", 0.75), ("b", "c3", 0.25)]
    catalogue = spark.createDataFrame(shares, "signature string, context string, share double")
    one, two = (F.col("sample_id") % 10 + 1).cast("double"), (F.col("sample_id") % 7).cast("double")
    counts = F.array(*(F.struct(F.lit(c).alias("context"), n.alias("n")) for c, n in (("c1", one), ("c2", two * 0.75), ("c3", two * 0.25))))
    spectra = samples.select("sample_id", F.explode(counts).alias("e")).select("sample_id", "e.context", "e.n")
    return panels.fit_signatures(spectra, catalogue, "sample_id", 400).select("sample_id", "signature", r6("weight", F.round("count", 2)))
