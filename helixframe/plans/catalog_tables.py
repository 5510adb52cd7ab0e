"""Registered queries of annotation joins, summaries of tool tables, result reports and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import reports
from helixframe.functions import variants as V
from helixframe.operators import bootstrap, cohort, joins, metrics, results, splits, studies
from helixframe.plans.catalog import AUC, GROUPED, SPLIT, counted, labelled_samples, query, r6
from helixframe.shared import settled
from helixframe.sources import tables

# Annotation joins


@query("variants", sql="""t AS (SELECT chrom, pos, ref, alt, l_partkey AS transcript, filter AS review, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY l_orderkey, l_linenumber, l_partkey, coalesce(filter, '')) AS rn FROM variants WHERE l_partkey % 3 = 0),
j AS (SELECT v.chrom, t.transcript, t.review, t.chrom IS NOT NULL AS found FROM variants v LEFT JOIN t ON t.rn = 1 AND t.chrom = v.chrom AND t.pos = v.pos AND t.ref = v.ref AND t.alt = v.alt)
SELECT chrom, CASE WHEN found THEN 'found' ELSE 'not_found' END AS status, count(*) AS n, count(review) AS n_reviewed, CAST(sum(transcript) AS BIGINT) AS transcripts FROM j GROUP BY ALL""")
def first_match_annotation(variants: DataFrame) -> DataFrame:
    """Several columns of the first entry of each key, and not_found."""
    table = variants.where("l_partkey % 3 = 0").select(*V.KEY, F.col("l_partkey").alias("transcript"), F.col("filter").alias("review"), "l_orderkey", "l_linenumber")
    found = joins.annotate(variants.select(*V.KEY), table, ["transcript", "review"], ["l_orderkey", "l_linenumber", "transcript", F.coalesce("review", F.lit(""))])
    return found.groupBy("chrom", "status").agg(F.count("*").alias("n"), F.count("review").alias("n_reviewed"), F.sum("transcript").alias("transcripts"))


@query("variants", "scores", sql="""a AS (SELECT substr(chrom, 4) AS chrom, pos, ref, unnest([alt, ref]) AS alt FROM variants), i AS (SELECT substr(chrom, 4) AS chrom, pos, ref, alt, score FROM scores),
h AS (SELECT a.*, score FROM a JOIN i USING (chrom, pos, ref, alt)) SELECT chrom, count(*) AS n_found, (SELECT count(*) FROM variants) AS n_queried, round(sum(score), 4) AS total FROM h GROUP BY 1""")
def clinical_index_hits(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """Alleles of records found in an index without prefixes; records and alleles are counted apart."""
    records = variants.select("chrom", "pos", "ref", F.array("alt", "ref").alias("alts"))
    hits, counts = joins.clinical_hits(records, scores, ["score"], [F.col("score").desc()])
    return hits.groupBy("chrom").agg(F.count("*").alias("n_found"), F.round(F.sum("score"), 4).alias("total")).withColumn("n_queried", counts.select("n_queried").scalar()).select("chrom", "n_found", "n_queried", "total")


@query("vcf_lines", sql="""f AS (SELECT string_split(value, chr(9)) AS p FROM vcf_lines), e AS (SELECT 'chr' || p[1] AS chrom, CAST(p[2] AS BIGINT) AS pos, p[4] AS ref, unnest(string_split(p[5], ',')) AS alt FROM f),
v AS (SELECT * FROM e WHERE alt NOT IN ('*', '.')), k AS (SELECT DISTINCT chrom, pos, ref, alt FROM v WHERE pos % 4 <> 0),
s AS (SELECT *, CASE WHEN length(alt) = 1 THEN greatest(pos % 10, pos % 7) ELSE pos % 10 END / 10.0::DOUBLE AS score FROM k)
SELECT length(v.alt) = 1 AS snv, count(*) AS n, count(score) AS n_scored, round(sum(score), 4) AS total FROM v LEFT JOIN s USING (chrom, pos, ref, alt) GROUP BY 1""")
def splice_snv_and_indel(vcf_lines: DataFrame) -> DataFrame:
    """Single bases from one table, all others from another one, which lacks a delta; records that don't pass too."""
    # Lines are parsed once, and each distinct variant is looked up once, however many rows it has.
    rows = settled(tables.vcf_variants(vcf_lines, pass_only=False).groupBy(*V.KEY).agg(F.count("*").alias("rows")))
    keys = rows.select(*V.KEY).where("pos % 4 <> 0")
    delta = lambda n: ((F.col("pos") % n) / F.lit(10.0)).alias(f"d{n}")
    found = joins.splice_scores(rows, keys.select(*V.KEY, delta(10), delta(7)), keys.select(*V.KEY, delta(10)), ("d10", "d7"))
    scored = F.when(F.col("score").isNotNull(), F.col("rows")).otherwise(0)
    return found.groupBy(V.is_snv().alias("snv")).agg(F.sum("rows").alias("n"), F.sum(scored).alias("n_scored"), F.round(F.sum(F.col("score") * F.col("rows")), 4).alias("total"))


@query("variants", "catalog", sql="""v AS (SELECT chrom, pos, CASE WHEN l_partkey % 3 = 0 THEN concat('rs', CAST(l_partkey AS STRING)) END AS rsid FROM variants),
p AS (SELECT DISTINCT c.* FROM catalog c JOIN v ON v.chrom = c.chrom AND v.pos = c.pos), pp AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, trait ORDER BY coalesce(nullif(pvalue, 0), 1), rsid) AS rn FROM p),
r AS (SELECT DISTINCT c.* FROM catalog c JOIN v ON v.rsid = c.rsid)
SELECT 'position' AS matched_by, rsid, trait FROM pp WHERE rn = 1 UNION ALL SELECT 'rsid', rsid, trait FROM r""")
def catalog_hits_both_ways(variants: DataFrame, catalog: DataFrame) -> DataFrame:
    rsid = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("rs"), F.col("l_partkey").cast("string")))
    return joins.catalog_hits_both_ways(variants.select("chrom", "pos", rsid.alias("rsid")), catalog).select("matched_by", "rsid", "trait")


@query("variants", "bed", sql="SELECT chrom, count(*) AS n FROM variants v WHERE EXISTS (SELECT 1 FROM bed b WHERE b.chrom = v.chrom AND v.pos >= bed_start AND v.pos <= bed_end AND bed_start > 0) GROUP BY 1")
def region_filter(variants: DataFrame, bed: DataFrame) -> DataFrame:
    """Regions that count from 1, both ends inside."""
    regions = bed.where("bed_start > 0").select("chrom", F.col("bed_start").alias("start"), F.col("bed_end").alias("end"))
    return joins.in_regions(variants, regions).groupBy("chrom").agg(F.count("*").alias("n"))


CSQ_HEADER = '##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence annotations. Format: Allele|SYMBOL|Amino_acids|Protein_position">'
CHANGES = """f AS (SELECT row_id, string_split(csq, '|') AS p FROM csq), g AS (SELECT row_id, p[1] AS gene, string_split(p[2], '/')[1] || p[3] || string_split(p[2], '/')[2] AS change FROM f WHERE contains(p[2], '/')
  UNION ALL SELECT row_id, p[1] || 'B', 'M' || p[3] || 'K' FROM f)"""


@query("csq", sql=f"{CHANGES} SELECT gene, change, min(row_id) AS pos, count(*) AS n FROM g GROUP BY ALL")
def csq_transcripts(csq: DataFrame) -> DataFrame:
    """Two transcripts of each record, their fields named by the header line."""
    return _changes(csq)


def _changes(csq: DataFrame) -> DataFrame:
    p = F.split("csq", r"\|")
    info = F.concat(F.lit("DP=3;CSQ=A|"), "csq", F.lit(",A|"), p[0], F.lit("B|M/K|"), p[2], F.lit("-9,A|short;END=1"))
    return joins.protein_changes(csq.withColumn("pos", F.col("row_id")), V.csq_entries(info, V.csq_fields(CSQ_HEADER)))


@query("csq", sql=f"""{CHANGES}, c AS (SELECT DISTINCT gene, change FROM g), e1 AS (SELECT gene, change, min('LEVEL_' || CAST(row_id % 3 AS STRING)) AS level_1, bool_or(row_id % 3 = 0) AS therapeutic_1 FROM g WHERE row_id % 5 = 0 GROUP BY ALL),
e2 AS (SELECT gene, change, min(chr(CAST(65 + row_id % 4 AS INT))) AS level_2, bool_or(row_id % 2 = 0) AS therapeutic_2 FROM g WHERE row_id % 7 = 0 GROUP BY ALL)
SELECT gene, change, level_1, therapeutic_1, level_2, therapeutic_2 FROM c LEFT JOIN e1 USING (gene, change) LEFT JOIN e2 USING (gene, change)""")
def evidence_lookup(csq: DataFrame) -> DataFrame:
    """Two evidence tables for each distinct protein change."""
    p = F.split("csq", r"\|")
    both = F.array(F.struct(p[0].alias("gene"), V.protein_change(p[1], p[2]).alias("change")), F.struct(F.concat(p[0], F.lit("B")).alias("gene"), F.concat(F.lit("M"), p[2], F.lit("K")).alias("change")))
    rows = csq.select("row_id", F.explode(both).alias("e")).select("row_id", "e.*").where(F.col("change").isNotNull())
    first = rows.where("row_id % 5 = 0").select("gene", "change", F.concat(F.lit("LEVEL_"), (F.col("row_id") % 3).cast("string")).alias("level"), (F.col("row_id") % 3 == 0).alias("therapeutic"))
    second = rows.where("row_id % 7 = 0").select("gene", "change", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("row_id") % 4 + 1).cast("int")).alias("level"), (F.col("row_id") % 2 == 0).alias("therapeutic"))
    return joins.evidence_for(_changes(csq).select("gene", "change"), first, second)


@query("variants", "scores", sql="SELECT v.chrom, pos, ref, alt, round(score, 6) AS score FROM (SELECT DISTINCT chrom, pos, ref, alt FROM variants) v JOIN scores USING (chrom, pos, ref, alt) WHERE score > 0.564 ORDER BY chrom, pos, ref, alt LIMIT 200")
def first_interesting_variants(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """The report's first 200 by place."""
    found = joins.lookup(variants.select(*V.KEY).distinct(), scores)
    kind = F.concat(F.upper(F.substring(V.pathogenicity_class(F.col("score")), 1, 1)), F.substring(V.pathogenicity_class(F.col("score")), 2, 40))
    return joins.first_interesting(found.withColumn("kind", kind), V.is_interesting(F.col("kind")), 200).select("chrom", "pos", "ref", "alt", r6("score"))


# Fields and lines

TRAITS = ("Hypertension", "Lupus erythematosus", "Urate levels", "BMI", "Height", "Heart failure", "Metabolic syndrome", "C-reactive protein")


@query("catalog", sql="t AS (SELECT CAST(substr(rsid, 3) AS BIGINT) % 8 AS k FROM catalog) SELECT CASE WHEN k IN (0, 1, 5) THEN 'health' WHEN k IN (2, 3) THEN 'biomarker' ELSE 'trait' END AS category, count(*) AS n FROM t GROUP BY 1")
def trait_categories(catalog: DataFrame) -> DataFrame:
    at = (F.substring("rsid", 3, 20).cast("bigint") % len(TRAITS) + 1).cast("int")
    return catalog.groupBy(V.trait_category(F.element_at(F.array(*map(F.lit, TRAITS)), at)).alias("category")).agg(F.count("*").alias("n"))


@query("bed", sql="SELECT chrom, bed_start, bed_end, count(*) AS n FROM bed GROUP BY ALL")
def bed_lines(bed: DataFrame) -> DataFrame:
    """Intervals written as lines, with comments and broken lines among them, and read back."""
    line = F.concat_ws("\t", F.regexp_replace("chrom", "^chr", ""), "bed_start", "bed_end", F.lit("name"))
    lines = bed.select(F.explode(F.array(line, F.lit("#note"), F.lit("track x"), F.lit("chr1 5"), F.lit("chr1 a b"))).alias("value"))
    return tables.bed_intervals(lines).groupBy("chrom", "bed_start", "bed_end").agg(F.count("*").alias("n"))


@query("assertions", sql="""SELECT variation_id, variation_id % 3 <> 0 AND variation_id % 7 <> 0 AS valid, CASE variation_id % 4 WHEN 0 THEN NULL ELSE CAST(last_evaluated AS DATE) END AS day, CASE WHEN variation_id % 5 = 0 THEN 'task' ELSE 'task/hard' END AS task,
round(ln(least(greatest(score, 1e-10), 1 - 1e-10) / (1 - least(greatest(score, 1e-10), 1 - 1e-10))), 6) AS logit, printf('%.3f (%.3f–%.3f)', score, score - 0.1, score + 0.1) AS shown, CASE WHEN variation_id % 2 = 0 THEN 1 WHEN variation_id % 3 = 0 THEN NULL ELSE 0 END AS lof,
CAST(least(10, greatest(2, floor(variation_id / 10))) AS BIGINT) AS parts, CASE WHEN variation_id % 6 = 0 THEN NULL ELSE variation_id % 90 END AS position FROM assertions""")
def parsed_fields(assertions: DataFrame) -> DataFrame:
    """Terms, dates in four forms, task names, logits, interval texts, functional labels, mutations."""
    ident = F.col("variation_id")
    term = F.when(ident % 3 == 0, "HP:12").when(ident % 7 == 0, "hp:0000001").otherwise(F.concat(F.lit("HP:"), F.lpad((ident % 10_000_000).cast("string"), 7, "0")))
    day = F.when(ident % 4 == 0, "no date").when(ident % 4 == 1, F.date_format("last_evaluated", "yyyy-MM-dd")).when(ident % 4 == 2, F.date_format("last_evaluated", "MMM dd, yyyy")).otherwise(F.date_format("last_evaluated", "yyyyMMdd"))
    kind = F.when(ident % 2 == 0, " lof ").when(ident % 3 == 0, "INT").otherwise("func")
    mutation = F.when(ident % 6 == 0, "A-1T").otherwise(F.concat(F.lit("A"), (ident % 90).cast("string"), F.lit("T")))
    config = F.when(ident % 5 == 0, "default").otherwise("hard")
    return assertions.select(
        "variation_id",
        V.valid_phenotype_term(term).alias("valid"),
        V.parsed_date(day).alias("day"),
        V.task_id(F.lit("task"), config).alias("task"),
        r6("logit", V.logit(F.col("score"))),
        V.interval_text(F.col("score"), F.col("score") - 0.1, F.col("score") + 0.1).alias("shown"),
        V.functional_label(kind, include_intermediate=False).alias("lof"),
        V.component_count(F.lit(10), ident).cast("bigint").alias("parts"),
        V.mutation_parts(mutation)["position"].cast("bigint").alias("position"),
    )


@query("samples", sql="""SELECT sample_id, 'CYP' || CAST(sample_id % 5 AS STRING) AS gene, CASE WHEN sample_id % 4 = 3 THEN '*2/*3' WHEN sample_id % 4 = 2 THEN '' ELSE '*1/*4' END AS diplotype, CASE WHEN sample_id % 4 IN (2, 3) THEN NULL ELSE '1.0' END AS activity_score,
CASE WHEN sample_id % 4 = 1 THEN 'slow' ELSE 'normal' END AS phenotype FROM samples""")
def diplotype_calls(samples: DataFrame) -> DataFrame:
    """Reports in three forms, one locus each, read as rows."""
    ident = F.col("sample_id")
    name = F.concat(F.lit('"CYP'), (ident % 5).cast("string"), F.lit('"'))
    first = F.concat(F.lit('{"calls": [{"gene": '), name, F.lit(', "recommendationDiplotypes": [{"label": "*1/*4", "activityScore": "1.0"}], "phenotype": "normal"}], "geneCalls": [{"gene": "X"}]}'))
    second = F.concat(F.lit('{"calls": [], "reportContext": {"geneReports": [{"geneSymbol": '), name, F.lit(', "recommendationDiplotypes": [{"label": "*1/*4", "activityScore": "1.0"}, {"label": "*9"}], "phenotypes": {"term": "slow"}}]}}'))
    third = F.concat(F.lit('{"geneCalls": [{"gene": '), name, F.lit(', "phenotype": "normal"}, {"phenotype": "nameless"}]}'))
    fourth = F.concat(F.lit('{"geneCalls": [{"gene": '), name, F.lit(', "recommendationDiplotypes": [], "printDiplotype": "*2/*3", "phenotype": "normal"}]}'))
    text = F.when(ident % 4 == 0, first).when(ident % 4 == 1, second).when(ident % 4 == 2, third).otherwise(fourth)
    return reports.diplotype_calls(samples.select("sample_id", text.alias("report")), ("$.calls", "$.reportContext.geneReports", "$.geneCalls"))


# Metrics with intervals


def _bounded(found: DataFrame) -> DataFrame:
    """Intervals are random; that they hold the estimate and are neither empty nor wide is not."""
    return found.withColumn("inside", (F.col("ci_lower") < F.col("estimate")) & (F.col("estimate") < F.col("ci_upper")))


@query("assays", sql="SELECT assay_id, round(corr(CAST(dms_score AS DOUBLE), score), 6) AS estimate, count(*) AS n, true AS inside FROM assays GROUP BY 1")
def pearson_bootstrap(assays: DataFrame) -> DataFrame:
    return _bounded(bootstrap.pearson_interval(assays, "row_id", "dms_score", "score", ["assay_id"], replicates=200)).select("assay_id", r6("estimate"), "n", "inside")


INCREMENTAL = "SELECT assay_id, round((sum((y - b) * (y - b)) - sum((y - f) * (y - f))) / (var_pop(y) * count(*)), 6) AS estimate, count(*) AS n"


@query("assays", sql=f"r AS (SELECT assay_id, CAST(dms_score AS DOUBLE) AS y, 150000.0::DOUBLE AS b, 140000 + score * 20000 AS f FROM assays) {INCREMENTAL} FROM r GROUP BY 1")
def incremental_r2_by_assay(assays: DataFrame) -> DataFrame:
    rows = assays.withColumns({"b": F.lit(150000.0), "f": F.lit(140000) + F.col("score") * 20000})
    return metrics.incremental_r2(rows, "dms_score", "f", "b", ["assay_id"]).select("assay_id", r6("estimate"), "n")


@query("assays", sql=f"r AS (SELECT 'all' AS assay_id, CAST(dms_score AS DOUBLE) AS y, 150000.0::DOUBLE AS b, 140000 + score * 20000 AS f FROM assays), i AS ({INCREMENTAL} FROM r GROUP BY 1) SELECT estimate, n, true AS inside FROM i")
def incremental_r2_bootstrap(assays: DataFrame) -> DataFrame:
    rows = assays.withColumns({"b": F.lit(150000.0), "f": F.lit(140000) + F.col("score") * 20000})
    return _bounded(bootstrap.incremental_r2_interval(rows, "row_id", "dms_score", "f", "b", replicates=200)).select(r6("estimate"), "n", "inside")


@query("assertions", sql="""l AS (SELECT *, CAST(variation_id % 97 AS DOUBLE) / 97 AS old FROM assertions WHERE clinsig_simple IN (0, 1)), b AS (SELECT clinsig_simple AS y, avg(CAST(CAST(score > 0.5 AS INT) = clinsig_simple AS DOUBLE)) AS r FROM l GROUP BY 1),
u AS (SELECT clinsig_simple AS y, avg(CAST(CAST(score >= 0.5 AS INT) - CAST(old >= 0.5 AS INT) AS DOUBLE)) AS m FROM l GROUP BY 1)
SELECT 'balanced accuracy' AS metric, round((SELECT avg(r) FROM b), 6) AS estimate, true AS inside UNION ALL SELECT 'nri', round((SELECT sum(CASE y WHEN 1 THEN m ELSE -m END) FROM u), 6), true""")
def classification_bootstrap(assertions: DataFrame) -> DataFrame:
    rows = assertions.where(F.col("clinsig_simple").isin(0, 1)).withColumns({"old": (F.col("variation_id") % 97).cast("double") / 97, "called": (F.col("score") > 0.5).cast("int")})
    a = bootstrap.balanced_accuracy_interval(rows, "variation_id", "clinsig_simple", "called", replicates=200)
    b = bootstrap.nri_interval(rows, "variation_id", "clinsig_simple", "old", "score", replicates=200)
    both = _bounded(a).withColumn("metric", F.lit("balanced accuracy")).unionByName(_bounded(b).withColumn("metric", F.lit("nri")))
    return both.select("metric", r6("estimate"), "inside")


@query("assays", sql="r AS (SELECT assay_id, score * 500000 - CAST(dms_score AS DOUBLE) AS r FROM assays) SELECT assay_id, round(median(r), 4) AS median, round(avg(abs(r)), 4) AS mae, count(*) AS n FROM r GROUP BY 1")
def residual_summary(assays: DataFrame) -> DataFrame:
    found = metrics.residual_summary(assays.withColumn("p", F.col("score") * 500000), "dms_score", "p", ["assay_id"])
    return found.select("assay_id", F.round("median", 4).alias("median"), F.round("mae", 4).alias("mae"), "n")


@query("assays", sql="e AS (SELECT min(dms_score) AS lo, max(dms_score) AS hi FROM assays) SELECT CAST(least(floor((dms_score - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM assays, e GROUP BY 1")
def equal_bins(assays: DataFrame) -> DataFrame:
    return metrics.equal_bins(assays, "dms_score", 10).select("bin", "n")


@query("assertions", sql=f"i AS (SELECT CASE WHEN variation_id % 4 = 0 THEN 0.5 ELSE score END AS score, clinsig_simple FROM assertions), {counted('SELECT * FROM i')} SELECT round({AUC}, 6) AS auroc, CAST(sum(pos + neg) AS BIGINT) AS n, (SELECT bool_and(clinsig_simple IN (0, 1)) FROM assertions) AS binary FROM c")
def imputed_auroc(assertions: DataFrame) -> DataFrame:
    """Missing scores count as 0.5; the label column has a third value."""
    rows = metrics.imputed(assertions.withColumn("score", F.when(F.col("variation_id") % 4 != 0, F.col("score"))), "score")
    return metrics.auroc(rows, "clinsig_simple", "score").select(r6("auroc", F.col("estimate")), "n").withColumn("binary", metrics.is_binary(assertions, "clinsig_simple").scalar())


CONSEQUENCES = ("missense", "nonsense", "splice", "noncoding", "inframe")


@query("assertions", sql=f"k AS (SELECT *, (['missense', 'nonsense', 'splice', 'noncoding', 'inframe'])[CAST(variation_id % 5 AS INT) + 1] AS variant_class FROM assertions), {counted('SELECT * FROM k', 'variant_class')} SELECT variant_class, round({AUC}, 6) AS auroc, CAST(sum(pos + neg) AS BIGINT) AS n FROM c GROUP BY 1")
def auroc_by_consequence(assertions: DataFrame) -> DataFrame:
    rows = assertions.withColumn("variant_class", F.element_at(F.array(*map(F.lit, CONSEQUENCES)), (F.col("variation_id") % 5 + 1).cast("int")))
    return metrics.auroc(rows, "clinsig_simple", "score", ["variant_class"]).select("variant_class", r6("auroc", F.col("estimate")), "n")


@query("samples", sql=f"{GROUPED}, d AS (SELECT ancestry, CASE WHEN n >= 30 OR ancestry = 'ALL' THEN estimate END AS e FROM a), q AS (SELECT ancestry, (SELECT max(e) FROM d WHERE ancestry = 'EUR') - e AS drop FROM d) SELECT ancestry, CASE WHEN drop <> 0 THEN 0.5::DOUBLE END AS ratio FROM q")
def improvement_of_drop(samples: DataFrame) -> DataFrame:
    """Against a method whose drops are half as large."""
    drops = studies.drop_from(metrics.by_group_and_whole(labelled_samples(samples), metrics.auroc, "ancestry", "label", "score"))
    return studies.improvement(drops, drops.withColumn("drop", F.col("drop") / 2)).select("ancestry", r6("ratio"))


@query("runs", sql="r AS (SELECT model_name, min_by(estimate, run_no) FILTER (WHERE run_no % 3 <> 0) AS e, min(run_no) FILTER (WHERE run_no % 3 <> 0) AS k FROM runs GROUP BY 1) SELECT model_name, concat('m', CAST(k AS STRING)) AS metric, round(e, 6) AS estimate, CASE WHEN model_name = 'm0' THEN 0.0::DOUBLE WHEN model_name <> 'm1' THEN round(e / 0.8, 6) END AS normalised FROM r")
def first_ceiling(runs: DataFrame) -> DataFrame:
    """The first metric that has an estimate, over its ceiling; a ceiling of 0 gives 0, none gives null."""
    rows = runs.select("model_name", F.concat(F.lit("m"), F.col("run_no").cast("string")).alias("metric"), F.when(F.col("run_no") % 3 != 0, F.col("estimate")).alias("estimate"), F.col("run_no").alias("ordinal"))
    ceilings = runs.sparkSession.createDataFrame([(f"m{i}", 0.0 if i == 0 else 0.8) for i in (0, 2, 3, 4, 5)], "model_name string, ceiling double")
    first = metrics.first_ceiling(rows, ceilings, ["model_name"]).select("model_name", "metric", "estimate")
    return metrics.ceiling_normalised(first, ceilings, ["model_name"], impossible="zero").select("model_name", "metric", r6("estimate"), r6("normalised"))


# Cohort tables


@query("svs", sql="""c AS (SELECT sv_type, (['pathogenic', 'benign', '', 'Likely pathogenic'])[CAST(sv_id % 4 AS INT) + 1] AS class, sv_id % 11 AS locus FROM svs)
SELECT 'all' AS part, '' AS name, count(*) AS n FROM c UNION ALL SELECT 'type', sv_type, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'class', class, count(*) FROM c WHERE class <> '' GROUP BY 2
UNION ALL SELECT 'pathogenic', '', count(*) FROM c WHERE lower(replace(class, ' ', '_')) IN ('pathogenic', 'likely_pathogenic') UNION ALL SELECT 'pathogenic loci', '', count(DISTINCT locus) FROM c WHERE lower(replace(class, ' ', '_')) IN ('pathogenic', 'likely_pathogenic')""")
def structural_summary(svs: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("pathogenic", "benign", "", "Likely pathogenic"))), (F.col("sv_id") % 4 + 1).cast("int"))
    return cohort.structural_summary(svs.withColumns({"class": kind, "locus": F.col("sv_id") % 11}), "sv_type", "class", "locus")


@query("svs", sql="""c AS (SELECT sv_type, (['Pathogenic', 'Benign', 'likely_pathogenic'])[CAST(sv_id % 3 AS INT) + 1] AS class, sv_id % 5 AS locus FROM svs)
SELECT 'all' AS part, '' AS name, count(*) AS n FROM c UNION ALL SELECT 'type', sv_type, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'class', class, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'pathogenic', '', count(*) FROM c WHERE class IN ('Pathogenic', 'likely_pathogenic') UNION ALL SELECT 'pathogenic loci', '', count(DISTINCT locus) FROM c WHERE class IN ('Pathogenic', 'likely_pathogenic')""")
def cnv_summary(svs: DataFrame) -> DataFrame:
    """Columns in other cases and spellings."""
    kind = F.element_at(F.array(*map(F.lit, ("Pathogenic", "Benign", "likely_pathogenic"))), (F.col("sv_id") % 3 + 1).cast("int"))
    return cohort.cnv_summary(svs.select(F.col("sv_type").alias("CNV_Type"), kind.alias("Classification"), (F.col("sv_id") % 5).alias("Gene_Name")))


@query("variants", sql="""d AS (SELECT chrom, concat(ref, alt) AS r, concat(alt, ref) AS a FROM variants WHERE ref <> alt), c AS (SELECT chrom, least(r || '>' || a, reverse(translate(r, 'ACGT', 'TGCA')) || '>' || reverse(translate(a, 'ACGT', 'TGCA'))) AS channel FROM d)
SELECT chrom, channel, count(*) AS n FROM c GROUP BY ALL""")
def dinucleotide_spectrum(variants: DataFrame) -> DataFrame:
    both = variants.select("chrom", F.concat("ref", "alt").alias("ref"), F.concat("alt", "ref").alias("alt"))
    return cohort.dinucleotide_spectrum(both, "chrom")


@query("variants", sql="""i AS (SELECT chrom, CASE WHEN pos % 2 = 0 THEN ref ELSE ref || repeat(alt, CAST(pos % 7 + 1 AS INT)) END AS r, CASE WHEN pos % 2 = 0 THEN ref || repeat(alt, CAST(pos % 7 + 1 AS INT)) ELSE ref END AS a, pos % 7 + 1 AS k, alt AS b, pos % 2 = 0 AS ins FROM variants)
SELECT chrom, concat_ws(':', CASE WHEN ins THEN 'Ins' ELSE 'Del' END, CAST(least(k, 5) AS STRING), CASE WHEN k > 1 THEN 'N' WHEN b IN ('C', 'G') THEN 'C' ELSE 'T' END) AS channel, count(*) AS n FROM i GROUP BY ALL""")
def indel_spectrum(variants: DataFrame) -> DataFrame:
    longer = F.concat("ref", F.expr("repeat(alt, CAST(pos % 7 + 1 AS INT))"))
    even = F.col("pos") % 2 == 0
    return cohort.indel_spectrum(variants.select("chrom", F.when(even, F.col("ref")).otherwise(longer).alias("ref"), F.when(even, longer).otherwise(F.col("ref")).alias("alt")), "chrom")


@query("reads", sql="l AS (SELECT 'chr' || CAST(i AS STRING) AS chrom, 6000000 AS n FROM range(1, 24) t(i)), e AS (SELECT chrom, unnest(range(0, 6)) AS bin FROM l), c AS (SELECT chrom, CAST(floor(pos / 1000000) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY ALL) SELECT e.chrom, e.bin, coalesce(n, 0) AS n FROM e LEFT JOIN c ON c.chrom = e.chrom AND c.bin = e.bin")
def read_bins_of_whole_chromosomes(reads: DataFrame) -> DataFrame:
    lengths = reads.sparkSession.range(1, 24).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.lit(6_000_000).alias("length"))
    return cohort.read_bins(reads, lengths=lengths)


@query("reads", "bed", sql="""s AS (SELECT DISTINCT chrom, bed_start * 1000 AS centre FROM bed), j AS (SELECT s.chrom, centre, count(r.pos) AS k, count(*) FILTER (WHERE abs(r.pos - centre) <= 5000) AS c FROM s LEFT JOIN reads r ON r.chrom = s.chrom AND abs(r.pos - centre) <= 20000 GROUP BY ALL)
SELECT count(*) AS n_sites, round(avg(k * 100 / 40001.0::DOUBLE), 2) AS mean_coverage, round(avg(c * 100 / 10001.0::DOUBLE), 2) AS mean_central FROM j""")
def site_coverage(reads: DataFrame, bed: DataFrame) -> DataFrame:
    sites = bed.select("chrom", (F.col("bed_start") * 1000).alias("centre")).distinct().withColumn("site", F.struct("chrom", "centre"))
    return cohort.site_coverage(joins.near_sites(reads, sites, 20000), sites, "site", 20000, 5000)


@query("genotypes", "catalog", sql="""w AS (SELECT CAST(substr(rsid, 3) AS BIGINT) AS variant_id, 'trait ' || CAST(CAST(substr(rsid, 3) AS BIGINT) % 2 AS STRING) AS trait FROM catalog), s AS (SELECT sample_id, trait, CAST(sum(dosage) AS BIGINT) AS score FROM genotypes JOIN w USING (variant_id) GROUP BY ALL)
SELECT sample_id, trait, score, NULL AS warning FROM s UNION ALL SELECT NULL, 'height', NULL, 'no weights for height'""")
def traits_without_weights(genotypes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scores of two traits, and a warning for a third that has no weights."""
    ident = F.substring("rsid", 3, 20).cast("bigint")
    weights = catalog.select(ident.alias("variant_id"), F.concat(F.lit("trait "), (ident % 2).cast("string")).alias("trait"), F.lit(1.0).alias("weight"))
    scores = cohort.polygenic_scores(genotypes, weights, ["trait"])
    wanted = genotypes.sparkSession.createDataFrame([("trait 0",), ("trait 1",), ("height",)], "trait string")
    return cohort.scores_with_warnings(scores.select("sample_id", "trait", F.col("score_sum").cast("bigint").alias("score")), wanted)


@query("vcf_lines", sql="f AS (SELECT string_split(value, chr(9)) AS p FROM vcf_lines), g AS (SELECT p[1] AS chrom, p[10] AS gt, p[4] AS ref, string_split(p[5], ',')[1] AS a FROM f WHERE p[10] <> './.'), c AS (SELECT chrom, count(*) FILTER (WHERE gt = '0/1' AND a <> ref) AS n_het, count(*) FILTER (WHERE gt = '1|1' AND a <> ref) AS n_hom FROM g GROUP BY 1) SELECT chrom, n_het, n_hom, round(CAST(n_het AS DOUBLE) / nullif(n_hom, 0), 6) AS ratio FROM c")
def het_hom_ratio(vcf_lines: DataFrame) -> DataFrame:
    return cohort.het_hom_ratio(tables.vcf_genotypes(vcf_lines), ["chrom"]).select("chrom", "n_het", "n_hom", r6("ratio"))


# Splits and checks


@query("samples", sql="SELECT count(*) AS n, count(*) FILTER (WHERE k = 1) AS n_once FROM (SELECT sample_id, 1 AS k FROM samples)")
def leave_one_out(samples: DataFrame) -> DataFrame:
    """Each sample alone in a fold: as many folds as samples, so the folds are the ids."""
    folds = samples.select("sample_id").distinct().groupBy("sample_id").agg(F.count("*").alias("k"))
    return folds.agg(F.count("*").alias("n"), F.count_if(F.col("k") == 1).alias("n_once"))


@query("assertions", "samples", "kinship", sql=f"""{SPLIT}, d AS (SELECT sample_id, min(last_evaluated) AS day FROM samples JOIN assertions ON variation_id = sample_id GROUP BY 1),
v AS (SELECT 'relatedness' AS "check", (SELECT count(*) FROM kinship k JOIN sp x ON x.sample_id = id_a JOIN sp y ON y.sample_id = id_b WHERE kinship > 0.0442 AND x.split <> y.split) AS violations
UNION ALL SELECT 'temporal', 1 UNION ALL SELECT 'chromosome', 1 UNION ALL SELECT 'label', 0 UNION ALL SELECT 'summary_stat', (SELECT count(*) FROM sp WHERE split = 'test' AND sample_id % 3 = 0) UNION ALL SELECT 'no such check', 1
UNION ALL SELECT 'temporal_by_id', (SELECT count(*) FROM sp JOIN d USING (sample_id) WHERE split = 'test' AND day < TIMESTAMP '1999-12-31'))
SELECT "check", violations = 0 AS passed, violations FROM v""")
def named_leakage_checks(assertions: DataFrame, samples: DataFrame, kinship: DataFrame) -> DataFrame:
    """Named checks, some without their inputs and one unknown, and dates found by id."""
    people = splits.individuals(samples, "sample_id", "ancestry")
    named = splits.run_checks(["relatedness", "temporal", "chromosome", "label", "summary_stat", "no such check"], people, "sample_id", kinship=kinship, cohort=samples.where("sample_id % 3 = 0"))
    dates = assertions.select(F.col("variation_id").alias("sample_id"), "last_evaluated")
    by_id = splits.check_temporal_by_id(people.where("split = 'test'"), dates, "sample_id", "last_evaluated", F.lit("1999-12-31").cast("timestamp"))
    return named.unionByName(by_id)


# Result store and reports


@query("runs", sql="h AS (SELECT task_id, model_name, metric, run_no, estimate, row_number() OVER w AS place, estimate - lag(estimate) OVER w AS change FROM runs WINDOW w AS (PARTITION BY task_id, model_name, metric ORDER BY ts, run_no)) SELECT task_id, model_name, run_no, CAST(place AS INTEGER) AS place, round(change, 6) AS change FROM h")
def metric_series(runs: DataFrame) -> DataFrame:
    return results.series(runs).select("task_id", "model_name", "run_no", "place", r6("change"))


@query("runs", sql="SELECT run_no, round(estimate, 6) AS estimate FROM runs WHERE task_id = 'clinvar/balanced' AND model_name = 'm3' AND metric = 'auroc'")
def run_history(runs: DataFrame) -> DataFrame:
    return results.history(runs, "clinvar/balanced", "m3", "auroc").select("run_no", r6("estimate"))


@query("runs", sql="SELECT run_no, concat(task_id, ' | ', model_name, ' | auroc=', printf('%.4f [%.4f, %.4f]', estimate, estimate - 0.125, estimate + 0.125), ', half=', printf('%.4f [%.4f, %.4f]', estimate / 2, estimate / 2 - 0.125, estimate / 2 + 0.125)) AS line FROM runs")
def run_summary_lines(runs: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("auroc").alias("metric"), F.col("estimate")), F.struct(F.lit("half").alias("metric"), (F.col("estimate") / 2).alias("estimate")))
    rows = runs.select("run_no", "task_id", "model_name", F.explode(both).alias("m")).select("run_no", "task_id", "model_name", "m.*")
    return results.summary_lines(rows.withColumns({"ci_lower": F.col("estimate") - 0.125, "ci_upper": F.col("estimate") + 0.125}))


@query("runs", sql="l AS (SELECT model_name, task_id, arg_max(estimate, (ts, run_no)) AS e FROM runs GROUP BY ALL) SELECT CASE model_name WHEN 'm0' THEN '**Model**' WHEN 'm2' THEN 'm2 (circularity: trained on it)' ELSE model_name END AS label, round(max(e) FILTER (WHERE task_id = 'clinvar/all_snv'), 6) AS all_snv, round(coalesce(max(e) FILTER (WHERE task_id = 'clinvar/balanced'), 0), 6) AS balanced FROM l GROUP BY 1")
def model_against_baselines(runs: DataFrame) -> DataFrame:
    last = results.latest(runs, ["model_name", "task_id"]).select("model_name", F.col("task_id").alias("metric"), "estimate")
    flags = runs.sparkSession.createDataFrame([("m2", "trained on it")], "model_name string, reason string")
    rows = results.against_baselines(last.where("model_name = 'm0'"), last.where("model_name <> 'm0'"), ["clinvar/all_snv", "clinvar/balanced"], flags)
    rows = rows.select("label", r6("all_snv", F.col("clinvar/all_snv")), r6("balanced", F.col("clinvar/balanced")))
    return results.bars(rows, ["balanced"])


TIMED = "t AS (SELECT *, date_trunc('second', started_at) AS s FROM tool_results)"


@query("tool_results", sql=f"""{TIMED} SELECT run_id, round(epoch(max(s)) - epoch(min(s)) + 2.5, 3) AS seconds, array_to_string(list_sort(list_distinct(list(tool_name) FILTER (WHERE status = 'failed'))), ',') AS failed_tools,
array_to_string(list_sort(list_distinct(list(tool_name) FILTER (WHERE status = 'ok'))), ',') AS ok_tools FROM t GROUP BY 1""")
def run_times(tool_results: DataFrame) -> DataFrame:
    begun = F.date_trunc("second", "started_at")
    rows = tool_results.withColumns({"started_at": begun, "finished_at": begun + F.expr("INTERVAL 2500 MILLISECONDS")})
    return results.run_times(rows).select("run_id", "seconds", *(F.array_join(c, ",").alias(c) for c in ("failed_tools", "ok_tools")))


@query("runs", sql="SELECT task_id, model_name, count(*) FILTER (WHERE estimate >= 0.85) AS n_pass, count(*) AS n_runs FROM runs GROUP BY ALL")
def passes_over_runs(runs: DataFrame) -> DataFrame:
    limits = runs.select("task_id").distinct().withColumn("threshold", F.lit(0.85))
    return results.passes_over_runs(results.gates(runs, limits, ["task_id"]), ["task_id", "model_name"])


@query("runs", sql="""SELECT run_no, concat(task_id, CASE WHEN estimate >= 0.85 THEN ' [PASS]' ELSE ' [FAIL: below 0.85]' END) AS heading, metric, printf('%.4f (%.4f–%.4f), N=%d', estimate, estimate - 0.25, estimate + 0.25, run_no % 1000) AS value FROM runs""")
def tier0_report(runs: DataFrame) -> DataFrame:
    passed = F.col("estimate") >= 0.85
    rows = runs.withColumns({"gate": F.when(passed, "pass").otherwise("fail"), "gate_reason": F.when(~passed, "below 0.85"), "ci_lower": F.col("estimate") - 0.25, "ci_upper": F.col("estimate") + 0.25, "n": F.col("run_no") % 1000})
    return results.tier0(rows)


@query("runs", sql="k AS (SELECT *, run_no % 10 = 0 AS agg FROM runs) SELECT concat(task_id, '/aggregate') AS task_id, model_name, printf('%.4f', estimate) AS value, (SELECT count(*) FROM k WHERE NOT agg) AS n_single FROM k WHERE agg")
def tier1_report(runs: DataFrame) -> DataFrame:
    rows = runs.withColumn("task_id", F.when(F.col("run_no") % 10 == 0, F.concat("task_id", F.lit("/aggregate"))).otherwise(F.col("task_id")))
    return results.tier1(rows).select("task_id", "model_name", "value", "n_single")


@query("runs", sql="""k AS (SELECT *, 'o' || CAST(run_no % 3 AS STRING) AS organism, CASE WHEN run_no % 7 <> 0 THEN estimate END AS e FROM runs WHERE run_no % 2 = 1), s AS (SELECT organism, count(*) FILTER (WHERE e IS NULL) AS n_skipped FROM k GROUP BY 1)
SELECT organism, run_no AS trait, printf('%.3f ± %.3f', e, 0.5) AS value, run_no % 1000 AS n, CASE WHEN run_no % 5 = 0 THEN '' ELSE printf('%.2f (%.1f%%)', 0.75, 100 * e / 0.75) END AS ceiling, n_skipped FROM k JOIN s USING (organism) WHERE e IS NOT NULL""")
def tier3_report(runs: DataFrame) -> DataFrame:
    """Cross-validated R2 by organism and trait, grouped by the tier that runs name."""
    kept = F.col("run_no") % 7 != 0
    rows = runs.select(
        F.when(F.col("run_no") % 2 == 1, 3).otherwise(1).alias("tier"),
        F.concat(F.lit("o"), (F.col("run_no") % 3).cast("string")).alias("organism"),
        F.col("run_no").alias("trait"),
        F.when(kept, F.col("estimate")).alias("estimate"),
        F.when(kept, F.col("estimate") + 0.98).alias("ci_upper"),
        (F.col("run_no") % 1000).alias("n"),
        F.when(F.col("run_no") % 5 != 0, 0.75).alias("ceiling"),
        (~kept).alias("skipped"),
    )
    return results.tier3(rows)


@query("tool_results", sql="""m AS (SELECT * FROM (VALUES ('click', 'germline'), ('view', 'germline'), ('purchase', 'somatic')) v(tool_name, mode)) SELECT coalesce(mode, 'unknown') AS mode, status, count(*) AS n, array_to_string(list_sort(list_distinct(list(tool_name))), ',') AS tools FROM tool_results LEFT JOIN m USING (tool_name) GROUP BY 1, 2""")
def status_buckets(tool_results: DataFrame) -> DataFrame:
    modes = tool_results.sparkSession.createDataFrame([("click", "germline", 0), ("view", "germline", 0), ("purchase", "somatic", 1)], "tool_name string, mode string, place int")
    return results.status_buckets(tool_results, modes).withColumn("tools", F.array_join("tools", ","))


@query("runs", sql="""s AS (SELECT CAST(run_no AS STRING) AS section, CASE WHEN run_no % 4 = 0 THEN repeat('x', 100) END AS error, * FROM runs)
SELECT section, task_id, model_name, NULL AS metric, NULL::DOUBLE AS estimate, substr(error, 1, 80) AS error FROM s WHERE error IS NOT NULL
UNION ALL SELECT section, task_id, model_name, metric, round(estimate, 6), NULL FROM s WHERE error IS NULL UNION ALL SELECT section, task_id, model_name, 'half', round(estimate / 2, 6), NULL FROM s WHERE error IS NULL AND run_no % 3 <> 0""")
def scorecard(runs: DataFrame) -> DataFrame:
    """Sections with a map of metrics, one of them sometimes without an estimate, or with an error."""
    value = lambda e: F.struct(e.alias("estimate"), (e - 0.1).alias("ci_lower"), (e + 0.1).alias("ci_upper"), F.lit(5).cast("long").alias("n"))
    half = F.when(F.col("run_no") % 3 != 0, F.col("estimate") / 2)
    sections = runs.select(F.col("run_no").cast("string").alias("section"), "task_id", "model_name", F.when(F.col("run_no") % 4 == 0, F.repeat(F.lit("x"), 100)).alias("error"), F.create_map("metric", value(F.col("estimate")), F.lit("half"), value(half)).alias("metrics"))
    return results.scorecard(sections).select("section", "task_id", "model_name", "metric", r6("estimate"), "error")
