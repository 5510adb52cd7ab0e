"""The registered queries of the library, each with the DuckDB SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import markdown, reports
from helixframe.functions import variants as V
from helixframe.operators import bootstrap, cohort, joins, metrics, models, panels, results, splits, studies
from helixframe.plans.views import ctes, view
from helixframe.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CUTOFF = datetime(1999, 12, 31)


def query(*views: str, sql: str | None = None):
    """Registers a function of the named views' DataFrames, with the SQL that follows their definitions."""

    def register(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(*(view(spark, sf_dir, v) for v in views))
        if sql is not None:
            ORACLE_SQL[make.__name__] = f"{ctes(*views)}\n{'' if sql.lstrip().startswith('SELECT') else ', '}{sql}"
        return make

    return register


def r6(name: str, of=None):
    return F.round(F.col(name) if of is None else of, 6).alias(name)


def counted(rows: str, by: str = "", label: str = "clinsig_simple", score: str = "score") -> str:
    """SQL of the running counts by distinct score of a set of rows."""
    part, comma = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""c0 AS (SELECT {comma}{score} AS score, count(*) FILTER (WHERE {label} = 1) AS pos, count(*) FILTER (WHERE {label} = 0) AS neg FROM ({rows}) WHERE {label} IN (0, 1) AND {score} IS NOT NULL GROUP BY {comma}{score}),
c AS (SELECT *, sum(pos) OVER ({part} ORDER BY score) - pos AS pb, sum(neg) OVER ({part} ORDER BY score) - neg AS nb, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n FROM c0)
"""


AUC = "sum(CAST(pos AS DOUBLE) * (nb + 0.5 * neg)) / nullif(max(CAST(p AS DOUBLE)) * max(CAST(n AS DOUBLE)), 0)"
D = "CAST({} AS DOUBLE)"


# Evaluation


@query("assertions", sql=f"t AS (SELECT *, CASE WHEN last_evaluated <= TIMESTAMP '1999-12-31' THEN 'train' ELSE 'test' END AS split FROM assertions WHERE clinsig_simple IN (0, 1) AND last_evaluated IS NOT NULL), {counted('SELECT * FROM t', 'split')}, cov AS (SELECT split, count(*) AS total, count(score) AS scored FROM t GROUP BY split) SELECT split, total, round(CAST(scored AS DOUBLE) / total, 6) AS coverage, round({AUC}, 6) AS auroc, CASE WHEN abs({AUC} - 0.94) > 0.05 THEN 'differs' ELSE 'ok' END AS state FROM c JOIN cov USING (split) GROUP BY split, total, scored")
def eval_temporal_auroc(assertions: DataFrame) -> DataFrame:
    """Labelled assertions, split in time, their coverage and AUROC, and how these compare to an expected value."""
    rows = splits.temporal(assertions.where(F.col("clinsig_simple").isin(0, 1)), "last_evaluated", CUTOFF).where(F.col("split").isNotNull())
    found = metrics.auroc(rows, "clinsig_simple", "score", ["split"]).join(metrics.coverage(rows, "clinsig_simple", "score", ["split"]), "split")
    state = F.when(F.abs(F.col("estimate") - 0.94) > 0.05, "differs").otherwise("ok")
    return found.select("split", "total", r6("coverage"), r6("auroc", F.col("estimate")), state.alias("state"))


@query("assertions", sql="SELECT CAST(clinsig_simple AS INTEGER) AS label, review_status, count(*) AS n, CAST(min(last_evaluated) AS VARCHAR)[1:10] AS first_day FROM assertions WHERE review_status IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND clinsig_simple IN (0, 1) AND CAST(last_evaluated AS DATE) <= DATE '1998-06-30' GROUP BY ALL")
def asserted_before(assertions: DataFrame) -> DataFrame:
    """Set membership, label and as-of-date filters."""
    rows = assertions.where(F.col("review_status").isin("1-URGENT", "2-HIGH", "3-MEDIUM") & F.col("clinsig_simple").isin(0, 1) & (F.to_date("last_evaluated") <= F.to_date(F.lit("19980630"), "yyyyMMdd")))
    return rows.groupBy(F.col("clinsig_simple").alias("label"), "review_status").agg(F.count("*").alias("n"), F.date_format(F.min("last_evaluated"), "yyyy-MM-dd").alias("first_day"))


CLASSES = {"pathogenicity": "CASE WHEN score IS NULL THEN 'not_found' WHEN score < 0.34 THEN 'likely_benign' WHEN score > 0.564 THEN 'likely_pathogenic' ELSE 'ambiguous' END", "splice": "CASE WHEN score IS NULL THEN 'not_found' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.2 THEN 'moderate' ELSE 'low' END", "llr": "CASE WHEN score * 8 - 5 IS NULL THEN 'not_found' WHEN score * 8 - 5 <= -3 THEN 'deleterious' WHEN score * 8 - 5 >= 0 THEN 'benign' ELSE 'uncertain' END"}


@query("variants", "scores", sql=f"j AS (SELECT v.*, s.score FROM variants v LEFT JOIN scores s USING (chrom, pos, ref, alt)) SELECT chrom, count(*) AS n_queried, count(score) AS n_found, count(*) FILTER (WHERE {CLASSES['pathogenicity']} = 'likely_pathogenic') AS n_pathogenic, count(*) FILTER (WHERE {CLASSES['pathogenicity']} = 'likely_benign') AS n_benign, round(avg(score), 6) AS mean_score FROM j GROUP BY chrom")
def variant_score_lookup(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """Left join on the variant key, classes and counts by chromosome."""
    found = joins.lookup(variants, scores)
    kind = V.pathogenicity_class(F.col("score"))
    return found.groupBy("chrom").agg(F.count("*").alias("n_queried"), F.count("score").alias("n_found"), F.count_if(kind == "likely_pathogenic").alias("n_pathogenic"), F.count_if(kind == "likely_benign").alias("n_benign"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("variants", "scores", sql="SELECT chrom, count(*) AS n FROM variants SEMI JOIN scores USING (chrom, pos, ref, alt) GROUP BY chrom")
def missense_semi_join(variants: DataFrame, scores: DataFrame) -> DataFrame:
    return joins.having_score(variants, scores).groupBy("chrom").agg(F.count("*").alias("n"))


@query("variants", "scores", sql=f"j AS (SELECT v.*, s.score FROM variants v LEFT JOIN scores s USING (chrom, pos, ref, alt)) SELECT {CLASSES['splice']} AS impact, count(*) AS n FROM j GROUP BY ALL")
def splice_class_counts(variants: DataFrame, scores: DataFrame) -> DataFrame:
    return joins.lookup(variants, scores).groupBy(V.splice_impact(F.col("score")).alias("impact")).agg(F.count("*").alias("n"))


@query("variants", "scores", sql=f"j AS (SELECT v.*, s.score FROM variants v LEFT JOIN scores s USING (chrom, pos, ref, alt)) SELECT {CLASSES['llr']} AS class, count(*) AS n FROM j GROUP BY ALL")
def llr_class_counts(variants: DataFrame, scores: DataFrame) -> DataFrame:
    return joins.lookup(variants, scores).groupBy(V.llr_class(F.col("score") * 8 - 5).alias("class")).agg(F.count("*").alias("n"))


@query("variants", "bed", sql="SELECT DISTINCT chrom, pos, ref, alt FROM variants v WHERE EXISTS (SELECT 1 FROM bed b WHERE b.chrom = v.chrom AND v.pos - 1 >= bed_start AND v.pos - 1 < bed_end)")
def bed_confident_filter(variants: DataFrame, bed: DataFrame) -> DataFrame:
    return joins.in_intervals(variants.select(*V.KEY).distinct(), bed)


PRF = "CAST(count(*) FILTER (WHERE t AND q) AS BIGINT) AS tp, count(*) FILTER (WHERE t IS NULL) AS fp, count(*) FILTER (WHERE q IS NULL) AS fn"


@query("variants", "scores", "bed", sql=f"inb AS (SELECT DISTINCT chrom, pos, ref, alt FROM variants v WHERE (filter IS NULL OR filter = 'PASS') AND EXISTS (SELECT 1 FROM bed b WHERE b.chrom = v.chrom AND v.pos - 1 >= bed_start AND v.pos - 1 < bed_end)), tru AS (SELECT chrom, pos, ref, alt FROM scores s WHERE EXISTS (SELECT 1 FROM bed b WHERE b.chrom = s.chrom AND s.pos - 1 >= bed_start AND s.pos - 1 < bed_end)), j AS (SELECT ref, t, q FROM (SELECT *, true AS t FROM tru) FULL JOIN (SELECT *, true AS q FROM inb) USING (chrom, pos, ref, alt)), k AS (SELECT CASE WHEN ref IN ('A', 'G') THEN 'purine' ELSE 'pyrimidine' END AS class, {PRF} FROM j GROUP BY ALL) SELECT class, tp, fp, fn, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall, round(2.0 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn), 6) AS f1 FROM k")
def callset_prf_by_type(variants: DataFrame, scores: DataFrame, bed: DataFrame) -> DataFrame:
    """Call-set comparison inside the confident regions, by class of the reference base."""
    called = joins.in_intervals(variants.where(V.passes(F.col("filter"))).select(*V.KEY).distinct(), bed)
    found = joins.compare_sets(joins.in_intervals(scores.select(*V.KEY), bed), called, by={"class": F.when(F.col("ref").isin("A", "G"), "purine").otherwise("pyrimidine")})
    return found.select("class", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query("variants", "scores", sql="q AS (SELECT DISTINCT chrom, pos, ref, alt FROM variants WHERE filter IS NULL OR filter = 'PASS'), s AS (SELECT chrom, pos, ref, alt FROM scores) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM q INTERSECT SELECT * FROM s) UNION ALL SELECT 'query only', count(*) FROM (SELECT * FROM q EXCEPT SELECT * FROM s) UNION ALL SELECT 'truth only', count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM q)")
def variant_set_parts(variants: DataFrame, scores: DataFrame) -> DataFrame:
    q, s = variants.where(V.passes(F.col("filter"))).select(*V.KEY), scores.select(*V.KEY)
    parts = {"both": q.intersect(s), "query only": q.subtract(s), "truth only": s.subtract(q)}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# Parsing


@query("vcf_lines", sql="f AS (SELECT string_split(value, chr(9)) AS p FROM vcf_lines), e AS (SELECT 'chr' || p[1] AS chrom, CAST(p[2] AS BIGINT) AS pos, p[4] AS ref, unnest(string_split(p[5], ',')) AS alt FROM f WHERE p[7] IN ('PASS', '.')) SELECT chrom, count(*) AS n, count(*) FILTER (WHERE length(ref) = 1 AND length(alt) = 1) AS n_snv, CAST(sum(pos) AS BIGINT) AS pos_sum FROM (SELECT chrom, CAST(pos AS BIGINT) AS pos, ref, alt FROM e WHERE alt NOT IN ('*', '.')) GROUP BY chrom")
def vcf_scan(vcf_lines: DataFrame) -> DataFrame:
    rows = tables.vcf_variants(vcf_lines)
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(V.is_snv()).alias("n_snv"), F.sum("pos").alias("pos_sum"))


@query("vcf_lines", sql="f AS (SELECT string_split(value, chr(9)) AS p FROM vcf_lines), e AS (SELECT p[4] AS ref, string_split(p[5], ',')[1] AS a1, p[10] AS gt FROM f WHERE p[10] <> './.') SELECT CASE gt WHEN '0/0' THEN ref || ref WHEN '1|1' THEN a1 || a1 ELSE least(ref, a1) || greatest(ref, a1) END AS genotype, count(*) AS n FROM e GROUP BY ALL")
def vcf_genotype_counts(vcf_lines: DataFrame) -> DataFrame:
    return tables.vcf_genotypes(vcf_lines).groupBy(V.sorted_genotype(F.col("alleles")).alias("genotype")).agg(F.count("*").alias("n"))


@query("vcf_lines", sql="e AS (SELECT line_no, regexp_extract(value, 'SpliceAI=([^|;]*)[|]([^|]*)[|]([^|]*)[|]([^|]*)[|]([^|]*)[|]([^|]*)[|]', ['a', 'g', 's1', 's2', 's3', 's4']) AS m FROM vcf_lines) SELECT line_no, m.a AS allele, m.g AS symbol, greatest(CAST(m.s1 AS DOUBLE), CAST(m.s2 AS DOUBLE), CAST(m.s3 AS DOUBLE), CAST(m.s4 AS DOUBLE)) AS score FROM e")
def splice_info(vcf_lines: DataFrame) -> DataFrame:
    rows = tables.vcf_records(vcf_lines)
    return rows.select("line_no", V.splice_field(F.col("info"), 1).alias("allele"), V.splice_field(F.col("info"), 2).alias("symbol"), V.splice_score(F.col("info")).alias("score"))


@query("csq", sql="f AS (SELECT row_id, string_split(csq, '|') AS p FROM csq), g AS (SELECT row_id, p[1] AS gene, string_split(p[2], '/')[1] || p[3] || string_split(p[2], '/')[2] AS change FROM f WHERE contains(p[2], '/')), r AS (SELECT *, row_number() OVER (PARTITION BY gene, change ORDER BY row_id) AS rn FROM g) SELECT gene, change, row_id FROM r WHERE rn = 1")
def csq_protein_changes(csq: DataFrame) -> DataFrame:
    """Protein changes of transcript strings, the first row of each gene and change."""
    p = F.split("csq", r"\|")
    rows = csq.select("row_id", p[0].alias("gene"), V.protein_change(p[1], p[2]).alias("change")).where(F.col("change").isNotNull())
    return joins.first_by_key(rows, ["gene", "change"], ["row_id"]).select("gene", "change", "row_id")


# Rank and classification metrics


@query("assertions", sql=f"{counted('SELECT * FROM assertions')} SELECT round(sum(CAST(pos AS DOUBLE) / p * (p - pb) / ((p - pb) + (n - nb))), 6) AS auprc, round({AUC}, 6) AS auroc FROM c")
def auprc_overall(assertions: DataFrame) -> DataFrame:
    a, b = metrics.auprc(assertions, "clinsig_simple", "score"), metrics.auroc(assertions, "clinsig_simple", "score")
    return a.select(r6("auprc", F.col("estimate"))).crossJoin(b.select(r6("auroc", F.col("estimate"))))


@query("assertions", sql=f"{counted('SELECT * FROM assertions', 'gene_symbol')} SELECT gene_symbol, round(coalesce(max_by(CAST(p - pb AS DOUBLE) / ((p - pb) + (n - nb)), score) FILTER (WHERE p - pb >= 0.9 * p AND p > 0), 0), 6) AS ppv FROM c GROUP BY gene_symbol")
def ppv_at_sens(assertions: DataFrame) -> DataFrame:
    return metrics.ppv_at_sensitivity(assertions, "clinsig_simple", "score", 0.9, ["gene_symbol"]).select("gene_symbol", r6("ppv", F.col("estimate")))


@query("assertions", sql=f"{counted('SELECT * FROM assertions', 'gene_symbol')} SELECT gene_symbol, round(coalesce(min_by(CAST(nb + neg AS DOUBLE) / ((nb + neg) + (pb + pos)), score) FILTER (WHERE nb + neg >= 0.99 * CAST(n AS DOUBLE) AND n > 0), 0), 6) AS npv FROM c GROUP BY gene_symbol")
def npv_at_spec(assertions: DataFrame) -> DataFrame:
    return metrics.npv_at_specificity(assertions, "clinsig_simple", "score", 0.99, ["gene_symbol"]).select("gene_symbol", r6("npv", F.col("estimate")))


@query("assertions", sql="r AS (SELECT gene_symbol, clinsig_simple, avg(CAST((score > 0.5) = (clinsig_simple = 1) AS DOUBLE)) AS r, count(*) AS k FROM assertions WHERE clinsig_simple IN (0, 1) GROUP BY ALL), b AS (SELECT gene_symbol, avg((score - clinsig_simple) * (score - clinsig_simple)) AS br FROM assertions WHERE clinsig_simple IN (0, 1) GROUP BY ALL) SELECT gene_symbol, round(avg(r), 6) AS balanced_accuracy, CAST(sum(k) AS BIGINT) AS n, round(max(br), 6) AS brier FROM r JOIN b USING (gene_symbol) GROUP BY gene_symbol")
def balanced_accuracy_and_brier(assertions: DataFrame) -> DataFrame:
    rows = assertions.where(F.col("clinsig_simple").isin(0, 1)).withColumn("called", (F.col("score") > 0.5).cast("int"))
    a = metrics.balanced_accuracy(rows, "clinsig_simple", "called", ["gene_symbol"]).withColumnRenamed("estimate", "ba")
    b = metrics.brier(rows, "clinsig_simple", "score", ["gene_symbol"]).select("gene_symbol", F.col("estimate").alias("br"))
    return a.join(b, "gene_symbol").select("gene_symbol", r6("balanced_accuracy", F.col("ba")), "n", r6("brier", F.col("br")))


@query("assertions", sql=f"{counted('SELECT * FROM assertions')} SELECT round(score, 6) AS score, round(CAST(n - nb AS DOUBLE) / n, 6) AS fpr, round(CAST(p - pb AS DOUBLE) / p, 6) AS tpr FROM c")
def roc_curve(assertions: DataFrame) -> DataFrame:
    return metrics.roc_curve(assertions, "clinsig_simple", "score").select(r6("score"), r6("fpr"), r6("tpr"))


@query("assertions", sql=f"{counted('SELECT * FROM assertions')} SELECT round(score, 6) AS score, round(CAST(p - pb AS DOUBLE) / p, 6) AS recall, round(CAST(p - pb AS DOUBLE) / ((p - pb) + (n - nb)), 6) AS precision, round(CAST(p AS DOUBLE) / (p + n), 6) AS prevalence FROM c")
def pr_curve(assertions: DataFrame) -> DataFrame:
    return metrics.pr_curve(assertions, "clinsig_simple", "score").select(r6("score"), r6("recall"), r6("precision"), r6("prevalence"))


@query("assertions", sql="SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, round(avg(score), 6) AS mean_predicted, round(avg(CAST(clinsig_simple AS DOUBLE)), 6) AS observed, count(*) AS n FROM assertions WHERE clinsig_simple IN (0, 1) GROUP BY ALL")
def calibration_bins(assertions: DataFrame) -> DataFrame:
    return metrics.calibration_bins(assertions.where(F.col("clinsig_simple").isin(0, 1)), "clinsig_simple", "score").select("bin", r6("mean_predicted"), r6("observed"), "n")


@query("assertions", sql="h AS (SELECT clinsig_simple AS label, CAST(least(floor(score * 49), 48) AS BIGINT) AS bin, count(*) AS n FROM assertions WHERE score BETWEEN 0 AND 1 GROUP BY ALL) SELECT label, bin, n, round(CAST(n AS DOUBLE) * 49 / sum(n) OVER (PARTITION BY label), 6) AS density FROM h")
def score_histogram(assertions: DataFrame) -> DataFrame:
    return metrics.histogram(assertions.withColumnRenamed("clinsig_simple", "label"), "score", ["label"]).select("label", "bin", "n", r6("density"))


@query("assertions", sql=f"g AS (SELECT gene_symbol FROM assertions WHERE clinsig_simple IN (0, 1) GROUP BY 1 HAVING count(*) >= 10), {counted('SELECT * FROM assertions SEMI JOIN g USING (gene_symbol)', 'gene_symbol')}, a AS (SELECT gene_symbol, {AUC} AS a FROM c GROUP BY 1 HAVING max(p) > 0 AND max(n) > 0) SELECT round(avg(a), 6) AS mean, round(median(a), 6) AS median, round(min(a), 6) AS least, round(quantile_cont(a, 0.25), 6) AS p25, round(quantile_cont(a, 0.75), 6) AS p75, round(max(a), 6) AS most, count(*) AS n FROM a")
def auroc_by_gene(assertions: DataFrame) -> DataFrame:
    """Summary of AUROCs by gene, of those with ten scored rows and both classes."""
    per = metrics.auroc(assertions, "clinsig_simple", "score", ["gene_symbol"]).where((F.col("n") >= 10) & F.col("estimate").isNotNull())
    return metrics.summary(per, "estimate").select(*(r6(c) for c in ("mean", "median", "least", "p25", "p75", "most")), "n")


@query("assertions", sql="g AS (SELECT gene_symbol, count(*) FILTER (WHERE clinsig_simple = 1) AS pos, count(*) FILTER (WHERE clinsig_simple = 0) AS neg FROM assertions GROUP BY 1) SELECT gene_symbol, pos, neg, pos > 0 AND neg > 0 AS both_classes FROM g")
def class_balance(assertions: DataFrame) -> DataFrame:
    rows = assertions.groupBy("gene_symbol").agg(F.count_if(F.col("clinsig_simple") == 1).alias("pos"), F.count_if(F.col("clinsig_simple") == 0).alias("neg"))
    return rows.withColumn("both_classes", (F.col("pos") > 0) & (F.col("neg") > 0))


@query("assertions", sql="m AS (SELECT *, CAST(variation_id % 97 AS DOUBLE) / 97 AS old FROM assertions WHERE clinsig_simple IN (0, 1)), u AS (SELECT gene_symbol, clinsig_simple AS y, CAST(score >= 0.5 AS INT) - CAST(old >= 0.5 AS INT) AS d FROM m) SELECT gene_symbol, round(coalesce(avg(CAST(d AS DOUBLE)) FILTER (WHERE y = 1), 0) + coalesce(avg(CAST(-d AS DOUBLE)) FILTER (WHERE y = 0), 0), 6) AS nri FROM u GROUP BY 1")
def nri(assertions: DataFrame) -> DataFrame:
    rows = assertions.where(F.col("clinsig_simple").isin(0, 1)).withColumn("old", (F.col("variation_id") % 97).cast("double") / 97)
    return metrics.nri(rows, "clinsig_simple", "old", "score", 0.5, ["gene_symbol"]).select("gene_symbol", r6("nri", F.col("estimate")))


# Regression metrics

RANKS = "r AS (SELECT assay_id, rank() OVER (PARTITION BY assay_id ORDER BY dms_score) + (count(*) OVER (PARTITION BY assay_id, dms_score) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY assay_id ORDER BY score) + (count(*) OVER (PARTITION BY assay_id, score) - 1) / 2.0 AS rp FROM assays), s AS (SELECT assay_id, corr(CAST(ry AS DOUBLE), CAST(rp AS DOUBLE)) AS rho, count(*) AS n FROM r GROUP BY 1)"


@query("assays", sql=f"{RANKS} SELECT assay_id, round(rho, 6) AS rho, n FROM s")
def spearman_by_assay(assays: DataFrame) -> DataFrame:
    return metrics.spearman(assays, "dms_score", "score", ["assay_id"]).select("assay_id", r6("rho", F.col("estimate")), "n")


@query("assays", sql=f"{RANKS} SELECT round(avg(rho), 6) AS mean, round(median(rho), 6) AS median, round(1.96 * stddev_pop(rho) / sqrt(count(*)), 6) AS half_width, count(*) AS n FROM s")
def assay_rho_summary(assays: DataFrame) -> DataFrame:
    return metrics.summary(metrics.spearman(assays, "dms_score", "score", ["assay_id"]), "estimate").select(r6("mean"), r6("median"), r6("half_width"), "n")


@query("assays", sql=f"{RANKS}, k AS (SELECT assay_id, rho, row_number() OVER (ORDER BY rho DESC, assay_id) AS best, row_number() OVER (ORDER BY rho, assay_id) AS worst, ntile(4) OVER (ORDER BY rho, assay_id) AS quartile FROM s) SELECT assay_id, round(rho, 6) AS rho, CAST(best AS INTEGER) AS best, CAST(worst AS INTEGER) AS worst, CAST(quartile AS INTEGER) AS quartile FROM k WHERE best <= 5 OR worst <= 5")
def best_and_worst_assays(assays: DataFrame) -> DataFrame:
    """The five best and worst assays with their quartile; one row for each assay is ranked."""
    rows = metrics.spearman(assays, "dms_score", "score", ["assay_id"])
    up, down = Window.orderBy("estimate", "assay_id"), Window.orderBy(F.col("estimate").desc(), "assay_id")
    rows = rows.withColumns({"best": F.row_number().over(down), "worst": F.row_number().over(up), "quartile": F.ntile(4).over(up)})
    return rows.where("best <= 5 OR worst <= 5").select("assay_id", r6("rho", F.col("estimate")), "best", "worst", "quartile")


@query("assays", sql="SELECT assay_id, round(corr(dms_score, score), 6) AS pearson, round(avg(abs(dms_score - score * 500000)), 4) AS mae, round(1 - avg((dms_score - score * 500000) * (dms_score - score * 500000)) / var_pop(dms_score), 6) AS r_squared, round(regr_slope(dms_score, score), 4) AS slope, count(*) AS n FROM assays GROUP BY 1")
def pearson_r2_mae(assays: DataFrame) -> DataFrame:
    rows = assays.withColumn("p", F.col("score") * 500000)
    found = metrics.regression_errors(rows, "dms_score", "p", ["assay_id"]).join(metrics.pearson(rows, "dms_score", "score", ["assay_id"]).select("assay_id", "estimate"), "assay_id").join(metrics.least_squares_line(rows, "dms_score", "score", ["assay_id"]), "assay_id")
    return found.select("assay_id", r6("pearson", F.col("estimate")), F.round("mae", 4).alias("mae"), r6("r_squared"), F.round("slope", 4).alias("slope"), "n")


@query("assays", sql="d AS (SELECT assay_id, avg(CAST(sign(dms_score - 200000) = sign(score - 0.5) AS DOUBLE)) AS p, CAST(count(*) AS DOUBLE) AS n FROM assays WHERE dms_score <> 200000 GROUP BY 1) SELECT assay_id, round(p, 6) AS estimate, CAST(n AS BIGINT) AS n, round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS ci_lower, round(least(1, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS ci_upper FROM d")
def direction_accuracy_wilson(assays: DataFrame) -> DataFrame:
    rows = assays.select("assay_id", (F.col("dms_score") - 200000).alias("t"), (F.col("score") - 0.5).alias("p"))
    return metrics.direction_accuracy(rows, "t", "p", ["assay_id"]).select("assay_id", r6("estimate"), "n", r6("ci_lower"), r6("ci_upper"))


# Groups

LABELLED = "SELECT sample_id, ancestry, CAST(phenotype > 4500 AS INT) AS label, CAST((sample_id * 7919) % 10007 AS DOUBLE) / 10007.0 AS score FROM samples"


def labelled_samples(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", "ancestry", (F.col("phenotype") > 4500).cast("int").alias("label"), ((F.col("sample_id") * 7919) % 10007).cast("double").alias("s")).select("sample_id", "ancestry", "label", (F.col("s") / F.lit(10007.0)).alias("score"))


GROUPED = f"l AS ({LABELLED}), b AS (SELECT ancestry, label, score FROM l UNION ALL SELECT 'ALL', label, score FROM l), {counted('SELECT * FROM b', 'ancestry', 'label')}, a AS (SELECT ancestry, {AUC} AS estimate, CAST(sum(pos + neg) AS BIGINT) AS n FROM c GROUP BY 1)"


#: Groups of fewer than 30 rows have no estimate.
SHOWN = ", shown AS (SELECT ancestry, n, CASE WHEN n >= 30 OR ancestry = 'ALL' THEN estimate END AS estimate FROM a)"


@query("samples", sql=f"{GROUPED} SELECT ancestry, round(CASE WHEN n >= 30 OR ancestry = 'ALL' THEN estimate END, 6) AS auroc, n FROM a")
def metric_by_ancestry(samples: DataFrame) -> DataFrame:
    found = metrics.by_group_and_whole(labelled_samples(samples), metrics.auroc, "ancestry", "label", "score")
    return found.select("ancestry", r6("auroc", F.col("estimate")), "n")


@query("samples", sql=f"{GROUPED}{SHOWN} SELECT ancestry, round(estimate / (SELECT estimate FROM shown WHERE ancestry = 'EUR'), 6) AS ratio, round(estimate - (SELECT estimate FROM shown WHERE ancestry = 'EUR'), 6) AS drop FROM shown")
def portability(samples: DataFrame) -> DataFrame:
    found = metrics.portability(metrics.by_group_and_whole(labelled_samples(samples), metrics.auroc, "ancestry", "label", "score"))
    base = F.max(F.when(F.col("ancestry") == "EUR", F.col("estimate"))).over(Window.partitionBy(F.lit(0)))
    return found.select("ancestry", r6("ratio"), r6("drop", F.col("estimate") - base))


@query("samples", sql="SELECT ancestry, count(*) AS n, round(avg(phenotype), 4) AS mean, round(stddev_samp(phenotype), 4) AS std, round(min(phenotype), 2) AS least FROM samples GROUP BY 1")
def label_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("ancestry").agg(F.count("*").alias("n"), F.round(F.avg("phenotype"), 4).alias("mean"), F.round(F.stddev_samp("phenotype"), 4).alias("std"), F.round(F.min("phenotype"), 2).alias("least"))


# Splits and checks


@query("variants", sql="SELECT CASE WHEN chrom IN ('chr8', 'chr21') THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT chrom) AS chroms FROM variants GROUP BY 1")
def chrom_split(variants: DataFrame) -> DataFrame:
    return splits.by_chromosome(variants).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("chrom").alias("chroms"))


SPLIT = "o AS (SELECT *, row_number() OVER (PARTITION BY ancestry ORDER BY md5(concat(CAST(sample_id AS STRING), ':42')), sample_id) AS rn, count(*) OVER (PARTITION BY ancestry) AS c FROM samples), sp AS (SELECT sample_id, ancestry, phenotype, CASE WHEN rn <= floor(c * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(c * 0.8::DOUBLE) + floor(c * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o)"


@query("samples", sql=f"{SPLIT} SELECT sample_id, ancestry, split FROM sp")
def individual_split(samples: DataFrame) -> DataFrame:
    return splits.individuals(samples, "sample_id", "ancestry").select("sample_id", "ancestry", "split")


PAIRS = "pr AS (SELECT id_a AS a, id_b AS b FROM kinship WHERE kinship > 0.24 UNION ALL SELECT id_b, id_a FROM kinship WHERE kinship > 0.24)"


@query("samples", "kinship", sql=f"{SPLIT}, {PAIRS}, m1 AS (SELECT DISTINCT a FROM pr JOIN sp x ON x.sample_id = a AND x.split = 'test' JOIN sp y ON y.sample_id = b AND y.split IN ('train', 'val')), s1 AS (SELECT sample_id, CASE WHEN sample_id IN (SELECT a FROM m1) THEN 'train' ELSE split END AS split FROM sp), m2 AS (SELECT DISTINCT a FROM pr JOIN s1 x ON x.sample_id = a AND x.split = 'val' JOIN s1 y ON y.sample_id = b AND y.split = 'train') SELECT sample_id, CASE WHEN sample_id IN (SELECT a FROM m2) THEN 'train' ELSE split END AS split FROM s1")
def kinship_repair(samples: DataFrame, kinship: DataFrame) -> DataFrame:
    return splits.repair_related(splits.individuals(samples, "sample_id", "ancestry"), "sample_id", kinship, 0.24).select("sample_id", "split")


@query("samples", "kinship", sql="SELECT sample_id, ancestry FROM samples WHERE sample_id NOT IN (SELECT greatest(id_a, id_b) FROM kinship WHERE kinship > 0.2)")
def unrelated_samples(samples: DataFrame, kinship: DataFrame) -> DataFrame:
    return splits.unrelated(samples, "sample_id", kinship, 0.2).select("sample_id", "ancestry")


@query("samples", sql="e AS (SELECT sample_id, CAST(r AS INTEGER) AS repeat FROM samples, range(5) t(r)), k AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY md5(concat_ws(':', CAST(sample_id AS STRING), CAST(repeat AS STRING), '42')), sample_id) AS rn FROM e) SELECT sample_id, repeat FROM k WHERE rn <= 20")
def leave_n_out(samples: DataFrame) -> DataFrame:
    return splits.leave_n_out(samples, "sample_id", 20, 5)


@query("samples", sql="g AS (SELECT ancestry, count(*) AS n FROM samples GROUP BY 1), q AS (SELECT ancestry, n, least(n, CAST(round_even(CAST(n AS DOUBLE) / sum(n) OVER () * 33, 0) AS BIGINT)) AS quota FROM g), l AS (SELECT *, 33 - sum(quota) OVER () AS lft, coalesce(sum(n - quota) OVER (ORDER BY n DESC, ancestry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up, coalesce(sum(quota) OVER (ORDER BY n, ancestry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dn FROM q), f AS (SELECT ancestry, quota + CASE WHEN lft > 0 THEN greatest(0, least(n - quota, lft - up)) ELSE -greatest(0, least(quota, -lft - dn)) END AS quota FROM l), e AS (SELECT sample_id, ancestry, quota, CAST(r AS INTEGER) AS repeat FROM samples JOIN f USING (ancestry), range(3) t(r)), k AS (SELECT *, row_number() OVER (PARTITION BY ancestry, repeat ORDER BY md5(concat_ws(':', CAST(sample_id AS STRING), CAST(repeat AS STRING), '42')), sample_id) AS rn FROM e) SELECT sample_id, ancestry, repeat FROM k WHERE rn <= quota")
def stratified_leave_n_out(samples: DataFrame) -> DataFrame:
    return splits.stratified_leave_n_out(samples, "sample_id", "ancestry", 33, 3)


@query("assertions", sql="l AS (SELECT * FROM assertions WHERE clinsig_simple IN (0, 1)), g AS (SELECT gene_symbol, count(*) FILTER (WHERE clinsig_simple = 1) AS p, count(*) FILTER (WHERE clinsig_simple = 0) AS b FROM l GROUP BY 1), k AS (SELECT l.*, p, b, row_number() OVER (PARTITION BY gene_symbol, clinsig_simple ORDER BY md5(concat(CAST(variation_id AS STRING), ':42')), variation_id) AS rn FROM l JOIN g USING (gene_symbol) WHERE p >= 5 AND b >= 5) SELECT variation_id, gene_symbol, clinsig_simple FROM k WHERE rn <= least(p, b)")
def gene_balanced_sample(assertions: DataFrame) -> DataFrame:
    return splits.balanced_by_group(assertions, "variation_id", "gene_symbol", "clinsig_simple").select("variation_id", "gene_symbol", "clinsig_simple")


@query("assertions", sql="SELECT variation_id, gene_symbol FROM assertions ORDER BY md5(concat(CAST(variation_id AS STRING), ':42')), variation_id LIMIT 500")
def seeded_sample(assertions: DataFrame) -> DataFrame:
    return splits.seeded_sample(assertions.select("variation_id", "gene_symbol"), "variation_id", 500)


@query("assertions", "samples", "kinship", sql=f"""t AS (SELECT *, CASE WHEN last_evaluated <= TIMESTAMP '1999-12-31' THEN 'train' ELSE 'test' END AS split FROM assertions), {SPLIT},
v AS (SELECT 'temporal' AS "check", count(*) FILTER (WHERE (split = 'train' AND last_evaluated > TIMESTAMP '1999-12-31') OR (split = 'test' AND last_evaluated <= TIMESTAMP '1999-12-31')) AS violations FROM t
UNION ALL SELECT 'gene', count(*) FROM (SELECT gene_symbol FROM t WHERE split = 'train' INTERSECT SELECT gene_symbol FROM t WHERE split = 'test')
UNION ALL SELECT 'relatedness', count(*) FROM kinship k JOIN sp x ON x.sample_id = id_a JOIN sp y ON y.sample_id = id_b WHERE kinship > 0.0442 AND x.split <> y.split
UNION ALL SELECT 'cohort', count(*) FROM sp WHERE split = 'test' AND sample_id % 3 = 0
UNION ALL SELECT 'batch', CASE WHEN (SELECT count(DISTINCT ancestry) FROM sp WHERE split = 'test') = 1 AND (SELECT count(DISTINCT ancestry) FROM sp) > 1 THEN 1 ELSE 0 END)
SELECT "check", violations = 0 AS passed, violations FROM v""")
def leakage_report(assertions: DataFrame, samples: DataFrame, kinship: DataFrame) -> DataFrame:
    """All checks that have their inputs, without raising."""
    dated = splits.temporal(assertions, "last_evaluated", CUTOFF)
    people = splits.individuals(samples, "sample_id", "ancestry")
    return splits.report([splits.check_temporal(dated, "last_evaluated", CUTOFF), splits.check_overlap(dated, "gene_symbol", "gene"), splits.check_relatedness(people, "sample_id", kinship), splits.check_cohort(people, "sample_id", samples.where("sample_id % 3 = 0")), splits.check_batch(people, "ancestry")])


@query("tool_results", sql="SELECT tool_name, CASE WHEN lower(tool_name) IN ('pca', 'pca_clustering', 'genetic_pca') THEN true WHEN lower(tool_name) IN ('self_reported', 'self-reported', 'ehr', 'survey') THEN false ELSE true END AS passes, count(*) AS n FROM tool_results GROUP BY ALL")
def population_sources(tool_results: DataFrame) -> DataFrame:
    return tool_results.groupBy("tool_name", V.population_source_passes(F.col("tool_name")).alias("passes")).agg(F.count("*").alias("n"))


# Cohort jobs


@query("genotypes", "catalog", sql="w AS (SELECT CAST(substr(rsid, 3) AS BIGINT) AS variant_id, CAST(CAST(substr(rsid, 3) AS BIGINT) % 51 - 25 AS DOUBLE) AS weight, CAST(substr(rsid, 3) AS BIGINT) % 5 = 0 AS flipped FROM catalog) SELECT sample_id, sum(CASE WHEN flipped THEN 2 - dosage ELSE dosage END * weight) + 0.0::DOUBLE AS score_sum, (sum(CASE WHEN flipped THEN 2 - dosage ELSE dosage END * weight) + 0.0::DOUBLE) / (2 * count(*)) AS score_avg, count(*) AS n_variants FROM genotypes JOIN w USING (variant_id) GROUP BY 1")
def prs_scores(genotypes: DataFrame, catalog: DataFrame) -> DataFrame:
    ident = F.substring("rsid", 3, 20).cast("bigint")
    weights = catalog.select(ident.alias("variant_id"), (ident % 51 - 25).cast("double").alias("weight"), (ident % 5 == 0).alias("flipped"))
    zero = F.lit(0.0)  # makes a sum of -0.0 plain
    return cohort.polygenic_scores(genotypes, weights).select("sample_id", (F.col("score_sum") + zero).alias("score_sum"), (F.col("score_avg") + zero).alias("score_avg"), "n_variants")


@query("genotypes", "samples", sql="m AS (SELECT variant_id, sum(dosage) / (2.0 * (SELECT count(*) FROM samples)) AS f FROM genotypes GROUP BY 1) SELECT variant_id, round(CAST(least(f, 1 - f) AS DOUBLE), 6) AS maf FROM m WHERE least(f, 1 - f) >= 0.01")
def minor_allele_frequencies(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    return cohort.minor_allele_frequency(genotypes, samples.agg(F.count("*")).scalar(), 0.01).select("variant_id", r6("maf"))


@query("variants", "catalog", sql="h AS (SELECT DISTINCT chrom, pos FROM variants), j AS (SELECT h.chrom, h.pos, rsid, trait, pvalue, row_number() OVER (PARTITION BY h.chrom, h.pos, trait ORDER BY coalesce(nullif(pvalue, 0), 1), rsid) AS rn FROM h JOIN catalog c ON c.chrom = h.chrom AND c.pos = h.pos), g AS (SELECT *, CASE WHEN contains(lower(trait), 'steel') THEN 'biomarker' WHEN contains(lower(trait), 'brass') THEN 'health' ELSE 'trait' END AS category FROM j WHERE rn = 1), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY coalesce(nullif(pvalue, 0), 1), rsid) AS rank, count(*) OVER (PARTITION BY category) AS total FROM g) SELECT chrom, pos, rsid, trait, category, CAST(rank AS INTEGER) AS rank, total FROM k WHERE rank <= CASE category WHEN 'biomarker' THEN 50 ELSE 100 END")
def gwas_hits_topn(variants: DataFrame, catalog: DataFrame) -> DataFrame:
    """Association hits by position, the most significant of each category with full counts."""
    hits = joins.catalog_hits(variants, catalog, ["chrom", "pos"])
    low = F.lower("trait")
    hits = hits.withColumn("category", F.when(low.contains("steel"), "biomarker").when(low.contains("brass"), "health").otherwise("trait"))
    top = joins.top_by_category(hits, "category", {"health": 100, "trait": 100, "biomarker": 50}, [joins.significance(F.col("pvalue")), "rsid"])
    return top.select("chrom", "pos", "rsid", "trait", "category", "rank", "total")


@query("reads", sql="c AS (SELECT chrom, CAST(floor(pos / 1000000) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY ALL), e AS (SELECT chrom, unnest(range(0, max(bin) + 1)) AS bin FROM c GROUP BY 1) SELECT e.chrom, e.bin, coalesce(n, 0) AS n FROM e LEFT JOIN c ON c.chrom = e.chrom AND c.bin = e.bin")
def read_bins(reads: DataFrame) -> DataFrame:
    return cohort.read_bins(reads)


@query("reads", "bed", sql="s AS (SELECT DISTINCT chrom, bed_start * 1000 AS centre FROM bed), j AS (SELECT s.chrom, centre, pos - centre AS o FROM s JOIN reads r ON r.chrom = s.chrom AND abs(r.pos - centre) <= 20000) SELECT chrom, centre, count(*) AS n_reads, count(*) FILTER (WHERE abs(o) <= 5000) AS n_central, round(avg(abs(o)), 4) AS mean_distance FROM j GROUP BY ALL")
def footprint_windows(reads: DataFrame, bed: DataFrame) -> DataFrame:
    sites = bed.select("chrom", (F.col("bed_start") * 1000).alias("centre")).distinct().withColumn("site", F.struct("chrom", "centre"))
    return cohort.coverage_summary(joins.near_sites(reads, sites, 20000), "site", 5000).select("site.chrom", "site.centre", "n_reads", "n_central", F.round("mean_distance", 4).alias("mean_distance"))


@query("svs", sql="SELECT a.sv_id AS a_sv_id, b.sv_id AS b_sv_id, round(CAST(least(a.sv_end, b.sv_end) - greatest(a.sv_start, b.sv_start) AS DOUBLE) / greatest(a.sv_end - a.sv_start, b.sv_end - b.sv_start), 6) AS share FROM svs a JOIN svs b ON a.chrom = b.chrom AND a.sv_id < b.sv_id AND least(a.sv_end, b.sv_end) > greatest(a.sv_start, b.sv_start) WHERE a.sv_end - a.sv_start >= 50 AND b.sv_end - b.sv_start >= 50 AND CAST(least(a.sv_end, b.sv_end) - greatest(a.sv_start, b.sv_start) AS DOUBLE) / greatest(a.sv_end - a.sv_start, b.sv_end - b.sv_start) >= 0.7")
def sv_reciprocal_overlap(svs: DataFrame) -> DataFrame:
    large = svs.where(F.col("sv_end") - F.col("sv_start") >= 50)
    return joins.reciprocal_overlap(large, large).where("a_sv_id < b_sv_id").select("a_sv_id", "b_sv_id", r6("share"))


@query("svs", sql="SELECT sv_type, chrom, count(*) AS n, CAST(max(sv_end - sv_start) AS BIGINT) AS longest, count(*) FILTER (WHERE sv_end - sv_start >= 50) AS n_large FROM svs GROUP BY ALL")
def sv_summary(svs: DataFrame) -> DataFrame:
    size = F.col("sv_end") - F.col("sv_start")
    return svs.groupBy("sv_type", "chrom").agg(F.count("*").alias("n"), F.max(size).alias("longest"), F.count_if(size >= 50).alias("n_large"))


CONTEXT = "substr('ACGT', CAST(pos % 4 AS INT) + 1, 1)", "substr('ACGT', CAST(l_orderkey % 3 AS INT) + 1, 1)"


@query("variants", sql=f"v AS (SELECT chrom, ref, alt, {CONTEXT[0]} AS l, {CONTEXT[1]} AS r FROM variants WHERE ref <> alt), f AS (SELECT chrom, CASE WHEN ref IN ('A', 'G') THEN concat(translate(r, 'ACGT', 'TGCA'), '[', translate(ref, 'ACGT', 'TGCA'), '>', translate(alt, 'ACGT', 'TGCA'), ']', translate(l, 'ACGT', 'TGCA')) ELSE concat(l, '[', ref, '>', alt, ']', r) END AS channel FROM v) SELECT chrom, channel, count(*) AS n FROM f GROUP BY ALL")
def mutation_spectrum(variants: DataFrame) -> DataFrame:
    context = F.concat(F.expr(CONTEXT[0]), F.col("ref"), F.expr(CONTEXT[1]))
    return cohort.mutation_spectrum(variants.withColumn("context", context), "chrom")


@query("variants", sql="b AS (SELECT *, length(ref) = 1 AND length(alt) = 1 AND ref <> alt AS snv FROM variants), t AS (SELECT *, snv AND concat(ref, alt) IN ('AG', 'GA', 'CT', 'TC') AS ti FROM b) SELECT chrom, count(*) AS records, count(*) FILTER (WHERE snv) AS snvs, count(*) FILTER (WHERE filter IS NULL OR filter = 'PASS') AS passing, round(CAST(count(*) FILTER (WHERE ti) AS DOUBLE) / count(*) FILTER (WHERE snv AND NOT ti), 6) AS titv FROM t GROUP BY 1")
def call_statistics(variants: DataFrame) -> DataFrame:
    rows = cohort.call_statistics(variants, ["chrom"])
    return rows.select("chrom", "records", "snvs", "passing", r6("titv", F.col("transitions").cast("double") / F.col("transversions")))


@query("samples", sql="c AS (SELECT * FROM samples WHERE phenotype > 9000), w AS (SELECT ancestry, count(*) * 4 AS w FROM c GROUP BY 1), k AS (SELECT sample_id, ancestry, row_number() OVER (PARTITION BY ancestry ORDER BY md5(concat(CAST(sample_id AS STRING), ':42')), sample_id) AS rn FROM samples WHERE phenotype <= 9000) SELECT sample_id, ancestry FROM k JOIN w USING (ancestry) WHERE rn <= w")
def matched_controls(samples: DataFrame) -> DataFrame:
    return cohort.matched_controls(samples.where("phenotype > 9000"), samples.where("phenotype <= 9000"), ["ancestry"], "sample_id", 4).select("sample_id", "ancestry")


@query("reads", sql="s AS (SELECT chrom, CAST(floor(pos / 1000) AS BIGINT) AS site, count(*) * 11 AS coverage FROM reads GROUP BY ALL), u AS (SELECT *, site % 7 = 0 AS unstable FROM s WHERE coverage >= 20), p AS (SELECT chrom, count(*) AS n_sites, count(*) FILTER (WHERE unstable) AS n_unstable FROM u GROUP BY 1) SELECT chrom, n_sites, n_unstable, round(100.0 * n_unstable / n_sites, 2) AS percent, CASE WHEN round(100.0 * n_unstable / n_sites, 2) >= 20 THEN 'MSI-H' WHEN round(100.0 * n_unstable / n_sites, 2) >= 10 THEN 'MSI-L' ELSE 'MSS' END AS status FROM p")
def unstable_sites(reads: DataFrame) -> DataFrame:
    sites = reads.groupBy("chrom", F.floor(F.col("pos") / 1000).alias("site")).agg((F.count("*") * 11).alias("coverage")).withColumn("unstable", F.col("site") % 7 == 0)
    rows = cohort.unstable_sites(sites, ["chrom"])
    return rows.select("chrom", "n_sites", "n_unstable", F.col("percent").cast("double").alias("percent"), V.msi_status(F.col("percent")).alias("status"))


@query("tool_results", sql="f AS (SELECT run_id, tool_name, CAST(count(*) FILTER (WHERE status = 'ok') AS DOUBLE) / count(*) AS fraction FROM tool_results GROUP BY ALL) SELECT run_id, max_by(tool_name, (fraction, tool_name)) AS dominant, round(max(fraction), 6) AS fraction FROM f GROUP BY 1")
def dominant_tool(tool_results: DataFrame) -> DataFrame:
    f = tool_results.groupBy("run_id", "tool_name").agg((F.count_if(F.col("status") == "ok").cast("double") / F.count("*")).alias("fraction"))
    return cohort.dominant(f, "run_id", "tool_name", "fraction").select("run_id", "dominant", r6("fraction"))


# Result store


@query("runs", sql="r AS (SELECT *, row_number() OVER (PARTITION BY task_id, model_name ORDER BY ts DESC, run_no DESC) AS rn FROM runs) SELECT task_id, model_name, run_no, round(estimate, 6) AS estimate FROM r WHERE rn = 1")
def runs_latest_per_model(runs: DataFrame) -> DataFrame:
    return results.latest(runs, ["task_id", "model_name"]).select("task_id", "model_name", "run_no", r6("estimate"))


@query("runs", sql="r AS (SELECT *, row_number() OVER (PARTITION BY task_id, model_name ORDER BY ts DESC, run_no DESC) AS rn FROM runs) SELECT model_name, round(max(estimate) FILTER (WHERE task_id = 'clinvar/all_snv'), 6) AS all_snv, round(max(estimate) FILTER (WHERE task_id = 'clinvar/balanced'), 6) AS balanced FROM r WHERE rn = 1 GROUP BY 1")
def runs_compare_pivot(runs: DataFrame) -> DataFrame:
    rows = results.compare(runs, ["clinvar/all_snv", "clinvar/balanced"])
    return rows.select("model_name", r6("all_snv", F.col("clinvar/all_snv")), r6("balanced", F.col("clinvar/balanced")))


@query("runs", sql="SELECT run_no, task_id, model_name FROM runs WHERE contains(task_id, 'balanced') AND model_name = 'm3' ORDER BY ts DESC, run_no DESC LIMIT 50")
def list_runs(runs: DataFrame) -> DataFrame:
    return results.list_runs(runs, "balanced", "m3").select("run_no", "task_id", "model_name")


@query("runs", sql="SELECT task_id, model_name, count(*) AS n, round(avg(estimate), 6) AS mean, round(min(estimate), 6) AS least, round(max(estimate), 6) AS most FROM runs GROUP BY ALL")
def metric_history(runs: DataFrame) -> DataFrame:
    return runs.groupBy("task_id", "model_name").agg(F.count("*").alias("n"), F.round(F.avg("estimate"), 6).alias("mean"), F.round(F.min("estimate"), 6).alias("least"), F.round(F.max("estimate"), 6).alias("most"))


EXPECTED = (("m0", 0.94, 0.85), ("m1", 0.5, 0.3), ("m9", 0.95, 0.99))
EXPECTED_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {e}::DOUBLE, {t}::DOUBLE)" for m, e, t in EXPECTED) + ") v(model_name, expected, threshold)"
LATEST = "la AS (SELECT model_name, arg_max(estimate, (ts, run_no)) AS estimate FROM runs GROUP BY 1)"


@query("runs", sql=f"{LATEST}, ex AS ({EXPECTED_SQL}) SELECT model_name, expected, round(estimate, 6) AS estimate, CASE WHEN estimate IS NULL THEN 'missing' WHEN abs(estimate - expected) > 0.05 THEN 'differs' ELSE 'ok' END AS state FROM ex LEFT JOIN la USING (model_name)")
def baseline_validation(runs: DataFrame) -> DataFrame:
    expected = runs.sparkSession.createDataFrame(EXPECTED, "model_name string, expected double, threshold double")
    rows = results.validate(expected.drop("threshold"), results.latest(runs, ["model_name"]).select("model_name", "estimate"), ["model_name"])
    return rows.select("model_name", "expected", r6("estimate"), "state")


@query("runs", sql=f"{LATEST}, ex AS ({EXPECTED_SQL}) SELECT model_name, round(estimate, 6) AS estimate, CASE WHEN threshold IS NULL THEN 'none' WHEN estimate >= threshold THEN 'pass' ELSE 'fail' END AS gate, round(estimate / expected, 6) AS normalised FROM la LEFT JOIN ex USING (model_name)")
def gates(runs: DataFrame) -> DataFrame:
    limits = runs.sparkSession.createDataFrame(EXPECTED, "model_name string, expected double, threshold double")
    rows = results.gates(results.latest(runs, ["model_name"]).select("model_name", "estimate"), limits.drop("expected"), ["model_name"])
    rows = metrics.ceiling_normalised(rows, limits.select("model_name", F.col("expected").alias("ceiling")), ["model_name"])
    return rows.select("model_name", r6("estimate"), "gate", r6("normalised"))


@query("tool_results", sql="SELECT run_id, CASE WHEN bool_or(status IN ('failed', 'timeout', 'skipped') AND criticality = 'critical') THEN 'failed' WHEN bool_or((status IN ('failed', 'timeout', 'skipped') AND criticality <> 'optional') OR status = 'partial') THEN 'partial' ELSE 'ok' END AS status, count(*) AS n_tools, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'partial') AS n_partial, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'skipped') AS n_skipped FROM tool_results GROUP BY 1")
def pipeline_status(tool_results: DataFrame) -> DataFrame:
    return results.pipeline_status(tool_results)


# Models


@query("assertions", sql="SELECT variation_id, round(CAST(('0x' || substr(md5(concat_ws(':', CAST(variation_id AS STRING), '42')), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0, 9) AS null_score FROM assertions")
def null_model(assertions: DataFrame) -> DataFrame:
    return models.null_scores(assertions, "variation_id").select("variation_id", F.round("null_score", 9).alias("null_score"))


@query("assertions", sql=f"t AS (SELECT *, CASE WHEN last_evaluated <= TIMESTAMP '1999-12-31' THEN 'train' ELSE 'test' END AS split FROM assertions WHERE clinsig_simple IN (0, 1)), m AS (SELECT avg(CAST(clinsig_simple AS DOUBLE)) AS mean FROM t WHERE split = 'train'), lg AS (SELECT 'given' AS model, clinsig_simple, score AS s FROM t WHERE split = 'test' UNION ALL SELECT 'null', clinsig_simple, CAST(('0x' || substr(md5(concat_ws(':', CAST(variation_id AS STRING), '42')), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 FROM t WHERE split = 'test' UNION ALL SELECT 'mean', clinsig_simple, mean FROM t, m WHERE split = 'test'), {counted('SELECT * FROM lg', 'model', 'clinsig_simple', 's')} SELECT model, round({AUC}, 6) AS auroc FROM c GROUP BY 1")
def baseline_models(assertions: DataFrame) -> DataFrame:
    """The default baselines beside the given score, in one pass over long scores."""
    rows = splits.temporal(assertions.where(F.col("clinsig_simple").isin(0, 1)), "last_evaluated", CUTOFF)
    scored = models.mean_scores(models.null_scores(rows, "variation_id"), "clinsig_simple").where("split = 'test'")
    long = models.long_scores(scored, ["clinsig_simple"], {"given": F.col("score"), "null": F.col("null_score"), "mean": F.col("mean_score")})
    return metrics.auroc(long, "clinsig_simple", "score", ["model"]).select("model", r6("auroc", F.col("estimate")))


@query("assertions")
def auroc_bootstrap(assertions: DataFrame) -> DataFrame:
    return bootstrap.auroc_interval(assertions, "variation_id", "clinsig_simple", "score", replicates=500)


@query("samples")
def accuracy_bootstrap(samples: DataFrame) -> DataFrame:
    rows = labelled_samples(samples)
    right = ((F.col("score") > 0.5).cast("int") == F.col("label")).cast("double")
    return bootstrap.ratio_interval(rows, "sample_id", right, F.lit(1.0), ["ancestry"], replicates=500)


CLOCKS = (("first", 64, 0), ("second", 65, 1))  # name, probes, offset of the coefficients


def clock_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the vectors as probes, in decimals, so that sums don't depend on their order; one clock has a
    probe that no sample has."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("at", "value"))
    betas = rows.select("sample_id", (F.col("at") + 1).alias("cpg"), F.round(F.col("value").cast("double"), 6).cast("decimal(12,6)").alias("beta"))
    made = [(c, name, c * 3 + offset) for name, probes, offset in CLOCKS for c in range(1, probes + 1)]
    coefficients = spark.createDataFrame(made, "cpg int, clock string, coefficient int")
    ages = betas.select("sample_id").distinct().select("sample_id", (F.col("sample_id") % 80).alias("age"))
    scored = cohort.clock_scores(betas, coefficients, ages)
    return scored.select("sample_id", "clock", F.col("predicted").cast("double").alias("predicted"), "n_probes", "n_missing", F.col("acceleration").cast("double").alias("acceleration"))


QUERIES["clock_scores"] = clock_scores
ORACLE_SQL["clock_scores"] = """WITH m AS (SELECT vec_id AS sample_id, i AS cpg, CAST(round(CAST(embedding[i] AS DOUBLE), 6) AS DECIMAL(12, 6)) AS beta FROM embeddings, range(1, 65) t(i) WHERE i <= len(embedding)),
c AS (SELECT i AS cpg, 'first' AS clock, i * 3 AS k FROM range(1, 65) t(i) UNION ALL SELECT i, 'second', i * 3 + 1 FROM range(1, 66) t(i)),
s AS (SELECT sample_id, clock, CAST(sum(beta * k) AS DOUBLE) AS predicted, count(beta) AS n_probes FROM m JOIN c USING (cpg) GROUP BY ALL)
SELECT sample_id, clock, predicted, n_probes, CASE clock WHEN 'first' THEN 64 ELSE 65 END - n_probes AS n_missing, CAST(round(CAST(predicted AS DECIMAL(18, 6)) - sample_id % 80, 2) AS DOUBLE) AS acceleration FROM s"""


# Reports and specified metrics


@query("variants", sql=f"v AS (SELECT chrom, ref, alt, {CONTEXT[0]} AS l, {CONTEXT[1]} AS r FROM variants WHERE ref <> alt), f AS (SELECT chrom, CASE WHEN ref IN ('A', 'G') THEN concat(translate(r, 'ACGT', 'TGCA'), '[', translate(ref, 'ACGT', 'TGCA'), '>', translate(alt, 'ACGT', 'TGCA'), ']', translate(l, 'ACGT', 'TGCA')) ELSE concat(l, '[', ref, '>', alt, ']', r) END AS channel FROM v), n AS (SELECT chrom, channel, count(*) AS n FROM f GROUP BY ALL), k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY chrom) AS BIGINT) AS total, count(*) OVER (PARTITION BY chrom) AS n_present, row_number() OVER (PARTITION BY chrom ORDER BY n DESC, channel) AS rank FROM n) SELECT chrom, channel, n, total, n_present, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def spectrum_top5(variants: DataFrame) -> DataFrame:
    context = F.concat(F.expr(CONTEXT[0]), F.col("ref"), F.expr(CONTEXT[1]))
    return cohort.top_share(cohort.mutation_spectrum(variants.withColumn("context", context), "chrom"), "chrom", "channel", "n")


@query("svs", "bed", sql="c AS (SELECT sv_id, chrom, 'A' || CAST(sv_id % 3 AS STRING) AS locus FROM svs), t AS (SELECT sv_id, locus, 'HLA-A*0' || CAST(sv_id % 4 AS STRING) || ':01:' || CAST(sv_id % 2 AS STRING) AS a1, 'A*02:0' || CAST(sv_id % 3 AS STRING) AS a2, 'A*02:0' || CAST(sv_id % 3 AS STRING) || ':09' AS b1, CASE WHEN sv_id % 5 = 0 THEN 'A*09:01' ELSE 'A*0' || CAST(sv_id % 4 AS STRING) || ':01' END AS b2 FROM c), f AS (SELECT locus, list_sort(['A*0' || CAST(sv_id % 4 AS STRING) || ':01', a2]) = list_sort(['A*02:0' || CAST(sv_id % 3 AS STRING), b2]) AS same FROM t) SELECT locus, round(avg(CAST(same AS DOUBLE)), 6) AS concordance, count(*) AS n FROM f GROUP BY 1")
def hla_concordance(svs: DataFrame, bed: DataFrame) -> DataFrame:
    """Two-field agreement of typed loci, from alleles derived of the rows' ids."""
    ident = lambda n: (F.col("sv_id") % n).cast("string")
    rows = svs.withColumn("locus", F.concat(F.lit("A"), ident(3)))
    truth = rows.withColumns({"allele_1": F.concat(F.lit("HLA-A*0"), ident(4), F.lit(":01:"), ident(2)), "allele_2": F.concat(F.lit("A*02:0"), ident(3))})
    calls = rows.withColumns({"allele_1": F.concat(F.lit("A*02:0"), ident(3), F.lit(":09")), "allele_2": F.when(F.col("sv_id") % 5 == 0, "A*09:01").otherwise(F.concat(F.lit("A*0"), ident(4), F.lit(":01")))})
    return reports.hla_concordance(truth, calls, ["sv_id", "locus"], ["locus"]).select("locus", r6("concordance"), "n")


@query("samples", sql="SELECT sample_id, CASE WHEN sample_id % 7 = 0 THEN NULL ELSE round(phenotype / 10000, 6) END AS tumour_fraction, CASE WHEN sample_id % 3 = 0 THEN NULL ELSE 2.0::DOUBLE + sample_id % 3 END AS ploidy, sample_id % 7 = 0 AS warning FROM samples")
def tumour_fractions(samples: DataFrame) -> DataFrame:
    """Key-value lines, parsed back."""
    fraction = F.when(F.col("sample_id") % 7 == 0, "NA").otherwise(F.round(F.col("phenotype") / 10000, 6).cast("string"))
    ploidy = F.when(F.col("sample_id") % 3 == 0, "?").otherwise((F.lit(2.0) + F.col("sample_id") % 3).cast("string"))
    lines = samples.select("sample_id", F.explode(F.array(F.concat(F.lit("Tumor Fraction: "), fraction), F.concat(F.lit("Ploidy:"), ploidy), F.lit("no pair"))).alias("value"))
    return reports.tumour_fractions(lines, "sample_id")


@query("catalog", sql="e AS (SELECT split_part(trait, ' ', 1) AS gene, CASE WHEN CAST(substr(rsid, 3) AS BIGINT) % 4 = 0 THEN NULL ELSE 'LEVEL_' || CAST(CAST(substr(rsid, 3) AS BIGINT) % 4 AS STRING) END AS level, CASE WHEN CAST(substr(rsid, 3) AS BIGINT) % 8 = 0 THEN 'PREDICTIVE' ELSE 'PROGNOSTIC' END AS evidence_type, CAST(substr(rsid, 3) AS BIGINT) % 3 = 0 AS oncogenic FROM catalog) SELECT gene, min(level) AS best_level, bool_or(level IS NOT NULL OR evidence_type = 'PREDICTIVE') AS therapeutic, count(*) FILTER (WHERE oncogenic) AS n_oncogenic, count(*) FILTER (WHERE level IS NOT NULL OR evidence_type = 'PREDICTIVE') AS n_therapeutic FROM e GROUP BY 1")
def actionability(catalog: DataFrame) -> DataFrame:
    ident = F.substring("rsid", 3, 20).cast("bigint")
    evidence = catalog.select(
        F.split("trait", " ")[0].alias("gene"),
        F.when(ident % 4 != 0, F.concat(F.lit("LEVEL_"), (ident % 4).cast("string"))).alias("level"),
        F.when(ident % 8 == 0, "PREDICTIVE").otherwise("PROGNOSTIC").alias("evidence_type"),
        (ident % 3 == 0).alias("oncogenic"),
    )
    return cohort.actionability(evidence, ["gene"])


@query("samples", sql=f"{GROUPED}{SHOWN} SELECT 'auroc' AS metric, {', '.join(f'round(max(estimate) FILTER (WHERE ancestry = {chr(39)}{g}{chr(39)}), 6) AS {g.lower()}' for g in ('EUR', 'AFR', 'SAS', 'EAS', 'AMR', 'ALL'))} FROM shown")
def ancestry_report(samples: DataFrame) -> DataFrame:
    groups = ["EUR", "AFR", "SAS", "EAS", "AMR", "ALL"]
    found = metrics.by_group_and_whole(labelled_samples(samples), metrics.auroc, "ancestry", "label", "score").withColumn("metric", F.lit("auroc"))
    return results.pivot_by_group(found, groups).select("metric", *(r6(g.lower(), F.col(g)) for g in groups))


@query("samples", sql="e AS (SELECT sample_id, phenotype, CAST(r AS INTEGER) AS repeat FROM samples, range(5) t(r)), k AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY md5(concat_ws(':', CAST(sample_id AS STRING), CAST(repeat AS STRING), '42')), sample_id) AS rn FROM e), m AS (SELECT repeat, avg(phenotype) AS v FROM k WHERE rn <= 50 GROUP BY 1) SELECT round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, count(*) AS folds FROM m")
def cross_validated_mean(samples: DataFrame) -> DataFrame:
    """Mean and deviation over repeats of held-out samples."""
    folds = splits.leave_n_out(samples, "sample_id", 50, 5).join(samples, "sample_id")
    per = folds.groupBy("repeat").agg(F.avg("phenotype").alias("v"))
    return per.agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("sd"), F.count("*").alias("folds"))


@query("variants", "scores", sql=f"l AS (SELECT CASE WHEN concat(ref, alt) IN ('AG', 'GA', 'CT', 'TC') THEN 'transition' ELSE 'transversion' END AS class, CAST(l_partkey % 2 AS INT) AS y, score FROM variants JOIN scores USING (chrom, pos, ref, alt)), {counted('SELECT * FROM l', 'class', 'y')} SELECT class, round({AUC}, 6) AS auroc, CAST(sum(pos + neg) AS BIGINT) AS n FROM c GROUP BY 1")
def auroc_by_variant_class(variants: DataFrame, scores: DataFrame) -> DataFrame:
    change = F.concat("ref", "alt").isin("AG", "GA", "CT", "TC")
    rows = joins.lookup(variants, scores).select(F.when(change, "transition").otherwise("transversion").alias("class"), (F.col("l_partkey") % 2).cast("int").alias("y"), "score")
    return metrics.auroc(rows, "y", "score", ["class"]).select("class", r6("auroc", F.col("estimate")), "n")


# Studies, panels and reports


@query("samples", sql="s AS (SELECT *, sample_id % 4 AS a, sample_id % 3 AS b, (sample_id + CASE WHEN sample_id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS d FROM samples) SELECT ancestry, round(avg(CASE WHEN least(a, b) = least(b, d) AND greatest(a, b) = greatest(b, d) THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN a + b = b + d THEN 1.0 ELSE 0.0 END), 6) AS phenotype_match, count(*) AS n FROM s GROUP BY 1")
def diplotype_accuracy(samples: DataFrame) -> DataFrame:
    """Calls that name the haplotypes the other way round, a fifth of them wrong."""
    a, b = F.col("sample_id") % 4, F.col("sample_id") % 3
    d = (F.col("sample_id") + F.when(F.col("sample_id") % 5 == 0, 1).otherwise(0)) % 4
    named = lambda x, y: [F.concat(F.lit("*"), x.cast("string"), F.lit("/*"), y.cast("string")).alias("diplotype"), (x + y).alias("phenotype")]
    found = studies.diplotype_accuracy(samples.select("sample_id", "ancestry", *named(a, b)), samples.select("sample_id", *named(b, d)), ["sample_id"], ["ancestry"])
    return found.select("ancestry", r6("exact"), r6("phenotype_match"), "n")


@query("assays", sql="r AS (SELECT assay_id, row_id % 3 AS tissue, CASE WHEN count(*) < 3 THEN 0 ELSE corr(dms_score, score) END AS r FROM assays GROUP BY 1, 2) SELECT tissue, round(avg(r), 6) AS mean_r, round(avg(CASE WHEN r > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share_above, count(*) AS n_loci FROM r GROUP BY 1")
def tissue_correlations(assays: DataFrame) -> DataFrame:
    found = studies.tissue_correlations(assays.withColumn("tissue", F.col("row_id") % 3), "dms_score", "score", "assay_id")
    return found.select("tissue", r6("mean_r"), r6("share_above"), "n_loci")


@query("assays", sql="t AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES (0.9), (0.5)) v(t)) SELECT threshold, round(avg(CASE WHEN sign(dms_score - 200000.5) = sign(row_id % 7 - 3.5) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM assays JOIN t ON score > threshold GROUP BY 1")
def direction_by_confidence(assays: DataFrame) -> DataFrame:
    rows = assays.select((F.col("dms_score") - 200000.5).alias("true"), (F.col("row_id") % 7 - 3.5).alias("predicted"), "score")
    return studies.direction_by_confidence(rows, "true", "predicted", "score").select("threshold", r6("accuracy", F.col("estimate")))


@query("assays", sql="r AS (SELECT assay_id, corr(dms_score, score) AS r FROM assays GROUP BY 1), q AS (SELECT quantile_cont(r, 0.25) AS lo, quantile_cont(r, 0.75) AS hi FROM r) SELECT round(avg(r) FILTER (WHERE r <= lo), 6) AS bottom, round(avg(r) FILTER (WHERE r >= hi), 6) AS top FROM r, q")
def quartile_performance(assays: DataFrame) -> DataFrame:
    return studies.quartile_performance(metrics.pearson(assays, "dms_score", "score", ["assay_id"])).select(r6("bottom"), r6("top"))


@query("samples", sql="SELECT ancestry, round(avg(CAST(phenotype AS DOUBLE) + CASE WHEN sample_id % 4 = 0 THEN 15 ELSE 0 END), 4) AS adjusted, round(avg(CAST(phenotype AS DOUBLE)) FILTER (WHERE sample_id % 4 <> 0), 4) AS untreated FROM samples GROUP BY 1")
def medication_adjusted(samples: DataFrame) -> DataFrame:
    treated = F.col("sample_id") % 4 == 0
    rows = studies.medication_adjusted(samples.withColumn("untreated", F.when(~treated, F.col("phenotype").cast("double"))), "phenotype", treated, 15)
    return rows.groupBy("ancestry").agg(F.round(F.avg(F.col("phenotype").cast("double")), 4).alias("adjusted"), F.round(F.avg("untreated"), 4).alias("untreated"))


@query("samples", sql=f"{GROUPED}, shown AS (SELECT ancestry, CASE WHEN n >= 30 OR ancestry = 'ALL' THEN estimate END AS e FROM a) SELECT ancestry, round((SELECT max(e) FROM shown WHERE ancestry = 'EUR') - e, 6) AS drop FROM shown")
def ancestry_drop(samples: DataFrame) -> DataFrame:
    found = metrics.by_group_and_whole(labelled_samples(samples), metrics.auroc, "ancestry", "label", "score")
    return studies.drop_from(found).select("ancestry", r6("drop"))


@query("genotypes", "catalog", sql="w AS (SELECT CAST(substr(rsid, 3) AS BIGINT) AS variant_id, chrom FROM catalog), j AS (SELECT sample_id, chrom, CAST(dosage * (variant_id % 13 - 6) AS DOUBLE) AS part FROM genotypes JOIN w USING (variant_id)) SELECT sample_id, round(sum(part), 4) AS score, round(coalesce(sum(part) FILTER (WHERE chrom <> 'chr6'), 0), 4) AS score_without FROM j GROUP BY 1")
def scores_without_locus(genotypes: DataFrame, catalog: DataFrame) -> DataFrame:
    ident = F.substring("rsid", 3, 20).cast("bigint")
    weights = catalog.select(ident.alias("variant_id"), (ident % 13 - 6).cast("double").alias("weight"), "chrom")
    found = studies.scores_without(genotypes, weights, F.col("chrom") == "chr6")
    return found.select("sample_id", F.round("score", 4).alias("score"), F.round("score_without", 4).alias("score_without"))


@query("variants", "catalog", sql="""g AS (SELECT chrom, pos, CASE WHEN l_partkey % 3 = 0 THEN concat('rs', CAST(l_partkey AS STRING)) END AS rsid, concat(alt, ref) AS genotype FROM variants),
k AS (SELECT rsid, chrom, pos, CASE WHEN pos % 2 = 0 THEN trait END AS effect, row_number() OVER (PARTITION BY chrom, pos ORDER BY rsid) AS rn FROM catalog),
m AS (SELECT g.*, CASE WHEN k.rsid IS NOT NULL THEN k.effect ELSE p.effect END AS effect FROM g LEFT JOIN k ON k.rsid = g.rsid LEFT JOIN k p ON p.rn = 1 AND p.chrom = g.chrom AND p.pos = g.pos WHERE k.rsid IS NOT NULL OR p.rsid IS NOT NULL)
SELECT CASE WHEN genotype IN ('AG', 'GA') THEN 'carrier' WHEN genotype IN ('CT', 'TC') THEN 'typical' WHEN effect IS NOT NULL THEN effect ELSE concat('Genotype: ', genotype) END AS interpretation, count(*) AS n FROM m GROUP BY 1""")
def genotype_interpretations(variants: DataFrame, catalog: DataFrame) -> DataFrame:
    rsid = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("rs"), F.col("l_partkey").cast("string")))
    called = variants.select("chrom", "pos", rsid.alias("rsid"), F.concat("alt", "ref").alias("genotype"))
    texts = F.create_map(F.lit("GA"), F.lit("carrier"), F.lit("CT"), F.lit("typical"))
    curated = catalog.select("rsid", "chrom", "pos", F.when(F.col("pos") % 2 == 0, F.col("trait")).alias("effect"), texts.alias("texts"))
    return panels.interpret_genotypes(called, curated).groupBy("interpretation").agg(F.count("*").alias("n"))


@query("variants", "catalog", sql="v AS (SELECT DISTINCT chrom, pos FROM variants), p AS (SELECT DISTINCT chrom, pos FROM catalog), s AS (SELECT count(*) AS n_shared FROM v JOIN p USING (chrom, pos)) SELECT (SELECT count(*) FROM v) AS n_variants, (SELECT count(*) FROM p) AS n_panel, n_shared, n_shared >= 100 AS enough FROM s")
def panel_overlap(variants: DataFrame, catalog: DataFrame) -> DataFrame:
    return panels.panel_overlap(variants, catalog)


@query("assertions", sql="f AS (SELECT * FROM assertions WHERE variation_id % 4 = 3 AND CAST(greatest(variation_id % 1000, variation_id % 777) AS DOUBLE) / 50000 <= 0.01) SELECT gene_symbol, round(max(score), 6) AS best, count(*) AS n FROM f GROUP BY 1 ORDER BY max(score) DESC, gene_symbol LIMIT 10")
def prioritised_loci(assertions: DataFrame) -> DataFrame:
    """The ten loci with the best scores among rare variants that may change a product."""
    effect = F.element_at(F.array(*(F.lit(x) for x in (*panels.DISTANT, "MISSENSE"))), (F.col("variation_id") % 4 + 1).cast("int"))
    rows = assertions.select("gene_symbol", "score", effect.alias("effect"), *((F.col("variation_id") % m / F.lit(50000.0)).alias(f"af{m}") for m in (1000, 777)))
    best = panels.prioritise(rows, "effect", ["af1000", "af777"]).groupBy("gene_symbol").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    return best.orderBy(F.col("top").desc(), "gene_symbol").limit(10).select("gene_symbol", r6("best", F.col("top")), "n")


@query("variants", "scores", sql="j AS (SELECT v.chrom, count(*) AS n, count(*) FILTER (WHERE s.score > 0.564) AS k FROM variants v JOIN scores s USING (chrom, pos, ref, alt) GROUP BY 1) SELECT chrom, concat('| ', chrom, ' | ', CAST(n AS STRING), ' | ', printf('%.3f', CAST(k AS DOUBLE) / n), ' |') AS line, printf('%d of %d variants (%.1f %%)', k, n, k * 100.0::DOUBLE / n) AS sentence FROM j")
def report_lines(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """Lines of a Markdown table of likely pathogenic variants by chromosome, and the same in words."""
    found = joins.lookup(variants, scores).where("score IS NOT NULL").groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.564).alias("k"))
    line = markdown.table_row(F.col("chrom"), F.col("n"), markdown.number(F.col("k") / F.col("n"), 3))
    return found.select("chrom", line.alias("line"), markdown.percent_of(F.col("k"), F.col("n"), "variants").alias("sentence"))


@query("variants")
def signature_fit(variants: DataFrame) -> DataFrame:
    """Spectra by chromosome as sums of the spectra by filter."""
    change = F.concat_ws(">", "ref", "alt").alias("context")
    counts = variants.select("chrom", F.coalesce("filter", F.lit("none")).alias("signature"), change).groupBy("chrom", "signature", "context").agg(F.count("*").alias("n"))
    total = counts.groupBy("signature").agg(F.sum("n").alias("total"))
    catalogue = counts.groupBy("signature", "context").agg(F.sum("n").alias("m")).join(total, "signature").select("signature", "context", (F.col("m") / F.col("total")).alias("share"))
    return panels.fit_signatures(counts, catalogue, "chrom").select("chrom", "signature", F.round("count", 3).alias("count"))
