"""Readers of variant, interval, score and catalog files, and writers of results; every path is opened by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.variants import called_alleles, parsed_date, passes, splice_field, with_chr, without_chr
from helixframe.sources import ranges

VCF_FIELDS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample")


def vcf_records(lines: DataFrame) -> DataFrame:
    """One row for each record of lines (value): the fixed columns as text, and the first sample's."""
    own = [c for c in lines.columns if c != "value"]
    # The fields as a row of their own: no filter on them moves below it, so that a line is split once.
    rows = lines.where(~F.col("value").startswith("#")).select(*own, F.explode(F.array(F.split("value", "\t"))).alias("p")).where(F.size("p") >= 5)
    fields = [F.try_element_at("p", F.lit(i + 1)).alias(name) for i, name in enumerate(VCF_FIELDS)]
    return rows.select(*own, *fields).withColumn("pos", F.col("pos").try_cast("bigint")).where(F.col("pos").isNotNull())


def vcf_variants(lines: DataFrame, pass_only: bool = True) -> DataFrame:
    """One row for each alternative allele, chrom with its prefix; * and . are no alleles."""
    rows = vcf_records(lines)
    if pass_only:
        rows = rows.where(passes(F.col("filter")))
    own = [c for c in lines.columns if c != "value"]
    rows = rows.select(*own, with_chr(F.col("chrom")).alias("chrom"), "pos", "ref", F.explode(F.split("alt", ",")).alias("alt"), "info", "filter")
    return rows.where(~F.col("alt").isin("*", "."))


def vcf_genotypes(lines: DataFrame) -> DataFrame:
    """The first sample's alleles, without prefix of chrom; records with a missing allele are left out."""
    rows = vcf_records(lines)
    at = F.array_position(F.split("format", ":"), "GT").cast("int")
    call = F.try_element_at(F.split("sample", ":"), F.when(at > 0, at).otherwise(F.lit(1)))
    alleles = called_alleles(call, F.col("ref"), F.split("alt", ","))
    own = [c for c in lines.columns if c != "value"]
    rows = rows.select(*own, without_chr(F.col("chrom")).alias("chrom"), "pos", "id", "ref", alleles.alias("alleles"))
    return rows.where(F.col("alleles").isNotNull() & ~F.exists("alleles", F.isnull))


def read_vcf(spark: SparkSession, path: str, pass_only: bool = True) -> DataFrame:
    return vcf_variants(spark.read.text(path), pass_only)


def bed_intervals(lines: DataFrame) -> DataFrame:
    """(chrom, bed_start, bed_end); comments, track lines and short rows are left out."""
    p = F.split("value", r"\s+")
    rows = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("track") & (F.size(p) >= 3))
    rows = rows.select(with_chr(p[0]).alias("chrom"), p[1].try_cast("bigint").alias("bed_start"), p[2].try_cast("bigint").alias("bed_end"))
    return rows.dropna()


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return bed_intervals(spark.read.text(path))


def read_table(spark: SparkSession, path: str, schema: str, comment: str | None = "#", header: bool = False) -> DataFrame:
    """A tab-separated table by a schema, malformed rows left out: pathogenicity and log-ratio scores, clinical indices."""
    reader = spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").option("header", header)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def delimited(lines: DataFrame, fields: dict[str, tuple[int, str]], least: int, sep: str = "\t") -> DataFrame:
    """Lines (value) as columns: name to (place from 1, type). Comments and lines with fewer than `least` fields are left
    out, and those where a needed field (at a place up to `least`) is not of its type; later fields may be missing."""
    p = F.split("value", sep)
    rows = lines.where(~F.col("value").startswith("#") & (F.size(p) >= least)).withColumn("__p", p)
    own = [c for c in lines.columns if c != "value"]
    out = rows.select(*own, *(F.try_element_at("__p", F.lit(at)).try_cast(kind).alias(name) for name, (at, kind) in fields.items()))
    return out.dropna(subset=[name for name, (at, kind) in fields.items() if at <= least and kind != "string"])


# The fields of score and index tables, by place.
PATHOGENICITY_FIELDS = {"chrom": (1, "string"), "pos": (2, "bigint"), "ref": (3, "string"), "alt": (4, "string"), "transcript_id": (7, "string"), "score": (8, "double")}
LLR_FIELDS = {"chrom": (1, "string"), "pos": (2, "bigint"), "ref": (3, "string"), "alt": (4, "string"), "llr": (5, "double")}
INDEX_FIELDS = {"chrom": (1, "string"), "pos": (2, "bigint"), "ref": (3, "string"), "alt": (4, "string"), "gene": (5, "string"), "consequence": (6, "string"), "score": (7, "string"), "classification": (8, "string"), "explanation": (9, "string")}


def variant_summaries(rows: DataFrame, assembly: str = "GRCh38") -> DataFrame:
    """Rows of one assembly with last_evaluated as a date; dates that no format fits are left out."""
    return rows.where(F.col("Assembly") == assembly).withColumn("last_evaluated", parsed_date(F.col("LastEvaluated"))).where(F.col("last_evaluated").isNotNull())


def read_variant_summary(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the paths that exists, all columns as text (chromosomes are names). A gzip file is one task: write
    it as Parquet once."""
    return read_strings(spark, first_that_exists(spark, *paths))


def splice_scan(snv_lines: DataFrame, indel_lines: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, symbol, score) of both files of splice predictions, from their INFO fields."""
    rows = vcf_records(snv_lines).unionByName(vcf_records(indel_lines))
    # The entry as a row of its own, so that its pattern is searched once.
    entries = rows.select(with_chr(F.col("chrom")).alias("chrom"), "pos", "ref", F.explode(F.array(splice_field(F.col("info"), 0))).alias("entry")).where("entry <> ''")
    fields = entries.withColumn("f", F.split(F.col("entry").substr(len("SpliceAI=") + 1, 1 << 30), "\\|"))
    deltas = [F.coalesce(F.get("f", F.lit(n - 1)).try_cast("double"), F.lit(0.0)) for n in (3, 4, 5, 6)]
    return fields.select("chrom", "pos", "ref", F.get("f", F.lit(0)).alias("alt"), F.get("f", F.lit(1)).alias("symbol"), F.greatest(*deltas).alias("score"))


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header, all columns as text: annotated structural and copy-number variants."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def read_llr(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, llr) of log-ratio score files: at least five fields, comments and broken lines left out."""
    return delimited(spark.read.text(path), LLR_FIELDS, 5)


def read_assays(spark: SparkSession, path: str) -> DataFrame:
    """A folder of assay tables: assay_id (the file's stem), dms_score, mutant; files without DMS_score give no rows.

    Files differ in their columns and in their order: each is read by its own header. Files of one header are read
    together, so there are as many scans as headers.
    """
    heads = spark.read.text(f"{path}/*.csv").withColumn("file", F.col("_metadata.file_path")).where(F.col("_metadata.file_block_start") == 0)
    # The first line of each file: that with the smallest number in its first block.
    first = heads.withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    files: dict[str, list[str]] = {}
    for r in first.collect():  # a row for each file
        files.setdefault(r["header"], []).append(r["file"])
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?$", 1)
    parts = []
    for _, paths in sorted(files.items()):
        rows = spark.read.option("header", True).csv(sorted(paths)).withColumn("assay_id", name)
        if "DMS_score" in rows.columns:
            mutant = F.col("mutant") if "mutant" in rows.columns else F.lit(None).cast("string")
            parts.append(rows.select("assay_id", mutant.alias("mutant"), F.col("DMS_score").try_cast("double").alias("dms_score")))
    if not parts:
        raise ValueError("no table has a DMS_score")
    return reduce(DataFrame.unionByName, parts).where(F.col("dms_score").isNotNull())


def read_matrix(spark: SparkSession, path: str, ident: str = "cpg", sep: str | None = None) -> DataFrame:
    """A wide matrix, its first column the probe, as (ident, sample, beta)."""
    wide = spark.read.option("header", True).option("sep", sep or ("\t" if path.endswith((".tsv", ".tsv.gz")) else ",")).csv(path)
    first, *samples = wide.columns
    return wide.select(F.col(first).alias(ident), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in samples)).unpivot(ident, samples, "sample", "beta")


# The fields of an association.
ASSOCIATION_FIELDS = {"trait": "string", "mapped_trait": "string", "rsid": "string", "gene": "string", "risk_allele": "string", "pvalue": "double", "or_beta": "double"}


def read_catalog(spark: SparkSession, path: str, key: str, part_bytes: int = 8 << 20) -> DataFrame:
    """A JSON map from a key to a list of associations, one row for each; tasks read parts of a file (see ranges.json_lists).

    Where only Spark can open the path, a file is one task."""
    if ranges.can_open(path):
        return ranges.json_lists(spark, path, key, ASSOCIATION_FIELDS, part_bytes)
    schema = f"map<string,array<struct<{','.join(f'{c}:{t}' for c, t in ASSOCIATION_FIELDS.items())}>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias(key, "found"))
    return rows.select(key, F.explode("found").alias("a")).select(key, "a.*")


def read_sscore(spark: SparkSession, path: str) -> DataFrame:
    """Scores of samples: IID, SCORE1_AVG, SCORE1_SUM, ALLELE_CT; columns that are not there are null."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    rows = rows.toDF(*(c.lstrip("#") for c in rows.columns))
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).try_cast(t).alias(c) for c, t in (("IID", "string"), ("SCORE1_AVG", "double"), ("SCORE1_SUM", "double"), ("ALLELE_CT", "bigint"))))


def named_columns(df: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with the first column whose lower-cased name holds one of the words of each rule, by the rule's name."""
    found = {}
    for name, words in rules.items():
        column = next((c for w in words for c in df.columns if w in c.lower() and c not in found.values()), None)
        if column is None:
            raise ValueError(f"no column for {name}")
        found[name] = column
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


RUN_SCHEMA = "run_no long, task_id string, model_name string, ts timestamp, split_type string, metrics map<string,struct<estimate:double,ci_lower:double,ci_upper:double,n:bigint>>, n_samples map<string,bigint>, gate string, metadata map<string,string>"


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str, task_prefix: str | None = None, model: str | None = None) -> DataFrame:
    rows = spark.read.schema(RUN_SCHEMA).json(path)
    if task_prefix is not None:
        rows = rows.where(F.col("task_id").startswith(task_prefix))
    return rows if model is None else rows.where(F.col("model_name") == model)


def read_latest_runs(spark: SparkSession, folder: str, task_prefix: str | None = None, model: str | None = None) -> DataFrame:
    """Runs of the run_* file whose name is the greatest, which is the latest."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "run_*").load(folder).select("path")
    last = listed.agg(F.max("path")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no run_* in {folder}")
    return read_runs(spark, last, task_prefix, model)


def with_predictions_path(runs: DataFrame, path: str | None) -> DataFrame:
    """Runs whose metadata say where their predictions are; unchanged without a path."""
    if path is None:
        return runs
    added = F.create_map(F.lit("predictions_path"), F.lit(path))
    return runs.withColumn("metadata", F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "predictions_path"), added))


def stamps(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """wanted (key, part) with state, modified, size, n_files and digest of root/part.

    A file has its time, size and the digest of its first 16 KiB; a directory the time of the latest file right in it and
    the number and size of all files at any depth. State: file, directory, missing where nothing is there,
    unknown_artifact where part is null. Executors read the beginnings of the files that are wanted, and of no others.
    """
    rest = F.substring_index("path", f"{root.rstrip('/')}/", -1)
    files = ranges.listed(spark, root).withColumns({"__p": F.split(rest, "/")}).withColumns({"part": F.col("__p")[0], "depth": F.size("__p")}).drop("__p")
    own = files.join(wanted.select("part").distinct(), "part", "left_semi")
    found = own.groupBy("part").agg(F.max(F.when(F.col("depth") <= 2, F.col("modified"))).alias("modified"), F.sum("length").alias("size"), F.count("*").alias("n_files"), F.bool_or(F.col("depth") > 1).alias("inside"))
    read = ranges.with_digests(own.where("depth = 1").select("part", "path")).select("part", "digest")
    state = F.when(F.col("part").isNull(), "unknown_artifact").when(F.col("n_files").isNull(), "missing").when(F.col("inside"), "directory").otherwise("file")
    return wanted.join(found, "part", "left").join(read, "part", "left").select("key", "part", state.alias("state"), "modified", "size", F.coalesce("n_files", F.lit(0)).alias("n_files"), "digest")


def save_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").partitionBy("task_id", "model_name").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """The rows of a report table as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def fingerprints(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (file_name) with state, modified, size and the first 16 hex digits of the first 16 KiB's digest.

    Executors read the beginnings of the files that are wanted, however large and many they are. A name that occurs in
    several folders has a row for each; a file without bytes counts as missing."""
    files = ranges.listed(spark, path).withColumn("file_name", F.regexp_extract("path", r"([^/]+)$", 1))
    found = ranges.with_digests(files.join(wanted.select("file_name").distinct(), "file_name", "left_semi"))
    rows = wanted.join(found.select("file_name", "modified", F.col("length").alias("size"), "digest"), "file_name", "left")
    return rows.withColumn("state", F.when(F.col("digest").isNull(), "missing").otherwise("present"))


def first_that_exists(spark: SparkSession, *paths: str) -> str:
    """The first path or glob that matches something: a versioned folder before a plain one, an exact name before a pattern."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        if found is not None and len(found):
            return path
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def availability(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """expected (name, part) with n_files, bytes and available: how many files lie in folder/part, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    inside = files.withColumn("part", F.split(F.substring_index("path", f"{folder.rstrip('/')}/", -1), "/")[0])
    hits = expected.join(inside, "part", "left")
    return hits.groupBy("name", "part").agg(F.count("path").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), (F.count("path") > 0).alias("available"))


def read_partitioned_scores(spark: SparkSession, path: str, schema: str = "pos long, ref string, alt string, score double") -> DataFrame:
    """Tab-separated score files in folders chrom=...; a chromosome without a folder has no scores, so a left join gives null."""
    return spark.read.schema(f"{schema}, chrom string").option("sep", "\t").option("header", True).csv(path)
