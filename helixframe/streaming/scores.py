"""Scoring of variant files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from helixframe.functions.variants import KEY, pathogenicity_class
from helixframe.sources.tables import vcf_variants


def annotate_stream(spark: SparkSession, folder: str, scores: DataFrame, value: str = "score", most_files: int = 100) -> DataFrame:
    """Variants of files that arrive in folder, left-joined to a static score table: no state, so no watermark."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", most_files).load(folder)
    one = scores.groupBy(*KEY).agg(F.min(value).alias(value))
    return vcf_variants(lines).join(one, list(KEY), "left").withColumn("class", pathogenicity_class(F.col(value)))


def write_annotated(annotated: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet and stops when all files that are there have been read."""
    return annotated.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
