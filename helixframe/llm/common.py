"""Shared pieces of the training-data operators: readers, the shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a fresh temporary folder where the
    setting is missing and all runs in one process; on a cluster without it, an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="helixframe-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", own)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that a job wrote in the shared folder and has read for the last time."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A key is frequent if it has at least FREQUENT rows and more than one in FREQUENT_SHARE of all: so many keys at most.
FREQUENT, FREQUENT_SHARE = 1024, 10_000


def frequent_keys(df: DataFrame, key: str) -> DataFrame:
    """The frequent values of key, at most FREQUENT_SHARE rows whatever the size of df, from pre-aggregated counts."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    least = counts.agg(F.greatest(F.lit(FREQUENT), F.floor(F.coalesce(F.sum("__n"), F.lit(0)) / FREQUENT_SHARE) + 1)).scalar()
    return counts.where(F.col("__n") >= least).select(key)


def join_one(many: DataFrame, one: DataFrame, key: str, frequent: DataFrame | None = None) -> DataFrame:
    """many joined to one, which has a row for each key: rows of frequent keys stay where they are and get theirs by
    broadcast (at most FREQUENT_SHARE rows, so rows of one should be short), so no task gathers a frequent key. many should
    be cheap to compute again. frequent: frequent_keys of many, where they are known.
    """
    frequent = frequent_keys(many, key) if frequent is None else frequent
    marked = many.join(F.broadcast(frequent.withColumn("__f", F.lit(True))), key, "left")
    few = one.join(F.broadcast(frequent), key, "left_semi")
    often = marked.where("__f").drop("__f").join(F.broadcast(few), key)
    return often.unionByName(marked.where("__f IS NULL").drop("__f").join(one, key))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text (null: empty text), modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about SLICE_BYTES, each with its texts as UTF-8 bytes (null: empty)."""
    start, size, texts = 0, 0, []
    for i, x in enumerate(batch.column(column).cast(pa.binary()).to_pylist()):
        texts.append(x or b"")
        size += len(texts[-1])
        if size >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(start), texts
