"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, encoding, one stage after the other.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents. run() writes each stage's rows as Parquet in the shared folder and reads them for the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, mixing, sentencepiece_bpe, simhash_dedup, toxicity
from helixframe.llm.common import remove, shared_path, table
from helixframe.llm.queries import PIECE_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected from this score on.
TOXIC = 0.7

#: Rows of a batch between Spark and Python: with whole texts in them, Spark's own 10,000 take much memory outside the heap.
BATCH_ROWS = 2000

#: SQL can't express the trained machine, the fingerprints' hash and the merges.
ORACLE_SQL = None


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside have batches of BATCH_ROWS rows at most; the session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name, None)
    if own is None or not 0 < int(own) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def _rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs of (doc_id, text_key) in wanted, with wanted's other columns; of repeated rows with one id and text, one.

    The join and the removal of repeats share one partitioning, so a text moves once."""
    keyed = docs.select(*COLUMNS).withColumns({"text_key": F.xxhash64("text"), "__null": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0))})
    other = wanted.select(F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).alias("__id"), *(c for c in wanted.columns if c != "doc_id"))
    joined = keyed.join(other, ["__null", "__id", "text_key"])
    return joined.dropDuplicates(["__null", "__id", "text_key"]).drop("__null", "__id", "text_key")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the machine, trained on a bounded sample of the labelled ones, scores as toxic."""
    machine = toxicity.train_machine(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, machine, COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal without white space."""
    members, _ = exact_dedup.dedup(docs)
    return _rows_of(docs, members.where("kept").select("doc_id", "text_key").distinct()).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8): that with the smallest id."""
    with small_batches(spark):
        found = simhash_dedup.near_copies(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"))
    kept = found.select("root.doc_id", "root.text_key").distinct()
    return _rows_of(docs, kept).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat up to three times, and those it doesn't take go."""
    keyed = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    with small_batches(spark):
        mixed = mixing.mix(keyed, keep=("doc_id", "source", "text_key"))
    taken = mixed.withColumn("copies", mixing.copies(F.col("taken"), F.col("size")))
    times = taken.groupBy("doc_id", "text_key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    return _rows_of(docs, times).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with an end id, and digests of these and of the text decoded from them."""
    coded = sentencepiece_bpe.encode_documents(docs, PIECE_MODEL, ["doc_id", "source"], decode=True)
    return coded.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, read = table(spark, sf_dir, "documents"), None
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            path = shared_path(spark, f"pipeline-{at}")
            with small_batches(spark):
                docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if read is not None:
                remove(spark, read)  # what this stage read is not needed again
            read = path
    return docs
