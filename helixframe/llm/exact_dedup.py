"""Exact dedup with an extendible-hash index, in DataFrame operations only.

A row's key is a 64-bit hash of its normalised text. The directory starts with the buckets of a few leading key bits;
every bucket with more distinct keys than its capacity is split by one more bit, which doubles the directory where the
bucket was as deep as it, until no bucket is overfull. Every row is given its bucket by the directory before anything is
grouped, and a row without one is in no group.

Copies collapse in the tasks that read them, before they are moved: a text comes to the owner task of its bucket in SALTS
entries at most, even if a third of all rows hold it. The owner walks the entries of a key in order and compares the bytes
of each with the one before: other bytes begin the next text of the chain, equal bytes join its group. So groups are decided
there, and it writes its range of the index. Documents are led to their text by bucket, key and SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut, shared_path

# The characters that normalisation deletes.
SPACES = ("\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d")


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def prefix(key: Column, bits: Column | int) -> Column:
    """The leading bits of a key as a number."""
    return F.expr("0L") if isinstance(bits, int) and bits == 0 else F.shiftrightunsigned(key, 64 - bits)


def build_directory(keys: DataFrame, capacity: int, first_depth: int = 6, most_depth: int = 40) -> DataFrame:
    """Buckets (p, depth, n_keys) over the distinct values of `key`: all keys whose first `depth` bits are p. Only buckets
    of most_depth may hold more than capacity.

    Each round splits all overfull buckets at once; 64-bit hashes spread evenly, so that the rounds end soon after
    log2(keys / capacity). Only the count of overfull buckets comes to the driver.
    """
    cells = keys.select("key").distinct()
    total = cells.count()
    depth = max(first_depth, (max(1, total // capacity)).bit_length())
    inside, done = cells, None
    while True:
        level = cut(inside.groupBy(prefix(F.col("key"), depth).alias("p")).agg(F.count("*").alias("n_keys")).withColumn("depth", F.lit(depth)))
        full = level.where(F.col("n_keys") > capacity)
        last = depth >= most_depth or full.isEmpty()
        kept = level if last else level.where(F.col("n_keys") <= capacity)
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done.select("p", "depth", "n_keys")
        inside = cells.withColumn("q", prefix(F.col("key"), depth)).join(full.select(F.col("p").alias("q")), "q", "left_semi").drop("q")
        depth += 1


#: Entries of a text that its owner gets at most: copies collapse in so many groups of tasks.
SALTS = 64

#: Buckets up to this number are broadcast to the rows (some 60 MB); beyond it, rows join them by shuffle.
BROADCAST_BUCKETS = 1_000_000


def owned(df: DataFrame, directory: DataFrame, depths: list[int], few: bool) -> DataFrame:
    """df with depth and p of the bucket that holds its key; rows without a bucket are left out."""
    hits = df
    for depth in depths:
        level = directory.where(F.col("depth") == depth).select(F.col("p").alias(f"__p{depth}"), F.lit(True).alias(f"__in{depth}"))
        hits = hits.join(F.broadcast(level) if few else level, prefix(F.col("key"), depth) == F.col(f"__p{depth}"), "left")
    if not depths:
        return df.withColumns({"depth": F.lit(0), "p": F.lit(0).cast("long")}).where(F.lit(False))
    found = [F.when(F.col(f"__in{d}"), F.struct(F.lit(d).alias("depth"), F.col(f"__p{d}").alias("p"))) for d in depths]
    bucket = F.coalesce(*found)
    return hits.withColumn("__b", bucket).where("__b IS NOT NULL").select(*df.columns, "__b.depth", "__b.p")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 1 << 14, key_bits: int = 64, directory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, keep_id, group_size, kept, text_sha256, text_key (hash of the text as it is);
    the index: depth, p (its bucket), key, chain (number of the text among those of its key), sha, keep_id, keep_key,
    group_size).

    Texts are equal if identical without white space; null counts as empty. The row with the most code points, then
    the smallest doc_id (null last), stays: one row of each group, also where rows repeat its id and text. Only the two
    named columns are read. key_bits: leading bits of the hash that make the key (fewer make keys collide). directory: that of an
    earlier call over the same or more texts; texts in none of its buckets are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("points"), F.xxhash64(text).alias("text_key"), normalised(F.col(text)).alias("body"))
    key = F.xxhash64("body") if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("body"), 64 - key_bits), 64 - key_bits)
    rows = rows.withColumn("key", key)
    # Rows that repeat an id and a text are one entry with their number, so that one of them can stay.
    entries = cut(rows.select("doc_id", "text_key", "key", F.sha2("body", 256).alias("sha")).groupBy("doc_id", "text_key", "key", "sha").agg(F.count("*").alias("times")))
    directory = build_directory(entries, capacity) if directory is None else directory
    shape = directory.groupBy("depth").agg(F.count("*").alias("n")).collect()  # at most 64 numbers
    depths, few = sorted(r["depth"] for r in shape), sum(r["n"] for r in shape) <= BROADCAST_BUCKETS

    first = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key")))
    salted = rows.withColumns({"salt": F.pmod(F.spark_partition_id(), F.lit(SALTS)), "sha": F.sha2("body", 256)})
    # Depth and p as one number, a column even where all buckets have the same depth, so that texts move to owners once.
    bucket = F.expr("shiftleft(1L, depth) | p")
    brought = owned(salted, directory, depths, few).withColumn("bucket", bucket).groupBy("salt", "bucket", "depth", "p", "key", "sha").agg(F.first("body").alias("body"), first.alias("first"), F.count("*").alias("n"))
    # An owner task holds whole buckets; a bucket is at most `capacity` keys. All that follows is in its partitioning.
    walk = Window.partitionBy("bucket", "key").orderBy("sha", "body")
    before = F.lag("body").over(walk)
    walked = brought.repartition("bucket").withColumn("new", F.when(before == F.col("body"), 0).otherwise(1))
    walked = walked.withColumn("chain", F.sum("new").over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    texts = walked.groupBy("bucket", "depth", "p", "key", "chain").agg(F.first("sha").alias("sha"), F.min("first").alias("first"), F.sum("n").alias("group_size"))
    path = shared_path(spark, "dedup-index")
    texts = texts.select("depth", "p", "key", F.col("chain").cast("int").alias("chain"), "sha", F.col("first.doc_id").alias("keep_id"), F.col("first.text_key").alias("keep_key"), "group_size")
    texts.sortWithinPartitions("depth", "p", "key", "chain").write.parquet(path)
    index = spark.read.parquet(path)
    members = owned(entries, directory, depths, few).join(index, ["depth", "p", "key", "sha"])
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
    each = members.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("doc_id", "keep_id", "group_size", (same & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"), "text_key"), index
