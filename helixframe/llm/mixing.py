"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source form a stream: its documents in a seeded random order, up to `passes` times over, cut into blocks
of `block_words`. Blocks are allotted to sources by the highest quotients target / (2 k + 1), which gives whole numbers
that add up; a source's blocks are allotted in the same way to bundles of its shards, and a bundle's to its shards, by their
sizes. So no task ranks more than a source's bundles or a bundle's shards. Each shard then takes its quota of
consecutive blocks from a seeded starting block, going round, so that nearly every document is taken a whole number of
times: one seeded run of blocks for each shard is the selection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut, text_slices

#: Sources up to this number are broadcast to the documents.
BROADCAST_SOURCES = 100_000


def sizes(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` with size, the number of words `[^\\x20\\x09-\\x0D]+` (null: 0)."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    names = source.columns[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "size long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array([len(x.split()) for x in texts], pa.int64())], [*names, "size"])

    return source.mapInArrow(run, schema)


def targets(sources: DataFrame, weights: tuple[float, ...], passes: int) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes by weight. No target
    exceeds passes times its source's size; what a capped source can't use goes to the others by weight. Sources are
    capped in the order of size / weight, so that one ordered pass finds the level at which no more are.
    """
    numbered = sources.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("n") % len(weights) + 1).cast("int"))
    ordered = numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(passes))
    order = Window.orderBy(F.col("most") / F.col("weight"), "n")
    before, onwards, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onwards)
    ranked = ordered.withColumn("level", level).withColumn("free", F.col("most") > F.col("level") * F.col("weight"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("n"), F.col("level")))).over(everything)["level"]
    return ranked.withColumn("final", final).select("source", "n", "source_size", "weight", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("final") * F.col("weight"))).cast("double").alias("target"))


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """parties with quota: in each group, as many whole seats as column `seats` says, by the highest votes / (2 k + 1).

    With n parties, dividing by sum / (seats - n / 2) gives every party at most its seats, and by sum / (seats + n / 2)
    at least; only the quotients between the two, 2 n at most, are ranked. Ties go to the smaller key.
    """
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumns({"__sum": F.sum(votes).over(own), "__n": F.count("*").over(own)})
    share = lambda moved: F.when(F.col("__sum") > 0, F.floor(F.greatest(F.lit(0.0), F.col(seats) + moved) * F.col(votes) / F.col("__sum") + 0.5)).otherwise(F.lit(0)).cast("long")
    p = p.withColumns({"__low": F.greatest(share(-F.col("__n") / 2.0 - 1) - 1, F.lit(0)), "__high": share(F.col("__n") / 2.0 + 1) + 1})
    p = p.withColumn("__left", F.col(seats) - F.sum("__low").over(own))
    quotients = p.withColumn("__k", F.explode(F.sequence(F.col("__low"), F.col("__high")))).withColumn("__q", F.col(votes) / (2 * F.col("__k") + 1))
    rank = F.row_number().over(own.orderBy(F.col("__q").desc(), *key, "__k"))
    won = quotients.withColumn("__won", (rank <= F.col("__left")).cast("long"))
    return won.groupBy(*parties.columns).agg((F.max("__low") + F.sum("__won")).alias("quota"))


def _joined(left: DataFrame, right: DataFrame, small: bool, *keys: str) -> DataFrame:
    """left with right's columns, on keys that may be null."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    condition = on[0]
    for x in on[1:]:
        condition &= x
    return left.join(F.broadcast(other) if small else other, condition).drop(*(f"__{k}" for k in keys))


def spot(seed: int) -> Column:
    """Where a row (doc_id, size, __key: hash of its text) stands: by its id and text, or anywhere if it has no words."""
    return F.when(F.col("size") > 0, F.xxhash64(F.lit(seed), "doc_id", "__key")).otherwise(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), passes: int = 3, block_words: int = 16, shard_words: int = 1 << 20, bundle_shards: int = 1024, seed: int = 17, keep: tuple[str, ...] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """One row per document: `keep`, size, source_size, target (of its source), taken (its words in the mix, repeats counted).

    A null source is a source of its own, weighed last; null and empty texts have size 0 and take nothing. taken is at
    most passes times the size, and a source's sum is within a block or two per shard of its target. Documents are
    placed by a seeded hash of doc_id and text, then by these, so that reruns agree, and rows without an id or with
    the same one spread; among equal rows it does not matter which is which. Rows of size 0 take nothing wherever they
    are, so they are dealt evenly. Only `keep` (doc_id and source among them) and the text are read.
    """
    rows = cut(sizes(docs.withColumn("__key", F.xxhash64(text)), [*keep, "__key"], text).withColumn("h", spot(seed)))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes))
    few = sources.count() <= BROADCAST_SOURCES
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")
    plan = apportion(sources.withColumn("blocks", blocks), [], ["n"], "target", "blocks")
    plan = plan.select("source", "source_size", "target", F.col("quota").alias("source_quota"), F.ceil(F.col("source_size") / shard_words).alias("n_shards"))
    placed = _joined(rows, plan, few, "source").withColumn("shard", F.when(F.col("n_shards") > 1, F.pmod(F.shiftright("h", 20), F.col("n_shards"))).otherwise(F.lit(0)))
    cells = placed.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("cell_words")).withColumn("bundle", F.floor(F.col("shard") / bundle_shards))
    bundles = apportion(cells.groupBy("source", "bundle", "source_quota").agg(F.sum("cell_words").alias("bundle_words")), ["source"], ["bundle"], "bundle_words", "source_quota")
    bundles = cut(bundles.select("source", "bundle", F.col("quota").alias("bundle_quota")))
    dealt = _joined(cells, bundles, bundles.count() <= BROADCAST_SOURCES, "source", "bundle")
    quotas = cut(apportion(dealt, ["source", "bundle"], ["shard"], "cell_words", "bundle_quota").select("source", "shard", "cell_words", "quota"))
    order = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "__key", "size")
    stream = placed.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    taken = _joined(stream, quotas, quotas.count() <= BROADCAST_SOURCES, "source", "shard")
    words, begin = F.col("cell_words"), F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest(F.lit(1), F.floor(F.col("cell_words") / block_words))) * block_words
    taken = taken.withColumns({"much": F.least(F.col("quota") * block_words, words * passes), "begin": begin})
    rounds, rest = F.floor(F.col("much") / words), F.col("much") % words
    over = lambda a, b: F.greatest(F.lit(0), F.least(F.col("stop"), b) - F.greatest(F.col("stop") - F.col("size"), a))
    partial = over(F.col("begin"), F.col("begin") + rest) + over(F.lit(0), F.col("begin") + rest - words)
    return taken.select(*keep, "size", "source_size", "target", F.when(words > 0, rounds * F.col("size") + partial).otherwise(F.lit(0)).cast("long").alias("taken"))


def copies(taken: Column, size: Column) -> Column:
    """How often a document as a whole goes into the mix."""
    return F.when(size > 0, F.floor((taken + size / 2) / size)).otherwise(F.lit(0)).cast("int")
