"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to `ORDER` bytes, counted over all training texts. A byte is predicted from the
longest context that the trie holds; where the context has not seen it, an escape hands over to the context one byte
shorter, whose symbols that the longer one had already offered are excluded. Escapes are estimated from the number of
distinct symbols. The code length of a text is the sum over its
bytes and an end symbol; scoring does not change the model, so a byte's cost depends on the bytes before it alone.

Nothing that was counted is left out. The grams of the full order and what they cost are a table in the shared folder;
the most frequent, at most a fixed number, are broadcast. What a text holds of other grams is counted in its task and
joined to that table, and the distinct grams that training never saw go down the orders by joins. The words of the
unigram base are counted in full; the most frequent (again at most a fixed number) are broadcast, all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cut, shared_path, text_slices
from helixframe.llm.simhash_dedup import LOWER

ORDER = 5
START, END = 0xFE, 0xFF  # never part of UTF-8
SYMBOLS = 255  # bytes without START
#: Texts that a task counts or scores at a time, in bytes, and grams that it gathers before it hands them on.
PART_BYTES, GATHERED = 2 << 20, 3 << 20
#: White space, so no word: stands for the end of a text among the words.
END_WORD = "\n"


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each byte (and end) with its context, and where each text's codes begin."""
    pad = bytes([START]) * ORDER
    joined = np.frombuffer(b"".join([y for x in texts for y in (pad, x.translate(LOWER), b"\xff")]), np.uint8)
    codes = np.zeros(len(joined) - ORDER, np.int64)
    for k in range(ORDER + 1):
        codes |= joined[ORDER - k : len(joined) - k].astype(np.int64) << (8 * k)
    sizes = np.array([len(x) + 1 for x in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return codes[joined[ORDER:] != START], starts


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part, texts in text_slices(batch, column):
        at, size = 0, 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= PART_BYTES or i + 1 == len(texts):
                yield part.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, word, n): counts of the grams and words of all texts, pre-aggregated by task; several rows for one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        gathered = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)

        def rows(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(codes), 1 << 18):
                part = codes[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.string()), pa.array(n[at : at + (1 << 18)])], ["gram", "word", "n"])

        def spoken() -> Iterator[pa.RecordBatch]:
            if words:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())], ["gram", "word", "n"])

        for batch in batches:
            for _, texts in _parts(batch, "text"):
                for x in texts:
                    words.update(x.translate(LOWER).split())
                words[END_WORD.encode()] += len(texts)
                found.append(np.unique(grams(texts)[0], return_counts=True))
                gathered += len(found[-1][0])
                if gathered > GATHERED:
                    found = [merged()]
                    if len(found[0][0]) > GATHERED // 2:
                        yield from rows(*found.pop())
                    gathered = sum(len(c) for c, _ in found)
                if len(words) > 300_000:
                    yield from spoken()
                    words.clear()
        if found:
            yield from rows(*merged())
        yield from spoken()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "gram long, word string, n long")


class Trie:
    """The contexts and symbols of each order, as sorted arrays: in memory, what score_documents does by joins."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        """levels: for each order, from 0, the kept grams, their counts, the contexts and all that was seen in these."""
        self.levels = []
        below: tuple[np.ndarray, np.ndarray] | None = None
        for order, (codes, n, contexts, seen) in enumerate(levels):
            by = np.argsort(codes)
            codes, n = codes[by], n[by].astype(np.float64)
            by = np.argsort(contexts)
            contexts, seen = contexts[by], seen[by].astype(np.float64)
            of = np.searchsorted(contexts, codes >> 8)
            kept = np.bincount(of, n, len(contexts))
            distinct = np.bincount(of, minlength=len(contexts)).astype(np.float64)
            excluded = np.zeros(len(contexts))
            if below is not None and len(codes):
                shorter = codes & ((1 << 8 * order) - 1)
                excluded = np.bincount(of, below[1][np.searchsorted(below[0], shorter)], len(contexts))
            self.levels.append((codes, n, contexts, kept, distinct, seen - kept + distinct, excluded))
            below = codes, n

    @staticmethod
    def _find(sorted_codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_codes):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(sorted_codes, wanted), len(sorted_codes) - 1)
        return at, sorted_codes[at] == wanted

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))  # those not predicted yet
        gone = np.zeros(len(codes))  # counts of excluded symbols, in the context at hand
        shut = np.zeros(len(codes))  # the number of excluded symbols
        for order in range(len(self.levels) - 1, -1, -1):
            kept_codes, n, contexts, kept, distinct, escape, excluded = self.levels[order]
            own = codes[left] & ((1 << 8 * (order + 1)) - 1)
            c, known = self._find(contexts, own >> 8)
            if not known.any():
                continue
            e, hit = self._find(kept_codes, own)
            hit &= known
            whole = kept[c] - gone[left] + escape[c] if len(contexts) else None
            out[left[hit]] += np.log10(n[e[hit]] / whole[hit])
            missed = known & ~hit
            out[left[missed]] += np.log10(escape[c[missed]] / whole[missed])
            gone[left[missed]], shut[left[missed]] = excluded[c[missed]], distinct[c[missed]]
            left = left[~hit]
        out[left] -= np.log10(np.maximum(1, SYMBOLS - shut[left]))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The log10 probability of each text with its end."""
        codes, starts = grams(texts)
        distinct, where = np.unique(codes, return_inverse=True)
        return np.add.reduceat(self.log10(distinct)[where], starts)


def _priced(texts: list[bytes], known: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The summed costs of each text's known grams; its other grams and how often it holds them, from offsets on."""
    codes, starts = grams(texts)
    distinct, where = np.unique(codes, return_inverse=True)
    at, found = Trie._find(known, distinct)
    costs = np.zeros(len(distinct))
    costs[found] = cost[at[found]]
    scores = np.add.reduceat(costs[where], starts)
    other = np.flatnonzero(~found[where])
    of = np.searchsorted(starts, other, side="right") - 1
    pairs, times = np.unique(of * len(distinct) + where[other], return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(distinct))
    return scores, offsets.astype(np.int32), distinct[pairs % len(distinct)], times.astype(np.int32)


def learnt(grams: DataFrame) -> DataFrame:
    """(gram, n, cost) of all grams of the full order: log10 of a gram's share of what its context has seen and its escape."""
    own = grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("seen"), F.collect_list(F.struct("gram", "n")).alias("own"))  # at most SYMBOLS
    return own.select(F.explode("own").alias("own"), (F.col("seen") + F.size("own")).alias("whole")).select("own.gram", "own.n", F.log10(F.col("own.n") / F.col("whole")).alias("cost"))


def fallen(wanted: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, cost) of the distinct grams in wanted, none of which is in grams: down the orders, as Trie.log10."""
    mask = lambda bytes_: F.lit((1 << 8 * bytes_) - 1).cast("long")
    left = wanted.select("gram", F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("shut"))
    level, done = grams.select("gram", "n"), []
    for order in range(ORDER, -1, -1):
        left = left.withColumn("own", F.col("gram").bitwiseAND(mask(order + 1))).withColumn("context", F.shiftright("own", 8))
        below = cut(level.groupBy(F.col("gram").bitwiseAND(mask(order)).alias("shorter")).agg(F.sum("n").alias("m"))) if order else None
        symbols = level.withColumn("context", F.shiftright("gram", 8)).join(left.select("context").distinct(), "context", "left_semi")
        if order:
            symbols = symbols.withColumn("shorter", F.col("gram").bitwiseAND(mask(order))).join(below, "shorter")
        else:
            symbols = symbols.withColumn("m", F.lit(0).cast("long"))
        about = symbols.groupBy("context").agg(F.sum("n").alias("seen"), F.count("*").alias("distinct"), F.sum("m").alias("excluded"))
        left = left.join(F.broadcast(about) if order <= 2 else about, "context", "left")  # 2^16 contexts at most
        if order < ORDER:
            hits = level.select(F.col("gram").alias("own"), "n")
            left = left.join(F.broadcast(hits) if order <= 1 else hits, "own", "left")
        else:
            left = left.withColumn("n", F.lit(None).cast("long"))
        known, whole = F.col("seen").isNotNull(), F.col("seen") - F.col("gone") + F.col("distinct")
        step = F.when(known, F.log10(F.coalesce("n", "distinct") / whole)).otherwise(0.0)
        left = cut(left.select("gram", (F.col("cost") + step).alias("cost"), F.coalesce("excluded", "gone").alias("gone"), F.coalesce("distinct", "shut").alias("shut"), F.col("n").isNotNull().alias("hit")))
        done.append(left.where("hit").select("gram", "cost"))
        left = left.where("NOT hit").drop("hit")
        if order:
            level = below.select(F.col("shorter").alias("gram"), F.col("m").alias("n"))
    out = left.select("gram", (F.col("cost") - F.log10(F.greatest(F.lit(1), F.lit(SYMBOLS) - F.col("shut")))).alias("cost"))
    for part in done:
        out = out.unionByName(part)
    return out


def _frequent(costs: DataFrame, most: int) -> Column:
    """Whether a gram is broadcast: those above the least count, in steps of a 16th of a power of two, that leaves at most `most`."""
    step = F.floor(F.log2("n") * 16)
    least, held = 1 << 20, 0
    for at, n in sorted(((r["at"], r["k"]) for r in costs.groupBy(step.alias("at")).agg(F.count("*").alias("k")).collect()), reverse=True):  # at most 1,024
        held += n
        if held > most:
            break
        least = at
    return step >= least


def score_documents(docs: DataFrame, training: Column, keep: list[str], text: str = "text", frequent_words: int = 1 << 20, trie_keep: int = 1 << 21) -> DataFrame:
    """One row per document: `keep`, n_tokens, n_known, train_tokens, base_score, score; the model is learnt from rows where training holds.

    base_score: sum over the words and the end of log10((c + 0.5) / (N + 0.5 (V + 1))); score: the log10 probability by
    the trie. Null and empty texts are the end alone. Without training rows all counts are 0. Repeated rows each have
    their score and each count in training. Only `keep`, the text and the columns of training are read. At most
    frequent_words words and trie_keep grams are broadcast; neither changes a score.
    """
    spark = docs.sparkSession
    shown = docs.select(F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("__train")).where("__train").select("text")
    path = shared_path(spark, "ppm-counts")
    counts = count(shown)
    summed = counts.groupBy("gram", "word").agg(F.sum("n").alias("n"))
    summed.write.parquet(path)
    summed = spark.read.parquet(path)
    words = summed.where(F.col("word").isNotNull()).select("word", F.col("n").alias("c"))
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    grams_of = summed.where(F.col("gram").isNotNull()).select("gram", "n")
    path = shared_path(spark, "ppm-costs")
    learnt(grams_of).write.parquet(path)
    costs = spark.read.parquet(path)
    frequent = _frequent(costs, trie_keep)
    broad = costs.where(frequent).select("gram", "cost").toArrow()  # at most trie_keep
    codes = broad.column("gram").to_numpy()
    by = np.argsort(codes)
    broad = codes[by], broad.column("cost").to_numpy()[by]
    often = words.where(F.col("c") * frequent_words >= tokens).toArrow()  # at most frequent_words
    whole = tokens + 0.5 * (distinct + 1)
    hot = {w.encode(): float(np.log10((c + 0.5) / whole)) for w, c in zip(often.column("word").to_pylist(), often.column("c").to_pylist())}
    shared = spark.sparkContext.broadcast((broad, hot))

    source = docs.select(*keep, F.col(text).alias("__text"))
    names = source.columns[:-1]
    made = ["n_tokens", "n_hot", "hot_score", "broad_score", "rare", "grams", "times"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "n_tokens long, n_hot long, hot_score double, broad_score double, rare array<string>, grams array<long>, times array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        broad, hot = shared.value
        get, end = hot.get, END_WORD.encode()
        for batch in batches:
            for part, texts in _parts(batch, "__text"):
                n_tokens, n_hot, sums, rare = [], [], [], []
                for x in texts:
                    spoken = x.translate(LOWER).split()
                    spoken.append(end)
                    costs = list(map(get, spoken))
                    if None in costs:
                        other = [w.decode() for w, c in zip(spoken, costs) if c is None]
                        costs = [c for c in costs if c is not None]
                    else:
                        other = []
                    n_tokens.append(len(spoken))
                    n_hot.append(len(costs))
                    sums.append(sum(costs))
                    rare.append(other)
                scores, offsets, other, times = _priced(texts, *broad)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(names))), pa.array(n_tokens, pa.int64()), pa.array(n_hot, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores), pa.array(rare, pa.list_(pa.string())), pa.ListArray.from_arrays(offsets, other), pa.ListArray.from_arrays(offsets, times)],
                    [*names, *made],
                )

    path = shared_path(spark, "ppm-scored")
    source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    scored = spark.read.parquet(path)
    others = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").count()
    priced = others.join(words, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    price = F.log10((F.col("c") + 0.5) / F.lit(float(whole)))
    rest = priced.groupBy("row").agg(F.sum(F.col("count") * price).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("count")).otherwise(0)).alias("more"))
    # Grams that weren't broadcast: from the table, or down the orders where training has not seen them.
    spots = scored.select("row", F.explode(F.arrays_zip("grams", "times")).alias("spot")).select("row", F.col("spot.grams").alias("gram"), F.col("spot.times").alias("times"))
    seldom = costs.where(~frequent).select("gram", "cost")
    unseen = cut(spots.select("gram").distinct().join(seldom, "gram", "left_anti"))
    prices = seldom.unionByName(fallen(unseen, grams_of))
    deep = spots.join(prices, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("deep"))
    return scored.drop("rare", "grams", "times").join(rest, "row", "left").join(deep, "row", "left").select(
        *keep,
        "n_tokens",
        (F.col("n_hot") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("broad_score") + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )
