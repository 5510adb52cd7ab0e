"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is seen as a ring of segments. If two fingerprints differ in at most `max_bits` bits, then some
segment starts a chain such that, for every length, the differences over that many consecutive segments stay within
their proportional share of max_bits. The first segment of that chain is equal in both, and the first two differ in one
bit at most, so all pieces of the second but one are equal too: the first segment and these pieces are the key under
which fingerprints meet. Where they meet, the rest of the chain is checked before the full distance.

Near copies by a similarity of shingles are searched with wider fingerprints (near_copies) and checked by their texts.

Equal fingerprints count once. Of the fingerprints that meet under a key, a task hands on a spanning set of links, never
all pairs; keys with more than `block` members are compared block against block in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cut, frequent_keys, join_one, text_slices

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Widths of the segments, from the top bit; 5 segments and 4 bits give chains that start equal.
SEGMENTS = (13, 13, 13, 13, 12)


def fingerprint(text: bytes, shingle_words: int = 4, seed: int = 42) -> int:
    """A bit is set if set in over half the hashes of the text's shingles, repeats included; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle_words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=">u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """Columns `keep` with fp, the fingerprint of the whole text as a signed number (null text: as empty)."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    names = source.columns[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                prints = np.array([fingerprint(x, shingle_words, seed) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(prints)], [*names, "fp"])

    return source.mapInArrow(run, schema)


def _shifts() -> list[int]:
    """How far each segment lies from the lowest bit."""
    return [64 - sum(SEGMENTS[: i + 1]) for i in range(len(SEGMENTS))]


def key_masks(at: int, parts: int) -> list[int]:
    """Masks of the bits that fingerprints with a chain from segment `at` share, one for each piece of the next segment
    that may hold the differing bit: the whole segment, and the next one without that piece."""
    after, shifts = (at + 1) % len(SEGMENTS), _shifts()
    whole, width = ((1 << SEGMENTS[at]) - 1) << shifts[at], SEGMENTS[after]
    cuts = [width * i // parts for i in range(parts + 1)]
    rest = lambda i: ((1 << width) - 1) ^ (((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i])
    return [whole | rest(i) << shifts[after] for i in range(parts)]


def parts_for(n: int, members: int = 512) -> int:
    """Into how many pieces the second segment is cut: the fewest for which n evenly spread fingerprints leave no more
    than `members` under a key. More pieces make longer keys (13 to 25 bits) and more of them; the links are the same."""
    for parts in (2, 4, 6):
        if n <= members << (13 + 12 * (parts - 1) // parts):
            return parts
    return 12


def chained(x: np.ndarray, at: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether differences x (one word each) pass the chain from segment `at`, each length within its share, up to the
    full distance, which is returned too."""
    m, shifts = len(SEGMENTS), np.array(_shifts(), np.uint64)
    masks = np.array([(1 << w) - 1 for w in SEGMENTS], np.uint64)
    total, ok = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for n in range(m):
        s = (at + n) % m
        total += np.bitwise_count((x[:, 0] >> shifts[s]) & masks[s])
        ok &= total <= (n + 1) * max_bits // m
    return ok, total


class Forest:
    """Links that connect what pairs connect, nearest pairs first; labels of members are kept in one array."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int, int]] = []

    def add(self, i: int, others: np.ndarray, distance: np.ndarray) -> None:
        """Links i with the nearest of `others` in each tree that isn't i's own."""
        labels = self.label[others]
        order = np.lexsort((others, distance, labels))
        first = order[np.flatnonzero(np.diff(labels[order], prepend=-1))]
        for j in first[labels[first] != self.label[i]].tolist():
            self.links.append((i, int(others[j]), int(distance[j])))
            self.label[self.label == labels[j]] = self.label[i]


#: Groups up to this size are compared in common, shifted against themselves.
SMALL = 48


def meet(met: DataFrame, check, words: int, block: int) -> DataFrame:
    """Links (a, b, distance) between the values of met.fp (long, or binary of `words` 8-byte words) that meet under a met.key and
    pass check(differences, keys) -> (passes, distance). Of the pairs under a key, a spanning set of links is handed on,
    nearest first, never all pairs. Keys with more than `block` members are dealt to blocks; every pair of blocks is a
    task's work of its own.
    """
    binary = words > 1
    big = cut(met.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks")))
    met = met.join(F.broadcast(big) if big.count() <= 10_000 else big, "key", "left")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks"))
    met = met.withColumn("own", F.when(F.col("blocks").isNotNull(), own).otherwise(F.lit(0)))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("x"), F.greatest(i, F.col("own")).alias("y")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    met = met.withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pair)))
    dealt = met.select("key", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), (F.col("own") == F.col("pair.y")).alias("second"), "fp")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "second", "fp")

    def large(key: int, fps: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        """Links of a group; n: members of its first block, or 0 if both blocks are the same."""
        forest, keys = Forest(len(fps)), np.full(len(fps), key)
        for i in range(n or len(fps) - 1):
            start = n or i + 1
            ok, distance = check(fps[start:] ^ fps[i], keys[start:])
            hits = np.flatnonzero(ok)
            if len(hits):
                forest.add(i, hits + start, distance[hits])
        return forest.links

    def small(key: np.ndarray, fps: np.ndarray, group: np.ndarray) -> list[tuple[int, int, int]]:
        """Links of many groups of up to SMALL members that follow each other."""
        rows, d = np.arange(len(key)), 1
        pairs = []
        while True:
            rows = rows[rows + d < len(key)]
            rows = rows[group[rows] == group[rows + d]]
            if not len(rows):
                break
            for at in range(0, len(rows), 1 << 16):
                part = rows[at : at + (1 << 16)]
                ok, distance = check(fps[part] ^ fps[part + d], key[part])
                hits = part[ok]
                pairs.append((distance[ok], hits, hits + d))
            d += 1
        if not pairs:
            return []
        distance, a, b = (np.concatenate(c) for c in zip(*pairs))
        order = np.lexsort((b, a, distance))
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.get(i, i)) != i:
                parent[i] = i = parent.get(up, up)
            return i

        links = []
        for i, j, d in zip(a[order].tolist(), b[order].tolist(), distance[order].tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[y] = x
                links.append((i, j, d))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _and_end(batches):
            held = [t for t in (rest, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
            if not held:
                continue
            table = pa.concat_tables(held).combine_chunks()
            key, x, y, second = (table.column(c).to_numpy() for c in ("key", "x", "y", "second"))
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            stops = np.concatenate([heads[1:], [len(key)]])
            rest = None
            if batch is not None:  # the last group may go on in the next batch
                rest = table.slice(heads[-1])
                heads, stops = heads[:-1], stops[:-1]
            if not len(heads):
                continue
            column = table.column("fp").chunk(0)
            fps = np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words) if binary else column.to_numpy().view(np.uint64).reshape(-1, 1)
            sizes = stops - heads
            links = []
            for g in np.flatnonzero((sizes > SMALL) | ((x[heads] != y[heads]) & (sizes > 1))).tolist():
                a, b = int(heads[g]), int(stops[g])
                n = 0
                if x[a] != y[a]:
                    n = int(np.argmax(second[a:b])) if second[a:b].any() else b - a
                    if not 0 < n < b - a:
                        continue
                links += [(i + a, j + a, d) for i, j, d in large(int(key[a]), fps[a:b], n)]
            few = np.flatnonzero((sizes > 1) & (sizes <= SMALL) & (x[heads] == y[heads]))
            if len(few):
                rows = np.concatenate([np.arange(a, b) for a, b in zip(heads[few].tolist(), stops[few].tolist())])
                group = np.repeat(few, sizes[few])
                links += [(int(rows[i]), int(rows[j]), d) for i, j, d in small(key[rows], fps[rows], group)]
            if links:
                a, b, d = (pa.array(c, pa.int64()) for c in zip(*links))
                yield pa.RecordBatch.from_arrays([column.take(a), column.take(b), d], ["a", "b", "distance"])

    kind = "binary" if binary else "long"
    return dealt.mapInArrow(run, f"a {kind}, b {kind}, distance long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, max_bits: int = 4, block: int = 2048, parts: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct values of prints.fp whose connected components are those of all pairs within
    max_bits (at most 4, which the segments are made for). parts: see parts_for.
    """
    if not 0 <= max_bits < len(SEGMENTS):
        raise ValueError(f"max_bits must be from 0 to {len(SEGMENTS) - 1}")
    distinct = prints.select("fp").distinct()
    parts = parts or parts_for(distinct.count())
    spots = []
    for at in range(len(SEGMENTS)):
        # The two segments as one number, the ring's end joined to its start, and the tag of the key.
        for piece, mask in enumerate(key_masks(at, parts)):
            signed = mask - (1 << 64) if mask >> 63 else mask
            kept = F.col("fp").bitwiseAND(F.lit(signed).cast("long"))
            low = min(_shifts()[at], _shifts()[(at + 1) % len(SEGMENTS)])
            near = F.shiftrightunsigned(kept, low) if at + 1 < len(SEGMENTS) else F.shiftleft(kept, SEGMENTS[0]).bitwiseOR(F.shiftrightunsigned(kept, 64 - SEGMENTS[0]))
            spots.append(F.shiftleft(near, 7).bitwiseOR(F.lit(at * 16 + piece).cast("long")))
    met = distinct.select("fp", F.explode(F.array(*spots)).alias("key"))
    return meet(met, lambda x, key: chained(x, (key & 127) >> 4, max_bits), 1, block).select("a", "b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: the smallest node of its component.

    Rounds of: each node points at the smallest node that it or a neighbour points at, then at what that points at.
    Minima are pre-aggregated, and nodes and roots that very many point at are joined by broadcast (see join_one), so
    neither a hub nor a large component is gathered in a task. The result of a round is kept in the shared folder, and
    only whether anything changed comes to the driver.
    """
    pair = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = edges.select(F.explode(F.array(pair(a, b), pair(b, a), pair(a, a), pair(b, b))).alias("e"))
    both = cut(ends.select("e.x", "e.y").distinct())  # with a link of each node to itself
    hubs = cut(frequent_keys(both, "y"))
    label = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root")))
    while True:
        seen = join_one(both, label.select(F.col("node").alias("y"), F.col("root").alias("r")), "y", frequent=hubs)
        least = seen.groupBy(F.col("x").alias("node")).agg(F.max(F.when(F.col("x") == F.col("y"), F.col("r"))).alias("old"), F.min("r").alias("root"))
        # What a root's own members found is told to the root, so that trees merge, not only their edges.
        told = least.groupBy(F.col("old").alias("node")).agg(F.min("root").alias("told"))
        least = cut(least.join(told, "node", "left").select("node", "old", F.least("root", F.coalesce("told", "root")).alias("root")))
        jump = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(join_one(least, jump, "root").select("node", "old", F.col("next").alias("root")))
        label = new.select("node", "root")
        if new.where(F.col("old") != F.col("root")).isEmpty():
            return label


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach, its own included), root (the
    smallest fingerprint of the component), text_key (hash of the text).

    Texts without words, null ones too, have fingerprint 0 and link like any other. Repeated rows are linked by their
    equal fingerprints. A null doc_id is never the smallest unless its component has no other. Only the two named
    columns are read.
    """
    rows = cut(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")), ["doc_id", "text_key"], "text", shingle_words))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(cut(links(prints, max_bits)))
    rooted = cut(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(join_one(rooted, names, "root").select("fp", "root", "component_id"))
    return join_one(rows, named, "fp").select("doc_id", "fp", "component_id", "root", "text_key")


# Near copies by five-word shingles: wider fingerprints, and the similarity itself.

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Wide(NamedTuple):
    """The shape of a wide fingerprint: 64-bit words, cut into lanes of 16 or 32 bits, whose lower `bits` are a segment."""

    bits: int = 14
    words: int = 9

    @property
    def lane(self) -> int:
        return 16 if self.bits <= 16 else 32

    @property
    def segments(self) -> int:
        return self.words * 64 // self.lane

    @property
    def kind(self) -> str:
        return f">u{self.lane // 8}"

    @property
    def most(self) -> int:
        """Bits by which near copies may differ."""
        return self.bits * self.segments * 96 // 504

    @property
    def chain(self) -> int:
        """Bits that chains of segments share out between them."""
        return self.bits * self.segments * 128 // 504


#: The share of bits in which fingerprints of texts at similarity 0.8 differ: arccos(2 J / (1 + J)) / pi.
DIFFER = 0.15


def wide_for(n: int, members: int = 512) -> Wide:
    """The shape for n fingerprints: segments long enough that evenly spread ones leave no more than `members` under a key,
    and so many of them that near copies agree in as many as at 14 bits. What a fingerprint is compared with under a key
    is bounded; the number of keys grows with n to the power of 0.23."""
    bits = min(30, max(14, (max(1, -(-n // members)) - 1).bit_length()))
    segments = 36 * (1 - DIFFER) ** (14 - bits)
    return Wide(bits, int(np.ceil(segments * (16 if bits <= 16 else 32) / 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, each well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles; hashes of words are kept, up to a number of them."""

    def __init__(self, shingle_words: int, keep: int = 100_000):
        self.size, self.keep, self.words = shingle_words, keep, {}

    def shingles(self, text: bytes) -> np.ndarray:
        """The distinct shingles of a text, sorted; a text with fewer words is one shingle, and none has none."""
        spoken = text.translate(LOWER).split()
        if not spoken:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.keep:
            self.words.clear()
        known = self.words
        for w in spoken:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 42)
        h = np.fromiter(map(known.__getitem__, spoken), np.uint64, len(spoken))
        n = max(1, len(h) - self.size + 1)
        total = np.full(n, min(len(h), self.size), np.uint64)
        for j in range(min(self.size, len(h))):
            total = _mixed(total * _MULTIPLIER ^ h[j : j + n])
        return np.unique(total)

    def wide(self, text: bytes, shape: Wide = Wide()) -> bytes:
        """Words of bits, each set if set in over half of the shingles, mixed anew for every word."""
        h = self.shingles(text)
        if not len(h):
            return bytes(8 * shape.words)
        counts = np.zeros((shape.words, 64), np.int64)
        steps = _MULTIPLIER * np.arange(1, shape.words + 1, dtype=np.uint64)
        for k in range(shape.words):
            mixed = _mixed(h + steps[k]).astype(">u8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(h), 1 << 16):
                counts[k] += np.unpackbits(mixed[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
        return (np.packbits(counts * 2 > len(h), axis=1).view(shape.kind) & ((1 << shape.bits) - 1)).astype(shape.kind).tobytes()


def wide_chained(x: np.ndarray, at: np.ndarray, shape: Wide) -> tuple[np.ndarray, np.ndarray]:
    """Whether differences x (shape.words each) pass the chain from segment `at` round the ring, and differ in at most
    shape.most bits, which are returned too. A chain of n segments may differ in its share of shape.chain."""
    bits = np.bitwise_count(np.ascontiguousarray(x).astype(">u8").view(shape.kind)).astype(np.int64)
    total, m = bits.sum(1), shape.segments
    found = np.flatnonzero(total <= shape.most)
    turned = bits[found[:, None], (at[found, None] + np.arange(m)[None, :]) % m]
    ok = np.zeros(len(x), bool)
    ok[found] = (turned.cumsum(1) <= shape.chain * np.arange(1, m + 1)[None, :] / m).all(1)
    return ok, total


def wide_keys(prints: DataFrame, shape: Wide) -> DataFrame:
    """(key, fp) for each segment of each value of prints.fp; a key is a segment and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shape.segments
        step = max(1, 9216 // m)  # so many keys that no batch is large outside the heap
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                column = batch.column("fp").slice(at, step)
                segments = np.frombuffer(b"".join(column.to_pylist()), shape.kind).astype(np.int64).reshape(-1, m)
                keys = segments << 10 | np.arange(m)[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), column.take(pa.array(np.repeat(np.arange(len(keys)), m)))], ["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp binary")


def near_copies(docs: DataFrame, shingle_words: int = 5, least: float = 0.8, block: int = 2048, shape: Wide | None = None) -> DataFrame:
    """One row per document: doc_id, text_key, root; documents of one root are near copies, directly or by way of others.

    docs: doc_id, text_key (hash of the text), text. Two documents are linked if the Jaccard similarity of their sets of
    shingles is at least `least`. Candidates have wide fingerprints that agree in one of the segments (14 bits and longer with
    the number of rows, see wide_for; or as `shape` says), go on in a chain of proportional budgets and differ in at most
    19 % of the bits; their similarity is then computed from the whole texts. Unlike the links of 64-bit fingerprints this is a search with a recall below 1 (see README).
    Texts without words are copies of each other. root is that of the smallest doc_id (null last), text_key.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text_key", "text")
    shape = shape or wide_for(docs.count())

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(shingle_words)
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([own.wide(x, shape) for x in texts], pa.binary())], ["doc_id", "text_key", "fp"])

    rows = cut(source.mapInArrow(prints_of, "doc_id long, text_key long, fp binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    prints = cut(rows.groupBy("fp").agg(first.alias("rep")))

    met = meet(wide_keys(prints, shape), lambda x, key: wide_chained(x, key & 1023, shape), shape.words, block)
    found = cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # Candidates are checked by their own texts: of each fingerprint, that of its first document.
    linked = found.select(F.col("a").alias("fp")).unionByName(found.select(F.col("b").alias("fp"))).distinct().join(prints, "fp").select("fp", F.col("rep.none").alias("none"), F.coalesce("rep.doc_id", F.lit(0).cast("long")).alias("id"), F.col("rep.text_key").alias("text_key"))
    texts = source.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text_key", "text").join(linked, ["none", "id", "text_key"]).select("fp", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(shingle_words)
        for batch in batches:
            for part, parts in text_slices(batch):
                sets = [own.shingles(x).view(np.int64) for x in parts]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["fp", "shingles"])

    sets = cut(texts.mapInArrow(sets_of, "fp binary, shingles array<long>").dropDuplicates(["fp"]))

    # A hub's set goes to all its links; the joins are split where adaptive execution finds them skewed.
    sides = found.join(sets.withColumnsRenamed({"fp": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"fp": "b", "shingles": "sb"}), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    roots = components(cut(sides.where(both >= F.lit(least) * (F.size("sa") + F.size("sb") - both)).select("a", "b")))
    rooted = cut(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("group")))
    named = cut(join_one(rooted, rooted.groupBy("group").agg(F.min("rep").alias("root")), "group").select("fp", "root"))
    return join_one(rows, named, "fp").select("doc_id", "text_key", "root")
