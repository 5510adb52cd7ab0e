"""Text quality with naive Bayes support vectors.

A text is the set of its n-grams: of bytes, of runs of byte classes, of words, and of marks that say how far back the same
word stood. Each n-gram's indicator is scaled by the log ratio of its counts in both classes, the vector by its length, so
that long texts weigh no more than short ones; a linear model with hinge loss, fitted by dual coordinate descent, separates
them. A sigmoid over margins of texts that a fold's model hasn't seen turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Bytes of a text that are looked at at a time; pieces end at white space and share OVERLAP words, which hold every n-gram between them.
PIECE = 1 << 20
OVERLAP = 8
#: Words that a mark looks back.
BACK = 4
#: (first salt, lengths) of the n-grams of bytes, classes, words and marks.
BYTES, RUNS, WORDS, MARKS = (0, (1, 2, 3, 4)), (100, (2, 4, 6)), (200, (1, 2)), (300, (2, 4))

_STEP = 0x9E3779B97F4A7C15
_BACKWARD = pow(_STEP, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _classes() -> np.ndarray:
    """White space, line ends, digits, upper-case and other letters; every other byte is a class of its own."""
    out = 10 + np.arange(256)
    out[_SPACE], out[10] = 0, 1
    out[48:58], out[65:91], out[97:123], out[128:] = 2, 3, 4, 4
    return out.astype(np.uint64)


_CLASS = _classes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(64 - BITS)


class Grams:
    """Sets of n-gram numbers of whole texts; keeps a bit for each number and powers for word hashes."""

    def __init__(self, piece: int = PIECE):
        self.piece, self.seen = piece, np.zeros(1 << BITS, bool)
        self._powers(4096)

    def _powers(self, n: int) -> None:
        self.up, self.down = (np.cumprod(np.full(n, x, np.uint64)) for x in (_STEP, _BACKWARD))

    def _mark(self, codes: np.ndarray, kind: tuple[int, tuple[int, ...]]) -> None:
        salt, lengths = kind
        h = np.full(len(codes), salt, np.uint64)
        for n in range(1, min(max(lengths), len(codes)) + 1):
            h = h[: len(codes) - n + 1] * np.uint64(_STEP) + codes[n - 1 :] + np.uint64(1)
            if n in lengths:
                self.seen[_mixed(h + np.uint64(n))] = True

    def _words(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word: differences of one running sum over the bytes, brought to the same power."""
        if len(b) > len(self.up):
            self._powers(2 * len(b))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)])])
        return (sums[ends] - sums[starts]) * self.down[starts]

    def numbers(self, text: bytes) -> np.ndarray:
        """The distinct numbers of the text's n-grams, in order."""
        whole, at, again = np.frombuffer(text, np.uint8), 0, 0
        while at < len(whole):
            b = whole[at : at + self.piece]
            more = at + self.piece < len(whole)
            space = _SPACE[b]
            if more and space.any():
                b = b[: len(space) - int(space[::-1].argmax())]
                space = space[: len(b)]
            edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
            starts, ends = edges[::2], edges[1::2]
            words = self._words(b, starts, ends)
            marks = np.zeros(len(words), np.uint64)
            for back in range(BACK, 0, -1):
                marks[back:][words[back:] == words[:-back]] = back
            runs = _CLASS[b]
            self._mark(b.astype(np.uint64), BYTES)
            self._mark(runs[np.concatenate([[True], runs[1:] != runs[:-1]])], RUNS)
            self._mark(words, WORDS)
            self._mark(marks[BACK if again else 0 :], MARKS)
            # The next piece starts OVERLAP words earlier, unless these are most of this one: then where this one ends.
            again = more and len(starts) > 2 * OVERLAP
            at += int(starts[-OVERLAP]) if again else len(b)
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


@dataclass
class Model:
    """score = sigmoid(slope * margin + shift); margin = sum of weights / root of the sum of squares + bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, numbers: np.ndarray) -> float:
        return float(self.weights[numbers].sum() / np.sqrt(max(1e-12, self.squares[numbers].sum())) + self.bias)

    def score(self, numbers: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(numbers) + self.shift, -40, 40))))


def log_count_ratios(texts: list[np.ndarray], good: np.ndarray, smooth: float = 1.0, least: int = 3) -> np.ndarray:
    """log of each n-gram's share of the counts in good texts over that in others; 0 if fewer than `least` texts have it."""
    counts = np.zeros((2, 1 << BITS))
    for numbers, y in zip(texts, good.tolist()):
        counts[int(y), numbers] += 1
    shares = (counts + smooth) / (counts + smooth).sum(1, keepdims=True)
    return np.where(counts.sum(0) >= least, np.log(shares[1] / shares[0]), 0.0)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, most: np.ndarray, width: int, epochs: int = 60, tolerance: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, duals) that minimise (|w|^2 + bias^2) / 2 + sum of most_i * hinge loss of row i.

    A row is (columns, values). Steps solve the dual in one variable at a time, within 0 and most_i, until the projected
    gradients of a round are all below the tolerance.
    """
    random, w, bias, duals = np.random.default_rng(seed), np.zeros(width), 0.0, np.zeros(len(rows))
    size = [float(v @ v) + 1.0 for _, v in rows]
    for _ in range(epochs):
        largest = 0.0
        for i in random.permutation(len(rows)).tolist():
            at, v = rows[i]
            slope = signs[i] * (w[at] @ v + bias) - 1.0
            projected = min(slope, 0.0) if duals[i] <= 0 else max(slope, 0.0) if duals[i] >= most[i] else slope
            largest = max(largest, abs(projected))
            if projected:
                new = min(max(duals[i] - slope / size[i], 0.0), most[i])
                step = (new - duals[i]) * signs[i]
                w[at] += step * v
                bias += step
                duals[i] = new
        if largest < tolerance:
            break
    return w, bias, duals


def _sigmoid(margins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic regression of smoothed labels on margins, by Newton's method with step halving."""
    n = np.array([(~good).sum(), good.sum()])
    target = np.where(good, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.stack([margins, np.ones(len(margins))])
    at = np.array([1.0, 0.0])
    loss = lambda t: float((weight * (np.logaddexp(0, t @ x) - target * (t @ x))).sum()) + 1e-6 * float(t @ t)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 2e-6 * np.eye(2), x @ (weight * (target - p)) - 2e-6 * at)
        while loss(at + step) > loss(at) and np.abs(step).max() > 1e-9:
            step /= 2
        at = at + step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def _fit(texts: list[np.ndarray], good: np.ndarray, cost: float) -> Model:
    ratios = log_count_ratios(texts, good)
    rows = []
    for numbers in texts:
        own = numbers[ratios[numbers] != 0]
        v = ratios[own]
        rows.append((own, v / np.sqrt(max(1e-12, v @ v))))
    share = len(texts) / 2 / np.maximum(1, np.array([(~good).sum(), good.sum()]))
    w, bias, _ = dual_coordinate_descent(rows, np.where(good, 1.0, -1.0), cost * share[good.astype(int)], 1 << BITS)
    return Model((w * ratios).astype(np.float32), (ratios * ratios).astype(np.float32), bias, 1.0, 0.0)


def train(texts: list[bytes], labels: list[int], cost: float = 3.0, folds: int = 3) -> Model:
    """Both classes weigh the same, whatever their numbers."""
    grams, good = Grams(), np.array(labels) == 1
    sets = [grams.numbers(t) for t in texts]
    unseen = np.zeros(len(sets))
    for fold in range(folds):
        test = [i for i in range(len(sets)) if i % folds == fold]
        own = [i for i in range(len(sets)) if i % folds != fold]
        if good[own].all() or not good[own].any():
            continue
        part = _fit([sets[i] for i in own], good[own], cost)
        unseen[test] = [part.margin(sets[i]) for i in test]
    model = _fit(sets, good, cost)
    share = len(sets) / 2 / np.array([(~good).sum(), good.sum()])
    model.slope, model.shift = _sigmoid(unseen, good, share[good.astype(int)])
    return model


def train_model(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_docs: int = 2000, sample_bytes: int = 20_000) -> Model:
    """Trains on at most sample_docs labelled texts of either label of up to sample_bytes, drawn by a hash of the id.

    docs: doc_id, text; labels: doc_id, quality (null labels and ids are left out; of several for a document the least
    counts). usable: condition on doc_id. Null texts are empty. Without examples of both labels, every text scores one half.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    if usable is not None:
        marked = marked.where(usable)
    drawn = marked.withColumn("__h", F.xxhash64(F.lit(13), "doc_id"))
    side = lambda rows, y, n, *order: rows.where(F.col("__quality") == y).orderBy("__h", "doc_id", *order).limit(n)
    wanted = side(drawn, 1, 2 * sample_docs).unionByName(side(drawn, 0, 2 * sample_docs))  # bounded, whatever the input
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).where(F.octet_length("__text") <= sample_bytes)
    found = texts.join(F.broadcast(wanted), "doc_id").withColumn("__key", F.xxhash64("__text"))
    rows = side(found, 1, sample_docs, "__key").unionByName(side(found, 0, sample_docs, "__key")).collect()
    rows.sort(key=lambda r: (r["__h"], r["doc_id"], r["__key"]))
    if len({r["__quality"] for r in rows}) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0)
    return train([r["__text"].encode() for r in rows], [int(r["__quality"]) for r in rows])


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` with score, from 0 (poor) to 1. Null and empty texts have no n-grams: the model's bias alone decides.

    Rows are independent: repeated rows and null ids are kept. The model's size is fixed (2^BITS n-grams), and a text is
    worked on in pieces, so its length costs time, not memory.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams, own = Grams(), shared.value
        for texts in batches:
            found = []
            for at in range(0, len(texts), 512):
                found += [own.score(grams.numbers(x or b"")) for x in texts.slice(at, 512).cast(pa.binary()).to_pylist()]
            yield pa.array(found, pa.float64())

    return docs.select(*keep, score(F.col(text)).alias("score"))
