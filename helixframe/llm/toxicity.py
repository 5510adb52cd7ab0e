"""Toxicity with a factorization machine over hashed terms.

A text's words run through half-overlapping windows; a window's terms are its words and their first four and five
letters, hashed. The machine scores a window by a weight for each term and an inner product for each pair of terms, so
that pairs count that no sum of single weights could tell; a text is as toxic as its worst window. Labels say nothing
about windows, so training starts from the terms' log odds and moves the weights of each text's worst window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.license_scan import words_of

BUCKETS = 1 << 18
HALF = 16
#: Words whose terms a worker keeps.
KEEP = 200_000


def terms(word: bytes) -> tuple[int, int, int]:
    letters = word.decode("utf-8", "replace")
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in (f"w{letters}", f"4{letters[:4]}", f"5{letters[:5]}"))


def distinct_in_halves(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each run of HALF words, each once, and where the runs begin: a word said over and over counts once."""
    keys = np.unique((np.arange(len(ids), dtype=np.int64) // HALF) << 32 | ids)
    return keys & 0xFFFFFFFF, np.searchsorted(keys >> 32, np.arange(-(-len(ids) // HALF)))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


class Scorer:
    """Scores of whole texts; what a word adds to its window is kept by word."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((4096, machine.factors.shape[1] + 2), np.float32)

    def _add(self, words: list[bytes]) -> None:
        new = list(dict.fromkeys(words))
        at = len(self.number)
        self.number.update(zip(new, range(at, at + len(new))))
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        ids = np.array([terms(w) for w in new])
        v = self.machine.factors[ids]
        self.rows[at : at + len(new)] = np.concatenate([self.machine.weights[ids].sum(1)[:, None], v.sum(1), (v * v).sum((1, 2))[:, None]], axis=1)

    def windows(self, words: list[bytes]) -> np.ndarray:
        """Scores of the windows of a text's words: halves i and i + 1 make window i."""
        if not words:
            return np.array([self.machine.bias])
        if len(self.number) > KEEP:
            self.number.clear()
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        if (ids < 0).any():
            self._add([w for w, i in zip(words, ids.tolist()) if i < 0])
            ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        ids, starts = distinct_in_halves(ids)
        halves = np.add.reduceat(self.rows[ids], starts, axis=0).astype(np.float64)
        sums = halves[:-1] + halves[1:] if len(halves) > 1 else halves
        return self.machine.bias + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.windows(words_of(text)).max(), -40, 40))))


def train(texts: list[bytes], labels: list[int], factors: int = 8, epochs: int = 6, rate: float = 0.15, seed: int = 3, threshold: float = 0.7) -> Machine:
    """Adaptive gradient steps on the logistic loss of each text's worst window; scores of threshold and more mean toxic."""
    random = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    known = np.array([terms(w) for w in number], np.int32).reshape(-1, 3)
    seen = np.zeros((2, BUCKETS))
    for words, y in zip(docs, labels):
        seen[y, np.unique(known[np.unique(words)])] += 1
    n = np.array([max(1, labels.count(0)), max(1, labels.count(1))])
    expected = seen.sum(0) * (n / n.sum())[:, None]  # if a term told nothing
    odds = np.log((seen[1] + 5) / (expected[1] + 5)) - np.log((seen[0] + 5) / (expected[0] + 5))
    machine = Machine(-3.0, np.clip(odds, -0.1, 3.0) / 2, random.normal(0, 0.01, (BUCKETS, factors)).astype(np.float32))
    machine.weights[np.abs(machine.weights) < 0.4] = 0.0
    gw, gv, gb = np.full(BUCKETS, 0.1, np.float32), np.full((BUCKETS, factors), 0.1, np.float32), 0.1
    for _ in range(epochs):
        for at in random.permutation(len(docs)).tolist():
            words, y = docs[at], labels[at]
            if len(words):
                kept, starts = distinct_in_halves(words)
                ids = known[kept]
                v = machine.factors[ids]
                parts = np.concatenate([machine.weights[ids].sum(1)[:, None], v.sum(1), (v * v).sum((1, 2))[:, None]], axis=1)
                halves = np.add.reduceat(parts, starts, axis=0)
                sums = halves[:-1] + halves[1:] if len(halves) > 1 else halves
                scores = machine.bias + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1])
                worst = int(scores.argmax())
                own, total, score = ids[starts[worst] : starts[worst + 2] if worst + 2 < len(starts) else None].ravel(), sums[worst, 1:-1], scores[worst]
            else:
                own, total, score = np.zeros(0, np.int64), np.zeros(factors), machine.bias
            error = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - y
            if abs(error) < 1e-3:
                continue
            gb += error * error
            machine.bias -= rate * error / np.sqrt(gb)
            own, count = np.unique(own, return_counts=True)
            step = error * count + 1e-4 * machine.weights[own]
            gw[own] += step * step
            machine.weights[own] -= rate * step / np.sqrt(gw[own])
            move = error * count[:, None] * (total[None, :] - machine.factors[own]) + 1e-3 * machine.factors[own]
            gv[own] += move * move
            machine.factors[own] -= 0.1 * rate * move / np.sqrt(gv[own])
    machine = Machine(machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32))
    # The decision at `threshold` is put between the highest scores of clean texts and the lowest of toxic ones.
    scorer = Scorer(machine)
    scores = np.array([scorer.windows(words_of(t)).max() for t in texts])
    clean, toxic = np.quantile(scores[np.array(labels) == 0], 0.999), np.quantile(scores[np.array(labels) == 1], 0.005)
    machine.bias += np.log(threshold / (1 - threshold)) - (clean + 0.4 * max(0.0, toxic - clean))
    return machine


def train_machine(docs: DataFrame, labels: DataFrame, usable=None, sample_docs: int = 2000, sample_bytes: int = 40_000) -> Machine:
    """Trains on at most sample_docs labelled texts of each label of up to sample_bytes, drawn by a hash of the id.

    docs: doc_id, text; labels: doc_id, toxic (null labels are left out; of several for a document the largest counts).
    usable: condition on doc_id. Without a toxic and a clean example, every text scores alike and low.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if usable is not None:
        marked = marked.where(usable)
    drawn = marked.withColumn("h", F.xxhash64(F.lit(11), "doc_id"))
    wanted = drawn.where("toxic = 1").orderBy("h", "doc_id").limit(2 * sample_docs).unionByName(drawn.where("toxic = 0").orderBy("h", "doc_id").limit(2 * sample_docs))
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes)
    found = texts.join(F.broadcast(wanted), "doc_id").withColumn("key", F.xxhash64("text"))
    rows = found.where("toxic = 1").orderBy("h", "doc_id", "key").limit(sample_docs).unionByName(found.where("toxic = 0").orderBy("h", "doc_id", "key").limit(sample_docs)).select("h", "doc_id", "key", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["key"]))
    if len({r["toxic"] for r in rows}) < 2:
        return Machine(-3.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, 1), np.float32))
    return train([r["text"].encode() for r in rows], [int(r["toxic"]) for r in rows])


def score_documents(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` with score, from 0 to 1. Null and empty texts have the score of a window without words.

    Rows are independent: repeated rows and null ids are kept. The machine's size is fixed (BUCKETS terms).
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(shared.value)
        for texts in batches:
            found = []
            for at in range(0, len(texts), 512):
                found += [own.score(x or b"") for x in texts.slice(at, 512).cast(pa.binary()).to_pylist()]
            yield pa.array(found, pa.float64())

    return docs.select(*keep, score(F.col(text)).alias("score"))
