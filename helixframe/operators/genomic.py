"""Genomic prediction and principal components over genotypes in long form, for any number of markers.

Genotypes (sample, marker, dosage) are packed once into blocks of markers, each with all its samples' dosages. Samples are
numbered, and what the driver holds is a few numbers for each sample; markers are never gathered. Both models work through
passes over the blocks: a task multiplies its centred markers X by XᵀQ, from the rows that are there or a dense part, and
Spark adds up the tasks. So the dual system of
a ridge is solved by conjugate gradients and components by a randomised range finder, without samples x samples or
markers x markers matrices.

A sample's row that isn't there is a dosage of 0; a null dosage is missing and counts as the marker's mean. Of repeated
rows the largest dosage counts. Rows with a null sample or marker are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import genotype_grid
from helixframe.shared import written

#: Samples that the driver keeps numbers of; beyond it, the numbers are tables of pieces (genotype_grid).
MOST_SAMPLES = 200_000
#: Genotype rows of a block, about; and bytes of a task's dense part of one.
BLOCK_ROWS, DENSE_BYTES = 1 << 20, 32 << 20
#: Numbers that a pass may send to the driver.
DRIVER_NUMBERS = 1 << 20


@dataclass
class Packed:
    """blocks (markers, starts, samples, dosages) in so many tasks, the samples in order, and which of them means and fits
    are from."""

    blocks: DataFrame
    tasks: int
    samples: list
    train: np.ndarray


def pack(genotypes: DataFrame, samples: DataFrame, block_rows: int = BLOCK_ROWS, most: int = MOST_SAMPLES) -> Packed:
    """genotypes: sample, marker, dosage; samples: sample, train (a boolean), a row for each sample.

    Rows of other samples are left out. A block is a bucket of whole markers by a hash; the number of buckets follows the
    number of rows, and a marker has at most one row for each sample.
    """
    known = samples.where(F.col("sample").isNotNull()).groupBy("sample").agg(F.bool_or("train").alias("train"))
    found = known.orderBy("sample").limit(most + 1).collect()  # bounded
    if len(found) > most:
        raise ValueError(f"more than {most} samples")
    numbers = known.select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("at"))  # at most `most` rows
    rows = genotypes.where(F.col("marker").isNotNull()).select("sample", "marker", F.col("dosage").cast("double").alias("dosage"))
    buckets = max(1, -(-rows.count() // block_rows))

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by([("marker", "ascending"), ("at", "ascending")])
        names = table.column("marker").combine_chunks().dictionary_encode()
        code, at, dosage = (x.to_numpy(zero_copy_only=False) for x in (names.indices, table.column("at").combine_chunks(), table.column("dosage").combine_chunks()))
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        bits = [np.append(starts, len(code)).astype(np.int64), at.astype(np.int32), dosage.astype(np.float64)]
        return pa.table([pa.array([names.dictionary.to_pylist()], pa.list_(pa.string())), *(pa.array([b.tobytes()], pa.binary()) for b in bits)], ["markers", "starts", "samples", "dosages"])

    one = rows.groupBy("sample", "marker").agg(F.max("dosage").alias("dosage")).join(F.broadcast(numbers), "sample")
    keyed = one.select(F.col("marker").cast("string").alias("marker"), "at", "dosage").withColumn("bucket", F.pmod(F.xxhash64("marker"), F.lit(buckets)))
    blocks = keyed.groupBy("bucket").applyInArrow(block, "markers array<string>, starts binary, samples binary, dosages binary")
    kept = written(blocks, "marker-blocks")
    return Packed(kept, kept.rdd.getNumPartitions(), [r["sample"] for r in found], np.array([bool(r["train"]) for r in found], bool))


class Part:
    """Some markers of a block: their dosages as given, centred and scaled on the fly.

    A missing dosage is the marker's mean. means and deviations (divisor n) are those of the training samples. Products take
    the rows that are there if these are few, else a dense matrix of DENSE_BYTES at most.
    """

    def __init__(self, markers: list[str], starts: np.ndarray, samples: np.ndarray, dosages: np.ndarray, train: np.ndarray):
        self.markers, self.starts, self.samples, self.n = markers, starts, samples, len(train)
        self.column = np.repeat(np.arange(len(markers)), np.diff(np.append(starts, len(samples))))
        own, gone = train[samples], np.isnan(dosages)
        count = lambda x: np.bincount(self.column, x, len(markers))
        given = np.where(gone, 0.0, dosages)
        seen = train.sum() - count((gone & own).astype(np.float64))
        self.means = count(given * own) / np.maximum(seen, 1)
        self.dosages = np.where(gone, self.means[self.column], dosages)
        # Centred squares: of the rows that are there, and of the dosages of 0 that aren't.
        there = count(((self.dosages - self.means[self.column]) ** 2) * own)
        rest = (train.sum() - count(own.astype(np.float64))) * self.means**2
        self.deviations = np.sqrt((there + rest) / max(1, train.sum()))
        self.deviations[self.deviations <= 1e-9 * np.maximum(1.0, np.abs(self.means))] = 0.0
        self.dense = None
        if len(samples) > 0.1 * self.n * len(markers):
            self.dense = np.zeros((self.n, len(markers)))
            self.dense[samples, self.column] = self.dosages

    def onto_markers(self, q: np.ndarray) -> np.ndarray:
        """The centred markers' products with the columns of q (samples x k)."""
        found = self.dense.T @ q if self.dense is not None else np.add.reduceat(q[self.samples] * self.dosages[:, None], self.starts)
        return found - self.means[:, None] * q.sum(0)

    def onto_samples(self, t: np.ndarray) -> np.ndarray:
        """The sums of the centred markers by the columns of t (markers x k)."""
        if self.dense is not None:
            found = self.dense @ t
        else:
            found = np.stack([np.bincount(self.samples, self.dosages * t[self.column, k], self.n) for k in range(t.shape[1])], axis=1)
        return found - self.means @ t

    def inverse(self, power: int) -> np.ndarray:
        """The deviations to the power -1 or -2 as a column; 0 for markers that don't vary."""
        return np.where(self.deviations > 0, np.where(self.deviations > 0, self.deviations, 1.0) ** -power, 0.0)[:, None]


def _parts(batch: pa.RecordBatch, train: np.ndarray) -> Iterator[Part]:
    step = max(1, DENSE_BYTES // 8 // max(1, len(train)))
    for i in range(batch.num_rows):
        markers = batch.column("markers")[i].as_py()
        starts, samples, dosages = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("starts", np.int64), ("samples", np.int32), ("dosages", np.float64)))
        for a in range(0, len(markers), step):
            b = min(a + step, len(markers))
            own = slice(starts[a], starts[b])
            yield Part(markers[a:b], starts[a:b] - starts[a], samples[own], dosages[own], train)


def _kernel(packed: Packed, q: np.ndarray, scaled: bool = False) -> np.ndarray:
    """X Xᵀ q over all samples, one pass; scaled: with markers of unit deviation, and none that don't vary.

    Sums are made in each task first. The tasks' sums go to the driver if they are DRIVER_NUMBERS at most; else Spark adds
    them up by place, and the driver gets as many numbers as q has.
    """
    train = packed.train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(q.shape)
        for batch in batches:
            for part in _parts(batch, train):
                t = part.onto_markers(q)
                total += part.onto_samples(t * part.inverse(2) if scaled else t)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

    each, out = packed.blocks.mapInArrow(run, "v array<double>"), np.zeros(q.size)
    if packed.tasks * q.size <= DRIVER_NUMBERS:
        for r in each.collect():  # a row for each task
            out += r["v"]
        return out.reshape(q.shape)
    for r in each.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():  # q.size rows
        out[r["at"]] = r["v"]
    return out.reshape(q.shape)


def _frame(packed: Packed, like: DataFrame, values: np.ndarray, columns: list[str]) -> DataFrame:
    """(sample, columns) of the driver's numbers for each sample."""
    kind = like.schema["sample"].dataType.simpleString()
    rows = [(s, *map(float, v)) for s, v in zip(packed.samples, values)]
    return like.sparkSession.createDataFrame(rows, ", ".join([f"sample {kind}", *(f"`{c}` double" for c in columns)]))


def ridge_predictions(genotypes: DataFrame, phenotypes: DataFrame, alpha: float = 1.0, tolerance: float = 1e-12, rounds: int = 2000, **options) -> DataFrame:
    """(sample, prediction) of every sample of phenotypes (sample, y): ridge on all markers with an intercept.

    Fitted on the samples with y, by conjugate gradients on the dual system (X Xᵀ + alpha) a = y - mean(y); one pass a round.
    Markers are centred by the fitted samples' means, not scaled. Without any y, predictions are null. alpha must be
    positive. An error if the residual is not within the tolerance after all rounds. More samples than MOST_SAMPLES have
    their numbers in tables, with the same rounds; `most` is a limit of the caller's own.
    """
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    rows = phenotypes.where(F.col("sample").isNotNull()).groupBy("sample").agg(F.max(F.col("y").cast("double")).alias("y"))
    if "most" not in options and rows.limit(MOST_SAMPLES + 1).count() > MOST_SAMPLES:
        return genotype_grid.ridge(genotypes, rows, alpha, tolerance, rounds)
    packed = pack(genotypes, rows.select("sample", F.col("y").isNotNull().alias("train")), **options)
    known = {r["sample"]: r["y"] for r in rows.where("y IS NOT NULL").collect()}  # at most MOST_SAMPLES rows
    train = packed.train
    if not train.any():
        return rows.select("sample", F.lit(None).cast("double").alias("prediction"))
    y = np.array([known.get(s, 0.0) for s in packed.samples])
    mean = y[train].mean()
    right = np.where(train, y - mean, 0.0)
    left, size = right.copy(), float(right @ right)
    goal, step, fitted = tolerance**2 * size, right.copy(), np.zeros(len(y))
    for _ in range(rounds):
        if size <= goal:
            break
        whole = _kernel(packed, step[:, None])[:, 0]  # of all samples: the predictions need those without y
        moved = np.where(train, whole, 0.0) + alpha * step
        length = size / float(step @ moved)
        fitted, left = fitted + length * whole, left - length * moved
        size, before = float(left @ left), size
        step = left + size / before * step
    if size > goal:
        raise ArithmeticError(f"not solved after {rounds} rounds")
    return _frame(packed, rows, (fitted + mean)[:, None], ["prediction"])


@dataclass
class Components:
    """scores (sample, pc1 ...) of the panel, loadings (marker, mean, deviation, load: an array), values, residual."""

    scores: DataFrame
    loadings: DataFrame
    values: np.ndarray
    residual: float


def _leading(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, width: int, rounds: int, tolerance: float, accepted: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, residual) of the k largest eigenvalues of a symmetric n x n matrix without negative ones.

    A random range of `width` vectors grows by what its best vectors leave over, and starts anew from these at four widths.
    """
    if not n:
        return np.zeros(0), np.zeros((0, 0)), 0.0
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0] if width < n else np.eye(n)
    moved, best, slow = times(basis), np.inf, 0
    for _ in range(rounds):
        inner = basis.T @ moved
        e, u = np.linalg.eigh((inner + inner.T) / 2)
        e, u = e[::-1][:width], u[:, ::-1][:, :width]
        vectors, images = basis @ u, moved @ u
        left = images - vectors * e
        top = max(float(e[0]), 0.0)
        residual = float(np.linalg.norm(left, axis=0)[:k].max()) / top if top else 0.0
        slow = slow + 1 if residual > 0.9 * best else 0
        if residual < best:
            best, found = residual, (e[:k], vectors[:, :k])
        if best <= tolerance or slow >= 3 and best <= accepted or basis.shape[1] == n:
            break
        if basis.shape[1] + width > min(n, 4 * width):
            basis, moved = vectors, images
        for _ in range(2):
            left = left - basis @ (basis.T @ left)
        q, r = np.linalg.qr(left)
        q = q[:, np.abs(np.diag(r)) > 1e-14 * top]
        q = q - basis @ (basis.T @ q)
        q = np.linalg.qr(q)[0][:, : n - basis.shape[1]]
        if not q.shape[1]:
            break
        basis, moved = np.concatenate([basis, q], axis=1), np.concatenate([moved, times(q)], axis=1)
    if best > accepted:
        raise ArithmeticError(f"components not certain after {rounds} rounds: residual {best:.1e} of the largest value")
    return found[0], found[1], best


def principal_components(genotypes: DataFrame, samples: DataFrame, k: int = 20, spare: int = 20, rounds: int = 100, tolerance: float = 1e-12, accepted: float = 1e-9, seed: int = 3, **options) -> Components:
    """The k leading components of a panel whose markers are standardised (divisor n); markers that don't vary are left out.

    samples: (sample) of the panel. A random range over the samples is refined by passes of X Xᵀ until the residuals of the
    k wanted components are within the tolerance of the largest value, or no longer fall and are within `accepted`;
    otherwise an error. Components without variance are left out. values are variances by component. Panels of more samples
    than MOST_SAMPLES are refined over the markers, of which there may be as many.
    """
    known = samples.where(F.col("sample").isNotNull()).select("sample").distinct()
    if "most" not in options and known.limit(MOST_SAMPLES + 1).count() > MOST_SAMPLES:
        leading = lambda times, m: _leading(times, m, k, min(m, k + spare), rounds, tolerance, accepted, seed)
        scores, loadings, values, best = genotype_grid.components(genotypes, known, k, MOST_SAMPLES, leading)
        return Components(scores, loadings, values / known.count(), best)
    packed = pack(genotypes, samples.select("sample", F.lit(True).alias("train")), **options)
    n = len(packed.samples)
    values, vectors, best = _leading(lambda q: _kernel(packed, q, scaled=True), n, k, min(n, k + spare), rounds, tolerance, accepted, seed)
    kept = values > 1e-10 * (values[0] if len(values) else 0.0)
    values, vectors = values[kept], vectors[:, kept]
    if len(values):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    roots, train = np.sqrt(values), packed.train

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, train):
                load, own = part.onto_markers(vectors) * part.inverse(1) / roots, part.deviations > 0
                columns = [pa.array(part.markers, pa.string()).filter(pa.array(own)), pa.array(part.means[own]), pa.array(part.deviations[own]), pa.array(list(load[own]), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["marker", "mean", "deviation", "load"])

    loadings = packed.blocks.mapInArrow(loads, "marker string, mean double, deviation double, load array<double>")
    scores = _frame(packed, samples, vectors * roots, [f"pc{i + 1}" for i in range(len(values))])
    return Components(scores, loadings, values / max(1, n), best)


def project(genotypes: DataFrame, samples: DataFrame, components: Components) -> DataFrame:
    """(sample, pc1 ...) of any samples on a panel's components, from a join of their genotypes with the loadings.

    Markers that the panel lacks don't count. A sample without rows has dosages of 0 everywhere.
    """
    k = len(components.values)
    rows = genotypes.where(F.col("sample").isNotNull()).groupBy("sample", F.col("marker").cast("string").alias("marker")).agg(F.max(F.col("dosage").cast("double")).alias("dosage"))
    joined = rows.join(components.loadings, "marker")
    # What a row adds to a sample that has a dosage of 0 everywhere.
    shift = F.when(F.col("dosage").isNull(), F.col("mean")).otherwise(F.col("dosage")) / F.col("deviation")
    sums = joined.groupBy("sample").agg(*(F.sum(shift * F.get("load", F.lit(i))).alias(f"__{i}") for i in range(k)))
    nothing = components.loadings.agg(*(F.coalesce(F.sum(F.col("mean") / F.col("deviation") * F.get("load", F.lit(i))), F.lit(0.0)).alias(f"__o{i}") for i in range(k)))
    whole = samples.select("sample").distinct().join(sums, "sample", "left").crossJoin(F.broadcast(nothing))  # nothing is one row
    return whole.select("sample", *((F.coalesce(f"__{i}", F.lit(0.0)) - F.col(f"__o{i}")).alias(f"pc{i + 1}") for i in range(k)))
