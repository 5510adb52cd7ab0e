"""Whitening of vectors onto their leading principal components by Chebyshev-filtered subspace iteration.

Vectors are packed once into blocks of integers. A pass multiplies the centred rows' XᵀX by a thin matrix Q: each task adds
up its blocks, Spark adds up the tasks. A filter is a Chebyshev polynomial of the covariance, one pass for each degree of its
recurrence, that damps the spectrum below the wanted part; then Q is made orthonormal, and the Rayleigh-Ritz values and
their residuals say whether the components are certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import shared_path

SCALE, SHIFT = 1024, 100_000
#: Bytes of a packed block.
BLOCK_BYTES = 4 << 20
#: Numbers that a pass may send to the driver.
DRIVER_NUMBERS = 1 << 20
#: The largest size of an entry's integer.
LARGEST = 1 << 48


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ident, vector as doubles) of the rows whose vector is there and has finite entries only."""
    rows = vectors.select(F.col(ident).cast("long").alias("ident"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite)


def integers(values: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * values)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"entries over {LARGEST // SCALE} are too large for exact sums")
    return x.astype(np.int64) + SHIFT


def pack(rows: DataFrame) -> DataFrame:
    """(idents, width, rows, x, sums, largest): blocks of usable() vectors; shorter vectors count as padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lengths = pc.list_value_length(batch.column("vector").slice(at)).to_numpy()
                reach = np.maximum.accumulate(np.maximum(lengths, 1)) * np.arange(1, len(lengths) + 1) * 8
                n = max(1, int(np.searchsorted(reach, BLOCK_BYTES, "right")))
                part = batch.slice(at, n)
                width = int(lengths[:n].max())
                x = np.full((n, width), SHIFT, np.int64)
                x[np.arange(width)[None, :] < lengths[:n, None]] = integers(part.column("vector").flatten().to_numpy())
                kind = np.int32 if not x.size or np.abs(x).max() < 1 << 31 else np.int64
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("ident").to_pylist()], pa.list_(pa.int64())), pa.array([width]), pa.array([n]), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([x.sum(0)], pa.list_(pa.int64())), pa.array([int(np.abs(x).max()) if x.size else SHIFT])],
                    ["idents", "width", "rows", "x", "sums", "largest"],
                )
                at += n

    return rows.mapInArrow(run, "idents array<long>, width long, rows long, x binary, sums array<long>, largest long")


@dataclass
class Fit:
    """What all rows share: n, the sums by dimension, and components (columns of unit length) with their variances."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    residual: float
    passes: int


def _unpacked(batch: pa.RecordBatch, i: int, width: int) -> np.ndarray:
    n, own, data = batch.column("rows")[i].as_py(), batch.column("width")[i].as_py(), batch.column("x")[i].as_py()
    x = np.full((n, width), SHIFT, np.int64)
    if own:
        x[:, :own] = np.frombuffer(data, np.int32 if len(data) == 4 * n * own else np.int64).reshape(n, own)
    return x


def _summed(blocks: DataFrame, add, size: int, tasks: int) -> np.ndarray:
    """The sum of add(batch, i) over all blocks, made in each task first.

    The tasks' sums go to the driver if they are DRIVER_NUMBERS at most; else Spark adds them up by place, and the driver
    gets `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                total += add(batch, i)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    each = blocks.select("rows", "width", "x").mapInArrow(run, "v array<double>")
    out = np.zeros(size)
    if tasks * size <= DRIVER_NUMBERS:
        for r in each.collect():  # a row for each task
            out += r["v"]
        return out
    places = each.select(F.posexplode("v").alias("at", "v"))
    for r in places.groupBy("at").agg(F.sum("v").alias("v")).collect():  # size rows
        out[r["at"]] = r["v"]
    return out


class Covariance:
    """The covariance of packed vectors, as passes over them; divisor n, centred before multiplying."""

    def __init__(self, blocks: DataFrame):
        self.blocks, self.tasks, self.passes = blocks, blocks.rdd.getNumPartitions(), 0
        n, width, largest = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("width"), F.lit(0)), F.coalesce(F.max("largest"), F.lit(0))).first()
        self.n, self.width = int(n), int(width)
        if self.n * (int(largest) + SHIFT) >= 1 << 62:
            raise ValueError("too many rows or too large entries for exact sums")
        # A block without the last dimensions holds zeros there.
        found = blocks.select(F.posexplode("sums").alias("at", "s"), "rows").groupBy("at").agg(F.sum("s").alias("s"), F.sum("rows").alias("rows")).collect()  # width rows
        self.sums = np.full(self.width, SHIFT * self.n, np.int64)
        for r in found:
            self.sums[r["at"]] = r["s"] + SHIFT * (self.n - r["rows"])

    def centred(self):
        n, sums, width = self.n, self.sums, self.width

        def rows(batch: pa.RecordBatch, i: int) -> np.ndarray:
            return (n * _unpacked(batch, i, width) - sums) / n

        return rows

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q: one pass."""
        self.passes += 1
        rows = self.centred()

        def add(batch: pa.RecordBatch, i: int) -> np.ndarray:
            y = rows(batch, i)
            return (y.T @ (y @ q)).ravel()

        return _summed(self.blocks, add, q.size, self.tasks).reshape(q.shape) / self.n

    def trace(self) -> float:
        self.passes += 1
        rows = self.centred()
        return float(_summed(self.blocks, lambda batch, i: np.array([(rows(batch, i) ** 2).sum()]), 1, self.tasks)[0]) / self.n


def filtered(times, q: np.ndarray, vq: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the matrix behind `times` applied to q: at most 1 in size on [low, high], large towards top
    and scaled to 1 there. vq: times(q), where it is known already."""
    centre, half = (low + high) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(1, degree):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def leading(times, width: int, k: int, spare: int = 24, degree: int = 12, rounds: int = 60, tolerance: float = 1e-14, accepted: float = 1e-11, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(components, values, residual) of the k largest eigenvalues of a symmetric matrix without negative ones.

    Rounds end when every wanted |V u - e u| is at most tolerance times the largest value, or when it no longer falls and is
    within `accepted`; otherwise an error. A small matrix is multiplied by the identity once.
    """
    block = min(width, k + spare)
    q = np.eye(width) if block == width else np.linalg.qr(np.random.default_rng(seed).standard_normal((width, block)))[0]
    best = (np.inf, None, None)
    for _ in range(rounds):
        vq = times(q)
        inner = q.T @ vq
        values, u = np.linalg.eigh((inner + inner.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        top = max(float(values[0]), 0.0)
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:k].max()) / top if top else 0.0
        stuck = residual > 0.5 * best[0]
        if residual < best[0]:
            best = (residual, q[:, :k], values[:k])
        high = float(values[-1])
        # Nothing to damp: the block holds everything that varies.
        if residual <= tolerance or stuck and best[0] <= accepted or block == width or high <= 1e-13 * top:
            break
        q = np.linalg.qr(filtered(times, q, vq, degree, 0.0, high, top))[0]
    if best[0] > accepted:
        raise ArithmeticError(f"components not certain after {rounds} rounds: residual {best[0]:.1e} of the largest value")
    return best[1], best[2], best[0]


def fit(blocks: DataFrame, k: int = 8) -> Fit:
    """The leading components. Directions without variance (1e-12 of the largest, or none) are left out."""
    v = Covariance(blocks)
    if not v.n or not v.width:
        return Fit(v.n, v.sums, np.zeros((v.width, 0)), np.zeros(0), 0.0, 0.0, v.passes)
    components, values, residual = leading(v.times, v.width, k)
    kept = (values > 0) & (values > 1e-12 * values[0])
    components, values = components[:, kept], values[kept]
    signs = np.sign(components[np.abs(components).argmax(0), np.arange(len(values))]) if len(values) else np.ones(0)
    return Fit(v.n, v.sums, components * signs, values, v.trace(), residual, v.passes)


def _whitened(model: Fit):
    scaled, n, sums = model.components / np.sqrt(model.variances), model.n, model.sums

    def rows(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        moved = n * _unpacked(batch, i, len(sums)) - sums
        return moved, (moved / n) @ scaled

    return rows


def identity_error(blocks: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity: one pass."""
    k, rows = len(model.variances), _whitened(model)
    if not k:
        return 0.0

    def add(batch: pa.RecordBatch, i: int) -> np.ndarray:
        w = rows(batch, i)[1]
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    found = _summed(blocks, add, k + k * k, blocks.rdd.getNumPartitions()) / model.n
    mean, second = found[:k], found[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def _squares(moved: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None where a long cannot hold one."""
    size = (moved.astype(np.float64) ** 2).sum(1)
    exact = (moved * moved).sum(1).tolist()
    for i in np.flatnonzero(size > 9e18).tolist():
        whole = sum(x * x for x in moved[i].tolist())
        exact[i] = whole if whole < 1 << 63 else None
    return exact


def whiten(blocks: DataFrame, model: Fit) -> DataFrame:
    """(ident, component from 1, deviation, whitened) of every packed row."""
    k, own = len(model.variances), _whitened(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                moved, w = own(batch, i)
                ids, n = batch.column("idents")[i].values.to_pylist(), len(moved)
                each = np.repeat(np.arange(n), k)
                columns = [pa.array(ids, pa.int64()).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(_squares(moved), pa.int64()).take(pa.array(each)), pa.array(w.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["ident", "component", "deviation", "whitened"])

    return blocks.mapInArrow(run, "ident long, component int, deviation long, whitened double")


def whitened_components(vectors: DataFrame, k: int = 8, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ident, component, n, deviation, whitened, explained, identity_error) of every usable vector and component.

    Rows without a vector, or with null or non-finite entries, are left out; vectors shorter than the longest one count as
    padded with zeros; repeated rows and null idents are rows like others. There are fewer components where fewer
    directions vary, and no rows without any. deviation is null where a long cannot hold it. Entries over 2^38 are an
    error. The packed table stays in the shared folder.
    """
    spark = vectors.sparkSession
    path = shared_path(spark, "whitening-blocks")
    pack(usable(vectors, ident, vector)).write.parquet(path)
    blocks = spark.read.parquet(path)
    model = fit(blocks, k)
    shares = F.array(*(F.lit(float(e) / model.trace) for e in model.variances)).cast("array<double>")
    return whiten(blocks, model).select(
        F.col("ident").alias(ident),
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(identity_error(blocks, model)).alias("identity_error"),
    )
