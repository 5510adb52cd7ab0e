"""Ridge and components over genotypes whose samples are too many for numbers on the driver.

Samples and markers are dealt into pieces by a hash and numbered inside them; genotypes become blocks of one piece of
samples and one of markers. A vector over samples or markers is a table of pieces, and a product is a join of blocks with
pieces and a sum by the other side's pieces. So a task holds some blocks and pieces, and the driver a few sums a round. Pieces
of BROADCAST_BYTES at most in all are broadcast to the blocks; more of them meet the blocks by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from helixframe.shared import removed, written

#: Samples or markers of a piece, about (places below 1 << 16 take two bytes); and genotype rows of a block.
SIDE, BLOCK_ROWS = 60_000, 1 << 20
#: Bytes of all pieces of a vector that are broadcast.
BROADCAST_BYTES = 64 << 20
#: A piece of a vector over one side: what belongs to the piece for good, its numbers, and sums that go to the driver.
PIECES = "piece int, own array<binary>, v binary, numbers array<double>"


@dataclass
class Grid:
    """samples (sample, y, sb, si), markers (marker, mean, deviation, mb, mi), blocks (sb, mb, rows, si, mi, dosage), and as
    pieces y of the samples (missing: not a training sample), and mean and deviation of the markers. train: samples with y,
    whose mean is y_mean."""

    samples: DataFrame
    markers: DataFrame
    blocks: DataFrame
    own_samples: DataFrame
    own_markers: DataFrame
    n: int
    n_markers: int
    train: int
    y_mean: float | None


def _least(values: np.ndarray, *kinds: type) -> bytes:
    """The values in the first of the kinds that holds them all exactly, else as they are; a reader tells by the length."""
    for kind in kinds:
        with np.errstate(invalid="ignore"):
            small = values.astype(kind)
        if np.array_equal(small, values):
            return small.tobytes()
    return values.tobytes()


def _read(values: pa.Scalar, rows: int, kinds: dict[int, type]) -> np.ndarray:
    buffer = values.as_buffer()
    return np.frombuffer(buffer, kinds[buffer.size // rows])


PLACES, DOSAGES = {2: np.uint16, 4: np.int32}, {1: np.int8, 4: np.float32, 8: np.float64}


def _numbered(df: DataFrame, key: str, pieces: int, piece: str, at: str) -> DataFrame:
    df = df.withColumn(piece, F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int"))
    return df.withColumn(at, (F.row_number().over(Window.partitionBy(piece).orderBy(key)) - 1).cast("int"))


def _pieces(df: DataFrame, piece: str, at: str, columns: list[str]) -> DataFrame:
    """(piece, own): the columns in the order of `at`; a null is NaN."""

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by(at)
        own = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64).tobytes() for c in columns]
        return pa.table([table.column(piece).slice(0, 1), pa.array([own], pa.list_(pa.binary()))], ["piece", "own"])

    return df.select(piece, at, *columns).groupBy(piece).applyInArrow(packed, "piece int, own array<binary>")


def grid(genotypes: DataFrame, phenotypes: DataFrame) -> Grid:
    """genotypes: sample, marker, dosage; phenotypes: sample, y, a row for each sample. Means and deviations (divisor n) are
    those of the samples with y; a missing dosage is the marker's mean."""
    n, train, y_mean = phenotypes.agg(F.count("*"), F.count("y"), F.avg("y")).first()
    parts = max(1, -(-n // SIDE))
    samples = written(_numbered(phenotypes, "sample", parts, "sb", "si"), "grid-samples")
    dosage = F.nanvl(F.col("dosage").cast("double"), F.lit(None).cast("double"))
    one = genotypes.where(F.col("marker").isNotNull()).groupBy("sample", "marker").agg(F.max(F.col("dosage").cast("double")).alias("dosage"))
    found = one.join(samples.select("sample", "sb", "si", F.col("y").isNotNull().alias("train")), "sample")
    rows = written(found.select("marker", "sb", "si", "train", dosage.alias("dosage")), "grid-rows")
    own = F.when(F.col("train"), F.col("dosage"))
    sums = rows.groupBy("marker").agg(F.count_if("train").alias("rows"), F.count(own).alias("given"), F.coalesce(F.avg(own), F.lit(0.0)).alias("avg"), F.coalesce(F.var_pop(own), F.lit(0.0)).alias("var"), F.count("*").alias("all"))
    mean = F.col("given") * F.col("avg") / F.greatest(F.lit(train) - F.col("rows") + F.col("given"), F.lit(1))
    # Centred squares: of the dosages that are there, and of those of 0 that aren't.
    squares = F.col("given") * (F.col("var") + F.pow(F.col("avg") - F.col("mean"), F.lit(2))) + (F.lit(train) - F.col("rows")) * F.pow("mean", F.lit(2))
    spread = F.sqrt(squares / max(1, train))
    stats = sums.withColumn("mean", mean).withColumn("spread", spread).select("marker", "mean", F.when(F.col("spread") > 1e-9 * F.greatest(F.lit(1.0), F.abs("mean")), F.col("spread")).otherwise(0.0).alias("deviation"), "all")
    stats = written(stats, "grid-statistics")
    n_markers, n_rows = stats.agg(F.count("*"), F.coalesce(F.sum("all"), F.lit(0))).first()
    columns = max(1, -(-n_markers // SIDE), -(-n_rows // (parts * BLOCK_ROWS)))
    markers = written(_numbered(stats.drop("all"), "marker", columns, "mb", "mi"), "grid-markers")

    def block(table: pa.Table) -> pa.Table:
        si, mi, dosage = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(t) for c, t in (("si", np.int32), ("mi", np.int32), ("dosage", np.float64)))
        bits = [_least(si, np.uint16), _least(mi, np.uint16), _least(dosage, np.int8, np.float32)]
        return pa.table([*(table.column(c).slice(0, 1) for c in ("sb", "mb")), pa.array([len(si)], pa.int32()), *(pa.array([b], pa.binary()) for b in bits)], ["sb", "mb", "rows", "si", "mi", "dosage"])

    cells = rows.join(markers, "marker").select("sb", "mb", "si", "mi", F.coalesce("dosage", "mean").alias("dosage"))
    blocks = written(cells.groupBy("sb", "mb").applyInArrow(block, "sb int, mb int, rows int, si binary, mi binary, dosage binary"), "grid-blocks")
    removed(rows, stats)
    return Grid(samples, markers, blocks, written(_pieces(samples, "sb", "si", ["y"]), "grid-pieces"), written(_pieces(markers, "mb", "mi", ["mean", "deviation"]), "grid-pieces"), n, n_markers, train, y_mean)


def _product(g: Grid, pieces: DataFrame, onto: str, k: int) -> DataFrame:
    """(piece, at, v): the blocks' sums for the pieces of the side `onto` (m or s), of the other side's pieces (piece, v)."""
    of, size = ("s", g.n) if onto == "m" else ("m", g.n_markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].as_py()
                source, target, dosage = (_read(batch.column(c)[i], rows, kinds) for c, kinds in (("source", PLACES), ("target", PLACES), ("dosage", DOSAGES)))
                v = np.frombuffer(batch.column("v")[i].as_buffer(), np.float64).reshape(-1, k)
                there = np.flatnonzero(np.bincount(target))
                sums = np.stack([np.bincount(target, dosage * v[source, j])[there] for j in range(k)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("piece").slice(i, 1), pa.array([there.astype(np.int32).tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["piece", "at", "v"])

    sides = g.blocks.select(F.col(f"{of}b").alias("from"), F.col(f"{onto}b").alias("piece"), "rows", F.col(f"{of}i").alias("source"), F.col(f"{onto}i").alias("target"), "dosage")
    others = pieces.select(F.col("piece").alias("from"), "v")
    joined = sides.join(F.broadcast(others) if 8 * size * k <= BROADCAST_BYTES else others, "from").select("piece", "rows", "source", "target", "dosage", "v")
    return joined.mapInArrow(run, "piece int, at binary, v binary")


Made = Callable[[list[np.ndarray], np.ndarray], tuple[list[np.ndarray], np.ndarray, list[float]]]


def _row(piece: int, made: tuple[list[np.ndarray], np.ndarray, list[float]]) -> pa.RecordBatch:
    own, v, numbers = made
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([[x.tobytes() for x in own]], pa.list_(pa.binary())), pa.array([v.tobytes()], pa.binary()), pa.array([list(map(float, numbers))], pa.list_(pa.float64()))], ["piece", "own", "v", "numbers"])


def _own(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.float64) for x in batch.column("own")[i]]


def _summed(parts: DataFrame, own: DataFrame, k: int, made: Made) -> DataFrame:
    """Pieces from the sums of a product: `made` gets what belongs to a piece and its sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept, piece = np.zeros((0, k)), None, None
        for batch in batches:
            for i in range(batch.num_rows):
                piece = batch.column("piece")[i].as_py()
                if batch.column("own")[i].is_valid:
                    kept = _own(batch, i)
                    size = len(kept[0])
                else:
                    at = np.frombuffer(batch.column("at")[i].as_buffer(), np.int32)
                    size = int(at[-1]) + 1
                if size > len(total):
                    total = np.concatenate([total, np.zeros((size - len(total), k))])
                if not batch.column("own")[i].is_valid:
                    total[at] += np.frombuffer(batch.column("v")[i].as_buffer(), np.float64).reshape(-1, k)
        yield _row(piece, made(kept, total))

    both = parts.select("piece", "at", "v", F.lit(None).cast("array<binary>").alias("own")).unionByName(own.select("piece", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("v"), "own"))
    return both.groupBy("piece").applyInArrow(run, PIECES)


def _mapped(pieces: DataFrame, made: Made) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = batch.column("v")[i] if "v" in batch.schema.names else None
                yield _row(batch.column("piece")[i].as_py(), made(_own(batch, i), np.frombuffer(v.as_buffer(), np.float64) if v is not None else None))

    return pieces.mapInArrow(run, PIECES)


def _written(pieces: DataFrame, what: str, k: int) -> tuple[DataFrame, list[float]]:
    """The pieces kept in the shared folder, and the sums of their numbers, from the same job."""
    sums = Observation()
    kept = written(pieces.observe(sums, *(F.sum(F.get("numbers", F.lit(j))).alias(f"n{j}") for j in range(k))), what)
    return kept, [sums.get[f"n{j}"] or 0.0 for j in range(k)]


def _rows(pieces: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """(sample, columns) of pieces over samples."""
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = np.frombuffer(batch.column("v")[i].as_buffer(), np.float64).reshape(-1, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), batch.column("piece")[i].as_py(), np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), *(pa.array(v[:, j]) for j in range(k))], ["sb", "si", *columns])

    each = pieces.select("piece", "v").mapInArrow(run, ", ".join(["sb int", "si int", *(f"`{c}` double" for c in columns)]))
    return samples.select("sample", "sb", "si").join(each, ["sb", "si"]).select("sample", *columns)


def ridge(genotypes: DataFrame, phenotypes: DataFrame, alpha: float, tolerance: float, rounds: int) -> DataFrame:
    """(sample, prediction) as genomic.ridge_predictions has it; phenotypes: sample, y, a row for each sample."""
    g = grid(genotypes, phenotypes)
    mean = g.y_mean
    if not g.train:
        return phenotypes.select("sample", F.lit(None).cast("double").alias("prediction"))

    def begin(own: list[np.ndarray], _: np.ndarray):
        fitting = ~np.isnan(own[0])
        left = np.where(fitting, own[0] - mean, 0.0)
        # What stays with a piece: 1 for a training sample, what is left, the step, what is fitted.
        return [fitting.astype(np.float64), left, left, np.zeros(len(left))], left, [left @ left, left.sum()]

    state, (size, total) = _written(_mapped(g.own_samples, begin), "grid-state", 2)
    goal, back, step_total = tolerance**2 * size, 0.0, total

    def stepped(beta: float) -> Made:
        def made(own: list[np.ndarray], _: np.ndarray):
            step = own[1] + beta * own[2]
            return [own[0], own[1], step, own[3]], step, []

        return made

    for _ in range(rounds):
        if size <= goal:
            break
        now, sum_now = (_mapped(state, stepped(back)) if back else state), step_total
        onto, (centre,) = _written(_summed(_product(g, now, "m", 1), g.own_markers, 1, lambda own, v: ([], v[:, 0] - own[0] * sum_now, [own[0] @ (v[:, 0] - own[0] * sum_now)])), "grid-markers-vector", 1)  # noqa: B023

        def moved(own: list[np.ndarray], v: np.ndarray):
            whole = v[:, 0] - centre  # noqa: B023
            return own, whole, [own[2] @ (own[0] * whole + alpha * own[2])]

        images, (curve,) = _written(_summed(_product(g, onto, "s", 1), now, 1, moved), "grid-images", 1)
        length = size / curve

        def taken(own: list[np.ndarray], whole: np.ndarray):
            left = own[1] - length * (own[0] * whole + alpha * own[2])  # noqa: B023
            return [own[0], left, own[2], own[3] + length * whole], left, [left @ left, left.sum()]  # noqa: B023

        old, before = state, size
        state, (size, total) = _written(_mapped(images, taken), "grid-state", 2)
        back = size / before
        step_total = total + back * step_total
        removed(old, onto, images)
    if size > goal:
        raise ArithmeticError(f"not solved after {rounds} rounds")
    return _rows(_mapped(state, lambda own, _: ([], own[3] + mean, [])), g.samples, ["prediction"])


def components(genotypes: DataFrame, samples: DataFrame, k: int, most: int, leading: Callable[..., tuple[np.ndarray, np.ndarray, float]]) -> tuple[DataFrame, DataFrame, np.ndarray, float]:
    """(scores, loadings, values, residual) as genomic.principal_components has them, through numbers for each marker on
    the driver; `leading` finds leading eigenvectors from (times, number of markers). samples: sample, a row for each."""
    g = grid(genotypes, samples.select("sample", F.lit(0.0).alias("y")))
    if g.n_markers > most:
        raise ValueError(f"more than {most} samples and more than {most} markers")
    markers = sorted(g.markers.withColumn("marker", F.col("marker").cast("string")).collect(), key=lambda r: (r["mb"], r["mi"]))  # at most `most` rows
    piece, means, spread = (np.array([r[c] for r in markers]) for c in ("mb", "mean", "deviation"))
    inverse = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)[:, None]
    spark, first = samples.sparkSession, {int(p): int(np.flatnonzero(piece == p)[0]) for p in np.unique(piece)}

    def onto_samples(q: np.ndarray) -> tuple[DataFrame, list[float]]:
        """Products of the standardised samples with the columns of q, and their sums as numbers."""
        z = q * inverse
        centre, width = means @ z, q.shape[1]
        rows = [(p, bytearray(np.ascontiguousarray(z[piece == p]).tobytes())) for p in first]
        parts = _product(g, spark.createDataFrame(rows, "piece int, v binary"), "s", width)
        return _written(_summed(parts, g.own_samples, width, lambda own, v: (own, v - centre, list((v - centre).sum(0)))), "grid-scores", width)

    def times(q: np.ndarray) -> np.ndarray:
        width, (onto, sums) = q.shape[1], onto_samples(q)
        found = np.zeros(q.shape)
        for r in _summed(_product(g, onto, "m", width), g.own_markers, width, lambda own, v: (own, v, [])).select("piece", "v").collect():  # numbers of q
            v = np.frombuffer(r["v"], np.float64).reshape(-1, width)
            found[first[r["piece"]] : first[r["piece"]] + len(v)] = v
        removed(onto)
        return (found - means[:, None] * np.array(sums)) * inverse

    values, vectors, best = leading(times, len(markers))
    kept = values > 1e-10 * (values[0] if len(values) else 0.0)
    values, vectors = values[kept], vectors[:, kept]
    names = [f"pc{i + 1}" for i in range(len(values))]
    if not names:
        return samples.select("sample"), spark.createDataFrame([], "marker string, mean double, deviation double, load array<double>"), values, best
    scores = _rows(onto_samples(vectors)[0], g.samples, names)
    # As with few samples: a component's largest score is positive.
    signs = np.array([-1.0 if x < 0 else 1.0 for x in scores.agg(*(F.max_by(c, F.abs(c)) for c in names)).first()])
    loadings = [(r["marker"], float(r["mean"]), float(r["deviation"]), [float(x) for x in v]) for r, v in zip(markers, vectors * signs) if r["deviation"] > 0]
    return scores.select("sample", *((F.col(c) * float(s)).alias(c) for c, s in zip(names, signs))), spark.createDataFrame(loadings, "marker string, mean double, deviation double, load array<double>"), values, best
