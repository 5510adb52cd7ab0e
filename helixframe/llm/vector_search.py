"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector is scaled to length one, padded with zeros to `bits` dimensions and rotated at random; its code is the signs,
packed into 64-bit words. A query is rotated in the same way and rounded at random to a few bits for each dimension,
which are packed as planes. The inner product of both is estimated by counting the bits that a code and the planes
share, and corrected by a scalar of the code; the estimate is wrong by more than a bound, known for each code, only with
a vanishing chance. Of each block of codes, the best estimates are computed exactly first; then every vector whose bound
still reaches the best `k` so far is computed exactly too.

Vectors of each length are a space of their own: a query meets vectors of its own length only, since inner products
between lengths are not defined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut

#: Bits of a query's rotated dimension.
PLANES = 4


def code_bits(dims: int, per_dim: float) -> int:
    """Bits of a code: at least one for each dimension, in whole words."""
    return 64 * max(1, -(-int(dims * max(1.0, per_dim)) // 64))


@lru_cache(maxsize=4)
def rotation(dims: int, bits: int, seed: int) -> np.ndarray:
    """bits x dims with orthonormal columns: the part of a random rotation that meets vectors padded with zeros."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dims)))[0]


def encode(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length, and the inner product of the rotated unit vector with its code, for rows of x."""
    scale = np.abs(x).max(1, keepdims=True)  # so that squares of very large or small numbers stay finite
    norms = np.sqrt(((x / scale) ** 2).sum(1)) * scale[:, 0]
    y = (x / norms[:, None]) @ rotation(x.shape[1], bits, seed).T
    return np.packbits(y > 0, axis=1), norms, np.abs(y).sum(1) / np.sqrt(bits)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed from the first dimension on."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


class Codes:
    """A block of packed codes, a row of words for each place in the code."""

    def __init__(self, packed: np.ndarray, norms: np.ndarray, own: np.ndarray, bound: float):
        self.words = np.ascontiguousarray(packed.view(np.uint64).T)
        bits = 64 * len(self.words)
        n = self.words.shape[1]
        self.ones = np.bitwise_count(self.words).sum(0, dtype=np.float32)
        self.scale = (norms / (own * np.sqrt(bits))).astype(np.float32)
        # The rounding of the query adds to what the code itself leaves open.
        self.radius = (norms * (np.sqrt(np.maximum(0, 1 - own * own)) / own * bound / np.sqrt(max(1, bits - 1)) + 1e-5)).astype(np.float32)
        self.both, self.count, self.plane, self.shared = np.empty(n, np.uint64), np.empty(n, np.uint8), np.empty(n, np.uint16), np.empty(n, np.uint16)

    def estimates(self, planes: np.ndarray, low: float, step: float, total: float, out: np.ndarray) -> None:
        """Estimated inner products with a unit query, into out. planes: PLANES x words, the most significant first."""
        bits = 64 * len(self.words)
        self.shared[:] = 0
        for plane in planes:
            self.shared <<= 1
            for word, mine in zip(self.words, plane):
                np.bitwise_and(word, mine, out=self.both)
                np.bitwise_count(self.both, out=self.count)
                self.shared += self.count
        # With signs s = 2 b - 1 and a dimension of low + step u: the sum of s (low + step u).
        np.multiply(self.shared, np.float32(2 * step), out=out)
        out += np.float32(2 * low) * self.ones
        out -= np.float32(step * total + bits * low)
        out *= self.scale


def rounded(turned: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Planes, least value, step and sum of steps of each rotated query, rounded up or down at random without bias."""
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), 1e-12)
    u = np.floor((turned - low[:, None]) / step[:, None] + np.random.default_rng(seed).random(turned.shape)).clip(0, (1 << PLANES) - 1).astype(np.uint8)
    planes = np.stack([np.packbits((u >> j) & 1, axis=1).view(np.uint64) for j in range(PLANES - 1, -1, -1)], axis=1)
    return planes, low, step, u.sum(1, dtype=np.float64)


def nearest_in_block(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, packed: np.ndarray, norms: np.ndarray, own: np.ndarray, k: int, bits: int, seed: int, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, number of the vector, score) of each query's k nearest in a block, itself left out."""
    length = encode(q, bits, seed)[1]
    planes, low, step, total = rounded((q / length[:, None]) @ rotation(q.shape[1], bits, seed).T, seed)
    codes = Codes(packed, norms, own, bound)
    first = min(len(x), 2 * k + 1)
    guess, reach = np.empty(len(x), np.float32), np.empty(len(x), np.float32)
    by_row = np.argsort(rows)
    at = np.minimum(np.searchsorted(rows, q_row, sorter=by_row), len(rows) - 1)
    here = rows[by_row[at]] == q_row  # whether the query itself is in the block, and where
    queries, vectors = [], []
    for i in range(len(q)):
        codes.estimates(planes[i], float(low[i]), float(step[i]), float(total[i]), guess)
        if here[i]:
            guess[by_row[at[i]]] = -np.inf
        least = -np.inf
        if first >= k:
            head = np.argpartition(guess, len(x) - first)[len(x) - first :]
            near = x[head] @ q[i]
            near[np.isneginf(guess[head])] = -np.inf
            least = np.partition(near, first - k)[first - k]
        np.add(guess, codes.radius, out=reach)
        wanted = np.flatnonzero((reach >= least / length[i]) & (guess > -np.inf))
        score = x[wanted] @ q[i]
        if len(wanted) > k:
            # Sums of another order than exact()'s may differ in the last places; what is that near is computed again.
            edge = np.partition(score, len(score) - k)[len(score) - k]
            wanted = wanted[score >= edge - 1e-9 * (abs(edge) + length[i] * norms[wanted])]
        vectors.append(wanted)
        queries.append(np.full(len(wanted), i))
    qi, xi = np.concatenate(queries), np.concatenate(vectors)
    score = np.concatenate([exact(q[qi[i : i + 65536]], x[xi[i : i + 65536]]) for i in range(0, len(qi), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(q)))[qi] < k
    return qi[best], xi[best], score[best]


def build_index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", per_dim: float = 4, seed: int = 5) -> DataFrame:
    """Every usable vector with its code: row (a number of its own), vec_id, vector, dims (its length), code, norm, own.

    Null, empty and zero vectors and those with null or non-finite components take no part. A code has per_dim bits for
    each dimension, in whole words. Nothing is fitted; the rotation depends on the seed and the length alone.
    """
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    v = v.withColumns({"row": F.monotonically_increasing_id(), "dims": F.size("vector")})
    names = ["row", "vec_id", "vector", "dims"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims)) if len(sizes) and (sizes != dims).any() else batch
                packed, norms, own = encode(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), code_bits(dims, per_dim), seed)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(norms), pa.array(own)], [*names, "code", "norm", "own"])

    return cut(v.select(*names).mapInArrow(run, "row long, vec_id long, vector array<double>, dims int, code binary, norm double, own double"))


def search(index: DataFrame, queries: DataFrame, k: int = 20, seed: int = 5, bound: float = 4.0, vector_block: int = 1 << 14, query_block: int = 1 << 14) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (rows of the index), its k nearest other rows of its length.

    Blocks of queries meet blocks of codes in tasks of a bounded size. Ties go to the smaller vec_id; of rows with equal
    vec_id, each is a candidate of its own. Fewer than k candidates: all of them. An empty index gives no rows.
    """
    asking = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("row", "vec_id", "vector", "dims")))
    n, m = index.groupBy("dims").agg(F.count("*").alias("n")), asking.groupBy(F.col("q_dims").alias("dims")).agg(F.count("*").alias("m"))
    # How many blocks the vectors and the queries of a length make: a row for each length.
    cells = n.join(m, "dims").select("dims", F.ceil(F.col("n") / vector_block).cast("int").alias("blocks"), F.ceil(F.col("m") / query_block).cast("int").alias("asks"))
    # The number of the row, not vec_id, deals rows to blocks: a repeated id makes no block larger.
    dealt = lambda row, of: F.pmod(F.xxhash64(row), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = index.join(cells, "dims").withColumns({"block": dealt("row", "blocks"), "asked": every("asks")}).drop("blocks", "asks")
    sizes = cells.select(F.col("dims").alias("q_dims"), "blocks", "asks")
    right = asking.join(sizes, "q_dims").withColumns({"q_asked": dealt("q_row", "asks"), "q_block": every("blocks")}).drop("blocks", "asks")
    schema = "query_row long, query_id long, vec_id long, score double"
    names = ["query_row", "query_id", "vec_id", "score"]

    def run(codes: pa.Table, wanted: pa.Table) -> pa.Table:
        if not codes.num_rows or not wanted.num_rows:
            return pa.table([pa.array([], pa.float64() if c == "score" else pa.int64()) for c in names], names)
        plain = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids, none = codes.column("vec_id").combine_chunks(), np.iinfo(np.int64).max
        packed = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
        qi, xi, score = nearest_in_block(matrix(wanted, "q_vector"), plain(wanted, "q_row"), matrix(codes, "vector"), plain(codes, "row"), ids.fill_null(none).to_numpy(), packed, plain(codes, "norm"), plain(codes, "own"), k, 8 * packed.shape[1], seed, bound)
        return pa.table([wanted.column("q_row").combine_chunks().take(pa.array(qi)), wanted.column("q_vec_id").combine_chunks().take(pa.array(qi)), ids.take(pa.array(xi)), pa.array(score)], names)

    met = left.groupBy("dims", "block", "asked").cogroup(right.groupBy("q_dims", "q_block", "q_asked")).applyInArrow(run, schema)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
