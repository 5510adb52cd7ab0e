"""Quality, Merkle manifest and whitening against plain versions, held-out labels and numpy's eigenvectors."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.llm import merkle_manifest, quality, whitening
from helixframe.llm import queries as Q

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {"tree": "x", "at": 1, "leaf": 0, "n": 2, "score": "s", "__h": 1, "quality": 5, "block": 0, "root": "r"}  # names that operators use


def clashing(df, **more):
    return df.withColumns({k: F.lit(v) for k, v in {**CLASHES, **more}.items()})


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


# Quality


def plain_numbers(text: bytes) -> set[int]:
    """The n-gram numbers of a text, one n-gram at a time."""
    mask, step = (1 << 64) - 1, quality._STEP

    def mixed(x):
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 32)) * 0x94D049BB133111EB) & mask
        return x >> (64 - quality.BITS)

    def grams(codes, salt, lengths):
        for n in lengths:
            for i in range(len(codes) - n + 1):
                x = salt
                for c in codes[i : i + n]:
                    x = (x * step + c + 1) & mask
                yield mixed((x + n) & mask)

    kinds = [0 if b in b" \t\x0b\x0c\r" else 1 if b == 10 else 2 if chr(b).isdigit() and b < 128 else 3 if 65 <= b <= 90 else 4 if 97 <= b <= 122 or b >= 128 else 10 + b for b in text]
    runs = [k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]]
    words = text.split()  # bytes split at the same white space
    codes = [sum((b + 1) * pow(step, i, 1 << 64) for i, b in enumerate(w)) & mask for w in words]
    marks = [next((k for k in range(1, quality.BACK + 1) if i >= k and words[i - k] == w), 0) for i, w in enumerate(words)]
    return {*grams(list(text), *quality.BYTES), *grams(runs, *quality.RUNS), *grams(codes, *quality.WORDS), *grams(marks, *quality.MARKS)}


def some_text(seed, n=120):
    r = random.Random(seed)
    return " \n".join("".join(r.choice("abcXé!7%") for _ in range(r.randint(1, 5))) for _ in range(n)).encode()


def test_ngrams_of_whole_texts():
    for seed in range(6):
        text = some_text(seed)
        assert set(quality.Grams().numbers(text).tolist()) == plain_numbers(text)
        assert set(quality.Grams(150).numbers(text).tolist()) == plain_numbers(text)  # in many pieces
    assert quality.Grams().numbers(b"").tolist() == []
    assert set(quality.Grams().numbers(b"  \n ").tolist()) == plain_numbers(b"  \n ")
    assert len(quality.Grams(100).numbers(b"x" * 1000)) > 0  # a word longer than a piece


def test_ratios_and_dual_coordinate_descent():
    sets = [np.array(x) for x in ([1, 2, 3], [1, 2], [1, 3, 4], [4, 5], [4, 5, 2], [5, 3])]
    good = np.array([True, True, True, False, False, False])
    found = quality.log_count_ratios(sets, good, least=1)
    size = 1 << quality.BITS
    assert found[1] == pytest.approx(np.log((4 / (8 + size)) / (1 / (7 + size))))
    assert found[5] == pytest.approx(np.log((1 / (8 + size)) / (4 / (7 + size))))
    assert found[9] == 0 and quality.log_count_ratios(sets, good)[4] != 0 and quality.log_count_ratios(sets, good, least=4)[4] == 0
    # Primal and dual objectives meet.
    random_ = np.random.default_rng(3)
    x, y, most = random_.normal(size=(40, 6)), np.where(random_.random(40) < 0.5, 1.0, -1.0), np.full(40, 0.7)
    w, bias, duals = quality.dual_coordinate_descent([(np.arange(6), v) for v in x], y, most, 6, epochs=5000, tolerance=1e-9)
    primal = (w @ w + bias**2) / 2 + (most * np.maximum(0, 1 - y * (x @ w + bias))).sum()
    dual = duals.sum() - ((duals * y) @ x @ (x.T @ (duals * y)) + (duals @ y) ** 2) / 2
    assert primal == pytest.approx(dual, abs=1e-5) and (duals >= 0).all() and (duals <= most).all()


def test_quality_of_held_out_texts(spark):
    scored = Q.op11_quality(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    rows = scored.toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows.itertuples())
    held = rows[rows["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() >= 0.95
    assert (held[held["quality"] == 1]["predicted"] == 1).mean() >= 0.97


def test_quality_edges(spark):
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 1), (None, "words that stand", None, None, None), (3, "thon stat " * 30_000, "en", "a", 1), (3, "thon stat " * 30_000, "en", "a", 1), (4, "%% !!", "en", "a", 2)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").withColumn("score", F.lit(1))
    model = quality.train_model(docs, labels)
    out = quality.score_documents(docs, model, ["doc_id"]).toPandas()
    assert len(out) == 6 and out["score"].between(0, 1).all()
    assert out[out["doc_id"].isin([1, 2])]["score"].nunique() == 1 and out[out["doc_id"] == 3]["score"].nunique() == 1
    none = quality.train_model(docs.limit(0), labels)
    assert quality.score_documents(docs, none, ["doc_id"]).toPandas()["score"].tolist() == [0.5] * 6
    assert quality.score_documents(docs.limit(0), none, ["doc_id"]).count() == 0


# Manifest


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_way(levels, at):
    way = []
    for nodes in levels[:-1]:
        start = at - at % 16
        way.append((nodes[start:at], nodes[at + 1 : start + 16]))
        at //= 16
    return way


def plain_manifest(docs):
    """Rows of the manifest of (doc_id, text, lang, source, n_chars) tuples."""
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: h(f(d[0]), f(d[3]), f(d[2]), f(d[4]), f(text))
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for d in docs:
        trees.setdefault(b"" if d[3] is None else b"=" + d[3].encode(), []).append(d)
    names, out = sorted(trees), []
    for name in names:
        trees[name].sort(key=lambda d: ((d[0] is not None, d[0] or 0), leaf(d, d[1])))
    levels = {name: plain_levels([leaf(d, d[1]) for d in trees[name]]) for name in names}
    top = plain_levels([levels[name][-1][0] for name in names])
    for i, name in enumerate(names):
        for at, d in enumerate(trees[name]):
            way = plain_way(levels[name], at) + plain_way(top, i)
            tampered = zlib.crc32(b"" if d[0] is None else str(d[0]).encode()) % 5 == 0
            node = leaf(d, lower(d[1]) if tampered else d[1])
            for left, right in way:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in way for x in left + right))
            out.append((d[0], leaf(d, d[1]), levels[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def same_manifest(found, expected):
    key = lambda r: tuple((x is not None and not pd.isna(x), str(x) if not isinstance(x, float) else str(int(x)) if not pd.isna(x) else "") for x in r)
    assert sorted(map(key, found)) == sorted(map(key, expected))


def manifest_of(docs):
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return merkle_manifest.manifest(merkle_manifest.leaf_table(docs, tampered, merkle_manifest.lower_ascii(F.col("text"))))


def test_manifest_of_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = Q.op12_merkle_manifest(spark, SF)
    assert found.columns == COLUMNS
    rows = [tuple(r) for r in found.collect()]
    same_manifest(rows, plain_manifest(docs))
    assert 0 < sum(not r[6] for r in rows) < len(rows) / 3


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "a": 1}, {"a": 16}, {"a": 17, "b": 257}, {None: 4097, "é": 2, "": 3, **{f"s{i}": 1 for i in range(20)}}])
def test_manifest_shapes(spark, sizes):
    rows = [(i, f"Text {i}", None if i % 7 == 0 else "en", s, None if i % 3 == 0 else i) for s, n in sizes.items() for i in range(n)]
    same_manifest([tuple(r) for r in manifest_of(spark.createDataFrame(rows, DOCS)).collect()], plain_manifest(rows))


def test_manifest_of_a_tree_over_several_blocks_of_blocks(spark):
    rows = [(i, f"T {i % 5}", "en", "hot", i) for i in range(70_000)] + [(i, None, None, "cold", None) for i in range(300)]
    same_manifest([tuple(r) for r in manifest_of(spark.createDataFrame(rows, DOCS).repartition(7)).collect()], plain_manifest(rows))


def test_manifest_edges(spark):
    rows = [(1, None, None, None, None), (None, "A", "en", "a", 1), (None, "A", "en", "a", 1), (5, "", "", "", 0), (5, "", "", "", 0), (6, "ÄÖ Text " * 50_000, "de", "a", 1), (7, "é😀", "x", "a", -3)]
    docs = spark.createDataFrame(rows, DOCS)
    same_manifest([tuple(r) for r in manifest_of(clashing(docs)).collect()], plain_manifest(rows))
    assert manifest_of(docs.limit(0)).count() == 0
    same = [(9, "Same", "en", "a", 4)] * 500  # equal rows are leaves of their own
    same_manifest([tuple(r) for r in manifest_of(spark.createDataFrame(same, DOCS)).collect()], plain_manifest(same))


def test_versions_share_all_but_the_copied_path():
    leaves = [h(str(i)) for i in range(700)]
    tree = merkle_manifest.Tree(leaves, 3)
    before = [list(x) for x in tree.levels]
    changed = leaves[:300] + [h("other")] + leaves[301:]
    assert merkle_manifest.copied_path(h("other"), list(tree.siblings(300))) == [merkle_manifest.Tree(changed, 3).levels[i + 1][300 // 16 ** (i + 1)] for i in range(3)]
    assert tree.levels == before


# Whitening


def plain_whitening(vectors, k=8):
    """vectors: (ident, list). numpy's eigenvectors of the covariance of the exact integers."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = np.floor(1024 * np.array([list(v) + [0.0] * (width - len(v)) for _, v in kept], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)
    return [i for i, _ in kept], n, deviation, y @ u / np.sqrt(np.where(e > 0, e, 1)), e / np.trace(v), e


def same_whitening(rows, vectors, k=8):
    ids, n, deviation, w, shares, e = plain_whitening(vectors, k)
    own = sum(e > 1e-12 * e[0])
    assert len(rows) == len(ids) * own
    signs = {}
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for c in range(own):
        found = np.array([by[i][c + 1]["whitened"] for i in ids])
        signs[c] = np.sign(found @ w[:, c])
        np.testing.assert_allclose(found * signs[c], w[:, c], atol=1e-8)
    for i, d in zip(ids, deviation):
        assert all(r["deviation"] == d and r["n"] == n and r["identity_error"] < 1e-10 for r in by[i].values())
        assert all(abs(by[i][c + 1]["explained"] / shares[c] - 1) < 1e-9 for c in range(own))


def test_whitening_of_given_vectors(spark):
    found = Q.op13_whitening(spark, SF)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same_whitening(found.collect(), vectors)


def test_filter_finds_close_eigenvalues():
    """The iteration alone, among slowly falling values; the passes are counted."""
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(300, 300)))[0]
    values = np.concatenate([[50.0], np.linspace(10, 9, 20), np.linspace(8.5, 0, 279)])
    v, passes = (q * values) @ q.T, []
    found, e, residual = whitening.leading(lambda x: passes.append(1) or v @ x, 300, 8)
    np.testing.assert_allclose(e, values[:8], rtol=1e-12)
    assert np.abs(np.abs((found * q[:, :8]).sum(0)) - 1).max() < 1e-11 and residual <= 1e-11 and len(passes) < 300
    # The polynomial itself: at most 1 on the damped part, 1 at the top after scaling.
    x = np.linspace(0, 9, 50)
    grown = whitening.filtered(lambda y: x[:, None] * y, np.ones((50, 1)), x[:, None] * np.ones((50, 1)), 6, 0.0, 9.0, 50.0)
    scale = np.cosh(6 * np.arccosh((50 - 4.5) / 4.5))
    np.testing.assert_allclose(grown[:, 0] * scale, np.cos(6 * np.arccos(np.clip((x - 4.5) / 4.5, -1, 1))), atol=1e-6)


def test_whitening_in_many_blocks_and_wide(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 70)) @ np.diag(np.linspace(3, 0.2, 70))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(9)
    monkeypatch.setattr(whitening, "DRIVER_NUMBERS", 0)  # Spark adds up the tasks' sums
    same_whitening(whitening.whitened_components(rows).collect(), vectors)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    vectors = [(1, [0.5, -0.25, 1.0]), (2, None), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [0.0, 0.0, 0.0]), (7, [2.0]), (8, []), (9, [0.125, 3.0, -1.0]), (10, [0.5, -0.25, 1.0])]
    rows = clashing(spark.createDataFrame(vectors, schema), ident=1, vector=2, x=3)
    same_whitening(whitening.whitened_components(rows).collect(), vectors, 8)
    assert whitening.whitened_components(rows.limit(0)).count() == 0
    assert whitening.whitened_components(rows.where("vec_id = 1")).count() == 0  # nothing varies
    null = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [0.0, 5.0])], schema)
    found = whitening.whitened_components(null).collect()
    assert len(found) == 3 and {r["component"] for r in found} == {1} and {r["n"] for r in found} == {3}
    with pytest.raises(Exception, match="too large"):
        whitening.whitened_components(spark.createDataFrame([(1, [1e30])], schema)).count()


def test_deviations_beyond_a_long():
    moved = np.array([[3, 4], [1 << 31, 1 << 31], [3_037_000_499, 0], [3_037_000_500, 0]], np.int64)
    assert whitening._squares(moved) == [25, None, 3_037_000_499**2, None]
