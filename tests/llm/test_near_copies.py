"""Near copies by wide fingerprints against similarities of all pairs, and the pipeline's stages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import simhash_dedup, toxicity
from helixframe.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(words, share, draw, pool):
    return [draw.choice(pool) if draw.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies():
    """Originals with copies of 1 to 5 % changed words, a chain of copies of copies, a large group, and others."""
    draw = random.Random(12)
    pool = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "bdfgklmnrst"]
    texts = []
    for _ in range(60):
        words = draw.choices(pool, k=draw.randint(60, 400))
        texts.append(words)
        for share in (0.005, 0.01, 0.02, 0.05):
            texts.append(changed(words, share, draw, pool))
    chain = draw.choices(pool, k=300)
    for _ in range(8):
        texts.append(chain)
        chain = changed(chain, 0.02, draw, pool)
    large = draw.choices(pool, k=200)
    texts += [changed(large, 0.01, draw, pool) for _ in range(300)]
    texts += [draw.choices(pool, k=draw.randint(1, 100)) for _ in range(100)] + [[], []]
    docs = [" ".join(t) for t in texts]
    draw.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block, shape", [(2048, None), (60, None), (2048, simhash_dedup.wide_for(512 << 17))])
def test_near_copies_are_the_components_of_similar_pairs(spark, copies, block, shape):
    df = spark.createDataFrame(copies, "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    rows = simhash_dedup.near_copies(df, block=block, shape=shape).collect()
    root = {r["doc_id"]: r["root"]["doc_id"] for r in rows}
    assert len(rows) == len(copies) == len(root)
    sets = {i: shingles(t) for i, t in copies}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = found = 0
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= 0.8:
                pairs += 1
                found += root[i] == root[j]
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert found >= 0.97 * pairs > 1000
    # No group holds what similar pairs don't connect, and its root is its smallest id.
    assert all(find(i) == find(root[i]) and root[i] <= i for i in ids)


def test_near_dedup_stage_keeps_one_of_each_group(spark, copies):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in copies] + [(10_000, None, None, None, None), (None, copies[0][1], "en", "x", 1), (5, copies[5][1], "en", "other", 9)], DOCS)
    kept = corpus_pipeline.near_dedup_stage(spark, df, "").collect()
    texts = dict(copies)
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept}
    assert len(sets) == len(kept) and None not in sets
    ids = sorted(sets)
    assert sum(jaccard(sets[i], sets[j]) >= 0.8 for x, i in enumerate(ids) for j in ids[x + 1 :]) <= 3  # what the search may miss
    dropped = [i for i in texts if i not in sets]
    assert dropped and all(any(jaccard(shingles(texts[i]), s) > 0.3 for s in sets.values()) for i in dropped)


def test_wide_fingerprints_tell_similarity():
    draw = random.Random(3)
    own = simhash_dedup.Shingler(5)
    pool = [f"w{i}" for i in range(3000)]
    for _ in range(20):
        words = draw.choices(pool, k=600)
        other = changed(words, 0.02, draw, pool)
        a, b = (own.wide(" ".join(w).encode()) for w in (words, other))
        distance = sum(x.bit_count() for x in np.bitwise_xor(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tolist())
        cosine = 2 * (j := jaccard(shingles(" ".join(words)), shingles(" ".join(other)))) / (1 + j)
        assert abs(distance - 504 * np.arccos(cosine) / np.pi) < 40
    assert own.wide(b"") == own.wide(b" \n") == bytes(8 * simhash_dedup.Wide().words)
    assert own.wide(b"A b\tC") == own.wide(b"a B c") != own.wide(b"a b d")


def test_wide_keys_grow_with_the_fingerprints(spark):
    """Ten times the fingerprints: no more comparisons for each of them under a key, and as many agreeing segments."""
    assert simhash_dedup.wide_for(0) == simhash_dedup.wide_for(1) == simhash_dedup.wide_for(512 << 14) == simhash_dedup.Wide(14, 9)
    differ = simhash_dedup.DIFFER
    for n in (10**7, 10**8, 10**9, 10**10, 10**11):
        shape = simhash_dedup.wide_for(n)
        assert n / 2**shape.bits <= 512 and shape.segments < 1024
        assert shape.segments * (1 - differ) ** shape.bits >= 36 * (1 - differ) ** 14
    draw = np.random.default_rng(4)
    per_key = []
    for n in (6_000, 60_000):
        shape = simhash_dedup.wide_for(n, members=1)._replace(words=2)
        raw = draw.integers(0, 256, (n, 8 * shape.words), np.uint8).view(shape.kind) & ((1 << shape.bits) - 1)
        prints = spark.createDataFrame([(bytearray(x.astype(shape.kind).tobytes()),) for x in raw], "fp binary")
        counts = simhash_dedup.wide_keys(prints, shape).groupBy("key").count()
        pairs = counts.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
        per_key.append(pairs / n / shape.segments)
    assert max(per_key) <= 0.6  # half a pair for each member at one member a key


def test_session_setting_is_put_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    try:
        for own in ("0", "100", "10000"):
            spark.conf.set(name, own)
            with corpus_pipeline.small_batches(spark):
                assert spark.conf.get(name) == ("100" if own == "100" else str(corpus_pipeline.BATCH_ROWS))
            assert spark.conf.get(name) == own
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_exact_dedup_stage(spark):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "t", 3), (2, "ab", "en", "s", 2), (3, " a  b", "de", None, 5), (4, None, None, None, None), (5, "", "en", "s", 0), (None, "zz", "en", "s", 2), (6, "z z", "en", "s", 3)]
    kept = corpus_pipeline.exact_dedup_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), d is None, d))
    assert Counter(r["doc_id"] for r in kept) == Counter(min(g)[2] for g in groups.values())


def test_toxicity_stage_drops_what_the_query_would_mark(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, docs, sf).collect()}
    machine = toxicity.train_machine(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(machine)
    scores = {r["doc_id"]: scorer.score((r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()}
    assert kept == {d for d, s in scores.items() if s < corpus_pipeline.TOXIC}


def test_mixing_stage_repeats_documents_as_the_mix_takes_them(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in Q.op2_mix_sources(spark, sf).collect()}
    rows = corpus_pipeline.mixing_stage(spark, docs, sf)
    assert rows.columns == docs.columns
    want = {d: (2 * t + n) // (2 * n) for d, (t, n) in taken.items() if n}
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter({d: k for d, k in want.items() if k})


def test_encoding_stage_equals_the_query(spark):
    sf = "/root/testdata/sf0.001"
    stage = corpus_pipeline.encoding_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, stage.select(columns).collect())) == Counter(map(tuple, Q.op4_sentencepiece(spark, sf).select(columns).collect()))


def test_stages_follow_each_other(spark):
    """run() gives what the stages give one after the other, and leaves only the last table that it reads."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert Counter(map(str, docs.collect())) == Counter(map(str, corpus_pipeline.run(spark, sf).collect()))
