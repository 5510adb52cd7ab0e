"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import chat_format, exact_dedup, license_scan, merkle_manifest, mixing, ppm_score, quality, secret_scan, sentencepiece_bpe, simhash_dedup, toxicity, vector_search, whitening
from helixframe.llm.common import crc_mod, table

PIECE_MODEL = os.environ.get("HELIXFRAME_PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = os.environ.get("HELIXFRAME_BYTE_RANKS") or public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and covered licence templates of every document."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts, base = F.col("phrases.start"), F.array_sort(F.array_distinct("phrases.label"))
    labels = F.array_sort(F.array_distinct(F.concat("phrases.label", "spans.label")))
    cover = F.coalesce(F.array_max("spans.cover"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(cover).alias("score"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))[0].select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    coded = sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL, ["doc_id"], decode=True)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    own = spark.sql(r"""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text
                        FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)""")
    rows = table(spark, sf_dir, "conversations").select(*(F.col(c).cast(t) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    formatted = chat_format.format_conversations(rows.unionByName(own), BYTE_RANKS, public_tokenizers.PATTERN)
    return chat_format.read_back(formatted, BYTE_RANKS, public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt without the held-out third of the labels."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    machine = toxicity.train_machine(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    scored = toxicity.score_documents(docs, machine, ["doc_id"])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and PPM log probabilities of every document, learnt without the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = ppm_score.score_documents(docs, crc_mod(F.col("doc_id"), 5) != 1, ["doc_id"])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_dedup.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document: the patterns', and those the random field adds."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan_secrets(docs, secret_scan.train_field(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    index = vector_search.build_index(table(spark, sf_dir, "embeddings"))
    return vector_search.search(index, index.where(F.col("vec_id") % 20 == 0))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt without the held-out fifth of the labels."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = quality.train_model(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    scored = quality.score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest, and the root that its tampered text leads to."""
    docs = table(spark, sf_dir, "documents")
    leaves = merkle_manifest.leaf_table(docs, crc_mod(F.col("doc_id"), 5) == 0, merkle_manifest.lower_ascii(F.col("text")))
    return merkle_manifest.manifest(leaves)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading components, whitened."""
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_ppm_score": op7_ppm_score,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_vector_search": op10_vector_search,
    "op11_quality": op11_quality,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_whitening": op13_whitening,
}

_ESCAPED = r"replace(replace(replace(replace(replace({}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"

#: A field of a leaf, and whether 5 divides the CRC-32 of an id: eight shifts for each byte.
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_FIFTH = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen(id) + 1), lambda i: [256 + ascii(substr(id, i, 1)), 0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: CASE WHEN b >= 256 THEN xor(c, b - 256) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 5 = 0"""
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLE_SQL = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text, coalesce('=' || source, '') AS tree, coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
x AS (SELECT row_number() OVER () AS rid, doc_id, tree, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf, CASE WHEN {_FIFTH} THEN sha256({_HEAD} || {_FIELD.format("lower_text")}) END AS changed FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY tree) AS n FROM x),
nodes AS (SELECT tree, 0 AS level, spot, leaf AS d, n FROM l
  UNION ALL SELECT tree, level + 1, spot // 16, sha256(string_agg(d, '' ORDER BY spot)), (any_value(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, level, spot // 16),
runs AS (SELECT tree, level, spot // 16 AS parent, list(d ORDER BY spot) AS children FROM nodes WHERE n > 1 GROUP BY ALL),
subs AS (SELECT tree, level, d, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, spot, d, n FROM subs
  UNION ALL SELECT level + 1, spot // 16, sha256(string_agg(d, '' ORDER BY spot)), (any_value(n) + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, spot // 16),
top_runs AS (SELECT level, spot // 16 AS parent, list(d ORDER BY spot) AS children FROM tops WHERE n > 1 GROUP BY ALL),
walk AS (SELECT rid, tree, 0 AS level, spot, coalesce(changed, leaf) AS now, '' AS proof FROM l
  UNION ALL SELECT rid, w.tree, w.level + 1, spot // 16, sha256(array_to_string(children[1:spot % 16], '') || now || array_to_string(children[spot % 16 + 2:], '')), proof || array_to_string(children[1:spot % 16], '') || array_to_string(children[spot % 16 + 2:], '')
  FROM walk w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.parent = w.spot // 16),
climb AS (SELECT rid, 0 AS level, s.spot, now, proof FROM walk w JOIN subs s ON s.tree = w.tree AND s.level = w.level
  UNION ALL SELECT rid, w.level + 1, spot // 16, sha256(array_to_string(children[1:spot % 16], '') || now || array_to_string(children[spot % 16 + 2:], '')), proof || array_to_string(children[1:spot % 16], '') || array_to_string(children[spot % 16 + 2:], '')
  FROM climb w JOIN top_runs r ON r.level = w.level AND r.parent = w.spot // 16),
root AS (SELECT level, d FROM tops WHERE n = 1)
SELECT doc_id, leaf, s.d AS subroot, root.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = root.d AS verified
FROM l JOIN subs s USING (tree) JOIN climb USING (rid) JOIN root ON root.level = climb.level""",
    "op10_vector_search": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score FROM ok q JOIN ok x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY body) AS group_size FROM n
  WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM k""",
    "op5_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) + 4 AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
