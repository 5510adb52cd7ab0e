"""Encoding and decoding with a SentencePiece merge model.

The encoder never runs the merges over a text. It walks the text with the longest vocabulary match at each place
(Aho-Corasick), keeps a token only if it is compatible with the token before it, and steps back to a shorter match
where none fits; places from which no encoding reaches the end are marked in a bitfield and not tried again. Two
adjacent tokens are compatible if merging their joined characters gives the same two tokens, and a sequence whose
neighbours are all compatible is what the merges over the whole would give. A text is first cut where no piece of the
model reaches across (checked against all pieces), as between letters and a space or comma, so that words are encoded
one by one and kept in a bounded cache.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import SLICE_BYTES

SPACE = "▁"
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Runs of Latin letters and runs of other characters, with the space marks before them.
CHUNK = re.compile(f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}]+|{SPACE}+")
#: For models with pieces that mix letters and other characters.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Entries of each generation of a worker's word cache (there are two), and the longest word that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 80_000, 48
#: Entries of a worker's table of compatible pairs.
PAIR_ENTRIES = 200_000
#: Tokens from here on are characters without a piece; the model writes them as bytes.
OTHER = 1 << 19


class MergeEncoder:
    """Encoder of a merge model that writes unknown characters as bytes (others are an error). Pieces that a model's
    users have defined count as any other piece here, while the library takes them whole before it merges."""

    def __init__(self, model_path: str):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._rank: dict[str, float] = {}
        self._id: dict[str, int] = {}
        self._byte: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self._byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self._rank[piece], self._id[piece] = sp.get_score(i), i
        if len(self._byte) != 256:
            raise ValueError("the model must write unknown characters as bytes")
        self._chunk = next((r for r in (CHUNK, WORD) if all(map(r.fullmatch, self._id))), re.compile("(?s).+"))
        self._automaton = ahocorasick.Automaton()
        for piece in self._id:
            if len(piece) > 1 and self.merge(piece) == [piece]:  # a piece that the merges never make is never a token
                self._automaton.add_word(piece, (len(piece), self._id[piece]))
        self._automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The merges themselves, over a few characters: best score first, leftmost of equals."""
        parts, rank = list(text), self._rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def tokens(self, chunk: str) -> list[int]:
        """The tokens of one word with the space marks before it, by backtracking: piece ids, or OTHER + code point."""
        n, ids, pairs = len(chunk), self._id, self._pairs
        options = [[(i + 1) << 21 | (ids.get(c) or OTHER + ord(c))] for i, c in enumerate(chunk)]  # from each place: end and token, shortest first
        for last, (size, token) in self._automaton.iter(chunk):
            options[last + 1 - size].append((last + 1) << 21 | token)
        failed = bytearray(n // 8 + 1)
        starts, tokens = [0], [-1]  # the stack: where each token begins, and the token before it
        at, before = 0, -1
        while True:
            untried = options[at]
            while untried:
                option = untried.pop()
                end = option >> 21
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                token = option & 0x1FFFFF
                if before >= 0:
                    fits = pairs.get(before << 21 | token)
                    if fits is None:
                        if len(pairs) >= PAIR_ENTRIES:
                            pairs.clear()
                        fits = pairs[before << 21 | token] = self.compatible(chunk[starts[-2] : at], chunk[at:end])
                    if not fits:
                        continue
                tokens.append(token)
                if end == n:
                    return tokens[1:]
                starts.append(end)
                at, before = end, token
                break
            else:  # the encoding of what lies before a place is unique, so a place that fails once fails for good
                failed[at >> 3] |= 1 << (at & 7)
                starts.pop()
                tokens.pop()
                if not starts:  # no sequence of compatible tokens, which pieces of equal rank might cause
                    return [ids.get(x) or OTHER + ord(x) for x in self.merge(chunk)]
                at, before = starts[-1], tokens[-1]

    def chunk_ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for token in self.tokens(chunk):
            if token < OTHER:
                ids.append(token)
            else:
                ids.extend(self._byte[b] for b in chr(token - OTHER).encode())
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        young = self._young
        out = []
        for chunk in self._chunk.findall(self.processor.normalize(text)):
            ids = young.get(chunk)
            if ids is None:
                ids = self._old.get(chunk) or self.chunk_ids(chunk)
                if len(chunk) <= CACHE_CHARS:
                    if len(young) >= CACHE_ENTRIES:
                        self._old, self._young = young, {}
                        young = self._young
                    young[chunk] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(model_path: str) -> MergeEncoder:
    return MergeEncoder(model_path)


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about SLICE_BYTES of text, so that ids and decoded texts of a part fit a small worker."""
    start, size, texts = 0, 0, []
    for i, x in enumerate(batch.column(column).to_pylist()):
        texts.append(x or "")
        size += len(texts[-1])
        if size >= SLICE_BYTES // 4:
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(start), texts


def encode_documents(docs: DataFrame, model_path: str, keep: list[str], text: str = "text", add_bos: bool = False, add_eos: bool = True, decode: bool = False) -> DataFrame:
    """Columns `keep` with `ids` array<int> of the whole text, and with `decoded` string if decode.

    Null and empty texts have only the added ids. Rows are independent: repeated rows, null ids and clashing extra
    columns (only `keep` and the text are read) change nothing. Memory is bounded by the longest text.
    """
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    fields = [*source.schema.fields[:-1]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>" + (", decoded string" if decode else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        sp = own.processor
        head = np.array([sp.bos_id()] if add_bos else [], np.int32).tobytes()
        tail = np.array([sp.eos_id()] if add_eos else [], np.int32).tobytes()
        for batch in batches:
            for part, texts in _pieces(batch, "__text"):
                packed = [head + own.encode(x) + tail for x in texts]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                values = np.frombuffer(b"".join(packed), np.int32)
                columns = [part.column(i) for i in range(len(fields))]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                if decode:
                    columns.append(pa.array([sp.decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "ids", *(["decoded"] if decode else [])])

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns `keep` with `decoded`, the text of each row's ids (null: empty text)."""
    source = encoded.select(*[F.col(c) for c in keep], F.col(ids).alias("__ids"))
    fields = [*source.schema.fields[:-1]]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = encoder(model_path).processor
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [sp.decode(x or []) for x in part.column(len(fields)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(fields))), pa.array(texts, pa.string())], [*(f.name for f in fields), "decoded"])

    return source.mapInArrow(run, schema)
