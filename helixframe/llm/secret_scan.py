"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags the words of a line as the beginning of a secret, its inside, or outside, from the word's shape, the
words beside it and features of the file; tags are decoded by Viterbi. A line where no word favours a secret over
outside by more than any transition could cost is outside throughout, so only the other lines are decoded.

It is trained here, on a bounded sample of windows of words: some with secrets that the fixed patterns name, some
without, and some of the latter with a made-up secret of another kind put in, with no word beside it to give it away, or
with a made-up harmless word of many characters. The word's own letters are no feature, only which are vowels, so the
field tells random strings from words and finds secrets that no pattern names. How sure it must be is set on windows
without secrets that it was not trained on.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cut, text_slices

# The patterns and the least length of what they must match.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")

LONG_HEX = re.compile(rb"[0-9a-f]{24,}")  # what HEX keeps: its matches are maximal runs
KEYWORDS = (b"passw", b"secret", b"token", b"api")
#: Words, the signs that assign, and the end of a line.
TOKEN = re.compile(rb"[A-Za-z0-9+/_.\x80-\xff-]+|[=:\n]")
#: Maps a text to the classes of its characters: digits, vowels and consonants of either case, joining signs, others.
CLASSES = bytes(48 if 48 <= b <= 57 else (101 if b in b"aeiouy" else 97) if 97 <= b <= 122 else (69 if b in b"AEIOUY" else 65) if 65 <= b <= 90 else 45 if b in b"+/_.-" else 0x80 if b >= 0x80 else b for b in range(256))
#: Maps classes to digits, lower case, upper case and others.
KIND = bytes(97 if b == 101 else 65 if b == 69 else b for b in range(256))
RUNS = re.compile(rb"[aeAE\x80]+")
CONSONANTS = re.compile(rb"[aA]+")
B_TAG, I_TAG, O_TAG = 0, 1, 2
BUCKETS = 1 << 12


def base_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), in bytes, leftmost and not overlapping in each kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


@lru_cache(maxsize=1 << 14)
def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) % BUCKETS


def shape(classes: bytes) -> tuple[str, ...]:
    """Features of a word's shape: length, classes of its characters, how often they change, and how far its letters
    could be said aloud."""
    n, kinds = len(classes), classes.translate(KIND)
    digits, lower, upper, other = (kinds.count(c) for c in (b"0", b"a", b"A", b"-"))
    changes = sum(x != y for x, y in zip(kinds, kinds[1:]))
    size = n if n < 12 else 12 + min(4, (n - 12) // 6)
    mix = f"{digits > 0}{lower > 0}{upper > 0}"
    letters = max(1, n - digits - other)
    vowels = 4 * (classes.count(b"e") + classes.count(b"E") + classes.count(b"\x80") // 2) // letters
    longest = max(map(len, RUNS.findall(classes)), default=0)
    hard = min(6, max(map(len, CONSONANTS.findall(classes)), default=0))
    large = min(3, n // 6)
    return (
        f"n{size}",
        f"mix{mix}",
        f"n{size // 4}mix{mix}",
        f"chg{min(6, changes // 2)}d{4 * digits // max(n, 1)}",
        f"n{size // 4}chg{min(6, changes // 2)}",
        f"asc{classes.isascii()}o{min(other, 3)}s{classes[:1] in b'=:'}",
        f"big{large}v{vowels}h{hard}",
        f"big{large}run{min(3, 4 * longest // max(n, 1))}mix{mix}",
        f"big{large}per{min(7, 10 * changes // max(n, 1))}o{min(other, 3)}",
    )


def own_features(classes: bytes) -> list[int]:
    return [_hash(f"w:{x}") for x in shape(classes)]


def side_features(token: bytes, classes: bytes, side: str, words: dict[bytes, int]) -> list[int]:
    """What a neighbour tells: itself if it is one of the words of the sample, its length and classes otherwise."""
    if token == b"\n":
        return [_hash(f"{side}:end")]
    return [_hash(f"{side}:{token.hex() if token in words else '|'.join(shape(classes)[:2])}")]


@dataclass
class Field:
    """Weights: features by tag, tag to tag, and the first tag; the words that count as themselves beside a secret; what
    a word outside is given beforehand."""

    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    words: dict[bytes, int]
    doubt: float = 0.0


def file_features(text: bytes) -> list[int]:
    """Features of the whole text: its size and lines, its shares of digits and of signs as code has them, and whether
    it speaks of secrets."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    share = lambda signs: int(min(4, np.ceil(8 * counts[list(signs)].sum() / n)))
    low = text.lower()
    return [_hash(f"f:{min(6, len(text).bit_length() // 3)}{counts[10] > 0}"), _hash(f"fd{share(b'0123456789')}"), _hash(f"fs{share(b'{}()[];=<>_#$')}"), _hash(f"fk{any(k in low for k in KEYWORDS)}")]


def viterbi(emissions: np.ndarray, trans: np.ndarray, first: np.ndarray) -> list[int]:
    """The best tags of a line; a secret can't start with its inside."""
    rows, move = emissions.tolist(), trans.tolist()
    score = [rows[0][t] + first[t] for t in range(3)]
    back = []
    for row in rows[1:]:
        came = [max(range(3), key=lambda p, t=t: score[p] + move[p][t]) for t in range(3)]
        score = [score[came[t]] + move[came[t]][t] + row[t] for t in range(3)]
        back.append(came)
    tag = max(range(3), key=score.__getitem__)
    tags = [tag]
    for came in reversed(back):
        tag = came[tag]
        tags.append(tag)
    return tags[::-1]


def line_features(tokens: list[bytes], about: list[int], words: dict[bytes, int]) -> list[list[int]]:
    classes = [t.translate(CLASSES) for t in tokens]
    edged, shapes = [b"\n", *tokens, b"\n"], [b"\n", *classes, b"\n"]
    return [own_features(classes[i]) + about + side_features(edged[i], shapes[i], "p", words) + side_features(edged[i + 2], shapes[i + 2], "n", words) for i in range(len(tokens))]


def train(lines: list[tuple[list[list[int]], list[int]]], words: dict[bytes, int], epochs: int = 8, rate: float = 0.2, decay: float = 1e-4, batch: int = 16) -> Field:
    """Weights of greatest conditional likelihood, by adaptive gradient steps over batches of lines of (features of each
    word, as many for each, and tags)."""
    weights, trans, first = np.zeros((BUCKETS + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    first[I_TAG] = trans[O_TAG, I_TAG] = -1e3
    if not lines:
        return Field(weights[:BUCKETS], trans, first, words, 1e3)
    gw, gt, gf = np.full((BUCKETS + 1, 3), 1e-2), np.full((3, 3), 1e-2), np.full(3, 1e-2)
    sizes = np.array([len(tags) for _, tags in lines])
    longest, width = sizes.max(), len(lines[0][0][0])
    features, tags = np.full((len(lines), longest, width), BUCKETS), np.full((len(lines), longest), O_TAG)
    for i, (own, marks) in enumerate(lines):
        features[i, : len(marks)], tags[i, : len(marks)] = own, marks
    one = np.eye(3)
    order = np.random.default_rng(7)
    total = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for _ in range(epochs):
        drawn = order.permutation(len(lines))
        for at in range(0, len(drawn), batch):
            rows = drawn[at : at + batch]
            n, f, y = sizes[rows], features[rows], tags[rows]
            longest = n.max()
            inside = np.arange(longest)[None, :] < n[:, None]
            e = weights[f[:, :longest]].sum(2)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = first + e[:, 0]
            for i in range(1, longest):
                alpha[:, i] = np.where(inside[:, i, None], total(alpha[:, i - 1, :, None] + trans, 1) + e[:, i], alpha[:, i - 1])
            for i in range(longest - 2, -1, -1):
                beta[:, i] = np.where(inside[:, i + 1, None], total(trans + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
            z = total(alpha[:, -1], 1)
            error = (np.exp(alpha + beta - z[:, None, None]) - one[y[:, :longest]]) * inside[:, :, None]
            steps = inside[:, 1:, None, None]
            both = np.where(steps, np.exp(np.minimum(0, alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])), 0.0)
            moves = both.sum((0, 1)) - (one[y[:, : longest - 1]][:, :, :, None] * one[y[:, 1:longest]][:, :, None, :] * steps).sum((0, 1))
            ids = f[:, :longest].ravel()
            g = np.stack([np.bincount(ids, np.repeat(error[:, :, t].ravel(), width), BUCKETS + 1) for t in range(3)], axis=1)
            touched = np.flatnonzero(np.abs(g).max(1) > 1e-6)
            touched = touched[touched < BUCKETS]
            step = g[touched] + decay * weights[touched]
            gw[touched] += step * step
            weights[touched] -= rate * step / np.sqrt(gw[touched])
            gt += moves * moves
            trans -= rate * moves / np.sqrt(gt)
            start = error[:, 0].sum(0)
            gf += start * start
            first -= rate * start / np.sqrt(gf)
            first[I_TAG] = trans[O_TAG, I_TAG] = -1e3
    return Field(weights[:BUCKETS], trans, first, words)


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _drawn(draw: np.random.Generator, alphabet: str, least: int, most: int) -> str:
    return "".join(alphabet[i] for i in draw.integers(0, len(alphabet), draw.integers(least, most + 1)))


#: Kinds of secrets that windows are given in training: makers from a random generator.
MADE_SECRETS = {
    "letters": lambda d: _drawn(d, LETTERS + LETTERS.upper() + DIGITS, 16, 48),
    "prefixed": lambda d: f"{_drawn(d, LETTERS, 2, 5)}{'_-'[d.integers(2)]}{_drawn(d, LETTERS + LETTERS.upper() + DIGITS, 16, 40)}",
    "groups": lambda d: "-".join(_drawn(d, (LETTERS.upper() if d.integers(2) else LETTERS + LETTERS.upper()) + DIGITS, 4, 8) for _ in range(d.integers(3, 6))),
    "base64": lambda d: _drawn(d, LETTERS + LETTERS.upper() + DIGITS + "+/", 24, 60),
    "upper": lambda d: _drawn(d, LETTERS.upper() + "234567", 16, 40),
    "lower": lambda d: _drawn(d, LETTERS + DIGITS, 18, 40),
    "parts": lambda d: ".".join(_drawn(d, LETTERS + LETTERS.upper() + DIGITS + "_", 12, 40) for _ in range(3)),
}


def made_harmless(draw: np.random.Generator, words: list[str]) -> str:
    """A word that isn't a secret, though it is long or mixed: numbers, dates, versions, names of files and of things."""
    word = lambda: words[draw.integers(len(words))] if words else "word"
    number = lambda a, b: _drawn(draw, DIGITS, a, b)
    kind = draw.integers(8)
    if kind == 0:
        return number(4, 20)
    if kind == 1:
        return "-".join(number(2, 4) for _ in range(draw.integers(2, 5)))
    if kind == 2:
        return f"{number(4, 4)}-{number(2, 2)}-{number(2, 2)}T{number(2, 2)}.{number(2, 2)}Z"
    if kind == 3:
        return "/".join(word() for _ in range(draw.integers(2, 6))) + (f"/{number(1, 4)}" if draw.integers(2) else ".html")
    if kind == 4:
        return "_-."[draw.integers(3)].join(word() for _ in range(draw.integers(2, 5))) + (number(1, 4) if draw.integers(2) else "")
    if kind == 5:
        return "".join(word().capitalize() for _ in range(draw.integers(2, 5))) + (number(1, 3) if draw.integers(3) == 0 else "")
    if kind == 6:
        return f"v{number(1, 2)}.{number(1, 2)}.{number(1, 3)}" + (f"-{word()}{number(1, 2)}" if draw.integers(2) else "")
    return f"{word()}{number(1, 6)}" if draw.integers(2) else "".join(word() for _ in range(draw.integers(2, 4))).upper()


Window = tuple[list[int], list[bytes], list[int]]


def tagged_windows(texts: list[bytes], most: int, window: int = 24, kinds: tuple[int, ...] = (0, 1, 2)) -> tuple[list[Window], list[Window]]:
    """Windows of words as (file features, words, tags): at most `most` with a secret of the patterns `kinds`, as many without.

    Of all windows of all texts, those with the smallest hashes of (text, number of the window), whatever their content.
    Windows with a secret of another pattern are in neither.
    """
    held: list[tuple[int, int, int]] = []  # heaps of (negative hash, text, first word)
    others: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        own = xxhash.xxh64_intdigest(text)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        for at in range(0, len(tokens), window):
            lo, hi = tokens[at][0], tokens[min(at + window, len(tokens)) - 1][1]
            found = {k for _, k, end, s in spans if s < hi and end > lo}
            if found - set(kinds):
                continue
            kept = held if found else others
            drawn = -xxhash.xxh64_intdigest(struct.pack("<QQ", own, at // window)), i, at
            if len(kept) < most:
                heapq.heappush(kept, drawn)
            else:
                heapq.heappushpop(kept, drawn)

    def tagged(i: int, at: int) -> Window:
        text = texts[i]
        secrets = [(s, end) for _, k, end, s in base_spans(text) if k in kinds]
        part = [(m.start(), m.group()) for m in TOKEN.finditer(text)][at : at + window]
        tags, before = [], None
        for start, token in part:
            own = next((s for s in secrets if start < s[1] and start + len(token) > s[0]), None)
            tags.append(O_TAG if own is None else I_TAG if own == before else B_TAG)
            before = own
        return file_features(text), [t for _, t in part], tags

    return tuple([tagged(i, at) for _, i, at in sorted(kept, reverse=True)] for kept in (held, others))


def planted(window: Window, put: str, tag: int, at: int) -> Window:
    """The window with a word, or a few that the token pattern makes of it, in front of word `at`."""
    about, tokens, tags = window
    new = TOKEN.findall(put.encode())
    marks = [tag if i == 0 or tag == O_TAG else I_TAG for i in range(len(new))]
    return about, tokens[:at] + new + tokens[at:], tags[:at] + marks + tags[at:]


def train_on(texts: list[bytes], sample_lines: int = 1500, kinds: tuple[int, ...] = (0, 1, 2), made: tuple[str, ...] = tuple(MADE_SECRETS), seed: int = 7) -> Field:
    """A field learnt from windows of texts: those with secrets of the patterns `kinds`, those without, and the latter
    again with made-up secrets of the kinds `made`, and with harmless words. A fifth of the windows without secrets, bare
    and with harmless words, only sets how sure the field must be."""
    held, clean = tagged_windows(texts, sample_lines, kinds=kinds)
    draw = np.random.default_rng(seed)
    counts = Counter(t for _, part, _ in held + clean for t in part if len(t) <= 12 and not any(48 <= b <= 57 for b in t))
    words = {t: i for i, t in enumerate(sorted(t for t, n in counts.items() if n >= 4 and t != b"\n"))}
    plain = sorted(t.decode("ascii", "ignore") for t in words if t.isalpha() and t.isascii())
    place = lambda w: int(draw.integers(0, len(w[1]) + 1))
    harmless = [planted(w, made_harmless(draw, plain), O_TAG, place(w)) for w in clean]
    secret = [planted(w, MADE_SECRETS[made[draw.integers(len(made))]](draw), B_TAG, place(w)) for w in clean] if made else []
    tested = len(clean) // 5
    lines = lambda windows: [(line_features(part, about, words), tags) for about, part, tags in windows]
    field = train(lines(held + clean[tested:] + harmless[tested:] + secret[tested:]), words)
    # How far the best tags of a window without secrets lie above outside throughout, for each word they mark.
    for features, tags in lines(clean[:tested] + harmless[:tested]):
        e = np.array([field.weights[f].sum(0) for f in features])
        e[:, O_TAG] += field.doubt
        while field.doubt < 20 and any(t != O_TAG for t in viterbi(e, field.trans, field.first)):
            field.doubt += 0.25
            e[:, O_TAG] += 0.25
    # That is the worst of these windows; most of it is kept as the distance for the words of all texts.
    field.doubt *= 0.75
    return field


def train_field(docs: DataFrame, text: str = "text", sample_docs: int = 1500, sample_bytes: int = 20_000, sample_lines: int = 1500) -> Field:
    """Trains on a bounded sample: sample_docs texts of up to sample_bytes with a mark of a secret, as many of any sort,
    and sample_lines windows with and without secrets. Texts and windows are drawn by a hash, so that reruns agree.
    """
    column = F.col(text)
    low = F.lower(column)
    mark = F.lit(False)
    for word in ("akia", "passw", "secret", "token", "api"):
        mark |= low.contains(word)
    usable = docs.where(column.isNotNull() & (F.octet_length(column) <= sample_bytes)).select(column.alias("text"), F.xxhash64(column).alias("h"), mark.alias("mark"))
    # The hashes come first, so that a task hands on numbers, not texts that are not drawn.
    drawn = cut(usable.select("h", "mark").distinct())
    last = [drawn.where(c).select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0] for c in ("mark", "true")]
    inside = [(F.col("mark") if i == 0 else F.lit(True)) & (F.col("h") <= h) for i, h in enumerate(last) if h is not None]
    if not inside:
        return train_on([])
    rows = usable.where(inside[0] | inside[-1]).groupBy("h").agg(F.min("text").alias("text")).collect()  # at most twice sample_docs
    return train_on(sorted(r["text"].encode() for r in rows), sample_lines)


class Tagger:
    """Tags whole texts. What a word adds to its own place and its neighbours' depends on its classes, or on the word if
    the sample held it, and is kept by these.
    """

    KEEP = 200_000

    def __init__(self, field: Field):
        self.field = field
        self.shapes: dict[bytes, int] = {}
        self.scores = np.zeros((1024, 9))  # of a shape: at its own place, at the next place, at the place before
        w = field.weights
        self.sides = np.zeros((len(field.words), 6))
        for word, at in field.words.items():
            self.sides[at] = np.concatenate([w[side_features(word, b"", side, field.words)].sum(0) for side in "pn"])
        out = field.trans[O_TAG, O_TAG]
        into = max(field.trans[O_TAG, B_TAG], field.trans[:2, :2].max(), field.first[B_TAG] - field.first[O_TAG] + out) - out
        #: The most that a word tagged as a secret gains by its transitions over staying outside.
        self.gain = max(0.0, float(into)) + max(0.0, float(field.trans[:2, O_TAG].max() - out))

    def _add(self, classes: bytes) -> int:
        at = self.shapes[classes] = len(self.shapes)
        if at >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        w, features = self.field.weights, shape(classes)
        about = "end" if classes == b"\n" else "|".join(features[:2])
        self.scores[at] = np.concatenate([w[[_hash(f"w:{x}") for x in features]].sum(0), *(w[_hash(f"{side}:{about}")] for side in "pn")])
        if classes == b"\n":
            self.scores[at, :3] = [-1e3, -1e3, 0]
        return at

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Secrets of a text, in bytes."""
        words = TOKEN.findall(text)
        if not words:
            return []
        if len(self.shapes) > self.KEEP:
            self.shapes.clear()
        end = self.shapes.get(b"\n")
        if end is None:
            end = self._add(b"\n")
        get = self.shapes.get
        ids = np.fromiter((i if (i := get(t)) is not None else self._add(t) for t in TOKEN.findall(text.translate(CLASSES))), np.int64, len(words))
        known = np.fromiter(map(self.field.words.get, words, repeat(-1)), np.int64, len(words))
        scores = self.scores[ids]
        at = np.flatnonzero(known >= 0)
        scores[at, 3:] = self.sides[known[at]]
        e = scores[:, :3] + self.field.weights[file_features(text)].sum(0)
        e[:, O_TAG] += self.field.doubt
        e[1:] += scores[:-1, 3:6]
        e[0] += self.scores[end, 3:6]
        e[:-1] += scores[1:, 6:9]
        e[-1] += self.scores[end, 6:9]
        hot = np.flatnonzero(np.maximum(e[:, B_TAG], e[:, I_TAG]) - e[:, O_TAG] + self.gain > 0)
        if not len(hot):
            return []
        heads = np.concatenate([[0], np.flatnonzero(ids == end) + 1])
        heads = heads[heads < len(words)]
        places = [m.span() for m in TOKEN.finditer(text)]
        found = []
        for line in np.unique(np.searchsorted(heads, hot, side="right") - 1).tolist():
            a, b = int(heads[line]), int(heads[line + 1]) if line + 1 < len(heads) else len(words)
            open_at = None
            for i, tag in enumerate([*viterbi(e[a:b], self.field.trans, self.field.first), O_TAG], a):
                if open_at is not None and tag != I_TAG:
                    found.append((places[open_at][0], places[i - 1][1]))
                    open_at = None
                if tag == B_TAG:
                    open_at = i
        return found


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of taken (start, kind, end), which are sorted."""
    starts = [t[0] for t in taken]
    ends = list(accumulate((t[2] for t in taken), max))
    return [(s, e) for s, e in spans if not (n := bisect_left(starts, e)) or ends[n - 1] <= s]


def scan_secrets(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end>> in code points, by start, then kind.

    Pattern spans always stay; the field adds those that overlap none of them, with kind crf. Null and empty texts have
    no spans; repeated rows and null ids are kept; only the two named columns are read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)  # BUCKETS x 3 weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for part, texts in text_slices(batch):
                rows = []
                for x in texts:
                    spans = [(s, k, e) for s, k, e, _ in base_spans(x)]
                    spans = sorted(spans + [(s, 3, e) for s, e in apart(tagger.spans(x), spans)])
                    if spans and not x.isascii():
                        where = {}
                        at, points = 0, 0
                        for p in sorted({p for s, _, e in spans for p in (s, e)}):
                            points += len(x[at:p].decode("utf-8", "replace"))
                            at, where[p] = p, points
                        spans = [(where[s], k, where[e]) for s, k, e in spans]
                    rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
