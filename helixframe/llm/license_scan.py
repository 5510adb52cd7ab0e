"""Licence scans: templates in one generalised suffix automaton over words; documents are streamed through it.

Every document word moves the automaton, which gives the matching statistics: the length of the longest piece of any
template that ends at that word, and the state that tells where in the templates it stands. Maximal matches of at
least `min_match` words become anchors; anchors of one template that follow each other in both texts, with gaps of
at most `max_gap` words, are chained. A chain that covers at least `min_cover` of a template is a span with the
template's label. Short phrases are templates too and count where they match in full.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import text_slices

# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Common licence notices and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission"),
)

#: Maps bytes to lower case, and all that are not part of a word to a space.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a UTF-8 text."""
    return text.translate(WORD_BYTES).split()


class TokenAutomaton:
    """Generalised suffix automaton of the templates and phrases, over word numbers.

    A state with one move keeps it in two arrays, others have a dict. A place (template, end) is kept once, at the state of
    the template's words up to it; places are in an order in which those of a state's subtree of links stand together, so a
    state's places are a range.
    """

    def __init__(self, templates: tuple = TEMPLATES, phrases: tuple = PHRASES):
        self.words: dict[bytes, int] = {}
        self.token, self.target, self.more = array("i", [-2]), array("i", [0]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.labels = [label for label, _ in templates]
        self.sizes: list[int] = []
        own = array("i"), array("i"), array("i"), array("i")  # state, template, end, the word that follows (or -2)
        for t, (_, text) in enumerate(templates):
            tokens = [self._number(w) for w in words_of(text.encode())]
            self.sizes.append(len(tokens))
            for end, (state, after) in enumerate(zip(self._add(tokens), [*tokens[1:], -2]), 1):
                for x, v in zip(own, (state, t, end, after)):
                    x.append(v)
        self.phrases = [([self._number(w) for w in words_of(text.encode())], label) for text, label in phrases]
        for tokens, _ in self.phrases:
            for _ in self._add(tokens):
                pass
        self.shortest = min(self.sizes, default=1 << 30)
        self._arrange(*(np.array(x, np.int32) for x in own))
        self.ends: dict[int, list[int]] = {}
        for p, (tokens, _) in enumerate(self.phrases):
            self.ends.setdefault(self._walk(tokens), []).append(p)
        # The next state up the links at which a phrase ends, itself included; 0: none.
        self.phrase_up = array("i", bytes(4 * len(self.length)))
        for state in self.by_length:
            if state:
                self.phrase_up[state] = state if state in self.ends else self.phrase_up[self.link[state]]
        del self.by_length

    def _arrange(self, state: np.ndarray, template: np.ndarray, end: np.ndarray, after: np.ndarray) -> None:
        """Puts the places in order: first[s] to first[s] + size[s] are those of s and all states below it."""
        n = len(self.length)
        self.by_length = np.argsort(np.array(self.length, np.int32), kind="stable").tolist()
        counts = np.bincount(state, minlength=n).tolist()
        size = array("i", counts)
        for s in reversed(self.by_length):
            if s:
                size[self.link[s]] += size[s]
        first, free = array("i", bytes(4 * n)), array("i", bytes(4 * n))
        for s in self.by_length:
            if s:
                up = self.link[s]
                first[s] = free[up]
                free[up] += size[s]
            free[s] = first[s] + counts[s]
        order = np.empty(len(state), np.int64)
        by_state = np.argsort(state, kind="stable")
        sorted_states = state[by_state]
        within = np.arange(len(state)) - np.searchsorted(sorted_states, sorted_states)
        order[np.array(first, np.int64)[sorted_states] + within] = by_state
        self.first, self.size = first, size
        self.place_template, self.place_end, self.place_after = template[order], end[order], after[order]

    def _number(self, word: bytes) -> int:
        return self.words.setdefault(word, len(self.words))

    def move(self, at: int, token: int) -> int:
        """The state that a word leads to, or -1."""
        many = self.more.get(at)
        if many is not None:
            return many.get(token, -1)
        return self.target[at] if self.token[at] == token else -1

    def _set(self, at: int, token: int, target: int) -> None:
        many = self.more.get(at)
        if many is not None:
            many[token] = target
        elif self.token[at] in (-2, token):
            self.token[at], self.target[at] = token, target
        else:
            self.more[at] = {self.token[at]: self.target[at], token: target}

    def _state(self, length: int, link: int) -> int:
        for x, v in ((self.token, -2), (self.target, 0), (self.length, length), (self.link, link)):
            x.append(v)
        return len(self.length) - 1

    def _split(self, at: int, token: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[target])
        self.token[copy], self.target[copy] = self.token[target], self.target[target]
        if target in self.more:
            self.more[copy] = dict(self.more[target])
        self.link[target] = copy
        while at >= 0 and self.move(at, token) == target:
            self._set(at, token, copy)
            at = self.link[at]
        return copy

    def _add(self, tokens: list[int]) -> Iterator[int]:
        """Adds a text; gives the state of each of its prefixes, which stays that prefix's state."""
        last = 0
        for token in tokens:
            at, target = last, self.move(last, token)
            if target >= 0:
                last = target if self.length[target] == self.length[at] + 1 else self._split(at, token, target)
            else:
                own = self._state(self.length[last] + 1, 0)
                while at >= 0 and self.move(at, token) < 0:
                    self._set(at, token, own)
                    at = self.link[at]
                if at >= 0:
                    target = self.move(at, token)
                    self.link[own] = target if self.length[target] == self.length[at] + 1 else self._split(at, token, target)
                last = own
            yield last

    def _walk(self, tokens: list[int]) -> int:
        at = 0
        for token in tokens:
            at = self.move(at, token)
        return at

    def places(self, state: int) -> set[tuple[int, int]]:
        """(template, end) of all places where what the state stands for ends."""
        own = slice(self.first[state], self.first[state] + self.size[state])
        return set(zip(self.place_template[own].tolist(), self.place_end[own].tolist()))

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """For each word (its number, or -1): the length of the longest match that ends there, and its state."""
        at, length = 0, 0
        for token in ids:
            to = self.move(at, token)
            while at and to < 0:
                at = self.link[at]
                length = self.length[at]
                to = self.move(at, token)
            if to >= 0:
                at = to
                length += 1
            yield length, at

    def scan(self, ids: list[int], start: int, min_match: int, anchors: dict[int, list[tuple[int, int, int]]], bases: list[tuple[int, int]]) -> None:
        """Adds maximal matches to anchors (by template: end in the text, end in the template, length) and phrases to bases (start, phrase).

        A match is maximal at a place of a template if the template goes on otherwise there than the text. The longest match
        stands at the places of its state; shorter ones at those that the states up its links have besides. Matches of fewer
        than min_match words count where they are a whole template.
        """
        least = min(min_match, self.shortest)
        for i, (length, state) in enumerate(self.stream(ids), start):
            follows = ids[i + 1 - start] if i + 1 - start < len(ids) else -1
            at, long, below = state, length, (0, 0)
            while long >= least:
                a, b = self.first[at], self.first[at] + self.size[at]
                for x, y in ((a, below[0]), (below[1], b)) if below[1] else ((a, b),):
                    if x < y:
                        for k in (x + np.flatnonzero(self.place_after[x:y] != follows)).tolist():
                            t = int(self.place_template[k])
                            if long >= min_match or long == self.sizes[t]:
                                anchors.setdefault(t, []).append((i + 1, int(self.place_end[k]), long))
                below = (a, b)
                at = self.link[at]
                long = self.length[at] if at >= 0 else 0
            at = self.phrase_up[state]
            while at:
                for p in self.ends[at]:
                    if length >= (n := len(self.phrases[p][0])):
                        bases.append((i + 1 - n, p))
                at = self.phrase_up[self.link[at]]

    def chains(self, anchors: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
        """(covered words, first word, end) of the best chain that ends at each anchor."""
        anchors = sorted(anchors)
        ends = [a[0] for a in anchors]
        out: list[tuple[int, int, int]] = []
        for end, place, length in anchors:
            best = (length, end - length, end)
            for j in range(bisect_left(ends, end - length - max_gap), len(out)):
                other_end, other_place, _ = anchors[j]
                if other_end > end - 1 or other_place >= place or place - length - other_place > max_gap:
                    continue
                new = min(length, end - other_end, place - other_place)
                if out[j][0] + new > best[0]:
                    best = (out[j][0] + new, out[j][1], end)
            out.append(best)
        return out


@lru_cache(maxsize=2)
def automaton(templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> TokenAutomaton:
    return TokenAutomaton(templates, phrases)


def read_templates(spark: SparkSession, path: str, most_words: int = 2_000_000) -> tuple[tuple[str, str], ...]:
    """Whole licence texts as templates (label, text): files named by their label, as in mit.txt, in a folder or glob.

    All templates together go to every task, so they may have most_words words at most (their automaton takes some 0.3 GB
    a million words, whatever they share); more are an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(\.[^.]*)?$", 1).alias("label"), F.col("value").alias("text"))
    return templates_of(files, most_words)


def templates_of(table: DataFrame, most_words: int = 2_000_000) -> tuple[tuple[str, str], ...]:
    """Templates of a table (label, text), in the order of both; rows with a null and texts without words are left out."""
    usable = table.select("label", "text").where(F.col("label").isNotNull() & F.col("text").isNotNull()).distinct()
    words = usable.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    if words > most_words:
        raise ValueError(f"{words} words of templates; at most {most_words}")
    return tuple((r["label"], r["text"]) for r in usable.orderBy("label", "text").collect() if words_of(r["text"].encode()))


def scan_document(own: TokenAutomaton, text: bytes, min_match: int, max_gap: int, min_cover: float) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, str, float]]]:
    """Number of words, places of phrases (start, phrase), covered spans (first word, end, label, covered share)."""
    words = words_of(text)
    numbers = np.fromiter(map(own.words.get, words, [-1] * len(words)), np.int32, len(words))
    anchors: dict[int, list[tuple[int, int, int]]] = {}
    bases: list[tuple[int, int]] = []
    # A match has only known words: shorter runs of them hold none, and an unknown word ends a match.
    least = min(min_match, own.shortest)
    known = np.flatnonzero(np.diff(np.concatenate(([0], numbers >= 0, [0]))))
    for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
        if b - a >= least:
            own.scan(numbers[a:b].tolist(), a, min_match, anchors, bases)
    spans = []
    for t, found in anchors.items():
        # The fullest chains first; others of the template have to lie beside them.
        taken: list[tuple[int, int]] = []
        for cover, first, end in sorted({c for c in own.chains(found, max_gap) if c[0] >= min_cover * own.sizes[t]}, key=lambda c: (-c[0], c[1], c[2])):
            at = bisect_left(taken, (first, end))
            if (not at or taken[at - 1][1] <= first) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (first, end))
                spans.append((first, end, own.labels[t], min(1.0, cover / own.sizes[t])))
    return len(words), sorted(bases), sorted(spans)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_match: int = 3, max_gap: int = 6, min_cover: float = 0.75, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, phrases array<struct<start, label>>, spans array<struct<first_word, end_word, label, cover>>.

    Null and empty texts have no words and empty arrays; rows are independent, so repeated rows and null ids are kept.
    Only the two named columns are read. min_match may not exceed the length of the shortest phrase. templates: (label,
    text), notices or whole licences (see read_templates); they go to every task.
    """
    if phrases and min_match > min(len(words_of(p.encode())) for p, _ in phrases):
        raise ValueError("min_match exceeds the shortest phrase")
    shared = docs.sparkSession.sparkContext.broadcast((templates, phrases))  # bounded by the templates
    schema = "doc_id long, n_words long, phrases array<struct<start:long,label:string>>, spans array<struct<first_word:long,end_word:long,label:string,cover:double>>"
    phrase = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(*shared.value)
        for batch in batches:
            for part, texts in text_slices(batch):
                n, bases, spans = zip(*(scan_document(own, x, min_match, max_gap, min_cover) for x in texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array([[{"start": s, "label": own.phrases[p][1]} for s, p in b] for b in bases], phrase),
                        pa.array([[dict(zip(("first_word", "end_word", "label", "cover"), s)) for s in x] for x in spans], span),
                    ],
                    ["doc_id", "n_words", "phrases", "spans"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
