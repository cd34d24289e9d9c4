"""License notices: fixed phrases, and an exact set-similarity join of text blocks with notice templates.

A block is a line, or a stretch across line ends of at most as many words as the template has. Block and template
are sets of words. They match when the block holds at least `threshold` of the template's words. Words are ordered by how often the whole corpus has them, rarest first. A block that
matches must hold one of the template's first n - need + 1 words (prefix filter) and at least `need` of all template
words (length filter); at the first common word, what is left on both sides must still reach `need` (positional
filter). A stretch must hold `need` places of template words, one of them in the prefix. Only pairs that pass are
counted out, so the result is exact. Of stretches of a template that overlap, the fullest counts. Templates are a short list in the
program, so each task holds their index; texts are never shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulltally.llm.arrays import byte_chunks, split_words

THRESHOLD = 0.75

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The licenses' own notices.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}

SEPARATORS = np.ones(256, bool)
SEPARATORS[128:] = False
SEPARATORS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = False

_BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<label:string,start:long,end:long,containment:double>>"


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return split_words(data, np.array([0, len(data)]), SEPARATORS).hashes()


def _counter(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in byte_chunks(batch.column("text")):
                hashes = split_words(data, offsets, SEPARATORS).hashes()
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                total += np.bincount(place[vocabulary[place] == hashes], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["word", "n"])

    return count


class Stretch(NamedTuple):
    """A match of a template within as many words as it has; places are words of the chunk."""

    template: int
    doc: int
    start: int
    end: int
    containment: float
    words: frozenset[int]


class Templates:
    """Templates as word ranks, rarest word of the corpus first, with an index of their prefixes."""

    def __init__(self, templates: Mapping[str, Sequence[str]], vocabulary: np.ndarray, counts: np.ndarray, threshold: float) -> None:
        self.vocabulary = vocabulary
        self.rank = np.empty(len(vocabulary), np.int64)
        self.rank[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))
        self.labels, self.words, self.need, self.lengths, self.rare = [], [], [], [], []
        self.prefixes: dict[int, list[tuple[int, int]]] = defaultdict(list)  # word: (template, position)
        for label in sorted(templates):
            for text in templates[label]:
                hashes = _words(text)
                words = np.unique(self.rank[np.searchsorted(vocabulary, np.unique(hashes))])
                need = math.ceil(threshold * len(words) - 1e-9)
                for position, word in enumerate(words[: len(words) - need + 1].tolist()):
                    self.prefixes[word].append((len(self.words), position))
                self.labels.append(label)
                self.words.append(frozenset(words.tolist()))
                self.need.append(need)
                self.lengths.append(len(hashes))
                self.rare.append(words[: len(words) - need + 1])
        self.least = min(self.need, default=0)

    def matches(self, block: list[int]) -> dict[int, float]:
        """Containment by template of a block: its distinct template words in rank order."""
        seen: set[int] = set()
        found: dict[int, float] = {}
        for j, word in enumerate(block):
            for template, i in self.prefixes.get(word, ()):
                if template not in seen:
                    seen.add(template)  # the first common word decides
                    size, need = len(self.words[template]), self.need[template]
                    if 1 + min(size - i, len(block) - j) - 1 >= need:
                        both = len(self.words[template].intersection(block))
                        if both >= need:
                            found[template] = both / size
        return found

    def stretches(self, at: np.ndarray, ranks: np.ndarray, owner: np.ndarray) -> list[Stretch]:
        """Stretches of all templates; at has the places of template words in ascending order, owner their documents."""
        out = []
        for t, words in enumerate(self.words):
            size, need, length = len(words), self.need[t], self.lengths[t]
            own = np.zeros(len(self.rank), bool)
            own[list(words)] = True
            mine = np.flatnonzero(own[ranks])
            if not need or len(mine) < need:
                continue
            place, rank, doc = at[mine], ranks[mine], owner[mine]
            last = np.searchsorted(place, place + length)  # of the window that starts at each place
            last = np.minimum(last, np.searchsorted(doc, doc, "right"))
            rare = np.zeros(len(self.rank), bool)
            rare[self.rare[t]] = True
            n_rare = np.append(0, np.cumsum(rare[rank]))
            first = np.flatnonzero((last - np.arange(len(place)) >= need) & (n_rare[last] > n_rare[:-1]))
            both = _distinct(rank.tolist(), first.tolist(), last[first].tolist())
            good = [(-n, k, int(last[k])) for n, k in zip(both, first.tolist(), strict=True) if n >= need]
            free = np.ones(len(place), bool)
            for n, a, b in sorted(good):
                if free[a] and free[b - 1]:  # those before are at least as full, none is shorter than need places
                    if not free[a:b].all():
                        continue
                    free[a:b] = False
                    a, b = _trimmed(rank, a, b)
                    out.append(Stretch(t, int(doc[a]), int(place[a]), int(place[b - 1]) + 1, -n / size, frozenset(rank[a:b].tolist())))
        return out


def _distinct(ranks: list[int], first: list[int], last: list[int]) -> list[int]:
    """Number of different ranks from each first to each last; both ascend."""
    counts: dict[int, int] = defaultdict(int)
    out, a, b = [], 0, 0
    for x, y in zip(first, last, strict=True):
        if x >= b:
            counts.clear()
            a = b = x
        while b < y:
            counts[ranks[b]] += 1
            b += 1
        while a < x:
            counts[ranks[a]] -= 1
            if not counts[ranks[a]]:
                del counts[ranks[a]]
            a += 1
        out.append(len(counts))
    return out


def _trimmed(rank: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """Without words at the end, then at the start, that the rest holds."""
    while rank[b - 1] in rank[a:b - 1]:
        b -= 1
    while rank[a] in rank[a + 1:b]:
        a += 1
    return a, b


def _beside(x: Stretch, ordered: list[Stretch], longest: int) -> list[Stretch]:
    """Those of ordered (by start, none longer than longest) that can overlap x."""
    return ordered[bisect_left(ordered, x.start - longest, key=lambda y: y.start):bisect_left(ordered, x.end, key=lambda y: y.start)]


def _outdone(x: Stretch, others: list[Stretch]) -> bool:
    """Whether the words of x lie inside a fuller match of another template at the same place."""
    return any(y.containment > x.containment and y.start < x.end and x.start < y.end and x.words <= y.words for y in others)


def _scanner(templates: Templates, phrases: list[tuple[np.ndarray, str]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = templates.vocabulary
        for batch in batches:
            for first, last, data, offsets in byte_chunks(batch.column("text")):
                words = split_words(data, offsets, SEPARATORS)
                hashes, owner, n = words.hashes(), words.docs(), last - first
                places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                for phrase, label in phrases:
                    at = np.flatnonzero(hashes[: max(0, len(hashes) - len(phrase) + 1)] == phrase[0])
                    for k in range(1, len(phrase)):
                        at = at[hashes[at + k] == phrase[k]]
                    at = at[owner[at] == owner[at + len(phrase) - 1]]
                    for w in at.tolist():
                        places[owner[w]].append((w - int(words.bounds[owner[w]]), label))
                blocks: list[list[dict]] = [[] for _ in range(n)]
                if len(vocabulary):
                    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    hit = np.flatnonzero(vocabulary[place] == hashes)
                    # A block is a line of a document, or a stretch across lines.
                    edges = np.union1d(offsets[:-1], np.flatnonzero(data == 10))
                    block = np.searchsorted(edges, words.starts[hit], "right")
                    pairs = np.unique(np.stack([block, templates.rank[place[hit]]]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
                    numbers, begin, size = np.unique(pairs[0], return_index=True, return_counts=True)
                    first_word = np.searchsorted(words.starts, np.append(edges, len(data)))
                    stretches: dict[int, list[Stretch]] = defaultdict(list)  # by document
                    in_line: dict[tuple[int, int], list[Stretch]] = defaultdict(list)  # by line and template
                    longest = max(templates.lengths)
                    for x in sorted(templates.stretches(hit, templates.rank[place[hit]], owner[hit]), key=lambda x: x.start):
                        stretches[x.doc].append(x)
                        a, b = np.searchsorted(first_word, [x.start, x.end - 1], "right").tolist()
                        if a == b:
                            in_line[a, x.template].append(x)
                    entries: list[set[tuple]] = [set() for _ in range(n)]
                    for b, at, m in zip(numbers.tolist(), begin.tolist(), size.tolist(), strict=True):
                        own = pairs[1, at:at + m].tolist()
                        if m >= templates.least and (found := templates.matches(own)):
                            doc = int(owner[first_word[b - 1]])
                            start, end = (int(first_word[x] - words.bounds[doc]) for x in (b - 1, b))
                            whole = [Stretch(t, doc, start, end, c, templates.words[t].intersection(own)) for t, c in found.items()]
                            for x in whole:
                                # It goes if the line has a fuller one with its words, and so has each place where it stands.
                                if not _outdone(x, whole) or not all(_outdone(y, _beside(y, stretches[doc], longest)) for y in in_line[b, x.template]):
                                    entries[doc].add((templates.labels[x.template], start, end, x.containment))
                    for doc, those in stretches.items():
                        base = int(words.bounds[doc])
                        for x in those:
                            a, b = np.searchsorted(first_word, [x.start, x.end - 1], "right").tolist()
                            if a != b and not _outdone(x, _beside(x, those, longest)):
                                entries[doc].add((templates.labels[x.template], x.start - base, x.end - base, x.containment))
                    for doc, those in enumerate(entries):
                        ordered = sorted(those, key=lambda x: (x[1], x[2], x[0], -x[3]))
                        blocks[doc] = [dict(zip(("label", "start", "end", "containment"), x, strict=True)) for x in ordered]
                columns = [
                    pa.array(np.diff(words.bounds), pa.int64()),
                    pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p)[0] if p else None for p in places], pa.int64()),
                    pa.array([max(p)[0] if p else None for p in places], pa.int64()),
                    pa.array([sorted({x for _, x in p}) for p in places], pa.list_(pa.string())),
                    pa.array(blocks, _BLOCKS),
                ]
                names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), *columns], ["doc_id", *names])

    return scan


def license_notices(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Phrases and template blocks of every row of docs (doc_id, text; other columns are ignored).

    Columns: doc_id, n_words, n_base (places of all phrases), first_word and last_word (their smallest and largest
    start, null without any), base_labels (sorted), blocks (label, start and end in words, containment). Every template
    that a line or a stretch across lines meets counts, unless its words lie inside a fuller match at the same place. Null and empty texts have no words.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = [_words(t) for label in sorted(templates) for t in templates[label]]
    vocabulary = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint64)
    counts = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        got = docs.select("text").mapInArrow(_counter(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()  # a row per template word
        counts[got["word"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    index = Templates(templates, vocabulary, counts, threshold)
    return docs.mapInArrow(_scanner(index, [(_words(p), label) for p, label in sorted(phrases.items())]), f"doc_id long, {SCHEMA}")
