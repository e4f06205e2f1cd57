"""Licence scans with a generalised suffix automaton (operator 8).

An automaton holds every run of words of licence templates. There are two, so that a whole text which quotes a notice doesn't stand
before it: one of the whole texts of the files in ``licenses`` (one a licence, named by its label), one of the usual notices. A text is
streamed through them word by word, which gives the matching statistics: at each word the longest run of template words that ends
there. Long matches (``ANCHOR`` words for notices, ``FULL_ANCHOR`` for whole texts) are chained,
in the order of text and of template and with small gaps; a chain is worth the words that it covers less ``SKIP_COST`` for each word of the
text that it skips, since one word may make another licence of it. Of all chains of a template the best become spans, as far as they
don't overlap, and a span worth ``COVERAGE`` of a template gives its label. A span inside one of another licence is part of that, and goes. A phrase of the base list ends at a word exactly where
the state, or a state that its suffix links lead to, is the phrase's.

Words: A-Z lower-cased, then runs of ASCII letters and digits and of all characters beyond ASCII. The driver reads the files (0.2 MB,
fixed) and sends them to the tasks.

Edge cases: null and empty texts have no words, no label and score 0; texts of any length are read once, from front to back; a phrase may
stand over line breaks and punctuation; equal matches are counted at each place; ties between chains go to the shorter and then the first
one; repeated rows and null ids are rows of their own; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keep, map_batches

#: Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Usual notices, in the words of the licences.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-2.0", "eclipse public license v 2 0"),
    ("epl-2.0", "eclipse public license version 2 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: The licences of the CC BY family after the name's own words, as signs and in words; identifiers in SPDX lines and their labels.
CC_BY = [("", ""), ("sa", "sharealike"), ("nc", "noncommercial"), ("nd", "noderivatives"), ("nc sa", "noncommercial sharealike"), ("nc nd", "noncommercial noderivatives")]
SPDX = "mit apache-2.0 gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 agpl-3.0 bsd-2-clause bsd-3-clause isc mpl-1.1 mpl-2.0 epl-2.0 cc0-1.0 unlicense artistic-1.0".split()
for signs, named in CC_BY:
    label = "-".join(["cc-by", *signs.split(), "4.0"])
    TEMPLATES += [(label, " ".join(f"cc by {signs} 4 0".split())), (label, " ".join(f"creative commons attribution {named} 4 0 international".split()))]
TEMPLATES += [(x, f"spdx license identifier {x.replace('-', ' ').replace('.', ' ')}") for x in SPDX]
ANCHOR, FULL_ANCHOR, GAP, COVERAGE, SKIP_COST = 2, 5, 6, 0.85, 2
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CLEAN).split()


def full_texts() -> list[tuple[str, str]]:
    """Label and text of each licence file."""
    return sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in (resources.files(__package__) / "licenses").iterdir() if f.name.endswith(".txt"))


class SuffixAutomaton:
    """Of several sequences of numbers; ``ends[s]`` has (sequence, end) of all runs of state s, if it has runs of ``anchor`` symbols or more."""

    def __init__(self, sequences: list[list[int]], anchor: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], [[]]
        for n, sequence in enumerate(sequences):
            last = 0
            for end, symbol in enumerate(sequence, 1):
                last = self._extend(last, symbol)
                self.ends[last].append((n, end))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.size[self.link[state]] >= anchor:
                self.ends[self.link[state]].extend(self.ends[state])

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(following)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, parent: int, symbol: int) -> int:
        """The state of the parent's longest run with the symbol; a state that also holds longer runs is divided."""
        child = self.next[parent][symbol]
        if self.size[child] == self.size[parent] + 1:
            return child
        clone = self._state(self.size[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new, at = self._state(self.size[last] + 1, 0, {}), last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        self.link[new] = self._split(at, symbol) if at >= 0 else 0
        return new

    def step(self, state: int, size: int, symbol: int) -> tuple[int, int]:
        """Matching statistics: the state and length after one more symbol."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            size = self.size[state]
        following = self.next[state].get(symbol)
        return (0, 0) if following is None else (following, size + 1)


class Templates:
    """Texts with labels, their automaton, and the chains of a text's matches. The first ``phrases`` of them are looked for as they are."""

    def __init__(self, texts: list[tuple[str, str]], anchor: int, phrases: int = 0):
        self.number: dict[bytes, int] = {}
        lists = [[self.number.setdefault(w, len(self.number)) for w in words_of(text)] for _, text in texts]
        self.labels, self.sizes, self.anchor, self.phrases = [label for label, _ in texts], [len(x) for x in lists], anchor, phrases
        self.automaton = a = SuffixAutomaton(lists, anchor)
        own = {}
        for phrase in range(phrases):
            state = size = 0
            for symbol in lists[phrase]:
                state, size = a.step(state, size, symbol)
            own[state] = phrase
        self.ending: list[list[int]] = []  # of each state: the phrases that end every run of at least their length
        for state in range(len(a.size)):
            found, at = [], state
            while own and at > 0:
                if at in own:
                    found.append(own[at])
                at = a.link[at]
            self.ending.append(found)

    def read(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """(start, label) of each phrase; start, length and state of the runs that can't be made longer to the right."""
        number, step, ending, anchor = self.number, self.automaton.step, self.ending, self.anchor
        places, matches = [], []
        state = size = 0
        before = -2
        for i in [i for i, w in enumerate(words) if w in number]:
            if i != before + 1:
                if size >= anchor:
                    matches.append((before + 1 - size, size, state))
                state = size = 0
            after, grown = step(state, size, number[words[i]])
            if grown <= size and size >= anchor:
                matches.append((before + 1 - size, size, state))
            state, size, before = after, grown, i
            if ending[state]:
                for p in ending[state]:
                    if size >= self.sizes[p]:
                        places.append((i + 1 - self.sizes[p], self.labels[p]))
        if size >= anchor:
            matches.append((before + 1 - size, size, state))
        return places, matches

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The best chain that ends with each match, in text order; spans are those that cover most and overlap no other of their template."""
        chains: dict[int, list[tuple[int, int, int, int]]] = {}  # of each template: worth, first word, word after the last, end
        whole: dict[int, list[tuple[int, int, int]]] = {}
        for start, size, state in matches:
            for t, end in self.automaton.ends[state]:
                if t < self.phrases:
                    continue
                near = [c for c in chains.get(t, ()) if start <= c[2] + GAP]  # matches come by start: others are too far from all later ones
                best = (size, start)
                for worth, first, after, at in near:
                    fresh = min(size, start + size - after, end - at)  # words that the chain hasn't covered
                    if fresh > 0:
                        best = max(best, (worth + fresh - SKIP_COST * max(0, start - after), first))
                near.append((*best, start + size, end))
                chains[t] = near
                if best[0] >= COVERAGE * self.sizes[t]:
                    whole.setdefault(t, []).append((*best, start + size))
        spans = []
        for t, found in whole.items():
            taken: list[tuple[int, int]] = []
            for worth, first, after in sorted(found, key=lambda c: (-c[0], c[2] - c[1], c[1])):
                k = bisect(taken, (first, after))
                if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= after):
                    insort(taken, (first, after))
                    spans.append((self.labels[t], first, after, worth / self.sizes[t]))
        return spans


def outermost(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Spans (label, first, after, coverage) in text order, without those inside a longer span of another label, or at the same place with less coverage."""
    kept, reach = [], {}  # of each label: the span so far that ends last
    for span in sorted(spans, key=lambda x: (x[1], -x[2], -x[3], x[0])):
        label, first, after, coverage = span
        if not any(o != label and a >= after and (a > after or f < first or c > coverage) for o, (f, a, c) in reach.items()):
            kept.append(span)
        if label not in reach or after > reach[label][1]:
            reach[label] = (first, after, coverage)
    return kept


class Scanner:
    def __init__(self, full: list[tuple[str, str]] | None = None):
        self.notices = Templates([(label, text) for text, label in BASE] + TEMPLATES, ANCHOR, len(BASE))
        self.full = Templates(full_texts() if full is None else full, FULL_ANCHOR)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Number of words; (start, label) of each base phrase; (label, first word, word after the last, coverage) of each span."""
        words = words_of(text)
        places, matches = self.notices.read(words)
        spans = self.notices.chain(matches) + self.full.chain(self.full.read(words)[1])
        return len(words), places, outermost(spans)


def scan_texts(docs: DataFrame) -> DataFrame:
    """Per document: n_words, places and spans, with their labels and word ranges."""
    shared = docs.sparkSession.sparkContext.broadcast(full_texts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = keep("license_scan", lambda: Scanner(shared.value))
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            places = pa.array([[{"start": s, "label": x} for s, x in p] for _, p, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])))
            spans = pa.array([[{"label": x, "first": a, "after": b, "coverage": c} for x, a, b, c in s] for _, _, s in found], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("coverage", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), places, spans], ["doc_id", "n_words", "places", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, n_words long, places array<struct<start:long,label:string>>, spans array<struct<label:string,first:long,after:long,coverage:double>>")


def licenses(docs: DataFrame) -> DataFrame:
    """The digest columns of ``scan_texts``."""
    from pyspark.sql import functions as F

    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    covered = F.greatest(F.coalesce(F.array_max(F.col("spans.coverage")), F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0))
    return scan_texts(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat(F.col("places.label"), F.col("spans.label"))).alias("labels"), F.least(covered, F.lit(1.0)).alias("score"),
    )
