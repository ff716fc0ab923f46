"""License scan: a generalised suffix automaton over the tokens of license templates.

Every text is streamed through the automaton, which gives at each word the longest run of
words ending there that stands in some template (matching statistics). Long matches with one
template are chained in the order of both text and template, so that a chain covers a span of
the template and counts each of its words once; a template covered well enough gives its label. Templates are short notices, and whole licence texts from
the folder ``licences``, whose files are named by label and version.
Three short phrases label a text wherever their words stand consecutively.
"""

from __future__ import annotations

import bisect
import functools
import importlib.resources
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of

#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: What a phrase says of a text's licence where no template is covered, as part of the score.
PHRASE_EVIDENCE = 0.9
#: Fixed opening passages of public license notices, lower case and without punctuation.
TEMPLATES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the software""",
    "apache": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied""",
    "gpl": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 3 of the license or at your option any later
        version this program is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more
        details""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies""",
    "mpl": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at http mozilla org mpl 2 0""",
    "lgpl": """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general
        public license as published by the free software foundation either version 2 1 of the license or at your option any
        later version this library is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for
        more details""",
    "agpl": """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general
        public license as published by the free software foundation either version 3 of the license or at your option any later
        version""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
        use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
        commercial or non commercial and by any means""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software for
        any purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions""",
    "boost": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit
        the software and to prepare derivative works of the software""",
    "epl": """this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
        which is available at https www eclipse org legal epl 2 0""",
}
#: Matches of at least so many words count; they join a chain over at most GAP words of the text and SKIP of the
#: template; a chain that covers so large a part of its template, or so many words of it, gives the template's label.
LEAST_RUN, GAP, SKIP, COVER, COVER_WORDS = 5, 4, 12, 0.6, 12
_SEPARATORS = bytes(32 if b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and any other than ASCII signs; A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_SEPARATORS).split()


def label_of(name: str) -> str:
    """The label of a template: its name up to the first dot."""
    return name.partition(".")[0]


@functools.cache
def whole_templates() -> dict[str, str]:
    """The notices, and the words of the whole licence texts of the package."""
    texts = {f"{p.name.removesuffix('.txt')}.text": p.read_text() for p in (importlib.resources.files(__package__) / "licences").iterdir() if p.name.endswith(".txt")}
    return TEMPLATES | {name: b" ".join(words_of(t)).decode() for name, t in sorted(texts.items())}


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    """The automaton of some templates; a worker builds it once."""
    return Scanner(dict(templates))


class Match(NamedTuple):
    """Words ``start`` to ``end`` of a text that stand in a template up to its word ``to``."""

    start: int
    end: int
    to: int


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences; each state knows where in which sequence it ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for token in sequence:
                last = self._extend(last, token)
        # a state ends wherever a prefix ends that it is a suffix of
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for number, sequence in enumerate(sequences):
            prefix = 0
            for end, token in enumerate(sequence, 1):
                prefix = state = self.next[prefix][token]
                while state > 0:
                    self.ends[state].append((number, end))
                    state = self.link[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, token: int, to: int) -> int:
        copy = self._state(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while state >= 0 and self.next[state].get(token) == to:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        to = self.next[last].get(token)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, token, to)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            to = self.next[state][token]
            self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, token, to)
        return new

    def statistics(self, tokens: list[int]) -> tuple[list[int], list[int]]:
        """Longest match ending at each token, and its state."""
        lengths, states, state, length = [], [], 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            lengths.append(length), states.append(state)
        return lengths, states


def chained(matches: list[Match]) -> tuple[list[int], list[int]]:
    """For each of ``matches``, in order of their ends, the most words that a chain up to it covers, and the match before it."""
    covered, before = [m.end - m.start for m in matches], [-1] * len(matches)
    for j, m in enumerate(matches):
        for i in range(j - 1, -1, -1):
            last = matches[i]
            gap, skip = m.start - last.end, m.to - (m.end - m.start) - last.to
            if gap > GAP:
                break
            # what overlaps in either order counts once
            new = m.end - m.start - max(0, -gap, -skip)
            if skip <= SKIP and new > 0 and covered[i] + new > covered[j]:
                covered[j], before[j] = covered[i] + new, i
    return covered, before


def chains(matches: list[Match], least: float) -> list[tuple[int, int, int]]:
    """(first word, end, covered words) of disjoint chains that cover ``least`` words or more, the best ones first."""
    taken: list[tuple[int, int, int]] = []
    left = matches
    while left:
        covered, before = chained(left)
        found: list[tuple[int, int, int]] = []  # by first word
        for at in sorted(range(len(left)), key=lambda j: (-covered[j], j)):
            if covered[at] < least:
                break
            end, first = left[at].end, at
            while before[first] >= 0:
                first = before[first]
            start = min(left[first].start, left[at].start)
            place = bisect.bisect(found, (start,))
            if (place == 0 or found[place - 1][1] <= start) and (place == len(found) or found[place][0] >= end):
                found.insert(place, (start, end, covered[at]))
        if not found:
            break
        taken += found
        # the template may stand in what the chains leave
        free = lambda m: (p := bisect.bisect(found, (m.start, 1 << 60))) == 0 or found[p - 1][1] <= m.start
        clear = lambda m: (p := bisect.bisect(found, (m.start,))) == len(found) or found[p][0] >= m.end
        left = [m for m in left if free(m) and clear(m)]
    return taken


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.names = sorted(templates)
        sequences = [[w.encode() for w in templates[n].split()] for n in self.names]
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        known = sorted({w for s in [*sequences, *(p for p, _ in self.phrases)] for w in s})
        self.ids = {w: i for i, w in enumerate(known)}
        coded = [[self.ids[w] for w in s] for s in sequences]
        self.sizes = [len(s) for s in coded]
        self.automaton = SuffixAutomaton(coded)
        # word pairs inside templates: without one, no match of two or more words passes
        size = len(known) + 1
        self.pairs = np.zeros(size * size, bool)
        for s in coded:
            for a, b in zip(s, s[1:], strict=False):
                self.pairs[a * size + b] = True

    def scan(self, text: str | None):
        """(words, phrase hits as (start, label), template spans as (label, first word, end, covered words, part of the template))."""
        words = words_of(text)
        unknown = len(self.ids)
        codes = np.fromiter((self.ids.get(w, unknown) for w in words), np.int64, len(words))
        hits = []
        for phrase, label in self.phrases:
            size = len(phrase)
            if len(codes) >= size:
                same = np.ones(len(codes) - size + 1, bool)
                for i, w in enumerate(phrase):
                    same &= codes[i : len(codes) - size + 1 + i] == self.ids[w]
                hits += [(int(at), label) for at in np.flatnonzero(same)]
        spans = []
        if len(codes) > 1:
            linked = self.pairs[codes[:-1] * (unknown + 1) + codes[1:]]
            edges = np.flatnonzero(np.diff(np.r_[False, linked, False].astype(np.int8)))
            runs = [(a, b + 1) for a, b in edges.reshape(-1, 2).tolist() if b + 1 - a >= LEAST_RUN]
            spans = self.chain(codes, runs)
        return len(words), sorted(hits), spans

    def chain(self, codes: np.ndarray, runs: list[tuple[int, int]]):
        matches: dict[int, list[Match]] = {}
        for a, b in runs:
            lengths, states = self.automaton.statistics(codes[a:b].tolist())
            for i, (length, state) in enumerate(zip(lengths, states, strict=True)):
                # the end of a match that does not grow further
                if length >= LEAST_RUN and (i + 1 == len(lengths) or lengths[i + 1] <= length):
                    for t, to in self.automaton.ends[state]:
                        matches.setdefault(t, []).append(Match(a + i + 1 - length, a + i + 1, to))
        spans = []
        for t, found in matches.items():
            least = min(COVER * self.sizes[t], COVER_WORDS)
            spans += [(label_of(self.names[t]), start, end, covered, covered / self.sizes[t]) for start, end, covered in chains(found, least)]
        # of templates that share words, the one that is covered best
        spans.sort(key=lambda s: s[1])
        worse = set()
        for i, s in enumerate(spans):
            for j in range(i + 1, len(spans)):
                if spans[j][1] >= s[2]:
                    break
                if s[3] != spans[j][3]:
                    worse.add(i if s[3] < spans[j][3] else j)
        return sorted(s for i, s in enumerate(spans) if i not in worse)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(id_col, n_words, hits array of (word, label), spans array of (label, first, end, covered, share)) for each row.

    Words are numbered from 0 over the whole text; ``covered`` counts words of the template, ``share``
    is their part of it. Null text has no words. Ids have any type. Overlapping phrases all
    count. Repeated rows and null ids are scanned like others; an empty table gives no rows; other
    columns are ignored. ``templates`` (text by name) default to all of the package; a name's part before a dot is the label.
    """
    given = tuple((whole_templates() if templates is None else templates).items())

    def run(batches):
        found_by = scanner(given)
        hit, span = pa.struct([("word", pa.int64()), ("label", pa.string())]), pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
        for batch in batches:
            found = [found_by.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[dict(zip(("word", "label"), h, strict=True)) for h in f[1]] for f in found], pa.list_(hit)),
                    pa.array([[dict(zip(("label", "first", "end", "covered", "share"), s, strict=True)) for s in f[2]] for f in found], pa.list_(span)),
                ],
                ["id", "n_words", "hits", "spans"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    schema = f"id {kind_of(rows, 'id')}, n_words long, hits array<struct<word: long, label: string>>, spans array<struct<label: string, first: long, end: long, covered: long, share: double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    label = lambda parts: F.concat_ws(",", F.array_sort(F.array_distinct(parts)))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_base"),
        F.array_min("hits.word").alias("first_word"),
        F.array_max("hits.word").alias("last_word"),
        label(F.col("hits.label")).alias("base_labels"),
        label(F.concat("hits.label", "spans.label")).alias("labels"),
        # the largest part of a template that a span covers, and the phrase as one more piece of evidence
        (1 - (1 - F.when(F.size("hits") > 0, PHRASE_EVIDENCE).otherwise(0.0)) * (1 - F.coalesce(F.array_max("spans.share"), F.lit(0.0)))).alias("score"),
    )
