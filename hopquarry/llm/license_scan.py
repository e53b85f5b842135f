"""License scans by matching statistics over a generalised suffix automaton.

The automaton holds the words of all templates (notices and texts of licences)
and phrases.  A text is streamed through it word by word: after each word the
state stands for the longest end of the text so far that some template has.
Where such a match cannot go on, it is a *long match* if it has ``LEAST_MATCH``
words.  Long matches are chained for each template they occur in: matches that
begin within ``GAP`` words of those before form a run, and a chain goes up in text
and template, without overlaps.  The chain of a run with the most words is a
span, and a template that is covered to ``COVERED`` gives its label.  Phrases are found exactly, wherever
they stand: a phrase ends at a word if its state is the text's state there or
one of its suffix links, which is looked up once for each state.

One narrow stage: the automaton is built once in each worker, and its size does
not depend on the data.  A text is cut into words a block at a time.

Defined results: a null text counts as empty; without words ``n_words`` and
``n_base`` are 0, ``first_word`` and ``last_word`` null, both label columns empty
strings and the score 0.  A phrase counts at each place, also where places
overlap.  The score is the largest share of a template that a chain covers; a phrase is
always covered whole, so each text with a base place scores 1.  Of equally good
chains the first stays.  Repeated rows and repeated or null ids give a row each; extra columns are
dropped, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import map_batches
from .words import ascii_words

#: Words that a match needs to be chained.
LEAST_MATCH = 4
#: Words of the text that may lie between two matches of a chain.
GAP = 12
#: Share of a template that a chain must cover for its label.
COVERED = 0.6
#: Bytes that are cut into words at once, at about this number.
BLOCK = 1 << 20

#: Phrases that give their label at each place.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The wording of public licences and of the notices that name them, by label.
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
             "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
               "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
               "permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
            "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
            "file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                  "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, "
                  "and by any means."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "spans array<struct<label string, template int, first_word long, last_word long, covered int, words int>>"


class Match(NamedTuple):
    """Words ``start`` up to ``end`` (not included) of a text, and the state they reach."""

    start: int
    end: int
    state: int


class Span(NamedTuple):
    """A chain of matches of one template: its place in the text and how many words of the template it covers."""

    template: int
    start: int
    end: int
    covered: int


class Automaton:
    """Generalised suffix automaton of token sequences: each state stands for the strings with one set of ends."""

    def __init__(self, templates: list[list[bytes]], phrases: list[list[bytes]]):
        self.templates, self.phrases = templates, phrases
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for which, tokens in enumerate([*templates, *phrases]):
            at = 0
            for place, token in enumerate(tokens):
                at = self._extend(at, token)
                while len(ends) < len(self.go):
                    ends.append([])
                if which < len(templates):
                    ends[at].append((which, place + 1))
        # a state's ends are its own and those of all that link to it, the longest first
        self.places = ends
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]].extend(self.places[state])
        self.ending = [self._phrases_at(state) for state in range(len(self.go))]

    def _new(self, length: int) -> int:
        self.go.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.go) - 1

    def _split(self, before: int, token: bytes, after: int) -> int:
        """The state for the strings of ``before`` and ``token`` alone: ``after``, or a part of it."""
        if self.length[after] == self.length[before] + 1:
            return after
        part = self._new(self.length[before] + 1)
        self.go[part], self.link[part] = dict(self.go[after]), self.link[after]
        self.link[after] = part
        while before >= 0 and self.go[before].get(token) == after:
            self.go[before][token] = part
            before = self.link[before]
        return part

    def _extend(self, last: int, token: bytes) -> int:
        known = self.go[last].get(token)
        if known is not None:
            return self._split(last, token, known)
        new, before = self._new(self.length[last] + 1), last
        while before >= 0 and token not in self.go[before]:
            self.go[before][token] = new
            before = self.link[before]
        if before >= 0:
            self.link[new] = self._split(before, token, self.go[before][token])
        return new

    def _phrases_at(self, state: int) -> list[tuple[int, int]]:
        """(length, phrase) of phrases that the state's longest string ends with."""
        out = []
        for which, tokens in enumerate(self.phrases):
            at = 0
            for token in tokens:
                at = self.go[at][token]
            above = state
            while above > 0 and above != at:
                above = self.link[above]
            if above == at:
                out.append((len(tokens), which))
        return out

    def scan(self, words: Iterable[bytes]) -> tuple[int, list[tuple[int, int]], list[Match]]:
        """How many words, (start, phrase) of all phrases, and the long matches that cannot go on."""
        go, link, length, ending, first = self.go, self.link, self.length, self.ending, self.go[0]
        found, matches = [], []
        state, size, at = 0, 0, -1
        for at, word in enumerate(words):  # noqa: B007
            after = go[state].get(word)
            if after is None:
                if size >= LEAST_MATCH:
                    matches.append(Match(at - size, at, state))
                if word not in first:
                    state = size = 0
                    continue
                while after is None:
                    state = link[state]
                    after = go[state].get(word)
                size = length[state]
            state = after
            size += 1
            for phrase_size, phrase in ending[state]:
                if phrase_size <= size:
                    found.append((at + 1 - phrase_size, phrase))
        if size >= LEAST_MATCH:
            matches.append(Match(at + 1 - size, at + 1, state))
        return at + 1, found, matches

    def chains(self, matches: list[Match]) -> list[Span]:
        """For each template, and each run of matches without a longer gap, the chain with the most words."""
        by_template: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, end, state in matches:
            for template, place in self.places[state]:
                by_template.setdefault(template, []).append((start, end, place - (end - start), place))
        spans = []
        for template, pieces in sorted(by_template.items()):
            run: list[tuple[int, int, int, int]] = []
            reach = 0
            for piece in pieces:  # in order of the text
                if run and piece[0] > reach + GAP:
                    spans.append(self._best_chain(template, run))
                    run = []
                run.append(piece)
                reach = piece[1]
            spans.append(self._best_chain(template, run))
        return spans

    def _best_chain(self, template: int, run: list[tuple[int, int, int, int]]) -> Span:
        """The heaviest chain, by dynamic programming over the places of the template.

        ``best`` holds, in order of the place where a chain ends in the template,
        only chains that cover more than all that end before, so a look-up is a
        binary search.  A chain joins it once the text has passed its end.
        """
        ends, best = [0], [(0, run[0][0], run[0][0])]  # place in the template; covered words, start and end in the text
        waiting: list[tuple[int, int, int, int]] = []
        top = (0, 0, 0)
        for start, end, low, high in run:
            ready = [w for w in waiting if w[0] <= start]
            waiting = [w for w in waiting if w[0] > start]
            for text_end, place, covered, text_start in ready:
                k = bisect_right(ends, place)
                if best[k - 1][0] >= covered:
                    continue
                while k < len(ends) and best[k][0] <= covered:
                    del ends[k], best[k]
                if ends[k - 1] == place:
                    best[k - 1] = (covered, text_start, text_end)
                else:
                    ends.insert(k, place)
                    best.insert(k, (covered, text_start, text_end))
            covered, text_start, _ = best[bisect_right(ends, low) - 1]
            if covered == 0:
                text_start = start
            chain = (covered + end - start, text_start, end)
            waiting.append((end, high, chain[0], text_start))
            if chain[0] > top[0]:
                top = chain
        return Span(template, top[1], top[2], top[0])


def words_of(text: bytes) -> Iterator[bytes]:
    """The text's words, a block at a time, cut between words."""
    start = 0
    while start < len(text):
        stop = start + BLOCK
        # a word goes on to the next character that is none
        while stop < len(text) and ascii_words(text[stop : stop + 1]):
            stop += 1
        yield from ascii_words(text[start:stop])
        start = stop


class Scanner:
    """Labels, places and score of a text."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.templates = [(label, ascii_words(text.encode())) for label, text in templates]
        self.phrase_labels = list(phrases.values())
        self.automaton = Automaton([tokens for _, tokens in self.templates], [ascii_words(p.encode()) for p in phrases])

    def scan(self, text: bytes) -> tuple:
        words = ascii_words(text) if len(text) <= BLOCK else words_of(text)
        n_words, found, matches = self.automaton.scan(words)
        base = {self.phrase_labels[phrase] for _, phrase in found}
        labels, score, spans = set(base), float(bool(found)), []
        for span in self.automaton.chains(matches) if matches else ():
            label, tokens = self.templates[span.template]
            share = span.covered / len(tokens)
            score = max(score, share)
            if share >= COVERED:
                labels.add(label)
                spans.append({"label": label, "template": span.template, "first_word": span.start, "last_word": span.end - 1, "covered": span.covered, "words": len(tokens)})
        starts = [start for start, _ in found]
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return n_words, len(found), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan_documents(
    documents: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", keep_spans: bool = False
) -> DataFrame:
    """Counts, places and labels of each document; with ``keep_spans`` also the covered ``spans``.

    ``templates`` are pairs of label and text, ``phrases`` name the label of each
    phrase; the module's own are the defaults.
    """
    own = (TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    built: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        if not built:
            built.append(Scanner(*own))
        rows = [built[0].scan(text or b"") for text in batch.column(1).to_pylist()]
        columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    long, text = pa.int64(), pa.string()
    kinds = [long, long, long, long, text, text, pa.float64()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    if keep_spans:
        kinds.append(pa.list_(pa.struct([("label", text), ("template", pa.int32()), ("first_word", long), ("last_word", long), ("covered", pa.int32()), ("words", pa.int32())])))
        names.append("spans")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(rows, run, f"{SCHEMA}, {SPANS}" if keep_spans else SCHEMA)
