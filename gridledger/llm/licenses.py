"""License scans with a generalised suffix automaton of licence words.

All templates share one automaton. A text is streamed through it word by word;
its state and length are the matching statistics: the longest run of words that
ends here and stands in some template. A run that cannot grow any more and has
at least ``LEAST`` words is a match. Matches of one template that go forward in
both text and template, with at most ``GAP`` words between, form a chain; a chain
that covers ``COVERED`` of the template is a span and gives its label. Short
phrases are templates that must be covered whole: their places are read off the
automaton's states, overlapping or not.

The automaton grows with the templates alone and is built once per task. Nothing
is shuffled. Rows: null and empty texts have no words and no labels; repeated
rows and null ids are scanned like any other; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm import common

#: Phrases whose places are all reported, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Passages of public licence texts, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
           " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
           " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
           " the Software",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
           " hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
           " the following conditions are met",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
                " compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
           " Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
            " General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0": "The person who associated a work with this deed has dedicated the work to the public domain",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or"
                           " transmitted in any form or by any means",
}
LEAST = 4
GAP = 6
COVERED = 0.75


class Automaton:
    """Suffix automaton of several word sequences; states know where in which template they occur."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (template, words up to here)
        self.templates = [(label, common.words_of(text.encode())) for label, text in templates.items()]
        self.phrases = [(label, common.words_of(text.encode())) for text, label in phrases.items()]
        finals = []
        for number, (_, words) in enumerate(self.templates):
            state = 0
            for at, word in enumerate(words):
                state = self._extend(state, word)
                self.ends[state].append((number, at + 1))
        for number, (_, words) in enumerate(self.phrases):
            state = 0
            for word in words:
                state = self._extend(state, word)
            if words:
                finals.append(number)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for state in order:  # a suffix occurs wherever the longer string does
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])
        self.phrase: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)  # (words, phrase) of a whole phrase ending here
        for number in finals:
            words = self.phrases[number][1]
            state = 0
            for word in words:
                state = self.next[state][word]
            self.phrase[state] = (*self.phrase[state], (len(words), number))
        for state in reversed(order):
            if self.link[state] > 0:
                self.phrase[state] = (*self.phrase[state], *self.phrase[self.link[state]])
        self.vocabulary = frozenset(w for _, words in (*self.templates, *self.phrases) for w in words)

    def _new(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of ``target`` that stands for the strings one word longer than those of ``state``."""
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        """State of the current sequence with one word more; known strings add no state."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, state = self._new(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of each word that is in some template; other words end every run."""
        vocabulary, following, link, lengths = self.vocabulary, self.next, self.link, self.length
        state = length = 0
        before = -1
        for at in [n for n, w in enumerate(words) if w in vocabulary]:
            if at != before + 1:
                state = length = 0
            before, word = at, words[at]
            while state and word not in following[state]:
                state = link[state]
                length = lengths[state]
            state = following[state][word]
            length += 1
            yield at, state, length

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Phrase places (start, label) and covered template spans (start, end, label, share of the template)."""
        places: list[tuple[int, str]] = []
        runs: list[tuple[int, int, int]] = []  # (end, length, state) of runs that cannot grow
        last = None
        for at, state, length in self.statistics(words):
            for size, number in self.phrase[state]:
                if size <= length:
                    places.append((at + 1 - size, self.phrases[number][0]))
            if last and (at != last[0] or length != last[1] + 1):
                if last[1] >= LEAST:
                    runs.append(last)
            last = (at + 1, length, state)
        if last and last[1] >= LEAST:
            runs.append(last)
        return sorted(places), self._chains(runs)

    def _chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Chains of runs per template; a run joins the open chain it follows most closely, or opens one."""
        chains: dict[int, list[list[int]]] = {}  # template: [text start, text end, template end, words covered]
        spans = []

        def close(number: int, chain: list[int]) -> None:
            label, words = self.templates[number]
            if chain[3] >= COVERED * len(words):
                spans.append((chain[0], chain[1], label, min(1.0, chain[3] / len(words))))

        for end, length, state in runs:
            for number, upto in self.ends[state]:
                start, begin = end - length, upto - length
                going = chains.setdefault(number, [])
                for chain in [c for c in going if start - c[1] > GAP]:
                    going.remove(chain)
                    close(number, chain)
                # A run may begin with words the chain has; they count once.
                fit = [c for c in going if upto > c[2] and end > c[1] and begin - c[2] <= GAP]
                if fit:
                    best = max(fit, key=lambda c: c[2])
                    best[3] += min(length, upto - best[2], end - best[1])
                    best[1], best[2] = end, upto
                else:
                    going.append([start, end, upto, length])
        for number, going in chains.items():
            for chain in going:
                close(number, chain)
        return sorted(set(spans))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, spans, score) per row.

    places: array of (start, label) of every phrase; spans: array of (first, end,
    label, covered); score: the largest covered share, 1 where a phrase stands.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(phrases, templates)
        for batch in batches:
            counts, places, spans = [], [], []
            for text in batch.column(1).to_pylist():
                words = common.words_of(text)
                found = automaton.scan(words)
                counts.append(len(words))
                places.append([{"start": s, "label": x} for s, x in found[0]])
                spans.append([{"first": a, "end": b, "label": x, "covered": c} for a, b, x, c in found[1]])
            place = pa.struct([("start", pa.int64()), ("label", pa.string())])
            span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())])
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(place)),
                                   pa.array(spans, pa.list_(span))], names=["doc_id", "n_words", "places", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, n_words long, places array<struct<start: long, label: string>>,"
             " spans array<struct<first: long, end: long, label: string, covered: double>>")
    covered = F.coalesce(F.array_max("spans.covered"), F.lit(0.0))
    return rows.withColumn("score", F.when(F.size("places") > 0, F.lit(1.0)).otherwise(covered))
