"""Licence scan: matching statistics against a generalised suffix automaton of licence tokens, chained to spans.

The automaton holds the tokens of all templates and phrases. A text's tokens are streamed through it once: at each token
it gives the longest run of tokens that ends there and occurs in a template; its suffix links give the longest run of
each template, at each of its places. A template's run of MIN_MATCH tokens or more that its next token does not extend is
an anchor, whatever longer run another template has there; anchors of one template that follow each other in the text and in the template, with gaps of up to MAX_GAP
tokens, are chained. A chain that covers at least ``cover`` of its template is a span with the template's label. Phrases
are found in the same pass: a phrase stands wherever its state is among the suffixes of the current run.

Tokens that no template has end every run, so only stretches of known tokens are streamed; stretches shorter than
MIN_MATCH are skipped unless they hold the last token of a phrase.

Edge cases. Null and empty texts have no words and no spans. Rows are scanned by themselves, so repeated rows and null
doc_ids need nothing more. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIN_MATCH, MAX_GAP = 4, 24
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,end:long,share:double>>"
)

# Phrases, and the wording of public licence notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so""",
    "mit-notice": "Released under the MIT License",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at""",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version""",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met""",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


def tokens(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower() changes A-Z alone


@dataclass
class Automaton:
    """Generalised suffix automaton: states with transitions, suffix link, length, and where their runs end."""

    step: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set] = field(default_factory=lambda: [set()])
    words: dict[str, list] = field(default_factory=dict)
    phrases: list[tuple] = field(default_factory=list)
    runs: list[tuple] = field(default_factory=list)

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, p: int, c) -> int:
        """The state of p's runs followed by c, made apart from longer ones if need be."""
        q = self.step[p][c]
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c) -> int:
        if c in self.step[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, c)
        return new

    def add(self, name: str, words: list) -> None:
        last = 0
        self.words[name] = words
        for i, c in enumerate(words):
            last = self._extend(last, c)
            self.ends[last].add((name, i + 1))

    def finish(self, phrases: dict) -> None:
        """Hands ends up the suffix links; notes at each state the phrases among its suffixes, and the longest run at each
        place of a template: (template, end, next token, length, or 0 for that of the current run)."""
        by_length = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for s in by_length:
            self.ends[self.link[s]] |= self.ends[s] if self.link[s] else set()
        own = {}
        for words, label in phrases.items():
            s = 0
            for c in words:
                s = self.step[s][c]
            own[s] = (len(words), label)
        self.phrases = [()] * len(self.length)
        for s in reversed(by_length):
            self.phrases[s] = self.phrases[self.link[s]] + ((own[s],) if s in own else ())
        self.runs = [()] * len(self.length)
        for s in by_length:
            made, seen, p = [], set(), s
            while p and (p == s or self.length[p] >= MIN_MATCH):
                for name, stop in sorted(self.ends[p] - seen):
                    if name:
                        follow = self.words[name][stop] if stop < len(self.words[name]) else -1
                        made.append((name, stop, follow, 0 if p == s else self.length[p]))
                seen |= self.ends[p]
                p = self.link[p]
            self.runs[s] = tuple(made)


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], cover: float):
        split = {k: tokens(v.encode()) for k, v in templates.items()}
        spoken = {tuple(tokens(k.encode())): v for k, v in phrases.items()}
        names = {t: i for i, t in enumerate(dict.fromkeys(w for ws in [*split.values(), *spoken] for w in ws))}
        self.known, self.sizes, self.cover = names, {k: len(v) for k, v in split.items()}, cover
        self.automaton = Automaton()
        for k, ws in split.items():
            self.automaton.add(k, [names[w] for w in ws])
        for ws in spoken:
            self.automaton.add("", [names[w] for w in ws])
        self.automaton.finish({tuple(names[w] for w in ws): v for ws, v in spoken.items()})
        self.closing = {names[ws[-1]] for ws in spoken}

    def _stretches(self, ids: list) -> Iterator[tuple[int, int]]:
        at, n = 0, len(ids)
        while at < n:
            if ids[at] is None:
                at += 1
                continue
            end = at
            while end < n and ids[end] is not None:
                end += 1
            if end - at >= MIN_MATCH or any(i in self.closing for i in ids[at:end]):
                yield at, end
            at = end

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """(words, phrase places, spans of templates)."""
        words = tokens(text)
        ids = list(map(self.known.get, words))
        places: list[tuple[int, str]] = []
        anchors: dict[str, list[tuple[int, int, int]]] = {}
        a = self.automaton
        for start, end in self._stretches(ids):
            state = run = 0
            for i in range(start, end + 1):
                token = ids[i] if i < end else None
                if run >= MIN_MATCH:
                    for name, stop, follow, size in a.runs[state]:
                        if token != follow:  # the run of this template is as long as it gets
                            size = size or run
                            anchors.setdefault(name, []).append((i - size, stop - size, size))
                if i == end:
                    break
                while state and token not in a.step[state]:
                    state = a.link[state]
                    run = a.length[state]
                if token in a.step[state]:
                    state, run = a.step[state][token], run + 1
                places += [(i + 1 - size, label) for size, label in a.phrases[state] if size <= run]
        return len(words), sorted(places), [s for name, found in anchors.items() for s in self._chained(name, found)]

    def _chained(self, name: str, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Best chains, each anchor in one chain at most."""
        found = sorted(set(found))
        best: list[tuple[int, int]] = []
        for i, (at, tpl, n) in enumerate(found):
            score, prev = n, -1
            for j in range(i - 1, -1, -1):
                at2, tpl2, n2 = found[j]
                if at - at2 > MAX_GAP + self.sizes[name]:
                    break
                lag = max(0, at2 + n2 - at, tpl2 + n2 - tpl)  # overlap counts once
                if at2 < at and tpl2 < tpl and at - at2 - n2 <= MAX_GAP and tpl - tpl2 - n2 <= MAX_GAP and best[j][0] + n - lag > score:
                    score, prev = best[j][0] + n - lag, j
            best.append((score, prev))
        spans, taken = [], set()
        for i in sorted(range(len(found)), key=lambda i: (-best[i][0], i)):
            share = min(1.0, best[i][0] / self.sizes[name])
            chain, k = [], i
            while k != -1 and k not in taken:
                chain.append(k)
                k = best[k][1]
            if k != -1 or share < self.cover:
                continue
            taken.update(chain)
            spans.append((name, found[chain[-1]][0], found[i][0] + found[i][2], share))
        return spans


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, cover: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row of docs.

    score is 1 where a phrase stands, else the largest share of a template that a chain covers, spans or not reaching
    ``cover`` included, 0 without any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, cover)
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
        names = [x.strip().split()[0] for x in re.split(r", (?![^<]*>)", RESULT)]
        for batch in batches:
            text, out = batch.column(1), []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                n, places, spans = scanner.scan((text[i].as_py() or "").encode())
                base = sorted({label for _, label in places})
                labels = sorted({*base, *(s[0] for s in spans)})
                score = 1.0 if places else max([0.0, *(s[3] for s in spans)])
                first, last = (places[0][0], places[-1][0]) if places else (None, None)
                rows = [dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in spans]
                out.append((doc, n, len(places), first, last, ",".join(base), ",".join(labels), score, rows))
            for k in range(0, len(out), 1000):
                columns = [pa.array(c, t) for c, t in zip(zip(*out[k : k + 1000], strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
