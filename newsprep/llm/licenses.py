"""License scans: matching statistics of every text against a generalised suffix automaton of licence tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, texts

#: Phrases that name a licence, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and grants as their licences word them, with labels.
TEMPLATES = (
    ("mit-notice", "released under the mit license"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights to use "
     "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
     "is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the software"),
    ("apache-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
     "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
     "any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later version this "
     "program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
     "merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following "
     "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
     "disclaimer in the documentation and or other materials provided with the distribution"),
)
#: Words of a match that may be chained, words that a chain may skip, and the share of a template that a span must cover.
LEAST, GAP, COVER = 3, 8, 0.7


class Automaton:
    """Suffix automaton of several token sequences; every state knows where in the templates its strings end."""

    def __init__(self, sequences: Sequence[tuple[str, ...]]):
        self.next, self.link, self.len = [{}], [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(sequences):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((number, i + 1))
        # Ends are passed down the suffix links, longest states first: bounded by the templates.
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]
        self.ends = [sorted(set(x)) for x in self.ends]

    def _extend(self, p: int, word: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        if word in nxt[p]:
            q = nxt[p][word]
            return q if length[q] == length[p] + 1 else self._clone(p, q, word)
        cur = len(length)
        nxt.append({}); link.append(0); length.append(length[p] + 1); self.ends.append([])  # noqa: E702
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
        return cur

    def _clone(self, p: int, q: int, word: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(length)
        nxt.append(dict(nxt[q])); link.append(link[q]); length.append(length[p] + 1); self.ends.append([])  # noqa: E702
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def statistics(self, words: Sequence[str]) -> Iterator[tuple[int, int, int]]:
        """End, length and state of the longest match that ends at each word that the automaton knows."""
        nxt, link, length, known = self.next, self.link, self.len, self.next[0]
        v = matched = 0
        for i, word in enumerate(words):
            if word not in known:
                v = matched = 0
                continue
            while word not in nxt[v]:
                v = link[v]
                matched = length[v]
            v = nxt[v][word]
            matched += 1
            yield i, matched, v


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        self.sizes = [len(x.split()) for x in [*(p for p, _ in phrases), *(t for _, t in templates)]]
        self.n = len(phrases)
        self.automaton = Automaton([tuple(x.split()) for x in [*(p for p, _ in phrases), *(t for _, t in templates)]])
        # A phrase ends at a word if its own state is the match's state or on its suffix links.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.automaton.len]
        whole = {}
        for k, (phrase, _) in enumerate(phrases):
            v = 0
            for word in phrase.split():
                v = self.automaton.next[v][word]
            whole.setdefault(v, []).append(k)
        for v in sorted(range(1, len(self.automaton.len)), key=self.automaton.len.__getitem__):
            self.phrases[v] = [(k, self.sizes[k]) for k in whole.get(v, [])] + self.phrases[self.automaton.link[v]]

    def scan(self, text: bytes) -> dict:
        words = text.translate(PLAIN).decode("latin-1").split(" ")
        words = [w for w in words if w]
        base: list[tuple[int, int]] = []
        spans: list[dict] = []
        chains: dict[int, list[int]] = {}  # template: words covered, start and end in the text, end in the template

        def close(k: int) -> None:
            covered, start, end, _ = chains.pop(k)
            if covered >= COVER * self.sizes[k]:
                spans.append({"label": self.labels[k], "start": start, "end": end, "cover": min(1.0, covered / self.sizes[k])})

        def chain(end: int, length: int, state: int) -> None:
            for k, at in self.automaton.ends[state]:
                if k < self.n:
                    continue
                if k in chains:
                    old = chains[k]
                    new = min(length, at - old[3], end + 1 - old[2])  # words that this match adds in both orders
                    if new > 0 and end + 1 - length - old[2] <= GAP:
                        chains[k] = [old[0] + new, old[1], end + 1, at]
                        continue
                    if end + 1 - length - old[2] <= GAP and at <= old[3] and at - length > 0:
                        continue  # a second place of the same words inside the template
                    close(k)
                chains[k] = [length, end + 1 - length, end + 1, at]

        last = (-2, 0, 0)
        for i, length, state in self.automaton.statistics(words):
            for k, size in self.phrases[state]:
                if length >= size:
                    base.append((i + 1 - size, k))
            if last[1] >= LEAST and not (i == last[0] + 1 and length == last[1] + 1):
                chain(*last)  # the match before was maximal
            last = (i, length, state)
        if last[1] >= LEAST:
            chain(*last)
        for k in list(chains):
            close(k)
        spans.sort(key=lambda s: (s["start"], s["end"], s["label"]))
        return {"n_words": len(words), "base": base, "spans": spans}


RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))),
])


def scan_licenses(docs: DataFrame, text_col: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with a struct ``into``: places of the phrases, labels, score, and the covered template spans in words.

    ``labels`` are those of the phrases and of the templates of which a span covers ``COVER`` or
    more; ``score`` is the best cover, 1 where a phrase stands, else 0 to 1. Null and empty texts have
    no words and no labels. Each row stands for itself; an existing column ``into`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for x in batches:
            rows = []
            for text in texts(x.column(text_col)):
                r = scanner.scan(text)
                starts = [s for s, _ in r["base"]]
                names = {scanner.labels[k] for _, k in r["base"]}
                rows.append({
                    "n_words": r["n_words"], "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(names)), "labels": ",".join(sorted(names | {s["label"] for s in r["spans"]})),
                    "score": 1.0 if starts else max((s["cover"] for s in r["spans"]), default=0.0), "spans": r["spans"],
                })
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(rows, RESULT)], names=[*x.schema.names, into])

    docs = docs.drop(into)
    kind = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double, spans: array<struct<label: string, start: bigint, end: bigint, cover: double>>>"
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{into}` {kind}"]))
