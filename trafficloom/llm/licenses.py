"""License scans with a positional index of template words.

Document counts over all documents give every template word an IDF. Of each template the words of highest IDF are indexed, as
many as it takes for the rest to weigh less than a match needs: whatever stands in a file with enough of a template's weight
agrees with it on an indexed word. A file's words are looked up in these postings (template, position). File
position minus template position gives the places where the template could stand; those are compared with the template as a
whole, and its key phrases must stand there before it gets the label. The base phrases are searched in the whole text besides.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.texts import emitted, narrow, rows_of

# The base phrases with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening sentences of public licences, each with the phrases that must be there.
TEMPLATES = {
    "apache-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        ["apache license", "in compliance with the license"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ["source and binary forms", "following conditions are met"],
    ),
    "cc0": (
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of "
        "his or her rights to the work worldwide",
        ["dedicated the work to the public domain"],
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        ["gnu general public license", "free software foundation"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee is hereby granted"],
    ),
    "lgpl-notice": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation",
        ["gnu lesser general public license"],
    ),
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ["free of charge to any person obtaining a copy"],
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license",
        ["mozilla public license"],
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ["released into the public domain"],
    ),
}
MIN_VOTES = 3
MIN_SCORE = 0.6
_RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
)
# A-Z in lower case; ASCII that is neither letter nor digit separates words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Index:
    """Templates with word weights; small and of fixed size, as the templates are."""

    def __init__(self, templates: Mapping[str, tuple[str, list[str]]], idf: Mapping[bytes, float]) -> None:
        self.labels = list(templates)
        self.texts = [words(t.encode()) for t, _ in templates.values()]
        self.phrases = [[b" " + b" ".join(words(p.encode())) + b" " for p in ps] for _, ps in templates.values()]
        self.idf = dict(idf)
        self.totals = [sum(self.idf[w] for w in ws) or 1.0 for ws in self.texts]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.texts):
            for word in self._rare(t):
                self.postings[word].extend((t, at) for at, w in enumerate(ws) if w == word)

    def _rare(self, t: int) -> list[bytes]:
        """The words of highest IDF without which a template keeps less than MIN_SCORE of its weight."""
        counts, left, out = Counter(self.texts[t]), self.totals[t], []
        for word in sorted(counts, key=lambda w: (-self.idf[w], w)):
            # a little more than needed, for sums that are rounded
            if left < (MIN_SCORE - 1e-9) * self.totals[t]:
                break
            out.append(word)
            left -= counts[word] * self.idf[word]
        return out

    def labelled(self, found: list[bytes]) -> tuple[set[str], float]:
        """Labels of the templates that stand in the words, and the best share of a template's weight."""
        if self.postings.keys().isdisjoint(found):
            return set(), 0.0
        places = {
            (t, at - position) for at, word in enumerate(found) if word in self.postings for t, position in self.postings[word]
        }
        labels, best = set(), 0.0
        for t, shift in places:
            template = self.texts[t]
            start = max(0, shift)
            window = found[start : max(0, shift + len(template))]
            agreed = [a for a, b in zip(template[start - shift :], window, strict=False) if a == b]
            score = min(1.0, sum(self.idf[a] for a in agreed) / self.totals[t])
            if score < MIN_SCORE or len(agreed) < min(MIN_VOTES, len(template)):
                continue
            line = b" " + b" ".join(window) + b" "
            if all(p in line for p in self.phrases[t]):
                labels.add(self.labels[t])
                best = max(best, score)
        return labels, best


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """(word, n): documents that hold each word of the vocabulary, and under the null word all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes | None] = Counter()
        for (text,) in rows_of(batches, "text"):
            counts[None] += 1
            counts.update(vocabulary.intersection(words(text)))
        return emitted("word binary, n long", iter(counts.items()))

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _base(found: list[bytes], phrases: list[tuple[bytes, str, int]]) -> tuple[list[int], set[str]]:
    line = b" " + b" ".join(found) + b" "
    places, labels = [], set()
    for phrase, label, _ in phrases:
        at, counted, before = line.find(phrase), 0, 0
        while at >= 0:
            before, counted = before + line.count(b" ", counted, at), at
            places.append(before)
            labels.add(label)
            at = line.find(phrase, at + 1)
    return places, labels


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, tuple[str, list[str]]] = TEMPLATES,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of `docs`.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest (null without any).
    labels holds the base labels and those of templates found; score is the best template score, 1.0 where a base phrase
    stands, else 0.0. Null text is empty (no words, no labels); repeated rows and null ids are scanned like any other.
    The counts behind the IDF cover all documents; what comes to the driver is one number per template word.
    """
    rows = narrow(docs, id_col, text_col)
    vocabulary = frozenset(w for t, _ in templates.values() for w in words(t.encode()))
    counts = {bytes(r["word"]) if r["word"] is not None else None: r["n"] for r in document_counts(rows, vocabulary).collect()}
    total = counts.get(None, 0)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1e-9 for w in vocabulary}
    index = Index(templates, idf)
    phrases = [(b" " + p.encode() + b" ", label, len(p.split())) for p, label in BASE_PHRASES.items()]
    rare_first = [p.split()[0] for p, _, _ in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scanned() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                found = words(text)
                low = text.translate(_WORDS)
                places, base = _base(found, phrases) if any(w in low for w in rare_first) else ([], set())
                labels, score = index.labelled(found)
                yield (
                    doc_id,
                    len(found),
                    len(places),
                    min(places, default=None),
                    max(places, default=None),
                    ",".join(sorted(base)),
                    ",".join(sorted(base | labels)),
                    1.0 if base else score,
                )

        return emitted(_RESULT, scanned())

    return rows.mapInArrow(run, _RESULT)
