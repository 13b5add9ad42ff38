"""Licence scan with a positional index of rare tokens.

Templates are short licence notices. The index holds, for each template, its words of highest IDF and
where they stand in it; IDF is counted over the whole corpus. A file's words are looked up in it; each hit
votes for the place where the template would begin. Where enough different words of a template agree on a place,
give or take ``SLACK`` words, the template's mandatory phrases are looked for at their places there,
and the share of its words that stand where they should, weighted by IDF, is its score.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ship_code

#: fixed values: phrases that count wherever their words stand in a row, and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: fixed values: label, notice, mandatory phrases
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("except in compliance with the license", "apache org licenses"),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee", "hereby granted"),
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    (
        "gpl-2.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version",
        ("gnu general public license", "version 2"),
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "version 3")),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license", "2 0"),
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    (
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution 4 0",),
    ),
    ("cc0", "To the extent possible under law, dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
)
RARE = 6  # words of a template in the index
AGREE = 0.5  # share of these that must agree on a place
SLACK = 3  # words by which places may differ
MATCH = 0.6  # share of a template's weight that must stand in place

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, notices array<struct<label: string, word: long, share: double>>"
)

#: bytes of words to themselves, A-Z to a-z, all others to blanks; letters beyond ASCII are word bytes
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[tuple[int, list[bytes]]]  # where it stands in the template, its words
    weights: list[float]
    need: int  # words of the index that must agree
    indexed: set[bytes]

    def in_place(self, words: list[bytes], at: int) -> float:
        """The share of weight of the words that stand at their place, give or take ``SLACK`` words."""
        found = 0.0
        for k, (word, weight) in enumerate(zip(self.words, self.weights)):
            if word in words[max(0, at + k - SLACK) : max(0, at + k + SLACK + 1)]:
                found += weight
        return found / sum(self.weights)

    def has_phrases(self, words: list[bytes], at: int) -> bool:
        return all(
            any(words[p : p + len(phrase)] == phrase for p in range(max(0, at + k - SLACK), max(0, at + k + SLACK + 1)))
            for k, phrase in self.phrases
        )


def _find(words: list[bytes], phrase: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


class RareTokenIndex:
    """Postings of each template's words of highest IDF; ties go to the word that comes first."""

    def __init__(self, templates, idf: dict[bytes, float], unseen: float):
        self.templates: list[Template] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (label, text, phrases) in enumerate(templates):
            words = words_of(text.encode())
            weights = [idf.get(w, unseen) for w in words]
            order = sorted(dict.fromkeys(words), key=lambda w: (-idf.get(w, unseen), words.index(w)))
            rare = set(order[:RARE])
            placed = [(_find(words, p), p) for p in (words_of(p.encode()) for p in phrases)]
            need = max(2, int(np.ceil(AGREE * len(rare))))
            self.templates.append(Template(label, words, placed, weights, need, rare))
            for k, word in enumerate(words):
                if word in rare:
                    self.postings[word].append((t, k))

    def notices(self, words: list[bytes], hits: list[int]) -> list[tuple[str, int, float]]:
        """(label, first word, share) of the templates found; ``hits`` are the places of indexed words.

        Tried are the places that an indexed word gives. Of places up to ``SLACK`` words apart the best one
        counts, the first of equal ones.
        """
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for p in hits:
            for t, k in self.postings.get(words[p], ()):
                votes[t].append((p - k, words[p]))
        found = []
        for t, cast in votes.items():
            template = self.templates[t]
            if len(cast) < template.need:
                continue
            cast.sort()
            seen: Counter[bytes] = Counter()
            begin, end, last, best = 0, 0, None, []
            for at, _ in cast:
                while end < len(cast) and cast[end][0] <= at + SLACK:
                    seen[cast[end][1]] += 1
                    end += 1
                while cast[begin][0] < at - SLACK:
                    seen[cast[begin][1]] -= 1
                    if not seen[cast[begin][1]]:
                        del seen[cast[begin][1]]
                    begin += 1
                if at != last and len(seen) >= template.need and template.has_phrases(words, at):
                    share = template.in_place(words, at)
                    if share >= MATCH:
                        best.append((at, share))
                last = at
            found += [(template.label, max(0, at), share) for at, share in _tops(best)]
        return sorted(found, key=lambda n: (n[1], n[0], -n[2]))


def _tops(places: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The best place of each run of places at most ``SLACK`` apart."""
    out, last = [], None
    for at, share in places:
        if last is not None and at - last <= SLACK:
            out[-1] = max(out[-1], (at, share), key=lambda x: x[1])
        else:
            out.append((at, share))
        last = at
    return out


def _phrases() -> list[tuple[list[bytes], str]]:
    return [(words_of(phrase.encode()), label) for phrase, label in BASE.items()]


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those that hold each word of the templates.

    Each task counts by itself and sends one row per word of the templates, so that what is shuffled
    and what reaches the driver has the size of their vocabulary, whatever the number of documents.
    """
    ship_code()
    vocabulary = frozenset(w for _, text, _ in templates for w in words_of(text.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts[b""] += 1
                counts.update(vocabulary.intersection(words_of(text.as_py() or b"")))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    counted = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "word string, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


def build_index(docs: DataFrame, templates=TEMPLATES) -> RareTokenIndex:
    """The index of the templates with IDF ``ln((n + 1) / (df + 1)) + 1`` over all documents."""
    n, frequencies = document_frequencies(docs, templates)
    idf = {w: float(np.log((n + 1) / (f + 1)) + 1) for w, f in frequencies.items()}
    return RareTokenIndex(templates, idf, float(np.log(n + 1) + 1))


def scan(docs: DataFrame, index: RareTokenIndex | None = None) -> DataFrame:
    """Every document with its licence phrases and notices, see ``SCHEMA``.

    ``notices`` are the templates found, with the word at which they begin. ``score`` is the highest share
    among them, 1 where a base phrase stands, else 0. Words are counted from 0 over the whole text. A
    null or empty text has no words, no labels (empty strings) and null places; null ids, ties and
    repeated rows are scanned like others; other columns are ignored; no rows give no rows.
    Documents are scanned one by one: nothing is shuffled, a lost task is repeated alone.
    """
    ship_code()
    index = index or build_index(docs)
    phrases = _phrases()
    first_words = {phrase[0] for phrase, _ in phrases}
    wanted = frozenset(first_words | set(index.postings))

    def row(doc_id, text: bytes) -> tuple:
        words = words_of(text)
        hits = [i for i, word in enumerate(words) if word in wanted]
        places, base = [], set()
        for i in hits:
            if words[i] in first_words:
                for phrase, label in phrases:
                    if words[i : i + len(phrase)] == phrase:
                        places.append(i)
                        base.add(label)
        notices = index.notices(words, hits) if len(hits) > 1 else []
        labels = base | {label for label, _, _ in notices}
        score = 1.0 if base else max((share for _, _, share in notices), default=0.0)
        return (
            doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), min(1.0, score), [dict(zip(("label", "word", "share"), n)) for n in notices],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [row(i, text.as_py() or b"") for i, text in zip(ids, batch.column(1).cast(pa.binary()))]
            columns = list(zip(*rows)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TYPES)], names=_NAMES)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
_TYPES = [
    *[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(),
    pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())])),
]
