"""Licence scan against a plain version that tries every template at every place."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import license_index as li
from basketry.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(words):
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return places, labels


def idf_of(texts):
    sets = [set(words_of(t)) for t in texts]
    return lambda w: math.log((len(sets) + 1) / (sum(w in s for s in sets) + 1)) + 1


def plain_labels(words, idf, templates):
    """Labels and the best share: every template, every place, by the definition."""
    labels, top = set(), 0.0
    for label, text, phrases in templates:
        notice = words_of(text)
        rare = set(sorted(dict.fromkeys(notice), key=lambda w: (-idf(w), notice.index(w)))[: li.RARE])
        need = max(2, math.ceil(li.AGREE * len(rare)))
        stands = lambda at, k, some: any(
            at + k + s >= 0 and words[at + k + s : at + k + s + len(some)] == some for s in range(-li.SLACK, li.SLACK + 1)
        )
        for at in range(-len(notice), len(words)):
            if not any(w in rare and 0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(notice)):
                continue  # places are those of an indexed word
            if len({w for k, w in enumerate(notice) if w in rare and stands(at, k, [w])}) < need:
                continue
            placed = []
            for phrase in map(words_of, phrases):
                k = next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)
                placed.append(stands(at, k, phrase))
            share = sum(idf(w) for k, w in enumerate(notice) if stands(at, k, [w])) / sum(map(idf, notice))
            if all(placed) and share >= li.MATCH:
                labels.add(label)
                top = max(top, share)
    return labels, top


def check(row, text, idf, templates=li.TEMPLATES):
    words = words_of(text)
    places, base = plain_base(words)
    assert (row.n_words, row.n_base) == (len(words), len(places))
    assert (row.first_word, row.last_word) == ((min(places), max(places)) if places else (None, None))
    assert row.base_labels == ",".join(sorted(base))
    if len(words) < 2000 or places:
        labels, top = plain_labels(words, idf, templates)
        assert row.labels == ",".join(sorted(base | labels))
        assert row.score == pytest.approx(1.0 if base else min(1.0, top), abs=1e-9)


def test_whole_table(spark):
    base = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = queries.op12_licenses(spark, base).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    idf = idf_of(texts.values())
    for r in rows:
        check(r, texts[r.doc_id], idf)


def test_planted_lines_are_found(spark):
    base = "/root/testdata/sf0.01"
    lines = {
        "gnu general public license, version 3": "gpl-3.0",
        "released under the mit license": "mit",
        "licensed under cc by-nc 4.0": "cc-by-nc-4.0",
        "licensed under the apache license, version 2.0": "apache-2.0",
    }
    docs = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in queries.op12_licenses(spark, base).collect()}
    for doc_id, text in docs.items():
        want = {label for line, label in lines.items() if line in text}
        assert got[doc_id] - set(PHRASES.values()) == want
    assert sum(map(bool, got.values())) > 10


def test_odd_rows(spark, odd):
    rows = li.scan(odd).collect()
    assert len(rows) == odd.count()
    texts = [r.text for r in odd.collect()]
    idf = idf_of(texts)
    for row, text in zip(rows, texts):
        check(row, text, idf)
    empty = [r for r in rows if r.n_words == 0]
    assert len(empty) == 3 and all(r.labels == r.base_labels == "" and r.first_word is None and r.notices == [] and r.score == 0 for r in empty)
    assert li.scan(odd.limit(0)).count() == 0


def test_edited_notices(spark, docs_frame):
    """Words put in or left out shift places by less than the slack; mandatory phrases must stay."""
    apache = "Licensed under the Apache License, Version 2.0"
    texts = [
        "x y z " * 50 + apache + " and more " * 40,
        "licensed  (very much) under  the APACHE license; version 2.0!",
        "the apache software is under a license, version 2.0",  # no mandatory phrase
        "Permission is hereby granted, free of charge, to any person getting a copy of this software and its associated "
        "documentation files, to deal in the software without restriction",
        "general public license CC-BY all rights reserved ALL RIGHTS RESERVED",
        "one text of clean words that has a license to version 2 of nothing",
        (apache + "\n") * 300,
        "été " + apache.replace(" ", "é"),
    ]
    docs = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows = {r.doc_id: r for r in li.scan(docs_frame(docs)).collect()}
    assert [rows[i].labels for i in range(8)] == ["apache-2.0", "apache-2.0", "", "mit", "cc-by,gpl,reserved", "", "apache-2.0", ""]
    assert (rows[4].n_base, rows[4].first_word, rows[4].last_word) == (4, 0, 8)
    assert [n.word for n in rows[0].notices] == [150]
    assert [n.word for n in rows[6].notices] == [8 * i for i in range(300)]
    idf = idf_of(texts)
    for i, text in enumerate(texts[:6]):
        check(rows[i], text, idf)


SMALL = (("ab", "a b c d e f g h", ("b c",)), ("ab", "h g f", ("g f",)), ("x", "x a x b", ("x b",)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefghx"), max_size=24))
def test_any_words(words):
    texts = [" ".join(words), "a b", "c x"]
    idf = idf_of(texts)
    known = {w: idf(w) for t in texts for w in t.split()}
    index = li.RareTokenIndex(SMALL, {w.encode(): x for w, x in known.items()}, math.log(4) + 1)
    bytes_ = [w.encode() for w in words]
    found = index.notices(bytes_, [i for i, w in enumerate(bytes_) if w in index.postings])
    labels, top = plain_labels(words, idf, SMALL)
    assert {f[0] for f in found} == labels
    assert max((f[2] for f in found), default=0.0) == pytest.approx(top)


def test_frequencies_count_documents(spark, docs_frame):
    n, found = li.document_frequencies(docs_frame([(1, "License license MIT"), (2, None), (3, "the license"), (3, "the license")]))
    assert n == 4 and found == {b"license": 3, b"mit": 1, b"the": 2}
