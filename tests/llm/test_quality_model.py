import zlib

import numpy as np
import pytest

from basketry.llm import quality_model as qm
from basketry.llm import queries
from basketry.llm.suffix_dedup import Hasher


def plain(text):
    """Passages of a text without numpy tricks: word lists."""
    words = text.split()
    return [words[i : i + qm.PASSAGE] for i in range(0, len(words), qm.PASSAGE)] or [[]]


def test_passages():
    texts = [b"", b"one two two\nthree ", b" \n", ("été " * 300).encode(), b"x" * 5000, b"a b " * 128]
    own, x = qm.passages(Hasher(), texts)
    at = 0
    for d, text in enumerate(texts):
        for words in plain(text):
            assert own[at] == d
            row = x[at]
            n = max(len(words), 1)
            pairs = set(zip(words, words[1:]))
            assert row[256] == pytest.approx(sum(map(len, words)) / n / 10, rel=1e-5)
            assert row[257] == pytest.approx(len(set(words)) / n) and row[260] == pytest.approx(np.log1p(len(words)))
            assert row[258] == pytest.approx(len(pairs) / max(len(words) - 1, 1))
            assert (row[:256] ** 2).sum() == pytest.approx(1 if text else 0, abs=1e-5)
            at += 1
    assert at == len(own)


def test_gradient():
    rng = np.random.default_rng(0)
    own = np.repeat([0, 1, 2], [2, 4, 1])
    x, label = rng.normal(size=(7, qm.WIDTH)), np.array([1.0, 0.0, 1.0])
    sizes = {"encode": (qm.WIDTH, qm.HIDDEN), "shift": qm.HIDDEN, "value": (qm.HIDDEN, qm.GATE), "gate": (qm.HIDDEN, qm.GATE), "attend": qm.GATE, "score": qm.HIDDEN, "bias": 1}
    model = qm.AttentionModel({k: rng.normal(0, 0.2, s) for k, s in sizes.items()} | {"mean": np.zeros(qm.WIDTH), "scale": np.ones(qm.WIDTH)})

    def loss():
        p = model.score(own, x)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for name, g in model._gradient(own, x, label).items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        was = model.w[name][at]
        model.w[name][at] = was + 1e-5
        up = loss()
        model.w[name][at] = was - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-8)
        model.w[name][at] = was
    assert np.bincount(own, weights=model.attention(own, x)) == pytest.approx([1, 1, 1])


def test_learns_from_whole_texts(spark, monkeypatch):
    texts = {1: "good plain words " * 5000, 2: "bad " * 100, 3: "a b c d " * 900}
    docs = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    seen = {}

    def fit(read, sizes, label):
        seen.update(rows=[read(i) for i in range(len(sizes))], sizes=list(sizes), label=list(label))

    monkeypatch.setattr(qm.AttentionModel, "fit", fit)
    qm.train(docs, labels)
    used = [i for i in sorted(texts) if zlib.crc32(str(i).encode()) % 5]
    assert 1 in used and 3 in used and seen["label"] == [i % 2 for i in used]
    for i, rows, size in zip(used, seen["rows"], seen["sizes"]):
        want = qm.passages(Hasher(), [texts[i].encode()])[1]
        want = np.repeat(want, 2, axis=0) if i == 3 else want  # the repeated row is in the same bag
        assert size == len(want) and np.array_equal(rows, want), i


def test_blocks_add_up(monkeypatch):
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(n, qm.WIDTH)).astype("f4") for n in (1, 50, 3, 7, 20, 2)]
    sizes, label = np.array([len(v) for v in x]), np.array([1.0, 0, 1, 0, 1, 1])
    whole = qm.AttentionModel.fit(x.__getitem__, sizes, label)
    monkeypatch.setattr(qm, "FIT_BLOCK", 10)
    assert [list(p) for p, _, _ in qm._blocks(x.__getitem__, sizes, np.arange(6))] == [[0], [1], [2, 3], [4], [5]]
    parts = qm.AttentionModel.fit(x.__getitem__, sizes, label)
    own, rows = np.repeat(np.arange(6), sizes), np.concatenate(x)
    assert parts.score(own, rows) == pytest.approx(whole.score(own, rows), abs=1e-4)


def test_query_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.QUERIES["op4_quality"](spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    test = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r.doc_id].held_out]
    right = np.mean([r.predicted == q for r, q in test])
    good, bad = [r.score for r, q in test if q], [r.score for r, q in test if not q]
    area = np.mean([[a > b for b in bad] for a in good])
    assert len(bad) > 50 and right > 0.97 and area > 0.98, (right, area)


def test_reruns_agree(spark, base):
    run = lambda: sorted((r.doc_id, r.score) for r in queries.QUERIES["op4_quality"](spark, base).collect())
    assert run() == run()


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 0, 1), (6, 1, 0), (None, 1, 0), (2, None, 0), (1, 1, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    model = qm.train(odd, labels)
    rows = qm.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert qm.train(odd, labels.limit(0)) is None and qm.train(odd.limit(0), labels) is None
    assert {r.score for r in qm.score(odd, None).collect()} == {0.5}
    assert qm.score(odd.limit(0), model).count() == 0
