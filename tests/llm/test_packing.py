import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from basketry.llm import packing, queries


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


def check(rows, docs, encode):
    assert {r.doc_id for r in rows} == {i for i, _ in docs}
    for doc_id, text in docs:
        ids = np.array(encode(text), dtype="<u4")
        pieces = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier, r.step_id))
    for parts in sequences.values():
        at = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # full windows: nothing is padded
        assert {(p[2], p[3]) for p in parts} == {(at, parts[0][3])}
    steps = {}
    for parts in sequences.values():
        steps.setdefault(parts[0][3], []).append(parts[0][2])
    assert max(map(sum, steps.values())) <= packing.STEP


def test_query(spark, base, encode):
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()
    check(queries.QUERIES["op6_packing"](spark, base).collect(), docs, encode)


def test_small_pool_makes_many_windows(spark, base, encode):
    docs = spark.read.parquet(f"{base}/documents.parquet").limit(80)
    rows = packing.pack(docs, queries.tokenizer_path(), tiers=(64, 256, 4096), pool=9000, step=8192).collect()
    check(rows, docs.select("doc_id", "text").collect(), encode)
    assert {64, 4096} <= {r.tier for r in rows}


def test_odd_rows(spark, docs_frame, odd, encode):
    rows = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), queries.tokenizer_path())
    check(rows.collect(), [(r.doc_id, r.text) for r in odd.dropDuplicates(["doc_id"]).collect() if r.doc_id], encode)
    whole = packing.pack(odd, queries.tokenizer_path()).collect()
    assert sum(r.length for r in whole) == sum(len(encode(r.text)) for r in odd.collect())


def test_no_rows(spark, odd):
    assert packing.pack(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_word_ids_after_forgetting(encode, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5)
    ids = packing.WordIds(queries.tokenizer_path())
    for text in ("one two three", "a b c d e f g h", "two, three! don't", "Ünï Å Ⅸ 3½", ""):
        assert ids(text.encode()).tolist() + [packing.END] == encode(text)


def test_word_ids_of_many_texts(encode):
    """Blanks at the edges, null and empty texts, words of many parts and long ones, in one batch."""
    import pyarrow as pa

    texts = [" a  b\t", None, "", "\n\x0b", "don't T-SHIRT x-1, (y). z.. 3,4", "w" * 300 + " é." * 5, "<|endoftext|> <|EndOfText|>", "ß. İ, K."]
    texts += [" ".join(f"word{i}ing Word{i}. {'qx' * (i % 9)}" for i in range(200))]
    ids = packing.WordIds(queries.tokenizer_path())
    for _ in range(2):
        flat, counts = ids.texts(pa.array(texts, pa.string()))
        parts = np.split(flat, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [encode(t) for t in texts]
    assert ids.folds_case and ids.cuts_marks and ids.ends_word.any()


def test_a_tokenizer_without_these_habits(tmp_path):
    """Upper case, marks that join a word and no word ends: nothing is taken for granted."""
    import pyarrow as pa
    from tokenizers import models, pre_tokenizers

    vocabulary = {"[U]": 0, "a": 1, "A": 3, "b": 4, "ab.": 5, ".": 6, "Ab": 7}
    plain = Tokenizer(models.WordLevel(vocabulary, unk_token="[U]"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    plain.save(str(tmp_path / "t.json"))
    ids = packing.WordIds(str(tmp_path / "t.json"))
    assert not ids.folds_case and not ids.cuts_marks and not ids.ends_word.any()
    text = "a A b ab. Ab . a. zz"
    assert ids(text.encode()).tolist() == plain.encode(text).ids == [1, 3, 4, 5, 7, 6, 0, 0]
    assert ids.texts(pa.array([text]))[1].tolist() == [9]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 1000)
    ids = packing.WordIds(queries.tokenizer_path())
    for i in range(20):
        ids(("x" * 400 + str(i)).encode())
        assert ids.bytes < 4000


def test_new_words_take_little_memory():
    """words are looked up some at a time and remembered without an object each."""
    import tracemalloc

    import pyarrow as pa

    words = [f"{i:x}q{i * 7919 % 99991:x}z" for i in range(40_000)]
    ids, texts = packing.WordIds(queries.tokenizer_path()), pa.array([" ".join(words)], pa.string())
    tracemalloc.start()
    try:
        before = pa.total_allocated_bytes(), tracemalloc.get_traced_memory()[0]
        counts = ids.texts(texts)[1]
        held, peak = (m - before[1] for m in tracemalloc.get_traced_memory())
        held += pa.total_allocated_bytes() - before[0]
    finally:
        tracemalloc.stop()
    tokens = int(counts[0])
    # a few numbers for each word and token, no lists of Python objects (before: 187 and 99 bytes, now 97 and 36)
    assert held < 130 * len(words)
    assert peak < 60 * tokens


def test_numbers_of_words_over_several_runs(encode, monkeypatch):
    """Words of one part and of several, in more runs than are looked up at a time, some of them known."""
    import pyarrow as pa

    monkeypatch.setattr(packing, "RUN", 3)
    monkeypatch.setattr(packing, "RUNS", 2)
    ids = packing.WordIds(queries.tokenizer_path())
    for n in (7, 40):
        texts = [" ".join(f"w{i}-x word{'abc'[i % 3] * i} <|endoftext|> é{i}." for i in range(n)), "", f"word {n}"]
        flat, counts = ids.texts(pa.array(texts, pa.string()))
        assert [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])] == [encode(t) for t in texts]
    assert len(ids.known) == ids.stored == len(ids.known.unique())


def test_batches_are_bounded_in_bytes(spark):
    """3,000 rows of 10 KB reach a worker in batches of about 4 MB; a limit of the session's own stays."""
    import pyarrow as pa

    from basketry.session import BATCH_BYTES

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 1200) as text")
    before = spark.conf.get(BATCH_BYTES, None)
    try:
        spark.conf.unset(BATCH_BYTES)
        packing.pack(docs, queries.tokenizer_path())
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 5 << 20
        spark.conf.set(BATCH_BYTES, "1MB")
        packing.pack(docs, queries.tokenizer_path())
        assert spark.conf.get(BATCH_BYTES) == "1MB"
    finally:
        spark.conf.unset(BATCH_BYTES)
        if before is not None:
            spark.conf.set(BATCH_BYTES, before)
