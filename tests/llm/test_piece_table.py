"""Fill-in-the-middle arrangement against a plain version with regular expressions on strings."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from basketry.llm import piece_table as pt
from basketry.llm import queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the rules, on strings."""
    text = text or ""
    digest = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    assert "".join(tokens) == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(got, doc_id, text):
    n, form, prefix, middle, output = plain(doc_id, text)
    assert (got.doc_id, got.n, got.form, got.prefix_chars, got.middle_chars) == (doc_id, n, form, prefix, middle)
    assert got.output_sha256 == sha(output) and got.restored_sha256 == sha(text or "")


def test_whole_table(spark):
    base = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = queries.op11_fim(spark, base).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        check(r, r.doc_id, texts[r.doc_id])
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd):
    rows = pt.digest(odd).collect()
    want = sorted((str(r.doc_id), *map(str, plain(r.doc_id, r.text)[:4]), sha(r.text or "")) for r in odd.collect())
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars)), r.restored_sha256) for r in rows) == want
    assert pt.digest(odd.limit(0)).count() == 0


def test_outputs_are_real_texts(spark, docs_frame):
    docs = [(i, f" été {'naïve ' * (i % 7)} x\x1c" + "\n" * (i % 3)) for i in range(200)] + [(900 + i, "a <M> b") for i in range(20)]
    frame = docs_frame([(i, t, "fr", "s") for i, t in docs])
    outputs = pt.transform(frame)
    texts = dict(docs)
    for r in outputs.collect():
        n, form, prefix, middle, output = plain(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.output) == (n, form, output)
        buffers = (texts[r.doc_id].encode(), b"<P><S><M>")
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode() == output
    back = pt.restore(outputs)
    assert back.columns == ["doc_id", "restored_sha256", "text"]
    assert {r.doc_id: r.text for r in back.collect()} == texts
    assert pt.restore(outputs, text=False).columns == ["doc_id", "restored_sha256"]
    assert pt.restore(outputs.limit(0)).count() == 0


TEXTS = st.text(alphabet=st.sampled_from([*" \t\n\x0b<>PSM", "a", "é", "\U0001f600", " ", "\x1c"]), max_size=40)


@given(TEXTS, st.integers(0, 10**6))
def test_round_trip(text, doc_id):
    table, form, n, *_ = pt.arranged(doc_id, text.encode(), pt.SEED, 100, pt.SPM)
    assert n == len(TOKEN.findall(text))
    assert pt.opened(table.bytes(), form).bytes() == text.encode()
    assert hashlib.sha256(table.bytes()).hexdigest() == table.sha256()


@given(st.lists(st.integers(0, 30), max_size=8), st.binary(min_size=30, max_size=30))
def test_cuts_keep_the_whole(offsets, data):
    table = pt.PieceTable.of(data)
    table.cut(*sorted(offsets[:4]))
    table.cut(*sorted(offsets[4:]))
    assert table.bytes() == data and len(table.pieces) == len(offsets) + 1
    edges = {0}
    for _, _, length in table.pieces:
        edges.add(max(edges) + length)
    assert set(offsets) <= edges


@pytest.mark.parametrize("order", pt.ARRANGEMENTS.values())
def test_inverse_undoes(order):
    table = pt.PieceTable(tuple([b"abcdef"]), [(0, i, 1) for i in range(6)])
    table.arrange(order)
    table.arrange(pt.inverse(order))
    assert table.bytes() == b"abcdef"
