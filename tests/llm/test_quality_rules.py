import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.llm import quality_rules as qr
from basketry.llm import queries
from basketry.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    w = re.findall(WORD, text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), r
        assert not (r.base_failed and r.kept)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_quality"](spark, folder).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_junk_goes_and_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.QUERIES["op7_quality"](spark, folder).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(rows[i].kept, q) for i, q in label.items() if not rows[i].base_failed]
    assert sum(k for k, q in judged if q) / sum(1 for _, q in judged if q) > 0.99
    assert sum(not k for k, q in judged if not q) / sum(1 for _, q in judged if not q) > 0.95


TEXTS = [
    None, "", " \n\t ", "a b c d e a b c d e", "a b c d e f a b c d e", "a a a a a a a a a a a a", "x " * 20_000,
    "one\none\n one\n\n\none\ttwo\x0b\n", "é\u00a0b \x1c # | <é> 5%", "l1 a b c d e f g h i\n" * 3 + "tail",
]


def test_cases(docs_frame):
    docs = docs_frame([(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    check(qr.judge(docs).collect(), dict(enumerate(TEXTS)))


def test_thresholds_follow_language_and_source(docs_frame):
    """The same text is odd among others and usual among its like."""
    plain, odd = "word " * 3 + "and some more words that never come back", "Word%% and### other$$ things&& with** marks|| all<< over>> the%% place##"
    rows = [(i, f"{plain} n{i}", "en", "plain") for i in range(300)] + [(1000 + i, f"{odd} n{i}", "en", "marked") for i in range(300)]
    rows += [(2000, f"{odd} x", "en", "plain"), (2001, f"{plain} x", "en", "marked"), (2002, f"{odd} y", None, None)]
    kept = {r.doc_id: r.kept for r in qr.judge(docs_frame(rows)).collect()}
    assert kept[0] and kept[1000] and kept[2001] and not kept[2000]


def test_fences_have_two_sides_and_no_fixed_distance(docs_frame):
    """Long words are odd where words are short, short ones where they are long; distances come from the rows."""
    tail = "one two three four five six seven eight nine ten eleven"
    short = [(i, f"a{i % 7} b{i % 11} {tail[: 40 + i % 9]} {i}", "en", "short") for i in range(200)]
    long = [(1000 + i, " ".join(f"{'w' * (11 + (i + k) % 4)}{k}" for k in range(14)), "en", "long") for i in range(200)]
    odd = [(5000, " ".join(f"{'w' * 12}{k}" for k in range(14)), "en", "short"), (5001, " ".join(f"w{k}" for k in range(14)), "en", "long")]
    kept = {r.doc_id: r.kept for r in qr.judge(docs_frame(short + long + odd)).collect()}
    assert not kept[5000] and not kept[5001] and sum(kept.values()) >= 398


def test_a_few_occurrences_are_never_odd(docs_frame):
    """Among texts without symbols, one with as many as ``FENCE`` stays and one with many goes."""
    plain = "word and some more words that never come back in this text at all"
    rows = [(i, f"{plain} n{i}", "en", "s") for i in range(300)]
    rows += [(1000, f"{plain} # $ %", "en", "s"), (1001, f"{plain} " + "# $ % & " * 4, "en", "s")]
    kept = {r.doc_id: r.kept for r in qr.judge(docs_frame(rows)).collect()}
    assert kept[1000] and not kept[1001] and all(kept[i] for i in range(300))


def test_sketches_merge(spark):
    values = spark.range(5000).select(((F.col("id") * 7919) % 4001).alias("v"))
    error = values.select(F.col("v"), qr.bucket(F.col("v")).alias("b")).collect()
    assert all(r.b <= r.v and r.v - r.b <= r.v / 32 for r in error) and all(r.b == r.v for r in error if r.v < 64)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    valued = materialize(qr.values(qr.measure(docs)), "valued")
    both = qr.sketch(valued.filter("doc_id % 2 = 0")).union(qr.sketch(valued.filter("doc_id % 2 = 1")))
    merged = both.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, merged.collect())) == sorted(map(str, qr.sketch(valued).collect()))


def test_odd_rows(odd):
    out = qr.judge(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert {r.size for r in out.select("size").collect()} == {"extra"}
    assert qr.judge(odd.limit(0)).count() == 0


@pytest.mark.parametrize("column", list(qr.MEASURES))
def test_clashing_columns(docs_frame, column):
    docs = docs_frame([(1, "a b c", "en", "s")]).withColumn(column, F.lit("mine")).withColumn("kept", F.lit("old"))
    row = qr.judge(docs).first()
    assert row[column] == "mine" and row.kept is False


def test_stays_in_the_engine(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    valued = qr.values(qr.measure(docs))
    for frame in (qr.judge(docs), valued, qr.fences(qr.sketch(materialize(valued, "valued")))):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "NestedLoop" not in text
