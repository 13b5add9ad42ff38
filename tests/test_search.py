"""Top-k joins against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import ann, index
from basketry.operators.search import DenseScore, top_k_join
from basketry.session import materialize


def vectors(n, seed, dims=8, copies=0):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, dims)).astype(np.float32)
    out[: copies] = out[0]
    return out


def frame(spark, m, key="id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return index.with_norm(spark.createDataFrame(rows, f"{key} long, embedding array<float>").repartition(3))


def brute(q, d, k, allowed=None):
    q, d = q.astype(np.float64), d.astype(np.float64)
    s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (d / np.linalg.norm(d, axis=1)[:, None]).T
    s = np.round(s, 6)
    out = {}
    for i in range(len(q)):
        ids = [j for j in range(len(d)) if allowed is None or allowed(i, j)]
        ids.sort(key=lambda j: (-s[i, j], j))
        out[i] = [(j, float(s[i, j])) for j in ids[:k]]
    return out


def collected(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def close(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert [x[0] for x in a[key]] == [x[0] for x in b[key]]
        assert [x[1] for x in a[key]] == pytest.approx([x[1] for x in b[key]], abs=1e-9)


@pytest.mark.parametrize("copies", [0, 60])
@pytest.mark.parametrize("max_broadcast", [1000, 0])
def test_dense_exact(spark, copies, max_broadcast):
    q, d = vectors(25, 1), vectors(180, 2, copies=copies)
    hits = index.search_vectors(
        frame(spark, q, "query_id"), frame(spark, d), 5, max_broadcast=max_broadcast, query_block=10, index_block=40
    )
    close(collected(hits), brute(q, d, 5))


def test_fewer_rows_than_k_and_no_queries(spark):
    q, d = vectors(3, 1), vectors(2, 2)
    close(collected(index.search_vectors(frame(spark, q, "query_id"), frame(spark, d), 5)), brute(q, d, 5))
    none = frame(spark, q, "query_id").filter("false")
    assert index.search_vectors(none, frame(spark, d), 5).count() == 0


def test_rows_without_a_vector_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None)]
    d = index.with_norm(spark.createDataFrame(rows, "id long, embedding array<float>"))
    q = d.withColumnRenamed("id", "query_id")
    for limit in (10, 0):
        hits = index.search_vectors(q, d, 5, max_broadcast=limit).collect()
        assert [(r.query_id, r.id) for r in hits] == [(1, 1)]


def test_many_bytes_of_queries_are_not_broadcast(spark, monkeypatch):
    from basketry.operators import search

    q, d = vectors(10, 5), vectors(60, 6)
    few = index.search_vectors(frame(spark, q, "query_id"), frame(spark, d), 3)
    monkeypatch.setattr(search, "MAX_BROADCAST_BYTES", 100)
    many = index.search_vectors(frame(spark, q, "query_id"), frame(spark, d), 3)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (few, many)]
    assert "MapInArrow" in plans[0] and "MapInArrow" not in plans[1] and "CoGroup" in plans[1]
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)
    close(collected(few), collected(many))


def test_payload_and_string_ids(spark):
    rows = [("b", "text b", [1.0, 0.0]), ("a", "text a", [1.0, 0.0]), ("c", "text c", [0.0, 1.0])]
    d = index.with_norm(spark.createDataFrame(rows, "id string, text string, embedding array<float>"))
    q = index.with_norm(spark.createDataFrame([("x", [2.0, 0.0])], "query_id string, embedding array<float>"))
    for limit in (10, 0):
        found = index.search_vectors(q, d, 2, ("text",), max_broadcast=limit).collect()
        assert {(r["rank"], r.id) for r in found} == {(1, "a"), (2, "b")}
    hits = index.search_vectors(q, d, 2, ("text",)).orderBy("rank").collect()
    assert [(r.id, r.text, r.score) for r in hits] == [("a", "text a", 1.0), ("b", "text b", 1.0)]


def test_query_key_must_differ(spark):
    d = frame(spark, vectors(3, 1))
    with pytest.raises(ValueError):
        top_k_join(d, d, 1, DenseScore(), query_id="id")


def test_indexed_vector_finds_itself(spark):
    d = vectors(50, 4)
    hits = index.search_vectors(frame(spark, d, "query_id"), frame(spark, d), 1).collect()
    assert all(r.query_id == r.id and r.score == 1.0 for r in hits) and len(hits) == 50


def words(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def brute_tfidf(docs, queries, k):
    n = len(docs)
    df = Counter(t for text in docs.values() for t in set(words(text)))
    idf = {t: math.log((n + 1) / (c + 1)) + 1 for t, c in df.items()}

    def vec(text):
        v = {t: c * idf[t] for t, c in Counter(words(text)).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    d = {i: vec(t) for i, t in docs.items()}
    out = {}
    for qid, text in queries.items():
        q = vec(text)
        scores = [(round(sum(w * v[t] for t, w in q.items() if t in v), 6), i) for i, v in d.items()]
        best = sorted([(-s, i) for s, i in scores if any(t in d[i] for t in q)])[:k]
        if best:
            out[qid] = [(i, -s) for s, i in best]
    return out


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    return {i: " ".join(f"w{min(rng.randint(0, vocabulary), rng.randint(0, vocabulary))}" for _ in range(rng.randint(1, 30))) for i in range(n)}


def text_index(spark, docs, keep=True):
    return index.TextIndex.build(spark.createDataFrame(list(docs.items()), "doc long, body string"), "doc", "body", keep)


def asked_of(spark, queries):
    return spark.createDataFrame(list(queries.items()), "query_id long, text string")


@pytest.mark.parametrize("keep", [True, False])
@pytest.mark.parametrize("max_bytes", [0, 10**9])
@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_text_search(spark, broadcast, max_bytes, keep):
    docs, queries = corpus(1, 150), corpus(2, 30, 80)
    docs[200] = docs[201] = docs[0]  # copies
    docs[202] = "Straße, ÉTÉ; straße!"
    docs[300] = None
    queries[40] = "straße"
    queries[41] = "unknown words only"
    queries[42] = None
    built, asked = text_index(spark, docs, keep), asked_of(spark, queries)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        hits = built.search(asked, 5, max_bytes=max_bytes)
        found, plan = collected(hits), hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    del docs[300], queries[42]
    close(found, brute_tfidf(docs, queries, 5))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and ("Arrow" in plan) == bool(max_bytes)
    texts = built.search(asked, 1, columns=("text",)).collect()
    assert all(r.text == docs[r.id] for r in texts)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_lose_nothing(spark, monkeypatch, seed):
    """Peaked queries, where most pairs are never met, and flat ones, where bounds cut little."""
    from basketry.operators import postings

    monkeypatch.setattr(postings, "PRODUCTS", 500)
    rng = random.Random(seed)
    docs = {i: " ".join(f"c{rng.randint(0, 5)}" for _ in range(rng.randint(1, 40))) + f" r{rng.randint(0, 60)}" * rng.randint(0, 3) for i in range(300)}
    queries = {i: docs[rng.randint(0, 299)] if i % 2 else f"c1 c2 r{i}" for i in range(25)}
    built, want = text_index(spark, docs), brute_tfidf(docs, queries, 4)
    for max_bytes in (0, 10**9):
        close(collected(built.search(asked_of(spark, queries), 4, max_bytes=max_bytes)), want)


def test_few_pairs_are_scored(spark):
    """Rows that share only common words with a query are not candidates."""
    from basketry.operators import postings
    from basketry.operators.embed import term_counts, tfidf_weights

    docs = {i: "the of and " * 3 + f"topic{i % 50} word{i} item{i % 50}" for i in range(1000)}
    queries = {i: f"the of and topic{i} item{i}" for i in range(20)}
    built, asked = text_index(spark, docs), asked_of(spark, queries)
    weights = tfidf_weights(term_counts(asked, "query_id", "text"), built.idf, "query_id")
    terms = postings.query_terms(weights)
    heavy = terms.filter("before < 0.5").select("query_id", "term", "weight")
    floor = postings.floors(postings.partial_scores(heavy, built.postings, ["term"]), 5)
    bounded = postings.with_bounds(terms, floor)
    assert bounded.filter("not first").select("term").distinct().count() == 3  # the, of, and
    met = postings.candidates(bounded, built.postings).count()
    assert 20 * 5 <= met <= 20 * 20  # of 20,000 pairs, all of which share a term
    close(collected(built.search(asked, 5, max_bytes=0)), brute_tfidf(docs, queries, 5))


@pytest.mark.parametrize("rare", [0, 3, 10**6])
@pytest.mark.parametrize("seed", range(2))
def test_classes_lose_nothing(spark, monkeypatch, rare, seed):
    """Rows and queries that agree in their frequent terms, with rare terms of their own or without."""
    from basketry.operators import postings

    monkeypatch.setattr(postings, "RARE", rare)
    rng = random.Random(seed)
    name = lambda: f"c{rng.randint(0, 3)} t{rng.randint(0, 2)}"
    docs = {i: f"{name()} #{i // 2}" if i % 3 else name() for i in range(200)}
    queries = {i: docs[rng.randint(0, 199)] if i % 4 else f"{name()} {name()} {i}" for i in range(40)}
    built = text_index(spark, docs)
    for k in (1, 4):
        close(collected(built.search(asked_of(spark, queries), k, max_bytes=0)), brute_tfidf(docs, queries, k))


def test_many_alike_queries_are_not_paired_with_all_rows(spark, monkeypatch):
    """the pairs made for texts that differ in one rare word grow with the texts, not with their square."""
    from basketry.operators import postings

    docs = {i: f"red ring {i}" for i in range(1500)}
    made, written = [], postings.materialize

    def counted(df, name):
        table = written(df, name)
        made.append((name, table.count()))
        return table

    monkeypatch.setattr(postings, "materialize", counted)
    found = text_index(spark, docs).search(asked_of(spark, docs), 3)
    assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
    hits = found.collect()
    assert {(r.query_id, r.id) for r in hits if r["rank"] == 1} == {(i, i) for i in docs} and len(hits) == 3 * len(docs)
    assert all({r.id for r in hits if r.query_id == i and r["rank"] > 1} == {0, 1} for i in (2, 700, 1499))
    assert max(n for _, n in made) <= 3 * len(docs)


def test_blocks_bound_weights(spark):
    from basketry.operators import postings

    rows = spark.createDataFrame([(w,) for w in (1.0, 0.75, 0.5, 0.4999, 0.25, 0.1, 2.0**-15, 1e-9)], "weight double")
    got = [(r.weight, r.block) for r in rows.withColumn("block", postings.block_of(F.col("weight"))).collect()]
    assert [b for _, b in got] == [0, 0, 0, 1, 1, 3, 14, postings.LAST_BLOCK]
    assert all(w <= 2.0**-b for w, b in got)


def test_a_hot_term_is_split(spark):
    """One term in most rows: the join on terms deals its postings to several tasks."""
    docs = {i: f"hot w{i % 7} v{i}" for i in range(6000)}
    queries = {i: f"hot w{i % 7} hot" for i in range(40)}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    from basketry.operators import postings
    from basketry.operators.embed import term_counts, tfidf_weights

    built, asked = text_index(spark, docs), asked_of(spark, queries)
    many = built.postings.repartition(24)
    weights = tfidf_weights(term_counts(asked, "query_id", "text"), built.idf, "query_id")
    terms = materialize(postings.query_terms(weights), "terms")
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        partial = postings.partial_scores(terms.select("query_id", "term", "weight"), materialize(many, "postings"), ["term"])
        n = len(partial.collect())
        assert "SortMergeJoin(skew=true)" in partial._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert n == 40 * 6000


def test_all_cells_probed_is_exact(spark):
    q, d = vectors(20, 5), vectors(150, 6)
    cells = ann.CellIndex.build(frame(spark, d), cells=6)
    hits = cells.search(frame(spark, q, "query_id"), 5, n_probe=6)
    close(collected(hits), brute(q, d, 5))
    assert cells.candidate_fraction(frame(spark, q, "query_id"), 6).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("max_broadcast", [1000, 0])
def test_cells_are_exact_inside_the_probed_cells(spark, max_broadcast):
    q, d = vectors(20, 5), vectors(150, 6, copies=50)
    cells = ann.CellIndex.build(frame(spark, d), cells=6)
    queries = frame(spark, q, "query_id")
    of_row = {r.id: r.cell for r in cells.rows.collect()}
    probed = {}
    for r in cells.probe(queries, 2).collect():
        probed.setdefault(r.query_id, set()).add(r.cell)
    hits = cells.search(queries, 5, n_probe=2, max_broadcast=max_broadcast, query_block=7, index_block=16)
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()
    close(collected(hits), brute(q, d, 5, lambda i, j: of_row[j] in probed[i]))
    exact = index.search_vectors(queries, frame(spark, d), 5)
    recall = ann.recall_at_k(hits, exact).first().recall
    share = cells.candidate_fraction(queries, 2).first()[0]
    assert 0 < share < 1 and 0 < recall <= 1
    expected = sum(of_row[j] in probed[i] for i in range(20) for j in range(150)) / 3000
    assert share == pytest.approx(expected)


@pytest.mark.parametrize("max_broadcast", [1000, 0])
def test_hash_tables(spark, max_broadcast):
    q, d = vectors(20, 7), vectors(120, 8)
    built = ann.HashIndex.build(frame(spark, d), dimensions=8, tables=3, bits=3)
    planes = ann.hash_planes(3, 3, 8)

    def same(i, j):
        a, b = (planes @ q[i].astype(float) >= 0), (planes @ d[j].astype(float) >= 0)
        return bool((a == b).all(axis=1).any())

    hits = built.search(frame(spark, q, "query_id"), 5, max_broadcast=max_broadcast, query_block=7, index_block=16)
    close(collected(hits), {i: v for i, v in brute(q, d, 5, same).items() if v})


def test_build_index_and_duplicates(spark):
    def model():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "toaster"), (2, None), (3, "kettle")], "pid long, name string")
    built = index.build_index(docs, "pid", "name", model)
    assert built.columns == ["id", "text", "embedding", "norm"]
    rows = {r.id: r for r in built.collect()}
    assert rows.keys() == {1, 3} and rows[1].norm == pytest.approx(math.sqrt(50))
    with pytest.raises(index.DuplicateKeyError):
        index.build_index(docs.union(docs), "pid", "name", model)
    asked = spark.createDataFrame([(9, "kettle")], "query_id long, text string")
    hit = index.search_text_with_model(asked, built, 1, model).first()
    assert (hit.id, hit.text, hit.score) == (3, "kettle", 1.0)


def test_embed_keeps_rows_and_null_texts(spark):
    from basketry.operators.embed import embed

    def model():
        return lambda texts: [[float(len(t))] for t in texts]

    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), 5)).alias("t"))
    rows = embed(df, "t", model, batch_size=7).collect()
    assert len(rows) == 1000
    assert all((r.embedding is None) if r.id % 3 == 0 else r.embedding == [5.0] for r in rows)


def test_named_index(spark):
    def model():
        return lambda texts: [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    from basketry.sources import sinks

    names = ("descriptions", "descriptions_index", "shop_postings", "shop_terms", "shop_catalogue")
    rows = [(0, "a toaster for bread"), (1, "vacuum cleaner"), (2, "coffee mill")]
    try:
        sinks.create_table(spark.createDataFrame(rows, "id long, text string"), names[0])
        index.create_index(spark, "descriptions", "descriptions_index", "id", "text", model)
        best = index.similarity_search(spark, "descriptions_index", "vacuum cleaner", model, num_results=2).collect()
        assert best[0].text == "vacuum cleaner" and best[0].score == 1.0 and len(best) == 2
        assert best[0].asDict().keys() == {"id", "text", "score"}
        index.TextIndex.build(spark.table("descriptions"), "id", "text").save("shop")
        loaded = index.TextIndex.load(spark, "shop")
        asked = spark.createDataFrame([(1, "I want to buy a toaster")], "query_id int, text string")
        assert loaded.search(asked, 1, columns=("text",)).first().text == "a toaster for bread"
    finally:
        for name in names:
            sinks.drop_table(spark, name)


def hashed(texts, fitted, dimensions=64):
    """Hashed signed TF-IDF vectors, by the definition."""
    import hashlib

    n = len(fitted)
    df = Counter(t for text in fitted for t in set(words(text)))
    out = []
    for text in texts:
        v = np.zeros(dimensions)
        for term, tf in Counter(words(text)).items():
            digest = hashlib.md5(term.encode()).hexdigest()
            idf = math.log((n + 1) / (df[term] + 1)) + 1
            v[int(digest[:8], 16) % dimensions] += tf * idf * (1 if int(digest[8], 16) >= 8 else -1)
        out.append(v)
    return out


def test_hashed_terms(spark):
    from basketry.operators.embed import HashedTerms, embed

    fitted = list(corpus(8, 40).values())
    model = HashedTerms.fit(spark.createDataFrame([(t,) for t in [*fitted, None]], "body string"), "body", 16)
    texts = [*fitted[:10], "never seen WORDS w1 w1", "", "...", None]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "key long, text string, embedding string")
    made = embed(rows, "text", model, key="key")
    assert made.columns == ["key", "text", "embedding"]
    got = {r.key: r.embedding for r in made.collect()}
    want = hashed([t or "" for t in texts], fitted, 16)
    for i, text in enumerate(texts):
        assert got[i] is None if text is None else got[i] == pytest.approx(want[i], rel=1e-6)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        embed(rows, "text", model)


def test_hashed_terms_in_an_index(spark):
    from basketry.operators.embed import HashedTerms

    docs, queries = corpus(1, 80), corpus(2, 12)
    frame_ = spark.createDataFrame(list(docs.items()), "doc long, body string")
    model = HashedTerms.fit(frame_, "body")
    built = index.build_index(frame_, "doc", "body", model)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    hits = index.search_text_with_model(asked, built, 3, model, columns=())
    found = collected(hits)
    d, q = (np.array(hashed(t.values(), docs.values())) for t in (docs, queries))
    assert {i: [x for x, _ in v] for i, v in found.items()} == {i: [x for x, _ in v] for i, v in brute(q, d, 3).items()}


def test_probe_order_is_the_true_order():
    from itertools import product

    from basketry.operators import probing

    x, width = np.random.default_rng(3).normal(size=(7, 4)), 0.8
    cells, near = probing.probe_order(x, width, 81)
    for row in range(7):
        far = {}
        for levels in product(range(3), repeat=4):
            gaps = [max(0, v + width / 2) if lv == 0 else max(0, abs(v) - width / 2) if lv == 1 else max(0, width / 2 - v) for v, lv in zip(x[row], levels)]
            far[sum(lv * 3**i for i, lv in enumerate(levels))] = sum(g * g for g in gaps)
        want = sorted(far, key=lambda c: (round(far[c], 12), c))
        assert [far[c] for c in cells[row]] == pytest.approx([far[c] for c in want]) and sorted(cells[row]) == list(range(81))
        assert cells[row, 0] == probing.cells_of(x[row : row + 1], width)[0]
    for count in (1, 5, 30):
        some, _ = probing.probe_order(x, width, count)
        assert (some == cells[:, :count]).all() and np.allclose(near[:, :count], probing.probe_order(x, width, count)[1])


@pytest.mark.parametrize("max_broadcast", [1000, 0])
def test_probes_reach_the_recall(spark, max_broadcast):
    """On clustered vectors few rows are scored; all cells visited is exact."""
    from basketry.operators import probing

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    d = (centres[rng.integers(0, 12, 600)] + 0.15 * rng.normal(size=(600, 8))).astype(np.float32)
    q = d[:60]
    rows, asked = frame(spark, d), frame(spark, q, "query_id")
    built = probing.ProbeIndex.build(rows, asked, 5, dimensions=8)
    hits = built.search(asked, 5, max_broadcast=max_broadcast, query_block=20, index_block=64)
    exact = index.search_vectors(asked, rows, 5)
    assert len(built.planes) == probing.planes_for(600) == 4
    assert ann.recall_at_k(hits, exact).first().recall >= 0.9
    assert built.candidate_fraction(asked).first()[0] < 0.35
    built.probes = 3**4
    if max_broadcast:
        close(collected(built.search(asked, 5)), brute(q, d, 5))


def test_last_visits_and_places_are_those_of_the_order():
    from basketry.operators import probing

    x, width = np.random.default_rng(4).normal(size=(9, 5)), 0.9
    x[:4] = np.round(x[:4])  # levels, and so distances, that are equal
    cells, near = probing.probe_order(x, width, 3**5)
    for probes in (1, 17, 200, 3**5, 1000):
        far, last = probing.last_visits(x, width, probes)
        assert (last == cells[:, min(probes, 3**5) - 1]).all() and (far == near[:, min(probes, 3**5) - 1]).all()
    for place in (0, 40, 242):
        assert (probing.places_of(x, width, cells[:, place]) == place + 1).all()


@pytest.mark.parametrize("copies", [0, 40])
def test_probing_in_blocks_makes_no_row_per_query_and_cell(spark, monkeypatch, copies):
    """Many queries: the same rows and share as by listing each query's cells; rows that come twice count once."""
    from basketry.operators import probing

    d = vectors(700, 11, copies=copies)
    rows = frame(spark, d)
    rows = rows.unionByName(rows.filter(F.col("id") < copies))
    asked = frame(spark, d[:90], "query_id")
    built = probing.ProbeIndex.build(rows, asked, 5, dimensions=8)
    built.probes = 20
    seen = {}
    for r in built.probe(asked).collect():
        seen.setdefault(r.query_id, set()).add(r.cell)
    of_row = {r.id: r.cell for r in built.rows.collect()}
    pairs = sum(of_row[r.id] in seen[q] for r in rows.select("id").collect() for q in seen)
    monkeypatch.setattr(probing.ProbeIndex, "probe", lambda self, queries: queries.sparkSession.sql("select raise_error('listed') query_id, 0 cell"))
    close(collected(built.search(asked, 5, max_broadcast=0, query_block=40, index_block=300)), brute(d[:90], d, 5, lambda i, j: of_row[j] in seen[i]))
    monkeypatch.setattr(probing, "QUERY_BLOCK", 40)
    assert built.candidate_fraction(asked).first()[0] == pytest.approx(pairs / (90 * 700))


def test_queries_are_placed_once_by_many_tasks(spark):
    """A table of one part is dealt to tasks; the placed queries carry the rows they meet and are not placed again."""
    from basketry.operators import probing

    d = vectors(1300, 21)
    rows, asked = frame(spark, d).coalesce(1), frame(spark, d, "query_id").coalesce(1)
    built = probing.ProbeIndex.build(rows, asked, 5, dimensions=8)
    placed = built.placed(asked)
    assert len(placed.inputFiles()) >= 3 and built.placed(placed) is placed
    of_row = {r.id: r.cell for r in built.rows.collect()}
    seen = {}
    for r in built.probe(asked).collect():
        seen.setdefault(r.query_id, set()).add(r.cell)
    assert {r.query_id: r._rows for r in placed.collect()} == {q: sum(c in seen[q] for c in of_row.values()) for q in seen}
    assert built.candidate_fraction(placed).first() == built.candidate_fraction(asked).first()


def test_rows_of_visited_cells_where_distances_are_equal():
    from basketry.operators import probing

    x, width = np.round(np.random.default_rng(6).normal(size=(20, 4))), 0.9
    sizes = np.random.default_rng(7).integers(0, 9, 81).astype(float)
    order = probing.probe_order(x, width, 81)[0]
    for probes in (1, 5, 40, 81):
        assert (probing.last_visits(x, width, probes, sizes)[2] == sizes[order[:, :probes]].sum(axis=1)).all()


@pytest.mark.parametrize("max_broadcast", [1000, 0])
@pytest.mark.parametrize("scale", [1.0, 1e30])
def test_scores_that_single_precision_cannot_tell_apart(spark, max_broadcast, scale):
    """Rows of which the cosines differ in the sixth digit, copies, and vectors that single precision cannot hold."""
    rng = np.random.default_rng(13)
    one = rng.normal(size=16)
    d = scale * (one + 3e-4 * rng.normal(size=(2500, 16)))
    d[100:400] = d[100]
    q = scale * (one + 1e-2 * rng.normal(size=(40, 16)))
    schema = "id long, embedding array<double>"
    rows = index.with_norm(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], schema))
    asked = index.with_norm(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], schema)).withColumnRenamed("id", "query_id")
    hits = top_k_join(asked, rows, 5, DenseScore(), max_broadcast=max_broadcast, query_block=16)
    close(collected(hits), brute(q, d, 5))


def test_probing_without_rows(spark):
    from basketry.operators import probing

    rows = frame(spark, vectors(3, 1))
    asked = rows.withColumnRenamed("id", "query_id")
    built = probing.ProbeIndex.build(rows, asked, 5, dimensions=8)
    assert built.search(asked, 5).count() >= 3
    none = rows.filter("false")
    built = probing.ProbeIndex.build(none, asked.filter("false"), 5, dimensions=8)
    assert built.search(asked.filter("false"), 5).count() == 0


@pytest.mark.parametrize("spread", [0.08, 1.0])
def test_bounded_search_is_exact(spark, spread):
    """Clustered vectors, where most cells are skipped, and vectors without clusters; zero vectors and copies."""
    from basketry.operators.bounded import BoundedIndex

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(15, 12))
    d = (centres[rng.integers(0, 15, 500)] + spread * rng.normal(size=(500, 12))).astype(np.float32)
    d[400:420] = d[7]
    q = np.concatenate([d[:40], rng.normal(size=(10, 12)).astype(np.float32)])
    d[3] = q[4] = 0
    rows, asked = frame(spark, d), frame(spark, q, "query_id")
    built = BoundedIndex.build(rows, centres=15)
    close(collected(built.search(asked, 6)), collected(index.search_vectors(asked, rows, 6)))
    scored = built.pairs_scored(asked, 6).first()
    assert scored.pairs == 500 * 50
    if spread < 0.5:
        assert scored.scored < 0.5 * scored.pairs
    assert built.search(asked.filter("false"), 6).count() == 0
    few = BoundedIndex.build(rows.limit(4), centres=2).search(asked, 6)
    assert few.count() == 4 * 50


@pytest.mark.parametrize("spread", [0.08, 1.0])
def test_bounded_search_of_many_queries_lists_no_cells(spark, monkeypatch, spread):
    """The cells of many queries are told inside blocks and counted inside tasks."""
    from basketry.operators.bounded import BoundedIndex

    rng = np.random.default_rng(10)
    centres = rng.normal(size=(9, 8))
    d = (centres[rng.integers(0, 9, 400)] + spread * rng.normal(size=(400, 8))).astype(np.float32)
    q = np.concatenate([d[:40], rng.normal(size=(10, 8)).astype(np.float32)])
    d[3] = q[4] = 0
    rows, asked = frame(spark, d), frame(spark, q, "query_id")
    built = BoundedIndex.build(rows, centres=9)
    reach = built._reach()
    first, floors = built._floors(asked, 6, reach)
    sizes = {r.cell: r.rows for r in built.bounds.collect()}
    listed = [r.cell for r in first.collect()] + [r.cell for r in built._visits(floors, reach).collect()]
    assert built.pairs_scored(asked, 6).first().scored == sum(sizes[c] for c in listed)
    raising = lambda self, asked, reach: spark.sql("select raise_error('listed') query_id, 0 cell")
    monkeypatch.setattr(BoundedIndex, "_visits", raising)
    hits = built.search(asked, 6, max_broadcast=0, query_block=20, index_block=150)
    close(collected(hits), collected(index.search_vectors(asked, rows, 6)))
    assert built.pairs_scored(asked, 6).first().pairs == 400 * 50


def test_rows_of_frequent_terms_are_not_shuffled_by_term(spark, monkeypatch):
    """The vectors are the same whichever terms are sent to every task, with terms and texts of every kind."""
    from basketry.operators import embed

    texts = ["a b c a", "b c d", "a a a e", "", None, "c b a f g h", "x"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a z")], "id long, text string")
    asked = spark.createDataFrame([(1, "a q q c"), (2, "unknown words")], "id long, text string")
    found = []
    for frequent in (100, 3, 0):
        monkeypatch.setattr(embed, "FREQUENT", frequent)
        model = embed.HashedTerms.fit(docs, "text", dimensions=8)
        common, rare = embed.frequent_terms(model.idf)
        assert common.count() <= frequent and (rare is None) == (frequent == 100)
        dense = [r for d in (docs, asked) for r in embed.embed(d, "text", model, key="id").collect()]
        sparse = embed.tfidf_vectors(docs, "id", "text", model.idf).collect()
        found.append((
            sorted(((str(r.id), r.text, r.embedding and [round(x, 5) for x in r.embedding]) for r in dense), key=str),
            sorted(((str(r.id), sorted(zip(r.terms, [round(w, 9) for w in r.weights])), round(r.norm, 9)) for r in sparse), key=str),
        ))
    assert found[0] == found[1] == found[2]
    assert len(found[0][1]) == 6 and len(found[0][0]) == 10
