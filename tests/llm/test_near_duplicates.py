import random
from collections import Counter

import numpy as np
import pytest

from basketry.llm import graph, near_duplicates as nd, queries
from basketry.llm.common import materialize


def sets_of(docs):
    out = []
    for _, text in docs:
        w = (text or "").encode().split()
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(docs):
    """doc position -> (links, smallest id of its component)."""
    sets = sets_of(docs)
    n = len(docs)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in by[x] if j > i}
        for j in near:
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[top(j)] = top(i)
    low = {}
    for i in range(n):
        low.setdefault(top(i), []).append(docs[i][0])
    low = {r: min((d for d in ids if d is not None), default=None) for r, ids in low.items()}
    return [(docs[i][0], links[i], low[top(i)] if links[i] else docs[i][0]) for i in range(n)]


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    out = []
    for size in (3, 12, 40, 120, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            out.append(" ".join(base))
            for edits in (0, 1, 2, 4, 9):
                copy = list(base)
                for _ in range(edits * size // 60):
                    copy[rng.randrange(size)] = word()
                out.append(rng.choice([" ", "  ", "\n"]).join(copy))
    rng.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


def same(rows, docs):
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in rows), key=key) == sorted(brute(docs), key=key)


def test_against_brute_force(docs_frame):
    docs = texts()
    same(nd.join(docs_frame(docs)).collect(), docs)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = queries.QUERIES["op1_jaccard"](spark, folder).collect()
    same(rows, docs)
    assert sum(r.n_links > 0 for r in rows) > 50


def test_large_class_in_blocks(docs_frame, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    same(nd.join(docs_frame(docs)).collect(), docs)


def test_prefixes_are_shortened(docs_frame, monkeypatch):
    """With few trees and long labels the first depth recalls too little, and says so."""
    monkeypatch.setattr(nd, "RECALL", 0.999999)
    rng = random.Random(4)
    docs = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(150)]
        docs.append((2 * g, " ".join(base)))
        copy = list(base)
        for at in (20, 60, 110):  # 15 of 146 shingles: similarity 0.81
            copy[at] = f"x{rng.random()}"
        docs.append((2 * g + 1, " ".join(copy)))
    _, linked, steps = nd.links(docs_frame(docs))
    assert steps[0][0] == nd.DEPTH and len(steps) > 1 and steps[-1][0] < nd.DEPTH
    assert linked.count() == 120


def test_one_document_of_each_class_stays(docs_frame):
    docs = texts(8) + [(None, "a b c d e f g"), (None, "a b c d e f g"), (5000, "one two three"), (5000, "one two three"), (7, ""), (8, None)]
    frame = docs_frame(docs)
    kept = nd.keep_one(frame)
    assert kept.columns == frame.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = {}
    for (i, text), (_, links, low) in zip(docs, brute(docs)):
        if not links:
            want[("alone", i, text)] = 1
        else:
            want[("class", low, None if low is not None else text)] = 1
    assert len(got) == len(want)
    assert {i for i, _ in got} == {k[1] for k in want}
    assert not any(n for _, n, _ in brute(got))


def test_odd_rows(odd):
    same(nd.join(odd).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert nd.join(odd.limit(0)).count() == 0 and nd.keep_one(odd.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)]
    pairs += [tuple(map(int, p)) for p in rng.integers(2000, 2400, (150, 2))]
    rows = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    root = {r.node: r.root for r in rows}
    assert {root[i] for i in range(301)} == {0} and {root[1000 + i] for i in range(200)} == {1000}
    assert all(root.get(a, a) == root.get(b, b) for a, b in pairs)


@pytest.mark.parametrize("depth", [1, 4, 6])
def test_chance_is_that_of_the_forest(depth):
    assert nd.chance(0.8, depth) > 0.999 and nd.chance(0.8, depth) <= nd.chance(0.9, depth)
    assert nd.expected_recall([0] * nd.BINS, depth) == 1.0


def test_hot_class_does_not_decide_for_other_links(docs_frame):
    # 40 texts that differ in one word of 300: all links are far above the threshold
    body = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join([*body[:150], f"x{i}", *body[150:]]), "en", "a") for i in range(40)]
    _, linked, steps = nd.links(docs_frame(docs))
    assert linked.count() == 40 and nd.expected_recall([0] * (nd.BINS - 1) + [1], nd.DEPTH) >= nd.RECALL
    assert nd.chance(0.8, steps[-1][0]) >= nd.RECALL


def test_a_chain_of_candidates_is_not_compared_all_to_all(docs_frame, monkeypatch):
    """Neighbours in a chain are near, its ends are not: few of all pairs of the class are candidates."""
    rng = random.Random(12)
    words = [f"w{rng.random()}" for _ in range(400)]
    docs = [(i, " ".join(words[5 * i : 5 * i + 160])) for i in range(48)]
    frame = docs_frame(docs)
    signed = nd.sign(frame)
    classes = nd._classes(materialize(signed, "signed"), nd.DEPTH).collect()
    largest = max(Counter(r.root for r in classes).values())
    signatures = {r.node: r.signature for r in signed.collect()}
    labels = np.stack([nd.cut_labels(s, nd.DEPTH) for s in signatures.values()])
    every = np.arange(len(labels))
    pairs = nd.candidate_pairs(labels, every, every)
    assert largest >= 40 and pairs.sum() < 0.6 * pairs.size
    same(nd.join(frame).collect(), docs)


def test_sparse_and_dense_intersections_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40)).astype("u8")) for _ in range(30)]
    left, right = np.arange(12), np.arange(12, 30)
    full = nd._shares(sets, left, right)
    for share in (0.02, 0.5, 1.0):
        wanted = rng.random(full.shape) < share
        assert (nd._shares_of_pairs(sets, left, right, wanted) == np.where(wanted, full, 0)).all()


def test_one_pass_is_enough_at_the_usual_target(docs_frame):
    _, _, steps = nd.links(docs_frame(texts(5)))
    assert [d for d, _ in steps] == [nd.DEPTH] and nd.chance(0.8, nd.DEPTH) >= nd.RECALL > nd.chance(0.8, nd.DEPTH + 1)
