import hashlib
import random

import numpy as np
import pytest

from basketry.llm import queries, run_index, suffix_dedup as sd


def brute(docs, length=200):
    """Position in docs -> (n_bytes, n_removed, n_spans, sha of what is left)."""
    data = [(t or "").encode() for _, t in docs]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = [np.zeros(len(b), dtype=bool) for b in data]
    for where in seen.values():
        if len(where) > 1:
            for d, i in where:
                gone[d][i : i + length] = True
    out = []
    for (doc_id, _), b, g in zip(docs, data, gone):
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        left = bytes(x for x, r in zip(b, g) if not r)
        out.append((doc_id, len(b), int(g.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def same(rows, docs):
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]
    assert sorted(got, key=key) == sorted(brute(docs), key=key)


def noise(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz  é\n", k=n))


def corpus(seed=1):
    rng = random.Random(seed)
    shared = [noise(rng, n) for n in (150, 199, 200, 201, 260, 420, 900)]
    docs = []
    for i in range(60):
        parts = [noise(rng, rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            if rng.random() < 0.4:
                at = rng.randrange(len(passage))
                passage = passage[:at] + "#" + passage[at + 1 :]
            parts += [passage, noise(rng, rng.randint(0, 300))]
        docs.append((i, "".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "One two " * 300), (103, "One two " * 100 + "x" + "One two " * 40)]
    return docs + [(104, "z" * 200), (105, "y" * 201), (106, ""), (107, None), (None, docs[5][1]), (108, "q" * 199 + "q"), (109, "q" * 200)]


def test_against_brute_force(docs_frame):
    docs = corpus()
    same(sd.deduplicate(docs_frame(docs)).collect(), docs)


def test_large_groups_are_split(docs_frame, monkeypatch):
    monkeypatch.setattr(sd, "LARGE", 8)
    rng = random.Random(2)
    passage, end = noise(rng, 500), noise(rng, 30)
    docs = [(i, noise(rng, rng.randint(0, 250)) + passage[: rng.choice([500, 500, 430, 310])] + noise(rng, rng.randint(0, 250))) for i in range(70)]
    docs += [(100 + i, noise(rng, 40) + passage[200:450] + end[: i % 7] + noise(rng, 60)) for i in range(30)]
    same(sd.deduplicate(docs_frame(docs)).collect(), docs)


def test_copies_share_their_ranges(docs_frame, monkeypatch):
    """What a copy has to cut does not grow with the number of copies."""
    cut = sd.cut

    def once(data, low, high):
        ranges = list(zip(low.tolist(), high.tolist()))
        if len(ranges) > len(set(ranges)):
            raise AssertionError(f"{len(ranges)} ranges, {len(set(ranges))} different")
        return cut(data, low, high)

    monkeypatch.setattr(sd, "cut", once)
    rng = random.Random(4)
    text = noise(rng, 900)
    docs = [(i, text) for i in range(40)] + [(100 + i, noise(rng, 50) + text[300:700] + noise(rng, 50)) for i in range(5)]
    docs += [(None, text), (None, text), (7, text), (200, noise(rng, 400))]
    same(sd.deduplicate(docs_frame(docs)).collect(), docs)


def test_long_texts_in_parts(docs_frame, monkeypatch):
    monkeypatch.setattr(sd, "_BUFFER", 1500)
    rng = random.Random(3)
    passage = noise(rng, 700)
    docs = [(i, noise(rng, 900) + passage + noise(rng, 1100 * i) + passage[:400] + noise(rng, 300)) for i in range(5)]
    same(sd.deduplicate(docs_frame(docs)).collect(), docs)


def test_query(spark, base):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    rows = queries.QUERIES["op8_suffixes"](spark, base).collect()
    same(rows, docs)
    assert sum(r.n_removed > 0 for r in rows) > 5


def test_odd_rows(docs_frame, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    small = [(i, t[:4000] if t else t) for i, t in rows]
    same(sd.deduplicate(docs_frame(small)).collect(), small)
    kept = {r.doc_id: r for r in sd.deduplicate(odd, with_text=True).collect()}
    assert kept[4].kept == b"" and kept[4].n_removed == 130_000 and kept[4].n_spans == 1
    assert sd.deduplicate(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    groups = np.sort(rng.integers(0, 4, 12))
    strings = [rng.integers(0, 2, rng.integers(1, 60)).astype("u1") + 97 * (seed % 2) for _ in groups]
    strings[3] = strings[2].copy()
    starts = np.cumsum([0] + [len(s) for s in strings[:-1]])
    index = run_index.RunLengthIndex(np.concatenate(strings), starts, groups)
    got = index.matching_statistics()
    for g, s, at in zip(groups, strings, starts):
        for i in range(len(s)):
            best = 0
            for h, t, other in zip(groups, strings, starts):
                if h == g:
                    for j in range(len(t)):
                        if other + j != at + i:
                            k = 0
                            while i + k < len(s) and j + k < len(t) and s[i + k] == t[j + k]:
                                k += 1
                            best = max(best, k)
            assert got[at + i] == best
    assert len(index.run_starts) <= index.n


@pytest.mark.parametrize("seed", range(6))
def test_parts_hold_every_long_match(seed):
    """With and without the parts that occur once, the same long matches come out."""
    rng = np.random.default_rng(seed)
    pool = [rng.integers(97, 97 + rng.integers(2, 26), rng.integers(60, 500)).astype("u1") for _ in range(6)]
    strings, groups = [], []
    for g in range(12):
        for _ in range(rng.integers(1, 6)):
            parts = [pool[rng.integers(6)] if rng.random() < 0.6 else rng.integers(97, 123, rng.integers(1, 150)).astype("u1") for _ in range(rng.integers(1, 5))]
            strings.append(np.concatenate(parts))
            groups.append(g)
    strings.append(np.full(900, 97, dtype="u1"))
    groups.append(12)
    starts = np.cumsum([len(s) for s in strings]) - [len(s) for s in strings]
    text = np.concatenate(strings)
    groups = np.array(groups)
    full = run_index.RunLengthIndex(text, starts, groups)
    begin, end, of = run_index.repeated_parts(text, starts, groups, 200)
    parts = np.cumsum(end - begin) - (end - begin)
    some = run_index.RunLengthIndex(np.concatenate([text[a:b] for a, b in zip(begin, end)]), parts, groups[of])
    at = some.long_matches(200)
    part = np.searchsorted(parts, at, side="right") - 1
    assert (at + (begin - parts)[part]).tolist() == full.long_matches(200).tolist()
    assert some.n < full.n and (starts[of] <= begin).all() and (end <= np.r_[starts[1:], len(text)][of]).all()
    assert [len(x) for x in run_index.repeated_parts(text[:50], starts[:1], groups[:1], 200)] == [0, 0, 0]


def test_contexts_without_a_repeat():
    """Strings of which no part repeats, none at all, and short ones."""
    rng = np.random.default_rng(1)
    text = lambda n: rng.integers(0, 256, n).astype("u1").tobytes()
    for held in ([(0, 1, 0, text(300)), (0, 2, 0, text(300))], [(0, 1, 0, b"")], [(0, 1, 0, text(30)), (1, 2, 5, text(250))]):
        assert sd._repeats(held).num_rows == 0
    same_ = text(260)
    found = sd._repeats([(0, 1, 10, same_), (0, 2, 20, same_ + text(50)), (1, 3, 0, same_)]).to_pylist()
    assert found == [{"text_key": 1, "start": 10, "end": 270}, {"text_key": 2, "start": 20, "end": 280}]
    empty = np.empty(0, dtype="i8")
    assert run_index.RunLengthIndex(np.empty(0, dtype="u1"), empty, empty).long_matches(200).tolist() == []
