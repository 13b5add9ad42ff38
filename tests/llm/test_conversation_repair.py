"""Repair of conversations against plain versions: every edit string, and a program of one conversation."""

import hashlib
import re
import zlib
from functools import cache
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import audit_paths as ap
from basketry.llm import conversation_repair as cr
from basketry.llm import queries

PATTERN = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """(turn, role, text) of one conversation's original rows (conv_id, turn, role, text), in order."""
    out = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\f\r")
        if not stripped:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("k" if stripped[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns): all edits of one conversation, by a plain recursion."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    @cache
    def best(at, state, inserts):
        found = []
        if at == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if at < len(rows):
            cost, audit, turns = best(at + 1, state, 0)
            found.append((cost + 2, "D" + audit, turns))
            if faults[at] not in "bd":
                extra, (_, role, text) = 5 * (faults[at] == "t"), rows[at]
                if role[:1] in step[state]:
                    cost, audit, turns = best(at + 1, role[:1], 0)
                    found.append((cost + extra, "K" + audit, (f"{role}:{text}", *turns)))
                for new in set(step[state]) - {"s"}:
                    cost, audit, turns = best(at + 1, new, 0)
                    found.append((cost + 1 + extra, "R" + audit, (f"{full[new]}:{text}", *turns)))
        if inserts < 3:
            for new in set(step[state]) - {"s"}:
                cost, audit, turns = best(at, new, inserts + 1)
                found.append((cost + 5, "I" + audit, (f"{full[new]}:", *turns)))
        return min(found) if found else (1 << 30, "", ())

    return best(0, "", 0)


def expected(conv_id, original):
    rows = damaged([(conv_id, *r) for r in original])
    faults = faults_of(rows)
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, repaired = cheapest(tuple(rows), tuple(faults))
    digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return (conv_id, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)


def check(frame, rows):
    groups = {}
    for conv_id, *rest in rows:
        groups.setdefault(conv_id, []).append(tuple(rest))
    got = [tuple(r) for r in frame.collect()]
    want = [expected(c, g) for c, g in groups.items()]
    assert len(got) == len(groups)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a == b


def every_string(kinds):
    """Cost and least audit by trying all strings of edits and roles, for a few turns."""
    best = None
    for inserts in range(5):
        for edits in product("DIKR", repeat=len(kinds) + inserts):
            if edits.count("I") != inserts:
                continue
            options, at, cost, ok = [], 0, 0, True
            for edit in edits:
                if edit == "I":
                    cost += 5
                    options.append("ua")
                    continue
                kind = kinds[at]
                at += 1
                if edit == "D":
                    cost += 2
                    continue
                ok &= kind != "d"
                cost += 5 * kind.isupper() + (edit == "R")
                options.append("ua" if edit == "R" else kind.lower())
            if ok and any(PATTERN.fullmatch("".join(r)) for r in product(*options)):
                best = min(best or (cost, "Z"), (cost, "".join(edits)))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="dsuaxSUAX", max_size=3), min_size=1, max_size=4))
def test_cheapest_and_least(sequences):
    costs, audits = ap.whole([s.encode() for s in sequences])
    assert [(c, a.decode()) for c, a in zip(costs, audits)] == [every_string(s) for s in sequences]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="dsuaxSUAX", max_size=12), min_size=1, max_size=6))
def test_ranks_order_audits(sequences):
    """Ranks of nodes are the order of their least audits, and pointers lead to their ends."""
    kinds = [s.encode() for s in sequences]
    block = ap.Block(kinds, np.broadcast_to(ap.FINAL, (len(kinds), 4)), np.ones(len(kinds), dtype=bool))
    good, to = block.arcs()
    ranks, pointers, steps = ap.rank_nodes(good, to)
    audits, _ = block.paths(np.arange(len(ranks)))
    assert list(map(len, audits)) == steps.tolist()
    known = {a: r for a, r in zip(audits, ranks.tolist())}
    assert [known[a] for a in sorted(known)] == list(range(len(known)))
    assert all(known[a] == r for a, r in zip(audits, ranks.tolist()))
    assert not good[pointers[-1]].any()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="dsuaxSUAX", max_size=14), st.lists(st.integers(0, 14), max_size=3))
def test_parts_are_as_good_as_the_whole(sequence, cuts):
    edges = [0, *sorted(min(c, len(sequence)) for c in cuts), len(sequence)]
    kinds = [sequence[a:b].encode() for a, b in zip(edges, edges[1:])]
    last = np.arange(len(kinds)) == len(kinds) - 1
    crossings = ap.crossing(kinds, last)
    behind, cost = [], np.zeros(4, dtype="i8")
    for crossing in crossings[::-1]:
        behind.append(cost)
        cost = (crossing + cost).min(axis=1)
    end = np.where(last[:, None], ap.FINAL, np.array(behind[::-1]))
    audits, states, _ = ap.parts(kinds, end, last)
    state, out = ap.EMPTY, b""
    for own, after in zip(audits, states):
        out += own[state]
        state = after[state]
    (want_cost,), (want,) = ap.whole([sequence.encode()])
    assert (int(cost[ap.EMPTY]), out) == (want_cost, want)


def test_whole_table(spark):
    base = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_conversations(spark, base)
    assert out.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    check(out, rows)


ODD = [
    (1, 0, "user", "hi."), (1, 1, "assistant", "yes."), (1, 5, "user", None), (1, None, None, "x"), (1, None, "user", "a b."),
    (None, 0, "user", "q?"), (None, None, "assistant", "a."), (None, 3, "tool", "t!"), (2, None, "system", "s."),
    (3, 7, "user", " \t\n"), (4, 2, "", "e."), (4, 2, "", "e."), (4, 3, "User", "E."), (5, -3, "user", "z" * 70_000 + "."),
    (5, 4, "assistant", "same."), (5, 5, "assistant", "same."), (5, 6, "user", "\U0001f600 é"), (5, 6, "user", "ok.\x1c"),
    *[(i, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"w{i % 3} {t % 4}.") for i in range(10, 40) for t in range(i % 9)],
]


def build(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, fault string, part string")
    return frame.selectExpr("*", "'z' as _row", "'z' as kinds", "'z' as first")


@pytest.mark.parametrize("settings_", [{}, {"part_rows": 2, "block_rows": 3}, {"chars": 10}])
def test_odd_rows(spark, settings_):
    frame = build(spark, ODD)
    check(cr.repair(frame.repartition(5), **settings_), ODD)
    assert cr.repair(frame.limit(0)).count() == 0


def test_a_long_conversation_is_cut_into_parts(spark):
    """One conversation of most rows: the same result whatever the parts, and no part above its bound."""
    rows = [(7, t // 2, ["user", "assistant", "system", "bot"][(t * 7 + t // 11) % 4], f"t{t % 97}" + "." * (t % 3 > 0)) for t in range(3000)]
    rows += [(i, 0, "user", "hello.") for i in range(100, 130)]
    frame = build(spark, rows)
    parts = cr._in_order(cr.damage(frame)).mapInArrow(cr._gather(100, 64, 1000), cr._GATHERED).filter("part is not null")
    sizes = [(r.n, r.c) for r in parts.selectExpr("size(roles) as n", "length(array_join(texts, '')) as c").collect()]
    assert max(n for n, _ in sizes) <= 64 and max(c for _, c in sizes) <= 1010 and len(sizes) > 40
    whole = {r.conv_id: r for r in cr.repair(frame).collect()}
    split = {r.conv_id: r for r in cr.repair(frame, part_rows=64, block_rows=100, chars=1000).collect()}
    assert whole == split and len(whole) == 31
    import sys

    sys.setrecursionlimit(50_000)
    assert tuple(split[7]) == expected(7, [r[1:] for r in rows if r[0] == 7])
