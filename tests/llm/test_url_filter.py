import itertools
import math

import pytest

from basketry.llm import queries, url_filter as uf

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain(url):
    """Host, path and rule of a url, written out."""
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(s + p, k) for s, p, k in RULES if (host == s or host.endswith("." + s)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def check(rows, urls):
    for r in rows:
        host, path, rule, kind = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == kind if rule else r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)


def test_query(spark):
    folder = "/root/testdata/sf0.1"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.QUERIES["op10_urls"](spark, folder).collect()
    assert len(rows) == len(urls)
    check(rows, urls)
    free = [r for r in rows if r.rule is None]
    bad = [r for r in free if any(w in r.host for w in ("casino", "pills", "bets", "spam", "adult", "ads-"))]
    good = [r for r in free if r not in bad]
    assert bad and sum(r.verdict == "block" for r in bad) / len(bad) > 0.9
    assert sum(r.verdict == "allow" for r in good) / len(good) > 0.99


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.net/en/x?y", "http://example.net/en", "https://a.b.example.net/de/#t", "http://net/", "http://net",
    "ftp://x://y/z", "http://example.com/de/", "http://badexample.com/de/", "http://a.org/fr/x", "http://a.org?fr/", "x\ny://h.org/fr/\nq?z", "http://ÄB.net/",
    "http://" + "casinowin" * 300 + ".com/" + "a" * 3000,
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "<p>casino win and some words</p>" if i % 2 else None, "extra", "s") for i, u in enumerate(URLS)]
    return spark.createDataFrame(rows + rows[:2] + [(None, "http://a.com/", "", "", "")], "page_id long, url string, html string, host string, token string")


def test_cases(pages):
    rows = uf.judge(pages).collect()
    assert len(rows) == len(URLS) + 3
    check([r for r in rows if r.page_id is not None], dict(enumerate(URLS)))
    assert uf.judge(pages.limit(0)).count() == 0


def test_split_is_the_cheapest():
    cost = {"th": 2.0, "the": 2.5, "he": 3.0, "casino": 9.0, "ca": 4.0, "si": 4.5, "no": 3.0, "win": 5.0, "in": 2.0}

    def all_splits(s):
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            out, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    out.append(s[last:i])
                    last = i
            yield [*out, s[last:]]

    for text in ("thethe", "casinowin", "xthex", "casino", "qq", "nothein"):
        price = lambda ws: sum(cost.get(w, 20.0 * len(w)) for w in ws)
        got = uf.best_split(text, cost, 20.0)
        assert "".join(got) == text and price(got) == pytest.approx(min(map(price, all_splits(text))))


def test_segments_in_spark(spark):
    counts = spark.createDataFrame([("free", 90), ("bets", 40), ("fr", 5), ("e", 1), ("be", 300)], "word string, n long")
    found = spark.createDataFrame([("freebets",), ("q" * 70,), ("xx",)], "piece string")
    rows = {r.piece: list(r.words) for r in uf.segment(found, counts).collect()}
    assert rows == {"freebets": ["free", "bets"], "q" * 70: ["q" * 70], "xx": ["xx"]}


def test_segments_of_any_length(spark):
    long, same = "donaudampfschifffahrtsgesellschaft", "donaudampfschifffahrtskapitaen"
    counts = spark.createDataFrame([("free", 90), ("bets", 40), (long, 3), (same, 9), ("q" * 300, 2)], "word string, n long")
    want = [["free", "bets"] * 8, ["free", "bets"] * 100, ["free", long, "bets"], [*["bets"] * 60, long, same, "free"], ["free", "q" * 300, "bets"], [long]]
    found = spark.createDataFrame([("".join(w),) for w in want], "piece string")
    rows = {r.piece: list(r.words) for r in uf.segment(found, counts).collect()}
    assert rows == {"".join(w): w for w in want}


def test_long_words_are_counted(spark):
    counts = uf.word_counts(spark.createDataFrame([("<p>short " + "w" * 30 + " " + "w" * 30,)], "html string"), "html")
    assert {r.word: r.n for r in counts.collect()}["w" * 30] == 2


def test_long_hosts_are_judged_by_their_words(spark):
    urls = ["http://casino.net/porn"] * 40 + [f"http://city.org/fr/museum{i}" for i in range(40)]
    urls += ["http://" + "casinoporn" * 6 + ".com/", "http://" + "casinoporn" * 7 + ".com/", "http://a.com/" + "casinoporn" * 7]
    rows = uf.judge(spark.createDataFrame([(i, u, "<p>casino porn city museum</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")).collect()
    short, host, path = sorted((r for r in rows if r.rule is None), key=lambda r: r.page_id)
    assert short.verdict == host.verdict == path.verdict == "block"
    assert host.score > short.score and path.score > short.score


def test_weights_are_those_of_naive_bayes(spark):
    tokens = spark.createDataFrame([("h", "/", "block", 3, "spam"), ("h", "/", None, 10, "news"), ("g", "/", "allow", 2, "news")], "host string, shape string, ruled string, urls long, token string")
    got = {r.token: r.weight for r in uf._weights(tokens, 0.0).collect()}
    kinds = len(set(uf.BLOCK_SEEDS) | set(uf.ALLOW_SEEDS))
    b, a = 3 + kinds, 10 * uf.PRESUMED + 2 + kinds
    assert got["spam"] == pytest.approx(math.log(4 / b) - math.log(1 / a))
    assert got["news"] == pytest.approx(math.log(1 / b) - math.log((10 * uf.PRESUMED + 3) / a))


def test_words_of_a_shape_are_added_up_once(spark, monkeypatch):
    """Urls that differ in digits are one shape, with a rule for some: the others' odds count their words once."""
    from pyspark.sql import functions as F

    from basketry.llm import url_filter

    monkeypatch.setattr(url_filter, "_weights", lambda tokens, seed: tokens.select("token").distinct().withColumn("weight", F.lit(1.0)))
    urls = ["http://ab.com/2024/tulip", "http://ab.com/2025/tulip", "http://ab.com/2025/tulip/rose"]
    text = "<p>tulip rose ab com tulip rose ab com</p>"
    pages = spark.createDataFrame([(i, u, text) for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in url_filter.judge(pages, rules=(("ab.com", "/2024/", "allow"),)).collect()}
    assert rows[0].rule == "ab.com/2024/" and rows[0].score is None
    assert round(rows[2].score - rows[1].score, 6) == 1.0
    other = {r.page_id: r for r in url_filter.judge(pages.filter("page_id > 0"), rules=(("ab.com", "/2024/", "allow"),)).collect()}
    assert round(other[2].score - other[1].score, 6) == 1.0
