"""URL filter: rules first, then words cut out of host names and a multinomial naive Bayes.

Runs of letters of a host or path are split into words by a unigram Viterbi pass; word frequencies
come from the text of the pages. The classifier learns from the urls that a rule decides, from the
others as presumed allowed, and from two short seed lists, and judges the urls no rule decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import materialize, ship_code

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Words that mark unwanted or ordinary sites before any url is seen.
BLOCK_SEEDS = (
    "ads adult bet bets bonus casino cheap click crack deals escort farm free gambling jackpot loan loans lottery "
    "nude pharma pills poker porn prize sex slots spam track tracker viagra warez win xxx"
).split()
ALLOW_SEEDS = (
    "about article blog book city docs edu forum guide health help history home learn library music museum news park "
    "press research school science shop sport story travel university weather wiki www"
).split()

HEAD = 20  # letters of a word that are looked up at once; longer words are found by their first ones
BLOCK = 256  # places of a run of letters that are cut out together
SEED_SHARE = 0.02  # of all urls: as many as these does a seed word stand for
SEED_WORDS = 1e-5  # of all words: as frequent is a seed word at least
PRESUMED = 0.2  # weight as allowed of a url that no rule decides
SMOOTH = 1.0
MARGIN = 2.0  # log odds above which a url is blocked: doubtful ones pass


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rule = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, rule, 1), upper, lower), F.regexp_extract(url, rule, 2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for site, start, kind in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == site) | F.endswith(host, F.lit(f".{site}"))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, F.lit(site + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def pieces(host: Column, path: Column) -> Column:
    """The runs of letters of host and path, lower-cased, as an array with repeats."""
    both = F.lower(F.concat_ws("/", host, path))
    return F.regexp_extract_all(both, F.lit(r"(\p{L}+)"), 1)


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): how often each run of letters occurs in the texts, without tags; seed words are added."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"<[^>]*>", " "))
    found = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "counts")
    least = math.ceil((counts.agg(F.sum("n")).first()[0] or 0) * SEED_WORDS) or 1
    seeds = texts.sparkSession.createDataFrame([(w, least) for w in (*BLOCK_SEEDS, *ALLOW_SEEDS)], "word string, n long")
    return counts.unionByName(seeds).groupBy("word").agg(F.max("n").alias("n"))


def best_split(piece: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split into words; ``unknown`` is the cost of a letter that belongs to none.

    Letters in a row that belong to no word stay together. Of equal costs the longer last word wins.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    lengths = sorted({len(w) for w in cost})
    for end in range(1, len(piece) + 1):
        options = [(best[end - 1][0] + unknown, end - 1)]
        for n in lengths:
            if n > end:
                break
            if (c := cost.get(piece[end - n : end])) is not None:
                options.append((best[end - n][0] + c, end - n))
        best.append(min(options))
    cuts, end = [], len(piece)
    while end:
        start = best[end][1]
        known = piece[start:end] in cost
        if cuts and not known and not cuts[-1][2]:
            cuts[-1] = (start, cuts[-1][1], False)
        else:
            cuts.append((start, end, known))
        end = start
    return [piece[a:b] for a, b, _ in reversed(cuts)]


def segment(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece) -> (piece, words): each distinct piece split by the unigram model of ``counts``.

    Only counts of substrings of the pieces are needed. Those of up to ``HEAD`` letters are cut out,
    ``BLOCK`` places of a piece in a row, and joined by word; longer words are joined by their first
    ``HEAD`` letters and looked for in the piece. Both are gathered per piece, so that no model
    travels whole.
    """
    found = materialize(found.select("piece", F.monotonically_increasing_id().alias("id")), "runs")
    spans = F.expr(f"""flatten(transform(sequence(1, least({BLOCK}, length(block))), i -> transform(
        sequence(1, least({HEAD}, length(block) - i + 1)), k -> substring(block, i, k))))""")
    block = F.expr(f"explode(transform(sequence(1, length(piece), {BLOCK}), i -> substring(piece, i, {BLOCK + HEAD - 1})))")
    parts = found.select("id", block.alias("block")).select("id", F.explode(F.array_distinct(spans)).alias("word"))
    known = parts.join(counts.filter(F.length("word") <= HEAD), "word").select("id", "word", "n")
    heads = F.expr(f"transform(sequence(1, least({BLOCK}, length(block) - {HEAD - 1})), i -> substring(block, i, {HEAD}))")
    wide = found.filter(F.length("piece") > HEAD).select("id", F.length("piece").alias("letters"), block.alias("block"))
    wide = wide.filter(F.length("block") >= HEAD).select("id", "letters", F.explode(F.array_distinct(heads)).alias("head"))
    long = counts.filter(F.length("word") > HEAD).select(F.substring("word", 1, HEAD).alias("head"), "word", "n")
    tried = wide.join(long, "head").filter(F.length("word") <= F.col("letters")).select("id", "word", "n")
    inside = tried.join(found, "id").filter(F.contains("piece", "word")).select("id", "word", "n")
    known = known.unionByName(inside).groupBy("id").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    rows = found.join(known, "id", "left")
    size = counts.agg(F.sum("n")).first()[0] or 1

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        unknown = math.log(size) + 5.0
        for texts, models in batches:
            out = []
            for text, model in zip(texts, models):
                cost = {r["word"]: math.log(size) - math.log(r["n"]) for r in (model if model is not None else [])}
                # rare one-letter debris would win against whole words
                cost = {w: c for w, c in cost.items() if len(w) > 1 or c < math.log(1000)}
                out.append(best_split(text, cost, unknown))
            yield pd.Series(out)

    return rows.select("piece", split("piece", "known").alias("words"))


def judge(pages: DataFrame, rules=RULES, margin: float = MARGIN) -> DataFrame:
    """``pages`` judged: page_id, host, path, rule, verdict, score (log odds of block; null with a rule).

    One row per input row. Null urls, and urls without ``://`` have an empty host and path and get the
    verdict of no words at all: the more frequent class. Null ids and repeated rows are judged like
    others, null pages add no words, other columns are ignored, no rows give no rows.
    """
    ship_code()
    host, path = url_parts(pages["url"])
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("ruled", verdict)
    # urls that differ in nothing but their digits are one: counted, not repeated
    shapes = rows.groupBy("host", F.regexp_replace("path", "[0-9]+", "0").alias("shape"), "ruled").agg(F.count(F.lit(1)).alias("urls"))
    shapes = materialize(shapes.withColumn("pieces", pieces(F.col("host"), F.col("shape"))), "shapes")
    distinct = shapes.select(F.explode("pieces").alias("piece")).distinct()
    counts = materialize(word_counts(pages.select(pages["html"].cast("string").alias("html")), "html"), "words")
    split = materialize(segment(distinct, counts), "pieces")
    said = sorted({p for site, start, _ in rules for p in (site + start).replace("/", ".").split(".") if p})
    tokens = (
        shapes.select("host", "shape", "ruled", "urls", F.explode("pieces").alias("piece"))
        .join(split, "piece")
        .select("host", "shape", "ruled", "urls", F.explode("words").alias("token"))
        # what the rules themselves say would only repeat them
        .filter(~F.col("token").isin(said))
    )
    tokens = materialize(tokens, "tokens")
    blocked = F.sum(F.when(F.col("ruled") == "block", F.col("urls")).otherwise(0))
    unruled = F.sum(F.when(F.col("ruled").isNull(), F.col("urls")).otherwise(0))
    prior = shapes.agg(blocked.alias("b"), unruled.alias("u"), F.sum("urls").alias("n")).first()
    bad, unsure, urls = prior.b or 0, prior.u or 0, prior.n or 0
    start = math.log(bad + 1) - math.log(urls - bad - unsure + PRESUMED * unsure + 1)
    weights = materialize(_weights(tokens, SEED_SHARE * urls), "weights")
    # a shape may stand both with and without a rule: only the words of the latter are added up
    open_ = tokens.filter(F.col("ruled").isNull())
    scores = open_.join(weights, "token").groupBy("host", "shape").agg(F.sum("weight").alias("odds"))
    judged = shapes.select("host", "shape").distinct().join(scores, ["host", "shape"], "left")
    judged = judged.withColumn("odds", F.round(F.coalesce("odds", F.lit(0.0)) + start, 9))
    judged = materialize(judged, "judged").withColumnsRenamed({"host": "_host", "shape": "_shape"})
    rows = rows.join(judged, (rows["host"] == judged["_host"]) & (F.regexp_replace("path", "[0-9]+", "0") == judged["_shape"]))
    score = F.when(F.col("ruled").isNull(), F.col("odds"))
    own = F.when(F.col("odds") > margin, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), score.alias("score"))


def _weights(tokens: DataFrame, seed: float) -> DataFrame:
    """(token, weight): the log ratio of a token's smoothed share in blocked and other urls;
    ``seed`` is the number of urls that a seed word stands for."""
    spark = tokens.sparkSession
    seeds = [(w, seed, 0.0) for w in BLOCK_SEEDS] + [(w, 0.0, seed) for w in ALLOW_SEEDS]
    is_block = F.coalesce(F.col("ruled") == "block", F.lit(False))
    sure = F.when(F.col("ruled").isNull(), PRESUMED).otherwise(1.0)
    seen = tokens.select("token", F.when(is_block, F.col("urls")).otherwise(0).cast("double").alias("b"), F.when(is_block, 0).otherwise(F.col("urls") * sure).cast("double").alias("a"))
    both = seen.unionByName(spark.createDataFrame(seeds, "token string, b double, a double"))
    both = materialize(both.groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "token-counts")
    all_b, all_a, kinds = both.agg(F.sum("b"), F.sum("a"), F.count(F.lit(1))).first()
    ratio = F.log((F.col("b") + SMOOTH) / (all_b + SMOOTH * kinds)) - F.log((F.col("a") + SMOOTH) / (all_a + SMOOTH * kinds))
    return both.select("token", ratio.alias("weight"))
