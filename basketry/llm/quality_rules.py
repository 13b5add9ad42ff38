"""Quality rules with thresholds that adapt to language and source.

Measures of every whole text are turned into mergeable quantile sketches: counts of integer values in
buckets whose width grows with the value (a relative error of 1/256), so that merging is adding and a
rerun gives the same sketch. From the sketch of a language and source, or of the language, or of all
documents where there are too few, come two quantiles of each measure and fences at a multiple of
their distance, above and, for the length of words, below; documents beyond a fence are rejected. No
distance is fixed: where a measure hardly varies, only what a single text can show by chance is let
through, which is a few occurrences, or the error of a mean over so many words. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import WHITE, materialize, set_aside, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
ENOUGH = 100  # documents of a language and source, or of a language, that make a sketch of their own
FENCE = 3  # distances of the quantiles beyond them, and what a single text may show by chance
#: measure -> percents of the two quantiles. Of rare things nearly all texts have none: there the spread
#: lies above the median. Junk of one kind may be a tenth of a source without moving the others.
MEASURES = {"symbols": (10, 90), "upper": (10, 90), "marks": (10, 90), "repeats": (50, 99), "dup_lines": (50, 99), "long_words": (25, 75)}
#: measure -> what its occurrences are counted per thousand of; mean word length is no count
OF = {"symbols": "word_chars", "upper": "word_chars", "marks": "word_chars", "repeats": "n_words", "dup_lines": "n_lines"}


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_upper and n_marks (long) and base_failed. A null text has no words."""
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    steps = docs.withColumn("_words", words(F.col("text").cast("string")))
    # hashes of the windows of five, in order: equal windows have equal hashes
    steps = steps.withColumn(
        "_windows",
        F.expr(f"""case when size(_words) < {WINDOW} then cast(array() as array<bigint>) else transform(
            sequence(0, size(_words) - {WINDOW}),
            i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])) end"""),
    )
    # only texts with an equal pair go further: windows sorted by hash, then the places of equal ones
    steps = steps.withColumn("_twice", F.expr("size(array_distinct(_windows)) < size(_windows)"))
    steps = steps.withColumn(
        "_sorted",
        F.expr("""case when _twice then sort_array(transform(_windows, (h, i) -> struct(h as h, i as i)))
                  else cast(array() as array<struct<h:bigint,i:int>>) end"""),
    )
    steps = steps.withColumn(
        "_places",
        F.expr("""sort_array(transform(
            filter(transform(_sorted, (x, k) -> struct(
                       x.i as i,
                       (k > 0 and _sorted[k - 1].h = x.h)
                           or (k < size(_sorted) - 1 and _sorted[k + 1].h = x.h) as twice)),
                   x -> x.twice),
            x -> x.i))"""),
    )
    repeats = F.expr(f"""aggregate(
        transform(_places, (p, k) -> case when k < size(_places) - 1 then least({WINDOW}, _places[k + 1] - p) else {WINDOW} end),
        0L, (total, n) -> total + n)""")
    white = F.lit(WHITE)
    plain = F.translate(text, WHITE, "")
    steps = steps.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, white)) > 0))
    return steps.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(plain).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        (F.length(plain) - F.length(F.regexp_replace(plain, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, "!?=~^_{}[]\\", ""))).cast("long").alias("n_marks"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    )


def values(measured: DataFrame) -> DataFrame:
    """The measures that get thresholds, as integers per thousand; 0 for texts without words."""
    per = lambda a, b: F.expr(f"case when {b} > 0 then 1000 * {a} div {b} else 0L end")
    return measured.withColumns(
        {
            "symbols": per("n_symbols", "word_chars"),
            "upper": per("n_upper", "word_chars"),
            "marks": per("n_marks", "word_chars"),
            "repeats": per("n_repeat_words", "n_words"),
            "dup_lines": per("n_dup_lines", "n_lines"),
            "long_words": per("word_chars", "n_words"),
        }
    )


def bucket(value: Column) -> Column:
    """The lower edge of a value's bucket: exact below 512, then the eight bits after the first kept."""
    shift = F.greatest(F.length(F.bin(value)) - 9, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("long")
    return value - F.pmod(value, width)


def sketch(valued: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): mergeable by adding n. Texts that fail the base rules say
    nothing about their source and are left out."""
    long = valued.filter(~F.col("base_failed")).select(
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("v"),
    )
    return long.groupBy("lang", "source", "v.measure", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """(lang, source, for each measure ``_top`` and ``_low``): the greatest and the least value that pass.

    Quantiles by the buckets' counts, of the language and source if they have ``ENOUGH`` documents,
    else of the language, else of all; the fences lie ``FENCE`` times their distance beyond them.
    """
    sketches = materialize(sketches, "sketches")
    keys = sketches.select("lang", "source").distinct()
    levels = []
    for level, by in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
        order = Window.partitionBy(*by, "measure").orderBy("bucket")
        merged = merged.withColumn("below", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*by, "measure")))
        percent = lambda k: F.element_at(F.create_map(*[F.lit(x) for m, pair in MEASURES.items() for x in (m, pair[k])]), F.col("measure"))  # noqa: E731, B023
        at = lambda k: F.min(F.when(100 * F.col("below") >= percent(k) * F.col("all"), F.col("bucket")))  # noqa: E731, B023
        quantiles = merged.groupBy(*by, "measure").agg(F.max("all").alias("docs"), at(0).alias("a"), at(1).alias("b"))
        reach = FENCE * (F.col("b") - F.col("a"))
        quantiles = quantiles.withColumn("fence", F.struct((F.col("a") - reach).alias("low"), (F.col("b") + reach).alias("top")))
        wide = quantiles.filter(F.col("docs") >= (ENOUGH if by else 0)).groupBy(*by).agg(
            *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{m}_{level}") for m in MEASURES]
        )
        levels.append(wide)
    full, lang, whole = levels
    full = full.withColumnsRenamed({"lang": "_l", "source": "_s"})
    out = keys.join(full, keys["lang"].eqNullSafe(full["_l"]) & keys["source"].eqNullSafe(full["_s"]), "left").drop("_l", "_s")
    lang = lang.withColumnRenamed("lang", "_l")
    out = out.join(lang, out["lang"].eqNullSafe(lang["_l"]), "left").drop("_l")
    last = whole.first() or {}  # two numbers per measure, if any text passes the base rules
    columns = []
    for m in MEASURES:
        for end in ("top", "low"):
            rest = F.lit(last[f"{m}_2"][end] if last and last[f"{m}_2"] else None).cast("long")
            columns.append(F.coalesce(F.col(f"{m}_0.{end}"), F.col(f"{m}_1.{end}"), rest).alias(f"{m}_{end}"))
    return out.select("lang", "source", *columns)


def _within(m: str) -> Column:
    """Whether a document's measure is inside its fences, give or take chance."""
    value, top, low = F.col(m), F.col(f"{m}_top"), F.col(f"{m}_low")
    if m in OF:  # ``FENCE`` occurrences more, of which fewer are never odd
        return value <= top + F.expr(f"case when {OF[m]} > 0 then {1000 * FENCE} div {OF[m]} else 0L end")
    # word lengths vary by about 1.5 times their mean, the mean of n words by an nth of that
    def beyond(distance: Column, mean: Column) -> Column:
        far = F.greatest(distance, F.lit(0)).cast("double")
        return far * far * F.col("n_words") > FENCE * FENCE * 1500.0 * F.greatest(mean, F.lit(0))

    return ~beyond(value - top, top) & ~beyond(low - value, low)


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep`` (lang and source among them), with the columns of ``measure`` and ``kept``: false where the base rules fail or a
    measure is beyond the fence of the document's language and source.

    Each input row gives one row. Null and empty texts have no words and fail; null languages and
    sources are values of their own; null ids and repeated rows are judged like others; columns of
    ``docs`` named like those added are replaced; no rows give no rows.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_marks", "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in added and (keep is None or c in keep)]
    plain, back = set_aside(docs.select(*keep, *[c for c in ("text", "lang", "source") if c not in keep]), "text", "lang", "source")
    carried = [c for c in plain.columns if c != "text" or "text" in keep]
    valued = materialize(values(measure(plain, carried)), "measured")
    tops = materialize(fences(sketch(valued)), "fences").withColumnsRenamed({"lang": "_l", "source": "_s"})
    # one row per language and source; the planner knows its size and sends it to the tasks if small
    joined = valued.join(tops, valued["lang"].cast("string").eqNullSafe(tops["_l"]) & valued["source"].cast("string").eqNullSafe(tops["_s"]), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(_within(m), F.lit(True))
    judged = joined.withColumn("kept", ~F.col("base_failed") & inside)
    return judged.select(*back[: len(keep)], *added)
