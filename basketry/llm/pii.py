"""Personal data: regular expressions propose spans, checksums confirm them, context words weigh them.

DataFrame functions only. The patterns are written with possessive quantifiers and look-behinds so
that a run of characters is read once; they match what the plain forms in the comments match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import set_aside

_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> pattern, in the order that breaks ties of equal starts
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a match may begin where the last one ended
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ ; runs of one digit are dropped with the other short ones
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # what the method adds
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[a-f0-9]{32,64}|[a-f0-9]{16,31})(?![A-Za-z0-9])",
    "national": r"(?<![0-9+().-])\(?[0-9]{2,4}[)\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: kind -> score of a confirmed proposal without context
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "key": 0.9, "secret": 0.4, "national": 0.3}
#: Words near a span that raise its score, and words that lower it.
CONTEXT = {
    "email": "mail|email|contact|write|courriel|correo|kontakt",
    "ip": "ip|address|host|server|adresse|client",
    "card": "card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta",
    "phone": "tel|phone|call|fax|mobile|cell|telefon|portable",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "key": "key|aws|access|secret|credential",
    "secret": "password|passwd|pwd|token|secret|apikey|api_key|credential|passwort|contrase",
    "national": "tel|phone|call|fax|mobile|cell|telefon|portable",
}
AGAINST = "version|isbn|issn|doi|sha1|sha256|md5|commit|checksum"
RAISE, LOWER, PASS = 0.4, 0.3, 0.6
NEAR = 32  # characters on either side of a span in which context words count
_SPAN = "struct<start:int,end:int,value:string>"


def _proposals(texts: DataFrame, kind: str, maybe: Column) -> DataFrame:
    """Adds the column ``kind``: its matches with their places in code points.

    The text between matches comes from splitting at them; running sums of the lengths of both give
    the places. Sums run over chunks of 256 matches, so that thousands of matches cost no square.
    """
    pattern = PATTERNS[kind]
    none = F.array().cast("array<string>")
    texts = texts.withColumn("_m", F.when(maybe, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
    texts = texts.withColumn("_g", F.when(F.size("_m") > 0, F.split("_text", pattern, -1)).otherwise(none))
    texts = texts.withColumn("_p", F.expr("transform(_m, (x, i) -> struct(length(_g[i]) as gap, length(x) as n, x as value))"))
    inner = f"""aggregate(slice(_p, c * 256 + 1, 256),
        struct(acc.at as at, cast(array() as array<{_SPAN}>) as found),
        (a, x) -> struct(a.at + x.gap + x.n as at, concat(a.found, array(struct(
            a.at + x.gap as start, a.at + x.gap + x.n as end, x.value as value))) as found))"""
    spans = f"""case when size(_p) = 0 then cast(array() as array<{_SPAN}>) else flatten(aggregate(
        sequence(0, (size(_p) - 1) div 256), struct(0 as at, cast(array() as array<array<{_SPAN}>>) as found),
        (acc, c) -> transform(array({inner}), r -> struct(r.at as at, concat(acc.found, array(r.found)) as found))[0]).found) end"""
    return texts.withColumn(f"_{kind}", F.expr(spans)).drop("_m", "_g", "_p")


def _luhn(digits: str) -> str:
    return f"""aggregate(sequence(1, length({digits})), 0L, (s, i) -> s + case
        when (length({digits}) - i) % 2 = 0 then int(substring({digits}, i, 1))
        else 2 * int(substring({digits}, i, 1)) div 10 + 2 * int(substring({digits}, i, 1)) % 10 end) % 10 = 0"""


def _mod97(compact: str) -> str:
    moved = f"concat(substring({compact}, 5), substring({compact}, 1, 4))"
    return f"""aggregate(sequence(1, length({compact})), 0L, (s, i) -> case
        when substring({moved}, i, 1) between '0' and '9' then (s * 10 + int(substring({moved}, i, 1))) % 97
        else (s * 100 + ascii(substring({moved}, i, 1)) - 55) % 97 end) = 1"""


#: kind -> condition on the span ``x`` that confirms it
CONFIRM = {
    "email": "true",
    "ip": """forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) < 3
        or (length(ltrim('0', p)) = 3 and ltrim('0', p) <= '255'))""",
    "card": f"""exists(array(translate(x.value, ' -', '')),
        d -> case when length(d) between 12 and 19 then {_luhn("d")} else false end)""",
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) between 9 and 15",
    "iban": f"exists(array(translate(x.value, ' ', '')), d -> length(d) between 15 and 34 and {_mod97('d')})",
    "key": "true",
    # not one digit or letter over and over, nor digits only
    "secret": "x.value rlike '[a-f]' and size(array_distinct(split(x.value, ''))) > 5",
    "national": "length(regexp_replace(x.value, '[^0-9]', '')) between 9 and 12",
}


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: an array of (start, ord, end, kind, value, score, base), by start and kind.

    Places are code points, the end exclusive. Spans of the base kinds are all that their pattern
    matches, leftmost and without overlap within the kind, and their check confirms. Spans of the
    other kinds need a score of ``PASS``, which a context word within ``NEAR`` characters before or
    behind them raises and a word for numbers of other uses lowers. A word behind that announces
    something else, as in ``phone:``, does not count. A null or empty text has none; null ids and
    repeated rows are rows like others, as nothing is looked at but the text.
    """
    plain, back = set_aside(docs, "text")
    texts = plain.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    digits, at = F.col("_text").rlike("[0-9]"), F.contains(F.col("_text"), F.lit("@"))
    texts = texts.withColumn("_digits", digits)
    for kind in PATTERNS:
        maybe = at if kind == "email" else F.col("_digits") & F.contains(F.col("_text"), F.lit("+")) if kind == "phone" else F.col("_digits")
        texts = _proposals(texts, kind, maybe)
    parts = []
    for number, kind in enumerate(PATTERNS):
        before = f"lower(substring(_text, greatest(x.start - {NEAR}, 0) + 1, least(x.start, {NEAR})))"
        behind = f"lower(substring(_text, x.end + 1, {NEAR}))"

        def near(found: str) -> str:
            return f"({before} rlike '(^|[^a-z])({found})' or {behind} rlike '(^|[^a-z])({found})[a-z]*+(?!\\\\x20?[:=])')"  # noqa: B023

        score = f"""round({SCORES[kind]}D
            + case when {near(CONTEXT[kind])} then {RAISE}D else 0D end
            - case when {near(AGAINST)} then {LOWER}D else 0D end, 2)"""
        made = f"""transform(filter(_{kind}, x -> {CONFIRM[kind]}), x -> struct(x.start as start, {number} as ord, x.end as end,
            '{kind}' as kind, x.value as value, greatest(0D, least(1D, {score})) as score, {str(kind in BASE).lower()} as base))"""
        parts.append(made if kind in BASE else f"filter({made}, x -> x.score >= {PASS}D)")
    texts = texts.withColumn("pii", F.expr(f"sort_array(concat({', '.join(parts)}))"))
    return texts.select(*[c for c, name in zip(back, docs.columns) if name != "pii"], "pii")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and places per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more."""
    found = find(docs.select("doc_id", "text"))
    label = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    joined = lambda a: F.array_join(F.transform(a, label), ",")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(k) for k in BASE],
        F.sha2(joined(F.filter("pii", lambda x: x["base"])), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda x: ~x["base"])).cast("long").alias("n_more"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``find`` replaced by its kind in capitals and angle brackets.

    Of overlapping spans the first names the place, all of both is taken out. Texts without spans, null
    texts among them, stay as they are; ``n_chars``, where there is one, follows the text. Null ids and
    repeated rows are rows like others.
    """
    plain, back = set_aside(docs, "text", "n_chars")
    found = find(plain)
    text = F.expr("""case when size(pii) = 0 then text else concat(
        aggregate(pii, struct(0 as at, '' as out), (a, x) -> case
            when x.end <= a.at then a
            when x.start < a.at then struct(x.end as at, a.out as out)
            else struct(x.end as at, concat(a.out, substring(text, a.at + 1, x.start - a.at), '<', upper(x.kind), '>') as out) end,
            a -> a.out),
        substring(text, array_max(transform(pii, x -> x.end)) + 1)) end""")
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*back)
