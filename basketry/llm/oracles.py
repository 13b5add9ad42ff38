"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: every pair of documents that share a shingle, then components by the smallest id that is reached
JACCARD = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, (common = x.n AND common = y.n) AS same FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * common >= 4 * (x.n + y.n - common)),
reach AS (SELECT a AS doc_id, a AS seen FROM (SELECT DISTINCT a FROM links) UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen),
classes AS (SELECT doc_id, min(seen) AS class_id FROM reach GROUP BY doc_id),
counts AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS copies FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links,
  CASE WHEN len(words) = 0 THEN 0 ELSE coalesce(copies, 0) + 1 END AS copies
FROM w LEFT JOIN classes USING (doc_id) LEFT JOIN counts USING (doc_id)"""


def _quality() -> str:
    parts = [
        rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, lang, source, text, regexp_extract_all(text, '{_WORD}') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM t),
tokens AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
windows AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
    || ' ' || lead(word, 4) OVER o AS five FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS c FROM windows WHERE five IS NOT NULL)
  WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(array_to_string(words, ''), '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^!?=~^_{{}}\[\]\\]', '', 'g'))::BIGINT AS n_marks
  FROM w LEFT JOIN covered USING (doc_id)),
measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
    CASE WHEN word_chars > 0 THEN 1000 * n_upper // word_chars ELSE 0 END AS upper,
    CASE WHEN word_chars > 0 THEN 1000 * n_marks // word_chars ELSE 0 END AS marks,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS long_words FROM base)"""
    ]
    # measure: percents of its two quantiles, what it is counted per thousand of
    rules = (
        ("symbols", 10, 90, "word_chars"), ("upper", 10, 90, "word_chars"), ("marks", 10, 90, "word_chars"),
        ("repeats", 50, 99, "n_words"), ("dup_lines", 50, 99, "n_lines"), ("long_words", 25, 75, None),
    )
    tests = []
    for m, low, high, of in rules:
        parts.append(f"""b_{m} AS (
  SELECT lang, source, {m} - {m} % (1 << greatest(length(bin({m})) - 9, 0)) AS bucket, count(*) AS n
  FROM measured WHERE NOT base_failed GROUP BY ALL)""")
        for level, by in enumerate(("lang, source", "lang", "one")):
            parts.append(f"""f_{m}_{level} AS (
  SELECT {by}, b + 3 * (b - a) AS top, a - 3 * (b - a) AS low FROM (
    SELECT {by}, max(total) AS docs, min(bucket) FILTER (100 * below >= {low} * total) AS a,
           min(bucket) FILTER (100 * below >= {high} * total) AS b
    FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}) AS total
          FROM (SELECT *, 1 AS one FROM b_{m}))
    GROUP BY {by}) WHERE docs >= {100 if level < 2 else 0})""")
        top, least = (f"""coalesce((SELECT {end} FROM f_{m}_0 f WHERE f.lang IS NOT DISTINCT FROM d.lang AND f.source IS NOT DISTINCT FROM d.source),
    (SELECT {end} FROM f_{m}_1 f WHERE f.lang IS NOT DISTINCT FROM d.lang), (SELECT {end} FROM f_{m}_2), {m})""" for end in ("top", "low"))
        if of:
            tests.append(f"{m} <= {top} + CASE WHEN {of} > 0 THEN 3000 // {of} ELSE 0 END")
        else:
            for distance, mean in ((f"{m} - {top}", top), (f"{least} - {m}", least)):
                tests.append(f"pow(greatest({distance}, 0)::DOUBLE, 2) * n_words <= 13500.0::DOUBLE * greatest({mean}, 0)")
    return (
        ",\n".join(parts)
        + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(tests)} AS kept FROM measured d"""
    )


#: every string of 200 bytes by its digest; runs of the places at which a repeated one starts
REPEATS = """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
starts AS (
  SELECT doc_id, i, md5(array_slice(bytes, i, i + 199)) AS digest
  FROM (SELECT doc_id, bytes, unnest(range(1, octet_length(bytes) - 198)) AS i FROM t WHERE octet_length(bytes) >= 200)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY digest) AS c FROM starts) WHERE c > 1),
runs AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM again)),
spans AS (SELECT doc_id, min(i) AS low, max(i) + 200 AS high FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(high) OVER o, 1) AS low, low AS high FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY low)
  UNION ALL SELECT doc_id, max(high), octet_length(any_value(bytes)) + 1 FROM spans JOIN t USING (doc_id) GROUP BY doc_id
  UNION ALL SELECT doc_id, 1, octet_length(bytes) + 1 FROM t WHERE doc_id NOT IN (SELECT doc_id FROM spans)),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN high > low THEN hex(array_slice(bytes, low, high - 1)) ELSE '' END, '' ORDER BY low) AS text
  FROM gaps JOIN t USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(bytes)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.text)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

ORACLES: dict[str, str] = {"op1_jaccard": JACCARD, "op7_quality": _quality(), "op8_suffixes": REPEATS}

ORACLES["op11_fim"] = r"""WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents),
drawn AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(tokens) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(tokens) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT doc_id, n, form, text, array_to_string(tokens[1:least(a, b)], '') AS prefix,
         array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(tokens[greatest(a, b) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN len(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts"""
