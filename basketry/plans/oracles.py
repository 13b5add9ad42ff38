"""The registered queries once more, as SQL over the same tables, for a value-by-value comparison."""

from __future__ import annotations

from basketry.functions.prompts import (
    GENERAL_STARTERS,
    GROCERY_STARTERS,
    LONG_ENDING,
    SHORT_ENDING,
    SYSTEM_PROMPT,
    SYSTEM_PROMPT_NO_EXPLANATION,
)


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _bucket(text: str, n: int = 100) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {n})"


STARTER_PRODUCTS = ("red widget", "small ring", "hot plate")
HELD_OUT_BUCKET = _bucket("user_id || ':' || product_id")
SAMPLE_BUCKET = _bucket("product_id || ':' || user_id")

ORD = """ord AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS order_date FROM orders)"""
LIN = """lin AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS product_id,
         l_suppkey AS supplier_id, l_extendedprice AS price, l_shipdate AS ship_date FROM lineitem)"""
PROD = """prod AS (
  SELECT p_partkey AS product_id, p_name || ' #' || p_partkey AS product_name FROM part)"""
NUMBERED = """numbered AS (
  SELECT *, row_number() OVER w AS order_number, lag(order_date) OVER w AS prior_date,
         lead(order_id) OVER w AS next_order
  FROM ord WINDOW w AS (PARTITION BY user_id ORDER BY order_date, order_id))"""
SHAPED = """shaped AS (
  SELECT order_id, user_id,
         CASE WHEN next_order IS NOT NULL THEN 'prior' WHEN user_id % 3 = 0 THEN 'test' ELSE 'train' END
           AS eval_set,
         order_number::INTEGER AS order_number, dayofweek(order_date)::INTEGER AS order_dow,
         hour(order_date)::INTEGER AS order_hour_of_day,
         date_diff('day', prior_date, order_date)::FLOAT AS days_since_prior_order
  FROM numbered)"""
CART = """cart AS (
  SELECT order_id, product_id,
         row_number() OVER (PARTITION BY order_id
           ORDER BY line_number, product_id, supplier_id, price, ship_date)::INTEGER AS add_to_cart_order
  FROM lin)"""
UNITED = """united AS (
  SELECT c.order_id, c.product_id, c.add_to_cart_order FROM cart c JOIN shaped s USING (order_id)
  WHERE s.eval_set IN ('prior', 'train'))"""

BOUGHT = """bought AS (
  SELECT user_id, product_id, count(*) AS product_purchases
  FROM ord JOIN lin USING (order_id) JOIN prod USING (product_id) GROUP BY ALL)"""
VISITS = "visits AS (SELECT user_id, count(DISTINCT order_id) AS purchase_events FROM ord GROUP BY ALL)"
RATED = """rated AS (
  SELECT user_id, product_id, product_purchases / purchase_events AS rating
  FROM bought JOIN visits USING (user_id))"""
RATING_CTES = (ORD, LIN, PROD, BOUGHT, VISITS, RATED)

TEST = f"test AS (SELECT * FROM rated WHERE {HELD_OUT_BUCKET} >= 80)"
# whole groups of equal ratings, as the running count includes all rows with the same rating
WHOLE = """running AS (
  SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY rating DESC) AS taken FROM test),
everyone AS (
  SELECT user_id, list(product_id ORDER BY rating DESC, product_id) AS selections
  FROM running WHERE taken <= 10 GROUP BY user_id),
chosen AS (SELECT * FROM everyone WHERE len(selections) > 5)"""
CHOSEN_CTES = (*RATING_CTES, TEST, WHOLE)

ITEMS = """items AS (
  SELECT user_id, unnest(selections) AS product_id, generate_subscripts(selections, 1) AS pos FROM chosen)"""
NAMED = """named AS (
  SELECT user_id, list(product_id ORDER BY pos) AS selections,
         list(coalesce(product_name, '') ORDER BY pos) AS names
  FROM items LEFT JOIN prod USING (product_id) GROUP BY user_id)"""
NAMED_CTES = (*CHOSEN_CTES, ITEMS, NAMED)

HISTORIES = """histories AS (
  SELECT c_custkey AS user_id, coalesce(names[1:3], []) AS history
  FROM customer LEFT JOIN named ON user_id = c_custkey)"""


def _started(starters) -> str:
    n = len(starters)
    return f"""started AS (
  SELECT user_id, len(history) = 0 AS cold,
         CASE WHEN len(history) = 0
              THEN [({_list(starters)})[({_bucket("user_id || ':0'", n)} + 1)]]
              ELSE history END AS history
  FROM histories)"""


def _spoken(items: str) -> str:
    return f"""CASE WHEN len({items}) > 1
      THEN array_to_string({items}[1:len({items}) - 1], ', ') || ', and ' || {items}[len({items})]
      WHEN len({items}) = 1 THEN {items}[1] END"""


def _prompt(items: str, system: str, ending: str) -> str:
    head = f"[INST] <<SYS>>\n{system}\n<</SYS>>\nA user bought "
    tail = " in that order. What single item would he/she be likely to purchase next?" + ending
    return f"{_text(head)} || {_spoken(items)} || {_text(tail)}"


LONG_PROMPTS = f"prompted AS (SELECT user_id, {_prompt('history', SYSTEM_PROMPT, LONG_ENDING)} AS prompt FROM started)"

# next purchases in the training part
FOLLOWED = f"""followed AS (
  SELECT product_id, lead(product_id) OVER (PARTITION BY user_id
           ORDER BY order_date, order_id, line_number, product_id, supplier_id, price, ship_date) AS next_product
  FROM lin JOIN ord USING (order_id) WHERE {HELD_OUT_BUCKET} < 80),
moves AS (
  SELECT product_id, next_product, count(*) AS n FROM followed WHERE next_product IS NOT NULL GROUP BY ALL),
ranked_moves AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, next_product)::INTEGER AS rank
  FROM moves),
best_move AS (SELECT product_id, next_product FROM ranked_moves WHERE rank = 1),
usual AS (
  SELECT next_product AS fallback FROM moves GROUP BY next_product ORDER BY sum(n) DESC, next_product LIMIT 1)"""

TOGETHER = f"""train_lines AS (
  SELECT DISTINCT order_id, product_id FROM lin JOIN ord USING (order_id) WHERE {HELD_OUT_BUCKET} < 80),
near AS (
  SELECT a.product_id, b.product_id AS neighbour, count(*) AS n
  FROM train_lines a JOIN train_lines b ON a.order_id = b.order_id AND a.product_id <> b.product_id
  GROUP BY ALL),
ranked_near AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, neighbour)::INTEGER AS rank FROM near)"""

NEIGHBOURS = f"""train_cart AS (
  SELECT order_id, product_id, add_to_cart_order FROM cart JOIN ord USING (order_id)
  WHERE {HELD_OUT_BUCKET} < 80),
near AS (
  SELECT a.product_id, b.product_id AS neighbour, count(*) AS n
  FROM train_cart a JOIN train_cart b
    ON a.order_id = b.order_id AND a.product_id <> b.product_id
   AND abs(a.add_to_cart_order - b.add_to_cart_order) BETWEEN 1 AND 10
  GROUP BY ALL),
ranked_near AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, neighbour)::INTEGER AS rank FROM near)"""

# what followed the last one to three names, in the training part
FOLLOWERS = f"""bought_names AS (
  SELECT user_id, product_name AS item, row_number() OVER w AS pos
  FROM lin JOIN ord USING (order_id) JOIN prod USING (product_id) WHERE {HELD_OUT_BUCKET} < 80
  WINDOW w AS (PARTITION BY user_id ORDER BY order_date, order_id, line_number, product_id, supplier_id, price, ship_date)),
runs AS (
  SELECT lead(item) OVER w AS next, [item] AS c1, [lag(item) OVER w, item] AS c2,
         [lag(item, 2) OVER w, lag(item) OVER w, item] AS c3
  FROM bought_names WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
followers AS (
  SELECT context, next, count(*) AS n FROM (
    SELECT c1 AS context, next FROM runs UNION ALL SELECT c2, next FROM runs WHERE c2[1] IS NOT NULL
    UNION ALL SELECT c3, next FROM runs WHERE c3[1] IS NOT NULL)
  WHERE next IS NOT NULL GROUP BY ALL),
usual_name AS (
  SELECT next AS usual FROM followers WHERE len(context) = 1 GROUP BY next ORDER BY sum(n) DESC, next LIMIT 1)"""


def _drawn(name: str, source: str, history: str, temperature: float) -> str:
    """``name``: ``source`` with ``drawn``, the next name for the list in ``history``, one row per user."""
    key = f"array_to_string({history}[-3:], '|')"
    noise = f"ln(-ln(({_bucket(f"'0:' || {key} || ':' || next", 1 << 32)} + 0.5) / 4294967296))"
    score = f"ln(n) / {temperature} - {noise}" if temperature else "n"
    return f"""{name}_answers AS (
  SELECT user_id, next FROM (
    SELECT user_id, next, row_number() OVER (PARTITION BY user_id ORDER BY len(context) DESC, {score} DESC, next) AS r
    FROM {source} JOIN followers ON context = {history}[-1:] OR context = {history}[-2:] OR context = {history}[-3:])
  WHERE r = 1),
{name} AS (
  SELECT s.*, coalesce(next, (SELECT usual FROM usual_name)) AS drawn FROM {source} s LEFT JOIN {name}_answers USING (user_id))"""


TRUTH = """truth AS (
  SELECT user_id, selections[1:3] AS history, selections[4:] AS ground_truth FROM chosen)"""


def _steps(n: int) -> str:
    """A walk of n steps from the last item of the history."""
    parts = ["step0 AS (SELECT user_id, history[len(history)] AS item0 FROM truth)"]
    for i in range(1, n + 1):
        parts.append(
            f"""step{i} AS (
  SELECT s.*, coalesce(b.next_product, (SELECT fallback FROM usual)) AS item{i}
  FROM step{i - 1} s LEFT JOIN best_move b ON b.product_id = s.item{i - 1})"""
        )
    items = ", ".join(f"item{i}" for i in range(1, n + 1))
    parts.append(f"walked AS (SELECT user_id, [{items}] AS recommendations FROM step{n})")
    return ",\n".join(parts)


WALK_CTES = (*CHOSEN_CTES, TRUTH, FOLLOWED, _steps(5))

NAME_FRAME = """true_names AS (
  SELECT user_id, list(p_name ORDER BY pos) AS ground_truth FROM (
    SELECT user_id, unnest(ground_truth) AS pid, generate_subscripts(ground_truth, 1) AS pos FROM truth)
  JOIN part ON p_partkey = pid GROUP BY user_id),
rec_names AS (
  SELECT user_id, list(p_name ORDER BY pos) AS recommendations FROM (
    SELECT user_id, unnest(recommendations) AS pid, generate_subscripts(recommendations, 1) AS pos FROM walked)
  JOIN part ON p_partkey = pid GROUP BY user_id),
name_hits AS (
  SELECT user_id, pos, list_contains(ground_truth, rec)::INTEGER AS rel, len(ground_truth) AS relevant FROM (
    SELECT user_id, ground_truth, unnest(recommendations) AS rec,
           generate_subscripts(recommendations, 1) AS pos
    FROM true_names JOIN rec_names USING (user_id)))"""
NAME_CTES = (*WALK_CTES, NAME_FRAME)

ID_HITS = """hits AS (
  SELECT user_id, pos, list_contains(ground_truth, rec)::INTEGER AS rel FROM (
    SELECT user_id, ground_truth, unnest(recommendations) AS rec,
           generate_subscripts(recommendations, 1) AS pos
    FROM truth JOIN walked USING (user_id)))"""


def _ap(hits: str) -> str:
    return f"""seen AS (
  SELECT *, sum(rel) OVER (PARTITION BY user_id ORDER BY pos) AS so_far FROM {hits}),
aps AS (
  SELECT user_id, coalesce(sum(so_far / pos) FILTER (rel = 1), 0) AS gain, sum(rel) AS n_hits
  FROM seen GROUP BY user_id)"""


# text search
def _tokens(text: str) -> str:
    return f"[t FOR t IN string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+') IF t <> '']"


def _text_ctes(docs: str, queries: str) -> str:
    """``docs`` (id, text), ``queries`` (query_id, text) -> ``ranked`` with scores."""
    return f"""docs AS ({docs}),
asked AS ({queries}),
doc_tokens AS (SELECT id, unnest({_tokens('text')}) AS term FROM docs),
doc_tf AS (SELECT id, term, count(*) AS tf FROM doc_tokens GROUP BY ALL),
idf AS (
  SELECT term, ln(((SELECT count(*) FROM docs WHERE text IS NOT NULL) + 1) / (count(*) + 1)) + 1 AS idf
  FROM doc_tf GROUP BY term),
doc_w AS (SELECT id, term, tf * idf AS w FROM doc_tf JOIN idf USING (term)),
doc_norm AS (SELECT id, count(*) AS n_terms, sqrt(sum(w * w)) AS norm FROM doc_w GROUP BY id),
query_tf AS (
  SELECT query_id, term, count(*) AS tf
  FROM (SELECT query_id, unnest({_tokens('text')}) AS term FROM asked) GROUP BY ALL),
query_w AS (SELECT query_id, term, tf * idf AS w FROM query_tf JOIN idf USING (term)),
query_norm AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM query_w GROUP BY query_id),
dots AS (
  SELECT query_id, id, sum(q.w * d.w) AS dot FROM query_w q JOIN doc_w d USING (term) GROUP BY ALL),
scored AS (
  SELECT query_id, id, round(dot / (q.norm * d.norm), 6) AS score
  FROM dots JOIN query_norm q USING (query_id) JOIN doc_norm d USING (id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM scored)"""


DOCUMENTS = "SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL"
BENCHMARK = "SELECT item_id AS query_id, text FROM benchmark"


def _hashed(name: str, tokens: str, idf: str, n: str) -> str:
    """``name_places`` (key, place, w) and ``name_norm`` (key, norm): hashed signed TF-IDF vectors of the rows
    (key, text) of ``tokens``, 64 places, IDF from the table ``idf`` or that of a term in none of ``n`` texts."""
    return f"""{name}_terms AS (
  SELECT key, term, count(*) AS tf FROM (SELECT key, unnest({_tokens('text')}) AS term FROM {tokens}) GROUP BY ALL),
{name}_places AS (
  SELECT key, {_bucket('term', 64)} AS place,
         sum(tf * coalesce(idf, ln({n} + 1) + 1) * CASE WHEN substr(md5(term), 9, 1) >= '8' THEN 1 ELSE -1 END)::FLOAT::DOUBLE AS w
  FROM {name}_terms LEFT JOIN {idf} USING (term) GROUP BY ALL),
{name}_norm AS (
  SELECT key, coalesce(norm, 0) AS norm FROM {tokens}
  LEFT JOIN (SELECT key, sqrt(sum(w * w)) AS norm FROM {name}_places GROUP BY key) USING (key) WHERE text IS NOT NULL)"""


def _idf(name: str, texts: str) -> str:
    """``name`` (term, idf) of the rows (text) of ``texts``."""
    return f"""{name} AS (
  SELECT term, ln(((SELECT count(*) FROM {texts} WHERE text IS NOT NULL) + 1) / (count(*) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT rowid, unnest(tokens) AS term FROM (
    SELECT row_number() OVER () AS rowid, {_tokens('text')} AS tokens FROM {texts})) GROUP BY term)"""


EMBEDDED_DOCUMENTS = (
    "t AS (SELECT doc_id AS key, text FROM documents WHERE text IS NOT NULL)",
    _idf("seen", "t"),
    _hashed("d", "t", "seen", "(SELECT count(*) FROM t)"),
)

VECTORS = """vectors AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings WHERE embedding IS NOT NULL)"""
EXACT = """pairs AS (
  SELECT q.id AS query_id, d.id, d.label, round(list_dot_product(q.v, d.v) / (q.norm * d.norm), 6) AS score
  FROM vectors q CROSS JOIN vectors d),
exact AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM pairs)
  WHERE rank <= 5)"""
HASHED = """planes AS (
  SELECT t, b, list(CASE WHEN ('0x' || substr(md5(t || ':' || b || ':' || j), 1, 1))::INTEGER >= 8
                         THEN 1.0 ELSE -1.0 END::DOUBLE ORDER BY j) AS plane
  FROM range(4) a(t), range(4) c(b), range(64) e(j) GROUP BY ALL),
buckets AS (
  SELECT id, t, sum(CASE WHEN list_dot_product(v, plane) >= 0 THEN 1 << b ELSE 0 END) AS bucket
  FROM vectors CROSS JOIN planes GROUP BY ALL),
candidates AS (
  SELECT DISTINCT a.id AS query_id, b.id AS id FROM buckets a JOIN buckets b USING (t, bucket)),
hash_best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
    FROM pairs JOIN candidates USING (query_id, id))
  WHERE rank <= 5)"""

# projections on as many planes as a table of this size gets, in cells of a middle third and two ends
PROBED = f"""size AS (SELECT greatest(1, round(ln((SELECT count(*) FROM vectors) / 8.0) / ln(3)))::INTEGER AS planes),
uniform AS (
  SELECT i, j, ({_bucket("'r:' || i || ':' || j", 1 << 32)} + 0.5) / 4294967296 AS r, ({_bucket("'t:' || i || ':' || j", 1 << 32)} + 0.5) / 4294967296 AS t
  FROM range((SELECT planes FROM size)) a(i), range(64) b(j)),
gauss AS (SELECT i, list(sqrt(-2 * ln(r)) * cos(2 * pi() * t) ORDER BY j) AS plane FROM uniform GROUP BY i),
projected AS (SELECT id, i, list_dot_product(v, plane) / norm AS x FROM vectors CROSS JOIN gauss),
fitted AS (SELECT 0.8615 * sqrt(avg(x * x)) AS width FROM projected),
placed AS (
  SELECT id, sum((1 + (x > width / 2)::INTEGER - (x < -width / 2)::INTEGER) * (3 ** i)::BIGINT)::BIGINT AS cell
  FROM projected CROSS JOIN fitted GROUP BY id),
reach AS (
  SELECT id, i, level, pow(CASE level WHEN 0 THEN greatest(0, x + width / 2) WHEN 1 THEN greatest(0, abs(x) - width / 2)
                                      ELSE greatest(0, width / 2 - x) END, 2) AS far
  FROM projected CROSS JOIN fitted CROSS JOIN range(3) l(level)),
digits AS (
  SELECT cell, i, (cell // (3 ** i)::BIGINT) % 3 AS level
  FROM (SELECT unnest(range((3 ** (SELECT planes FROM size))::BIGINT)) AS cell), range((SELECT planes FROM size)) p(i)),
ordered AS (
  SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY far, cell) AS place
  FROM (SELECT id, cell, sum(far) AS far FROM reach JOIN digits USING (i, level) GROUP BY ALL)),
sampled AS (SELECT id FROM vectors ORDER BY md5(id::VARCHAR), id LIMIT 200),
places AS (
  SELECT place FROM exact JOIN sampled s ON s.id = exact.query_id JOIN placed p ON p.id = exact.id
  JOIN ordered o ON o.id = exact.query_id AND o.cell = p.cell),
probing AS (
  SELECT place AS probes FROM (SELECT place, row_number() OVER (ORDER BY place) AS r FROM places)
  WHERE r = ceil(0.93 * (SELECT count(*) FROM places))),
visited AS (SELECT o.id AS query_id, cell FROM ordered o, probing WHERE place <= probes),
probe_best AS (
  SELECT * FROM (
    SELECT pairs.query_id, pairs.id, score,
           row_number() OVER (PARTITION BY pairs.query_id ORDER BY score DESC, pairs.id)::INTEGER AS rank
    FROM visited JOIN placed USING (cell) JOIN pairs ON pairs.query_id = visited.query_id AND pairs.id = placed.id)
  WHERE rank <= 5)"""

CHANGES = """changes AS (
  SELECT l_partkey AS id,
         CASE WHEN l_returnflag <> 'R' THEN p_name || ' by seller ' || l_suppkey END AS text,
         date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS version,
         CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'upsert' END AS op
  FROM lineitem JOIN part ON l_partkey = p_partkey),
held AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id
        ORDER BY version DESC, (op = 'delete') DESC, coalesce(text, '') DESC) AS r FROM changes)
  WHERE r = 1 AND op <> 'delete' AND text IS NOT NULL)"""
SYNCED = _with(
    CHANGES,
    "names AS (SELECT p_name AS text FROM part)",
    _idf("seen", "names"),
    "t AS (SELECT id AS key, text FROM held)",
    _hashed("d", "t", "seen", "(SELECT count(*) FROM names)"),
    select="SELECT id, text, version, round(norm, 4) AS norm FROM held JOIN d_norm ON id = key",
)

SNAPSHOTS = CHANGES + """,
old_held AS (
  SELECT id, text FROM (
    SELECT *, row_number() OVER (PARTITION BY id
        ORDER BY version DESC, (op = 'delete') DESC, coalesce(text, '') DESC) AS r
    FROM changes WHERE version < date_diff('day', DATE '1970-01-01', DATE '1998-01-01'))
  WHERE r = 1 AND op <> 'delete' AND text IS NOT NULL)"""

ROUNDED = "user_id, product_id, round(rating, 9) AS rating"
SELECTIONS = "user_id, array_to_string(selections, ',') AS selections"

ORACLES: dict[str, str] = {
    "orders_shape": _with(ORD, NUMBERED, SHAPED, select="SELECT * FROM shaped"),
    "csv_orders": _with(
        ORD, NUMBERED, SHAPED,
        select="SELECT * REPLACE (order_id::INTEGER AS order_id, user_id::INTEGER AS user_id) FROM shaped",
    ),
    "order_products_shape": _with(
        ORD, LIN, CART,
        """first_bought AS (
  SELECT user_id, product_id, min((order_date, order_id)) AS first FROM lin JOIN ord USING (order_id) GROUP BY ALL)""",
        select="""SELECT order_id, product_id, add_to_cart_order,
  ((order_date, order_id) > first)::INTEGER AS reordered
FROM cart JOIN ord USING (order_id) JOIN first_bought USING (user_id, product_id)""",
    ),
    "order_products_union": _with(ORD, LIN, NUMBERED, SHAPED, CART, UNITED, select="SELECT * FROM united"),
    "csv_order_products": _with(
        ORD, LIN, NUMBERED, SHAPED, CART, UNITED,
        select="SELECT * REPLACE (order_id::INTEGER AS order_id, product_id::INTEGER AS product_id) FROM united",
    ),
    "products_dim": """SELECT p_partkey AS product_id, p_name || ' #' || p_partkey AS product_name,
  dense_rank() OVER (ORDER BY p_brand)::INTEGER AS aisle_id,
  dense_rank() OVER (ORDER BY p_type)::INTEGER AS department_id FROM part""",
    "departments_dim": """SELECT row_number() OVER (ORDER BY department)::INTEGER AS department_id, department
FROM (SELECT DISTINCT p_type AS department FROM part)""",
    "aisles_dim": """SELECT row_number() OVER (ORDER BY aisle)::INTEGER AS aisle_id, aisle
FROM (SELECT DISTINCT p_brand AS aisle FROM part)""",
    "product_catalogue": _with(PROD, select="SELECT product_id AS id, product_name AS product FROM prod"),
    "catalogue_keys": """SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS id FROM documents""",
    "product_purchases": _with(ORD, LIN, PROD, BOUGHT, select="SELECT * FROM bought"),
    "purchase_events": _with(ORD, VISITS, select="SELECT * FROM visits"),
    "user_ratings": _with(*RATING_CTES, select=f"SELECT {ROUNDED} FROM rated"),
    "ratings_table": _with(
        *RATING_CTES,
        select=f"""SELECT {ROUNDED}, (('0x' || substr(md5(user_id || ':' || product_id), 1, 16))::UBIGINT >> 1)::BIGINT AS row_id
FROM rated""",
    ),
    "ratings_preview": _with(*RATING_CTES, select=f"SELECT {ROUNDED} FROM rated ORDER BY user_id, product_id LIMIT 3"),
    "ratings_hash_split": _with(
        *RATING_CTES,
        select=f"SELECT {ROUNDED}, CASE WHEN {HELD_OUT_BUCKET} < 80 THEN 'train' ELSE 'test' END AS part FROM rated",
    ),
    "ratings_hash_sample": _with(
        *RATING_CTES,
        select=f"SELECT {ROUNDED} FROM rated WHERE {SAMPLE_BUCKET} < 10",
    ),
    "rating_counts": _with(
        *RATING_CTES,
        select=f"SELECT count(*) AS total, count(*) FILTER ({SAMPLE_BUCKET} < 10) AS sample FROM rated",
    ),
    "selections_all_users": _with(*CHOSEN_CTES, select=f"SELECT {SELECTIONS} FROM everyone"),
    "selections_ties": _with(*CHOSEN_CTES, select=f"SELECT {SELECTIONS} FROM chosen"),
    "selections_strict": _with(
        *RATING_CTES, TEST,
        """placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, product_id) AS pos FROM test),
strict AS (SELECT user_id, list(product_id ORDER BY pos) AS selections FROM placed WHERE pos <= 10 GROUP BY user_id)""",
        select=f"SELECT {SELECTIONS} FROM strict WHERE len(selections) > 5",
    ),
    "sampled_users": _with(
        *CHOSEN_CTES, select=f"SELECT {SELECTIONS} FROM chosen ORDER BY md5(user_id || ':0'), user_id LIMIT 100"
    ),
    "selections_named": _with(
        *NAMED_CTES, select=f"SELECT {SELECTIONS}, array_to_string(names, '|') AS product_names FROM named"
    ),
    "history_truth": _with(
        *NAMED_CTES,
        select="""SELECT user_id, array_to_string(names[1:3], '|') AS previous_purchases,
  array_to_string(names[4:], '|') AS ground_truth FROM named""",
    ),
    "evaluation_table": _with(
        *NAMED_CTES,
        select=f"""SELECT {SELECTIONS}, array_to_string(names, '|') AS product_names,
  array_to_string(names[1:3], '|') AS previous_purchases,
  array_to_string(names[4:], '|') AS ground_truth FROM named""",
    ),
    "starter_items": _with(
        *NAMED_CTES, HISTORIES, _started(GENERAL_STARTERS),
        select="SELECT user_id, cold, array_to_string(history, '|') AS history FROM started",
    ),
    "prompts_short": _with(
        *NAMED_CTES,
        select=f"SELECT user_id, {_prompt('names', SYSTEM_PROMPT_NO_EXPLANATION, SHORT_ENDING)} AS prompt FROM named",
    ),
    "prompts_long": _with(
        *NAMED_CTES, HISTORIES, _started(GROCERY_STARTERS), LONG_PROMPTS, select="SELECT * FROM prompted"
    ),
    "scoring_payload": _with(
        *NAMED_CTES,
        select="""SELECT user_id, '{"dataframe_split":{"index":[' || array_to_string(range(len(names)), ',')
  || '],"columns":[0],"data":[["' || array_to_string(names, '"],["') || '"]]}}' AS payload FROM named""",
    ),
    "transition_topk": _with(
        ORD, LIN, FOLLOWED, select="SELECT product_id, next_product, n, rank FROM ranked_moves WHERE rank <= 5"
    ),
    "cooccurrence_topk": _with(ORD, LIN, TOGETHER, select="SELECT product_id, neighbour, n, rank FROM ranked_near WHERE rank <= 5"),
    "cart_window_topk": _with(
        ORD, LIN, CART, NEIGHBOURS, select="SELECT product_id, neighbour, n, rank FROM ranked_near WHERE rank <= 5"
    ),
    "vector_index": _with(
        *EMBEDDED_DOCUMENTS,
        select="SELECT key AS id, length(text)::INTEGER AS n_chars, round(norm, 4) AS norm FROM t JOIN d_norm USING (key)",
    ),
    "model_text_topk": _with(
        *EMBEDDED_DOCUMENTS,
        "a AS (SELECT item_id AS key, text FROM benchmark)",
        _hashed("q", "a", "seen", "(SELECT count(*) FROM t)"),
        """dots AS (
  SELECT q.key AS query_id, d.key AS id, sum(q.w * d.w) AS dot FROM q_places q JOIN d_places d USING (place) GROUP BY ALL),
scored AS (
  SELECT q.key AS query_id, d.key AS id, round(coalesce(dot / nullif(q.norm * d.norm, 0), 0), 6) AS score
  FROM q_norm q CROSS JOIN d_norm d LEFT JOIN dots ON query_id = q.key AND id = d.key),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM scored)""",
        select="SELECT query_id, rank, id, score FROM ranked WHERE rank <= 5",
    ),
    "embedding_topk": _with(VECTORS, EXACT, select="SELECT query_id, rank, id, label, score FROM exact"),
    "text_index": _with(
        _text_ctes(DOCUMENTS, BENCHMARK),
        select="SELECT id, n_terms::INTEGER AS n_terms, round(norm, 6) AS norm FROM doc_norm",
    ),
    "tfidf_topk": _with(
        _text_ctes(DOCUMENTS, BENCHMARK), select="SELECT query_id, rank, id, score FROM ranked WHERE rank <= 5"
    ),
    "product_search": _with(
        PROD,
        _text_ctes(
            "SELECT product_id AS id, product_name AS text FROM prod",
            "SELECT DISTINCT p_name AS query_id, 'I want to buy a ' || p_name AS text FROM part",
        ),
        select="SELECT query_id, rank, id, text, score FROM ranked JOIN docs USING (id) WHERE rank <= 5",
    ),
    "hash_topk": _with(VECTORS, EXACT, HASHED, select="SELECT query_id, rank, id, score FROM hash_best"),
    "hash_recall": _with(
        VECTORS, EXACT, HASHED,
        """filled AS (SELECT t, bucket, count(*) AS n FROM buckets GROUP BY ALL)""",
        select="""SELECT 'hash' AS method,
  round((SELECT count(*) FROM exact JOIN hash_best USING (query_id, id)) / (SELECT count(*) FROM exact), 9) AS recall,
  round((SELECT sum(n * n) FROM filled) / ((SELECT count(*) FROM vectors) * (SELECT count(*) FROM vectors)), 9)
    AS candidate_fraction""",
    ),
    "probe_topk": _with(VECTORS, EXACT, PROBED, select="SELECT query_id, rank, id, score FROM probe_best"),
    "probe_recall": _with(
        VECTORS, EXACT, PROBED,
        select="""SELECT (SELECT planes FROM size) AS planes, (SELECT probes FROM probing)::INTEGER AS probes,
  round((SELECT count(*) FROM exact JOIN probe_best USING (query_id, id)) / (SELECT count(*) FROM exact), 9) AS recall,
  round((SELECT count(*) FROM visited JOIN placed USING (cell))
    / ((SELECT count(*) FROM vectors) * (SELECT count(*) FROM vectors)), 9) AS candidate_fraction""",
    ),
    "catalogue_state": _with(CHANGES, select="SELECT id, text, version FROM held"),
    "index_synced": SYNCED,
    "index_stream_synced": SYNCED,
    "recommend_one": _with(
        *CHOSEN_CTES, TRUTH, FOLLOWED, _steps(1),
        "wanted AS (SELECT user_id, product_name AS query_id FROM step1 JOIN prod ON product_id = item1)",
        _text_ctes(
            "SELECT product_id AS id, product_name AS text FROM prod",
            "SELECT DISTINCT query_id, query_id AS text FROM wanted",
        ),
        select="SELECT user_id, rank, id AS item, score FROM wanted JOIN ranked USING (query_id) WHERE rank <= 3",
    ),
    "generated_items": _with(
        *NAMED_CTES, HISTORIES, _started(STARTER_PRODUCTS), FOLLOWERS,
        _drawn("cool", "started", "history", 0), _drawn("warm", "started", "history", 0.2), _drawn("hot", "started", "history", 0.5),
        select="""SELECT user_id, cool.drawn AS cool, warm.drawn AS warm, hot.drawn AS hot
FROM cool JOIN warm USING (user_id) JOIN hot USING (user_id)""",
    ),
    "recommend_prompted": _with(
        *NAMED_CTES, HISTORIES, _started(STARTER_PRODUCTS), FOLLOWERS, _drawn("wanted", "started", "history", 0.2),
        _text_ctes(
            "SELECT product_id AS id, product_name AS text FROM prod",
            "SELECT DISTINCT drawn AS query_id, drawn AS text FROM wanted",
        ),
        select="""SELECT user_id, rank, text AS item, score
FROM wanted JOIN ranked ON query_id = drawn JOIN docs USING (id) WHERE rank <= 3""",
    ),
    # a name finds itself: no other product has its number
    "sequence_prompted": _with(
        *NAMED_CTES, HISTORIES, _started(STARTER_PRODUCTS), FOLLOWERS,
        _drawn("step1", "started", "history", 0.5),
        "after1 AS (SELECT user_id, list_append(history, drawn) AS history FROM step1)",
        _drawn("step2", "after1", "history", 0.5),
        "after2 AS (SELECT user_id, list_append(history, drawn) AS history FROM step2)",
        _drawn("step3", "after2", "history", 0.5),
        select="""SELECT user_id, step1.drawn || '|' || step2.drawn || '|' || step3.drawn AS recommendations
FROM step1 JOIN step2 USING (user_id) JOIN step3 USING (user_id)""",
    ),
    "recommend_neighbours": _with(
        *CHOSEN_CTES, TRUTH, TOGETHER,
        """offers AS (
  SELECT user_id, neighbour, sum(n) AS n
  FROM (SELECT DISTINCT user_id, unnest(history) AS product_id FROM truth)
  JOIN near USING (product_id) GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, neighbour) AS r FROM offers),
usual AS (SELECT product_id FROM near GROUP BY product_id ORDER BY sum(n) DESC, product_id LIMIT 1)""",
        select="""SELECT user_id, coalesce(neighbour, (SELECT product_id FROM usual)) AS item, 1 AS rank
FROM truth LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (user_id)""",
    ),
    "recommend_steps": _with(
        *WALK_CTES, select="SELECT user_id, array_to_string(recommendations, ',') AS recommendations FROM walked"
    ),
    "relevance": _with(
        *NAME_CTES,
        select="""SELECT user_id, array_to_string(ground_truth, '|') AS ground_truth,
  array_to_string(recommendations, '|') AS recommendations,
  string_agg(rel::VARCHAR, '' ORDER BY pos) AS relevance
FROM name_hits JOIN true_names USING (user_id) JOIN rec_names USING (user_id)
GROUP BY user_id, ground_truth, recommendations""",
    ),
    "precision_at_k": _with(
        *NAME_CTES,
        select=f"""SELECT user_id, {', '.join(
            f"round(coalesce(sum(rel) FILTER (pos <= {k}), 0) / {k}, 9) AS p{k}" for k in (1, 3, 5))}
FROM name_hits GROUP BY user_id""",
    ),
    "average_precision": _with(
        *NAME_CTES, _ap("name_hits"),
        select="""SELECT user_id, round(CASE WHEN n_hits > 0 THEN gain / n_hits ELSE 0 END, 9) AS ap,
  round(gain / len(ground_truth), 9) AS ap_by_truth FROM aps JOIN true_names USING (user_id)""",
    ),
    "map_by_name": _with(
        *NAME_CTES, _ap("name_hits"),
        "m AS (SELECT count(*) AS users, avg(CASE WHEN n_hits > 0 THEN gain / n_hits ELSE 0 END) AS m FROM aps)",
        select="SELECT 5 AS k, users, round(m, 9) AS map_at_k, printf('MAP@5: %.2f', m) AS label FROM m",
    ),
    "map_at_k": _with(
        *WALK_CTES, ID_HITS, _ap("hits"),
        select="""SELECT 5 AS k, count(*) AS users,
  round(avg(CASE WHEN n_hits > 0 THEN gain / n_hits ELSE 0 END), 9) AS map_at_k FROM aps""",
    ),
}

ORACLES |= {
    "product_lookup": _with(PROD, select="SELECT product_id, product_name FROM prod WHERE product_id = 105"),
    "aisle_lookup": f"""SELECT product_id, coalesce(aisle, 'none') AS next_aisle
FROM ({ORACLES["products_dim"]}) p LEFT JOIN ({ORACLES["aisles_dim"]}) a ON a.aisle_id = p.aisle_id + 1""",
    "safe_names": "SELECT p_partkey AS product_id, p_name || '_' || p_partkey || '_v1' AS name FROM part",
    "tables_listed": """SELECT 'aisles' AS name, count(DISTINCT p_brand) AS rows FROM part
UNION ALL SELECT 'orders', count(*) FROM orders""",
    "prompts_fixed": _with(
        *NAMED_CTES, HISTORIES,
        "filled AS (SELECT user_id, CASE WHEN len(history) = 0 THEN ['pen', 'pencil', 'glue stick'] ELSE history END AS history FROM histories)",
        select=f"SELECT user_id, {_prompt('history', SYSTEM_PROMPT_NO_EXPLANATION, SHORT_ENDING)} AS prompt FROM filled",
    ),
    "prompts_with_literals": _with(
        *NAMED_CTES, HISTORIES,
        """everyone_named AS (
  SELECT user_id::VARCHAR AS user, history FROM histories
  UNION ALL VALUES ('ann', ['red widget', 'small ring']), ('bob', []), ('cy', ['hot plate']))""",
        select=f"SELECT user, {_prompt('history', SYSTEM_PROMPT, LONG_ENDING)} AS prompt FROM everyone_named",
    ),
    "search_responses": f"""SELECT query_id, string_agg(text, '|' ORDER BY rank) AS texts
FROM ({ORACLES["product_search"]}) GROUP BY query_id""",
    "index_by_name": _with(
        PROD,
        "names AS (SELECT p_name AS text FROM part)",
        _idf("seen", "names"),
        "t AS (SELECT product_id AS key, product_name AS text FROM prod)",
        "a AS (SELECT 0 AS key, 'a red widget #7' AS text)",
        _hashed("d", "t", "seen", "(SELECT count(*) FROM names)"),
        _hashed("q", "a", "seen", "(SELECT count(*) FROM names)"),
        select="""SELECT d.key AS id, text, round(coalesce(dot / nullif(q.norm * d.norm, 0), 0), 6) AS score
FROM d_norm d CROSS JOIN q_norm q JOIN t ON t.key = d.key
LEFT JOIN (SELECT d.key, sum(q.w * d.w) AS dot FROM q_places q JOIN d_places d USING (place) GROUP BY ALL) x ON x.key = d.key
ORDER BY score DESC, id LIMIT 5""",
    ),
    "change_table": ORACLES["catalogue_state"],
    "generation_payloads": _with(
        *NAMED_CTES, HISTORIES, FOLLOWERS,
        "buyers AS (SELECT * FROM histories WHERE len(history) > 0)",
        _drawn("answered", "buyers", "history", 0.2),
        select=f"""SELECT user_id, '{{"prompt":' || to_json({_prompt('history', SYSTEM_PROMPT, LONG_ENDING)}) || ',"temperature":0.2}}' AS request,
  drawn AS generated FROM answered""",
    ),
    "bounded_topk": ORACLES["embedding_topk"],
    "index_merged": SYNCED,
    "ratings_colocated": ORACLES["user_ratings"],
    "snapshot_changes": _with(
        SNAPSHOTS,
        select="""SELECT coalesce(n.id, o.id) AS id, n.text AS text, 2::BIGINT AS version,
  CASE WHEN n.id IS NULL THEN 'delete' ELSE 'upsert' END AS op
FROM old_held o FULL JOIN held n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.text <> n.text""",
    ),
    "snapshot_applied": _with(CHANGES, select="SELECT id, text FROM held"),
    "csv_routed_rows": f"SELECT * FROM ({ORACLES['csv_orders']}) WHERE order_id % 97 > 1",
    "csv_bad_rows": _with(
        ORD, NUMBERED, SHAPED,
        select="""SELECT CASE WHEN order_id % 97 = 0 THEN 'x' ELSE '' END || order_id || ',' || user_id || ',' || eval_set || ',1,'
  || CASE WHEN order_id % 97 = 0 THEN '2' ELSE 'monday' END || ',3,4.5' AS text, true AS from_bad_file FROM shaped WHERE order_id % 97 <= 1""",
    ),
    "average_precision_long": _with(
        *NAME_CTES, _ap("name_hits"),
        select="""SELECT user_id, round(CASE WHEN n_hits > 0 THEN gain / n_hits ELSE 0 END, 9) AS ap, n_hits::BIGINT AS hits FROM aps""",
    ),
    "bounded_text_topk": ORACLES["model_text_topk"],
    "csv_products": f"SELECT * REPLACE (product_id::INTEGER AS product_id) FROM ({ORACLES['products_dim']})",
    "csv_departments": ORACLES["departments_dim"],
    "csv_aisles": ORACLES["aisles_dim"],
    "csv_catalogue": ORACLES["product_catalogue"],
    "view_catalogue": ORACLES["product_catalogue"],
    "random_split_checked": _with(
        *RATING_CTES,
        select="SELECT count(*) AS ratings, count(*) AS rows, 0::BIGINT AS in_both, true AS share_near FROM rated",
    ),
    "random_sample_checked": _with(
        *RATING_CTES,
        select="SELECT count(*) AS ratings, 0::BIGINT AS strangers, 0::BIGINT AS twice, true AS share_near FROM rated",
    ),
    "selections_last": _with(
        *CHOSEN_CTES, select="SELECT user_id, array_to_string(selections[-5:], ',') AS selections FROM chosen"
    ),
}
