"""The registered queries: each runs one operator or chain over whole tables.

Arrays leave as joined strings and floating-point values rounded, so that another engine's result can
be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import metrics, prompts
from basketry.functions.arrays import last_items, lookup
from basketry.functions.hashing import hash_bucket
from basketry.operators import ann, backoff, changes, index, probing, ratings, selections, split, transitions
from basketry.operators.bounded import BoundedIndex
from basketry.operators.embed import HashedTerms, embed, inverse_document_frequency, tfidf_vectors
from basketry.operators.generate import NeighbourGenerator, TransitionGenerator
from basketry.operators.keys import dense_id
from basketry.operators.skew import probe_fraction_setting
from basketry.plans import evaluation
from basketry.plans.recommend import CatalogueSearch, DirectItem, recommend, recommend_sequence
from basketry.session import materialize, scratch_path, tune
from basketry.sources import readers, retail, schemas, sinks
from basketry.streaming import index_sync

STARTER_PRODUCTS = ("red widget", "small ring", "hot plate")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, base: str) -> DataFrame:
        return fn(tune(spark), base)

    QUERIES[fn.__name__] = run
    return fn


def _joined(array: str | Column, sep: str = ",") -> Column:
    array = F.col(array) if isinstance(array, str) else array
    return F.array_join(array.cast("array<string>"), sep)


# --- order tables -------------------------------------------------------------------------------


@query
def orders_shape(spark, base):
    return retail.orders(spark, base)


@query
def order_products_shape(spark, base):
    return retail.order_products(spark, base)


def _prior_and_train(spark, base):
    sets = retail.orders(spark, base).select("order_id", "eval_set")
    lines = retail.cart_positions(spark, base).join(sets, "order_id")
    return lines.filter("eval_set = 'prior'").drop("eval_set"), lines.filter("eval_set = 'train'").drop("eval_set")


@query
def order_products_union(spark, base):
    return readers.union_order_products(*_prior_and_train(spark, base))


@query
def csv_order_products(spark, base):
    """Write prior and train lines as CSV, then read both files as one bag under the declared schema."""
    paths = []
    for name, part in zip(("prior", "train"), _prior_and_train(spark, base), strict=True):
        paths.append(scratch_path(spark, f"order-products-{name}"))
        sinks.write_csv(part.select("order_id", "product_id", "add_to_cart_order", F.lit(0).alias("reordered")), paths[-1])
    return readers.read_order_products(spark, paths).drop("reordered")


@query
def csv_orders(spark, base):
    path = scratch_path(spark, "orders")
    sinks.write_csv(retail.orders(spark, base), path)
    return readers.read_orders(spark, path)


def _through_csv(frame: DataFrame, name: str) -> str:
    path = scratch_path(frame.sparkSession, name)
    sinks.write_csv(frame, path)
    return path


def _csv_with_bad_rows(spark, base):
    """Orders as CSV, two kinds of bad rows among them: an id that is no number, a weekday that is a name."""
    shaped = retail.orders(spark, base)
    path = _through_csv(shaped.filter("order_id % 97 > 1"), "orders-good")
    first = F.col("order_id") % 97 == 0
    bad = shaped.filter("order_id % 97 <= 1").select(
        F.concat(F.when(first, "x").otherwise(""), F.col("order_id").cast("string")).alias("order_id"),
        "user_id", "eval_set", F.lit("1").alias("order_number"), F.when(first, "2").otherwise("monday").alias("order_dow"),
        F.lit("3").alias("order_hour_of_day"), F.lit("4.5").alias("days_since_prior_order"),
    )
    bad = _through_csv(bad, "orders-bad")
    return readers.read_csv_routed(spark, [path, bad], schemas.ORDERS)


@query
def csv_routed_rows(spark, base):
    """The rows that fit the schema, where bad ones go to a table of their own."""
    return _csv_with_bad_rows(spark, base)[0]


@query
def csv_bad_rows(spark, base):
    """The texts of the rows that do not fit, with whether the file is known."""
    return _csv_with_bad_rows(spark, base)[1].select("text", F.col("file").contains("orders-bad").alias("from_bad_file"))


@query
def csv_products(spark, base):
    return readers.read_products(spark, _through_csv(retail.products(spark, base), "products"))


@query
def csv_departments(spark, base):
    return readers.read_departments(spark, _through_csv(retail.departments(spark, base), "departments"))


@query
def csv_aisles(spark, base):
    return readers.read_aisles(spark, _through_csv(retail.aisles(spark, base), "aisles"))


@query
def csv_catalogue(spark, base):
    """Products as CSV, read under a declared schema and renamed to a catalogue."""
    plain = retail.plain_products(spark, base).select("product_id", "product_name")
    return readers.as_catalogue(readers.read_csv(spark, _through_csv(plain, "catalogue"), plain.schema))


@query
def view_catalogue(spark, base):
    """The catalogue through a view that replaces one of its name."""
    sinks.replace_view(retail.plain_products(spark, base), "basketry_products_view")
    return readers.as_catalogue(readers.read_table(spark, "basketry_products_view"))


@query
def products_dim(spark, base):
    return retail.products(spark, base)


@query
def departments_dim(spark, base):
    return retail.departments(spark, base)


@query
def aisles_dim(spark, base):
    return retail.aisles(spark, base)


@query
def product_catalogue(spark, base):
    return readers.as_catalogue(retail.plain_products(spark, base))


@query
def product_lookup(spark, base):
    """One product by its key."""
    return readers.product_by_id(retail.plain_products(spark, base), 105)


@query
def aisle_lookup(spark, base):
    """Names from a map of the few aisles; the id after the last one is not in it."""
    rows = F.collect_list(F.struct("aisle_id", "aisle"))
    aisles = retail.aisles(spark, base).agg(F.map_from_entries(rows).alias("m")).scalar()
    return retail.products(spark, base).select("product_id", lookup(aisles, F.col("aisle_id") + 1, "none").alias("next_aisle"))


@query
def safe_names(spark, base):
    """Names of models, one for each product, without dots."""
    name = F.concat("p_name", F.lit("."), F.col("p_partkey").cast("string"), F.lit(".v1"))
    return retail.table(spark, base, "part").select(F.col("p_partkey").alias("product_id"), prompts.safe_name(name).alias("name"))


@query
def tables_listed(spark, base):
    """A database of its own: tables written, one dropped, the rest listed and read."""
    path = scratch_path(spark, "database")
    database = "basketry_" + path.rsplit("-", 1)[1]
    before = spark.catalog.currentDatabase()
    sinks.use_database(spark, database)
    try:
        frames = {"aisles": retail.aisles(spark, base), "departments": retail.departments(spark, base), "orders": retail.plain_orders(spark, base)}
        for name, frame in frames.items():
            sinks.overwrite_table(frame, name, path=f"{path}/{name}")
        sinks.drop_table(spark, "departments")
        listed = readers.list_tables(spark, database).filter("not isTemporary").select(F.col("tableName").alias("name"))
        counts = [readers.read_table(spark, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in ("aisles", "orders")]
        return listed.join(counts[0].unionByName(counts[1]), "name", "left")
    finally:
        sinks.use_database(spark, before)


@query
def catalogue_keys(spark, base):
    docs = retail.table(spark, base, "documents").select("source", "doc_id")
    return dense_id(docs, ["source", "doc_id"])


# --- ratings ------------------------------------------------------------------------------------


def _order_tables(spark, base):
    return (
        retail.plain_orders(spark, base),
        retail.line_pairs(spark, base),
        retail.plain_products(spark, base),
    )


@query
def product_purchases(spark, base):
    return ratings.product_purchases(*_order_tables(spark, base))


@query
def purchase_events(spark, base):
    return ratings.purchase_events(retail.plain_orders(spark, base))


def _rounded(rated: DataFrame) -> DataFrame:
    return rated.withColumn("rating", F.round("rating", 9))


@query
def user_ratings(spark, base):
    return _rounded(ratings.ratings(*_order_tables(spark, base)))


@query
def ratings_colocated(spark, base):
    """Ratings from tables written in buckets by order, joined where they lie."""
    orders, lines, products = _order_tables(spark, base)
    names, buckets = [], sinks.bucket_count(lines.count())
    for name, frame in (("orders", orders), ("lines", lines)):
        path = scratch_path(spark, f"bucketed-{name}")
        names.append(f"basketry_{name}_" + path.rsplit("-", 1)[1])
        # one file of each bucket
        placed = frame.repartition(buckets, "order_id")
        sinks.create_table(placed, names[-1], path=path, buckets=(buckets, "order_id"))
    return _rounded(ratings.colocated_ratings(*(readers.read_table(spark, n) for n in names), products))


@query
def ratings_table(spark, base):
    """Ratings saved as a table, replacing one of that name, and read back by name."""
    rated = ratings.user_product_purchases(*_order_tables(spark, base))
    name, path = "basketry_user_product_purchases", scratch_path(spark, "ratings")
    sinks.drop_table(spark, name)
    sinks.overwrite_table(rated, name, path=path)
    return _rounded(readers.read_table(spark, name))


@query
def ratings_preview(spark, base):
    """The first three ratings."""
    return readers.preview(_rounded(ratings.ratings(*_order_tables(spark, base))).orderBy("user_id", "product_id"), 3)


@query
def ratings_hash_split(spark, base):
    train, test = split.hash_split(ratings.ratings(*_order_tables(spark, base)))
    return _rounded(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))))


@query
def ratings_hash_sample(spark, base):
    return _rounded(split.hash_sample(ratings.ratings(*_order_tables(spark, base)), "product_id", "user_id"))


@query
def random_split_checked(spark, base):
    """What holds of a random split whatever the seed: no rating in both parts, none lost, its share."""
    train, test = split.random_split(ratings.ratings(*_order_tables(spark, base)))
    marked = train.select("user_id", "product_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select("user_id", "product_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    rows = marked.groupBy("user_id", "product_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return rows.agg(
        F.count(F.lit(1)).alias("ratings"),
        F.sum(F.col("a") + F.col("b")).alias("rows"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("in_both"),
        (F.abs(F.avg("a") - 0.8) < 0.03).alias("share_near"),
    )


@query
def random_sample_checked(spark, base):
    """What holds of a random sample: all its rows are ratings, none twice, its share."""
    rated = materialize(ratings.ratings(*_order_tables(spark, base)), "ratings").select("user_id", "product_id")
    drawn = split.bernoulli_sample(rated).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    both = rated.withColumn("r", F.lit(1)).join(drawn, ["user_id", "product_id"], "full")
    return both.agg(
        F.count("r").alias("ratings"),
        F.count_if(F.col("r").isNull()).alias("strangers"),
        F.count_if(F.col("n") > 1).alias("twice"),
        (F.abs(F.count("n") / F.count("r") - 0.1) < 0.03).alias("share_near"),
    )


@query
def rating_counts(spark, base):
    """Number of ratings and of sampled ratings, in one pass."""
    rated = ratings.ratings(*_order_tables(spark, base))
    sampled = hash_bucket("product_id", "user_id") < 10
    return rated.agg(F.count(F.lit(1)).alias("total"), F.count_if(sampled).alias("sample"))


@query
def ratings_random_sample(spark, base):
    return _rounded(split.bernoulli_sample(ratings.ratings(*_order_tables(spark, base))))


@query
def ratings_random_split(spark, base):
    train, test = split.random_split(ratings.ratings(*_order_tables(spark, base)))
    return _rounded(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))))


# --- selections ---------------------------------------------------------------------------------


def _held_out(spark, base, **options):
    return evaluation.held_out_selections(*_order_tables(spark, base), **options)


@query
def selections_all_users(spark, base):
    _, held_out = split.hash_split(ratings.ratings(*_order_tables(spark, base)))
    return selections.actual_selections(held_out).select("user_id", _joined("selections").alias("selections"))


@query
def selections_ties(spark, base):
    return _held_out(spark, base).select("user_id", _joined("selections").alias("selections"))


@query
def selections_strict(spark, base):
    return _held_out(spark, base, ties="strict").select("user_id", _joined("selections").alias("selections"))


@query
def selections_last(spark, base):
    """The last five selections of each user."""
    return _held_out(spark, base).select("user_id", _joined(last_items("selections", 5)).alias("selections"))


@query
def sampled_users(spark, base):
    return split.sample_users(_held_out(spark, base), 100).select("user_id", _joined("selections").alias("selections"))


@query
def selections_named(spark, base):
    named = selections.with_product_names(_held_out(spark, base), retail.plain_products(spark, base))
    return named.select(
        "user_id", _joined("selections").alias("selections"), _joined("product_names", "|").alias("product_names")
    )


@query
def history_truth(spark, base):
    table = evaluation.evaluation_table(*_order_tables(spark, base))
    return table.select(
        "user_id",
        _joined("previous_purchases", "|").alias("previous_purchases"),
        _joined("ground_truth", "|").alias("ground_truth"),
    )


@query
def evaluation_table(spark, base):
    """The whole table, saved (failing if it existed) and read back."""
    path = scratch_path(spark, "evaluation")
    name = "basketry_" + path.rsplit("-", 1)[1]
    sinks.create_table(evaluation.evaluation_table(*_order_tables(spark, base)), name, path=path)
    return readers.read_table(spark, name).select(
        "user_id",
        _joined("selections").alias("selections"),
        *[_joined(c, "|").alias(c) for c in ("product_names", "previous_purchases", "ground_truth")],
    )


# --- prompts ------------------------------------------------------------------------------------


def _named_histories(spark, base):
    """Every customer with the names of the purchases known of them; none for most."""
    known = evaluation.evaluation_table(*_order_tables(spark, base)).select("user_id", "previous_purchases")
    users = retail.table(spark, base, "customer").select(F.col("c_custkey").alias("user_id"))
    history = F.coalesce("previous_purchases", F.array().cast("array<string>"))
    return users.join(known, "user_id", "left").select("user_id", history.alias("history"))


@query
def starter_items(spark, base):
    started = prompts.with_starter("history", "user_id", prompts.GENERAL_STARTERS)
    return _named_histories(spark, base).select(
        "user_id", prompts.is_cold("history").alias("cold"), _joined(started, "|").alias("history")
    )


@query
def prompts_short(spark, base):
    text = prompts.purchase_prompt(
        "product_names", prompts.SYSTEM_PROMPT_NO_EXPLANATION, prompts.SHORT_ENDING
    )
    named = selections.with_product_names(_held_out(spark, base), retail.plain_products(spark, base))
    return named.select("user_id", text.alias("prompt"))


@query
def prompts_long(spark, base):
    started = prompts.with_starter("history", "user_id", prompts.GROCERY_STARTERS)
    return _named_histories(spark, base).select("user_id", prompts.purchase_prompt(started).alias("prompt"))


@query
def prompts_fixed(spark, base):
    """Who has bought nothing yet is asked about a fixed basket."""
    basket = F.array(*[F.lit(i) for i in prompts.FIXED_ITEMS])
    history = F.when(prompts.is_cold("history"), basket).otherwise(F.col("history"))
    return _named_histories(spark, base).select(
        "user_id", prompts.purchase_prompt(history, prompts.SYSTEM_PROMPT_NO_EXPLANATION, prompts.SHORT_ENDING).alias("prompt")
    )


LITERAL_HISTORIES = {"ann": ["red widget", "small ring"], "bob": [], "cy": ["hot plate"]}


@query
def prompts_with_literals(spark, base):
    """Prompts for literal histories, one of them empty, beside those of the customers."""
    known = _named_histories(spark, base).select(F.col("user_id").cast("string").alias("user"), "history")
    rows = known.unionByName(readers.literal_histories(spark, LITERAL_HISTORIES))
    return rows.select("user", prompts.purchase_prompt("history").alias("prompt"))


@query
def scoring_payload(spark, base):
    named = selections.with_product_names(_held_out(spark, base), retail.plain_products(spark, base))
    return named.select("user_id", prompts.split_payload("product_names").alias("payload"))


# --- next purchase ------------------------------------------------------------------------------


def _transition_counts(spark, base):
    """Learned from the training part only: no held-out pair of user and product is seen."""
    train = split.in_train()
    fraction = probe_fraction_setting(spark)
    pairs = transitions.next_purchases(
        retail.purchases(spark, base).filter(train),
        retail.PURCHASE_ORDER,
        retail.purchase_buckets(),
        probe=retail.purchases(spark, base, fraction).filter(train).select("user_id"),
        probe_fraction=fraction,
    )
    return transitions.transition_counts(pairs)


def _neighbour_counts(spark, base):
    lines = retail.plain_lines(spark, base).join(retail.plain_orders(spark, base), "order_id")
    return transitions.order_neighbours(lines.filter(split.in_train()))


@query
def transition_topk(spark, base):
    return transitions.top_transitions(_transition_counts(spark, base), 5)


@query
def cooccurrence_topk(spark, base):
    return transitions.top_neighbours(_neighbour_counts(spark, base), 5)


@query
def cart_window_topk(spark, base):
    """Products within ten cart positions of each other, each occurrence counted."""
    carts = retail.cart_positions(spark, base).join(retail.plain_orders(spark, base), "order_id")
    return transitions.top_neighbours(transitions.cart_neighbours(carts.filter(split.in_train())), 5)


# --- index and search ---------------------------------------------------------------------------


def _vectors(spark, base):
    rows = index.index_of_vectors(retail.table(spark, base, "embeddings"), "vec_id", "embedding", "label")
    return rows, rows.select(F.col("id").alias("query_id"), "embedding", "norm")


def _embedded_documents(spark, base):
    docs = retail.table(spark, base, "documents")
    model = HashedTerms.fit(docs, "text")
    return index.build_index(docs, "doc_id", "text", model), model


@query
def vector_index(spark, base):
    built, _ = _embedded_documents(spark, base)
    return built.select("id", F.length("text").alias("n_chars"), F.round("norm", 4).alias("norm"))


@query
def model_text_topk(spark, base):
    """Text queries against a catalogue embedded with the same model."""
    built, model = _embedded_documents(spark, base)
    asked = retail.table(spark, base, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search_text_with_model(asked, built, 5, model, columns=())


@query
def embedding_topk(spark, base):
    rows, asked = _vectors(spark, base)
    return index.search_vectors(asked, rows, 5, columns=("label",))


@query
def text_index(spark, base):
    docs = retail.table(spark, base, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = tfidf_vectors(docs, "id", "text", inverse_document_frequency(docs, "text"))
    return vectors.select("id", F.size("terms").alias("n_terms"), F.round("norm", 6).alias("norm"))


@query
def tfidf_topk(spark, base):
    built = index.TextIndex.build(retail.table(spark, base, "documents"), "doc_id", "text")
    asked = retail.table(spark, base, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return built.search(asked, 5)


def product_search_hits(spark, base):
    catalogue = readers.as_catalogue(retail.plain_products(spark, base))
    built = index.TextIndex.build(catalogue, "id", "product")
    names = retail.table(spark, base, "part").select(F.col("p_name").alias("query_id")).distinct()
    return built.search(names.withColumn("text", F.concat(F.lit("I want to buy a "), "query_id")), 5, columns=("text",))


@query
def product_search(spark, base):
    """Product types as text queries against the product names, with the text of the hits."""
    return product_search_hits(spark, base)


@query
def search_responses(spark, base):
    """Hits of the product search as the JSON of a search service, and the texts read back from it."""
    row = F.array(F.col("id").cast("string"), F.col("text"), F.col("score").cast("string"))
    hits = product_search_hits(spark, base).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))).alias("rows"))
    response = F.to_json(F.struct(F.struct(F.col("rows.row").alias("data_array")).alias("result")))
    return hits.select("query_id", _joined(prompts.search_response_column(response), "|").alias("texts"))


@query
def index_by_name(spark, base):
    """An index made from a table by name, and searched by name for one text."""
    path = scratch_path(spark, "named-index")
    source = "basketry_catalogue_" + path.rsplit("-", 1)[1]
    sinks.create_table(readers.as_catalogue(retail.plain_products(spark, base)), source, path=f"{path}/source")
    model = _product_model(spark, base)
    index.create_index(spark, source, f"{source}_index", "id", "product", model, path=f"{path}/index")
    return index.similarity_search(spark, f"{source}_index", "a red widget #7", model, num_results=5)


@query
def hash_topk(spark, base):
    rows, asked = _vectors(spark, base)
    return ann.HashIndex.build(rows, dimensions=64).search(asked, 5)


@query
def hash_recall(spark, base):
    rows, asked = _vectors(spark, base)
    built = ann.HashIndex.build(rows, dimensions=64)
    recall = ann.recall_at_k(built.search(asked, 5), index.search_vectors(asked, rows, 5))
    report = recall.select(F.lit("hash").alias("method"), F.round("recall", 9).alias("recall"))
    share = built.candidate_fraction(asked).scalar()
    return report.withColumn("candidate_fraction", F.round(share, 9))


@query
def cells_topk(spark, base):
    rows, asked = _vectors(spark, base)
    return ann.CellIndex.build(rows, cells=16).search(asked, 5, n_probe=4)


@query
def cells_recall(spark, base):
    rows, asked = _vectors(spark, base)
    built = ann.CellIndex.build(rows, cells=16)
    recall = ann.recall_at_k(built.search(asked, 5, n_probe=4), index.search_vectors(asked, rows, 5))
    report = recall.select(F.lit("cells").alias("method"), F.round("recall", 9).alias("recall"))
    share = built.candidate_fraction(asked, n_probe=4).scalar()
    return report.withColumn("candidate_fraction", F.round(share, 9))


def _probe_index(rows, asked):
    return probing.ProbeIndex.build(rows, asked, 5, dimensions=64)


@query
def probe_topk(spark, base):
    rows, asked = _vectors(spark, base)
    return _probe_index(rows, asked).search(asked, 5)


@query
def probe_recall(spark, base):
    """Recall of the probing index over all queries, with what it was fitted to and what it scores."""
    rows, asked = _vectors(spark, base)
    built = _probe_index(rows, asked)
    asked = built.placed(asked)
    recall = ann.recall_at_k(built.search(asked, 5), index.search_vectors(asked, rows, 5))
    return recall.select(
        F.lit(len(built.planes)).alias("planes"),
        F.lit(built.probes).alias("probes"),
        F.round("recall", 9).alias("recall"),
        F.round(built.candidate_fraction(asked).scalar(), 9).alias("candidate_fraction"),
    )


@query
def bounded_topk(spark, base):
    """Exact search that skips cells by their radius."""
    rows, asked = _vectors(spark, base)
    return BoundedIndex.build(rows, centres=16).search(asked, 5, columns=("label",))


def _bounded_documents(spark, base):
    built, model = _embedded_documents(spark, base)
    asked = retail.table(spark, base, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = index.with_norm(embed(asked, "text", model, key="query_id"))
    return BoundedIndex.build(materialize(built.select("id", "embedding", "norm"), "document-vectors"), centres=64), asked


@query
def bounded_text_topk(spark, base):
    """The same on vectors of documents, which lie in clusters."""
    built, asked = _bounded_documents(spark, base)
    return built.search(asked, 5)


@query
def bounded_share(spark, base):
    """The share of pairs that the exact search scores, floors included, for each kind of vectors."""
    rows, asked = _vectors(spark, base)
    random = BoundedIndex.build(rows, centres=16).pairs_scored(asked, 5)
    texts, text_queries = _bounded_documents(spark, base)
    copies = texts.rows.select(F.col("id").alias("query_id"), "embedding", "norm")
    kinds = {"embeddings": random, "benchmark texts": texts.pairs_scored(text_queries, 5), "documents": texts.pairs_scored(copies, 2)}
    out = [frame.select(F.lit(name).alias("vectors"), F.round(F.col("scored") / F.col("pairs"), 6).alias("share")) for name, frame in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- index in step with its source --------------------------------------------------------------


@query
def change_table(spark, base):
    """Changes appended to a table in two steps, and the state that it holds."""
    log, path = retail.catalogue_changes(spark, base), scratch_path(spark, "changes")
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        sinks.append_changes(log.filter(part), path)
    return index.live_rows(index.latest_changes(spark.read.schema(schemas.CATALOGUE_CHANGES).parquet(path)))


@query
def catalogue_state(spark, base):
    return index.live_rows(index.latest_changes(retail.catalogue_changes(spark, base)))


def _product_model(spark, base):
    """Fitted on the product names; the sellers in the changes are terms it has not seen."""
    return HashedTerms.fit(retail.table(spark, base, "part"), "p_name")


@query
def index_synced(spark, base):
    """An index of the changes up to 1998, then brought up to date with the later ones."""
    changes = retail.catalogue_changes(spark, base)
    border = F.datediff(F.lit("1998-01-01").cast("date"), F.lit("1970-01-01").cast("date"))
    old = index.latest_changes(changes.filter(F.col("version") < border))
    model = _product_model(spark, base)
    state = materialize(index.embed_changes(old, model), "index-state")
    synced = index.sync_index(state, changes.filter(F.col("version") >= border), model)
    return index.live_rows(synced).select("id", "text", "version", F.round("norm", 4).alias("norm"))


@query
def index_stream_synced(spark, base):
    """The same through a stream of change files."""
    lines_schema = retail.table(spark, base, "lineitem").schema
    # written as a pattern, the path may be one file or a folder of files
    stream = index_sync.change_stream(spark, f"{base}/lineitem.{{parquet}}", lines_schema)
    log = scratch_path(spark, "index-log")
    run = index_sync.start_sync(
        retail.catalogue_changes(spark, base, stream), log, scratch_path(spark, "index-progress"), _product_model(spark, base)
    )
    run.awaitTermination()
    return index_sync.synced_index(spark, log).select("id", "text", "version", F.round("norm", 4).alias("norm"))


def _snapshots(spark, base):
    """The catalogue as of 1998 and now, as ``(id, text)``."""
    log = retail.catalogue_changes(spark, base)
    border = F.datediff(F.lit("1998-01-01").cast("date"), F.lit("1970-01-01").cast("date"))
    frames = [index.live_rows(index.latest_changes(c)) for c in (log.filter(F.col("version") < border), log)]
    return [materialize(f.select("id", "text"), "snapshot") for f in frames]


@query
def snapshot_changes(spark, base):
    """What changed between two snapshots of the catalogue."""
    return changes.snapshot_changes(*_snapshots(spark, base), version=2)


@query
def snapshot_applied(spark, base):
    """The old snapshot with these changes applied: the new one."""
    old, new = _snapshots(spark, base)
    log = old.select("id", "text", F.lit(1).cast("long").alias("version"), F.lit("upsert").alias("op"))
    return index.live_rows(index.latest_changes(log.unionByName(changes.snapshot_changes(old, new, version=2)))).drop("version")


@query
def index_merged(spark, base):
    """An index state in buckets, of which each of two sets of changes rewrites those it touches."""
    log, model = retail.catalogue_changes(spark, base), _product_model(spark, base)
    day = lambda text: F.datediff(F.lit(text).cast("date"), F.lit("1970-01-01").cast("date"))
    path = scratch_path(spark, "index-buckets")
    old = index.latest_changes(log.filter(F.col("version") < day("1998-01-01")))
    index.write_state(index.embed_changes(old, model), path, 16)
    late = log.filter(F.col("version") >= day("1998-01-01"))
    for part in (late.filter(F.col("version") >= day("1998-06-01")), late.filter(F.col("version") < day("1998-06-01"))):
        index.merge_changes(spark, path, part, model, 16)
    synced = index.live_rows(index.read_state(spark, path))
    return synced.select("id", "text", "version", F.round("norm", 4).alias("norm"))


# --- recommendations and scores -----------------------------------------------------------------


def _id_truth(spark, base):
    # the evaluation set is a table: histories, walks and scores all read it
    return materialize(evaluation.id_histories(_held_out(spark, base)), "evaluation-ids")


def _transition_generator(spark, base):
    return TransitionGenerator.fit(_transition_counts(spark, base))


@query
def recommend_one(spark, base):
    """Last purchase -> product bought next -> its name as query -> nearest catalogue items."""
    products = retail.plain_products(spark, base)
    catalogue = index.TextIndex.build(readers.as_catalogue(products), "id", "product", keep=True)
    return recommend(
        _id_truth(spark, base),
        _transition_generator(spark, base),
        CatalogueSearch(catalogue, names=products),
        k=3,
    )


def _backoff_generator(spark, base, temperature=0.0):
    """Learned from the names bought one after the other, in the training part. Names are numbered in their order
    and counted by number."""
    products = retail.plain_products(spark, base)
    named = products.select(F.col("product_name").alias("name")).filter("name is not null").distinct()
    names = materialize(dense_id(named, "name", "code").select("code", "name"), "product-names")
    codes = products.join(names, F.col("product_name") == F.col("name"), "left").select(F.col("product_id").alias("_id"), "code")
    lines = retail.plain_lines(spark, base).select("order_id", "line_number", "product_id")
    lines = lines.join(codes, F.col("product_id") == F.col("_id")).drop("_id")
    bought = lines.join(retail.plain_orders(spark, base), "order_id").filter(split.in_train())
    # ordered by id, answered by name; lines that agree in this order are of one product
    bought = bought.withColumnsRenamed({"product_id": "item_id", "code": "product_id"})
    order = ["order_date", "order_id", "line_number", "item_id", "product_id"]
    fraction = probe_fraction_setting(spark)
    probe = retail.purchases(spark, base, fraction).filter(split.in_train()).select("user_id")
    counts = backoff.follower_counts(
        bought, order, retail.purchase_buckets("item_id"), probe=probe, probe_fraction=fraction
    )
    return backoff.BackoffGenerator.fit(counts, temperature=temperature, names=names)


@query
def generated_items(spark, base):
    """The next item for every history, at three temperatures."""
    model = _backoff_generator(spark, base)
    histories = materialize(_named_histories(spark, base), "histories")
    out = histories.select("user_id")
    for name, temperature in (("cool", 0.0), ("warm", 0.2), ("hot", 0.5)):
        found = recommend(histories, model.at(temperature), DirectItem(), starters=STARTER_PRODUCTS)
        out = out.join(found.select("user_id", F.col("item").alias(name)), "user_id")
    return out


@query
def generation_payloads(spark, base):
    """Request and response of a generation call for every history, and the text read from the response."""
    model = _backoff_generator(spark, base, 0.2)
    histories = materialize(_named_histories(spark, base), "histories").filter(~prompts.is_cold("history"))
    answers = recommend(histories, model, DirectItem()).select("user_id", "item")
    rows = histories.join(answers, "user_id")
    request = prompts.generation_request(prompts.purchase_prompt("history"), 0.2)
    response = F.to_json(F.struct(F.array(F.struct(F.col("item").alias("text"))).alias("candidates")))
    return rows.select("user_id", request.alias("request"), prompts.generated_text(response).alias("generated"))


@query
def recommend_prompted(spark, base):
    """History of names, or a starter -> text of the next item, drawn -> nearest catalogue items, by text."""
    catalogue = readers.as_catalogue(retail.plain_products(spark, base))
    built = index.TextIndex.build(catalogue, "id", "product", keep=True)
    return recommend(
        materialize(_named_histories(spark, base), "histories"),
        _backoff_generator(spark, base, 0.2),
        CatalogueSearch(built, item="text"),
        k=3,
        starters=STARTER_PRODUCTS,
    )


@query
def sequence_prompted(spark, base):
    """Three steps for every customer: each found item joins the history that the next one is drawn from."""
    catalogue = readers.as_catalogue(retail.plain_products(spark, base))
    built = index.TextIndex.build(catalogue, "id", "product", keep=True)
    walks = recommend_sequence(
        materialize(_named_histories(spark, base), "histories"),
        _backoff_generator(spark, base, 0.5),
        CatalogueSearch(built, item="text"),
        steps=3,
        starters=STARTER_PRODUCTS,
    )
    return walks.select("user_id", _joined("recommendations", "|").alias("recommendations"))


@query
def recommend_neighbours(spark, base):
    generator = NeighbourGenerator.fit(_neighbour_counts(spark, base))
    return recommend(_id_truth(spark, base), generator, DirectItem())


def _sequences(spark, base, truth):
    return recommend_sequence(truth, _transition_generator(spark, base), DirectItem(), steps=5)


@query
def recommend_steps(spark, base):
    out = _sequences(spark, base, _id_truth(spark, base))
    return out.select("user_id", _joined("recommendations").alias("recommendations"))


def _named_frame(spark, base):
    """Truth and recommendations by product name without the key: names collide, so there are hits."""
    names = retail.table(spark, base, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name")
    )
    truth = _id_truth(spark, base)
    recommended = _sequences(spark, base, truth)
    truth_names = selections.with_product_names(truth, names, "ground_truth", name="t")
    rec_names = selections.with_product_names(recommended, names, "recommendations", name="r")
    return evaluation.evaluation_frame(
        truth_names.select("user_id", F.col("t").alias("ground_truth")),
        rec_names.select("user_id", F.col("r").alias("recommendations")),
    )


@query
def relevance(spark, base):
    return _named_frame(spark, base).select(
        "user_id",
        _joined("ground_truth", "|").alias("ground_truth"),
        _joined("recommendations", "|").alias("recommendations"),
        _joined("relevance", "").alias("relevance"),
    )


@query
def precision_at_k(spark, base):
    return _named_frame(spark, base).select(
        "user_id",
        *[F.round(metrics.precision_at_k("relevance", k), 9).alias(f"p{k}") for k in (1, 3, 5)],
    )


@query
def average_precision(spark, base):
    ap = metrics.average_precision("relevance")
    by_truth = metrics.average_precision("relevance", "relevant", F.size("ground_truth"))
    return _named_frame(spark, base).select(
        "user_id", F.round(ap, 9).alias("ap"), F.round(by_truth, 9).alias("ap_by_truth")
    )


@query
def average_precision_long(spark, base):
    """Average precision from one row per recommendation, without arrays."""
    frame = materialize(_named_frame(spark, base), "named-frame")
    recommended = frame.select("user_id", F.posexplode("recommendations").alias("rank", "item"))
    truth = frame.select("user_id", F.explode("ground_truth").alias("item"))
    hits = metrics.long_relevance(recommended.withColumn("rank", F.col("rank") + 1), truth)
    return metrics.average_precision_long(hits, chunk=2).select("user_id", F.round("ap", 9).alias("ap"), "hits")


@query
def map_by_name(spark, base):
    scored = metrics.map_at_k(_named_frame(spark, base), 5)
    return scored.select("k", "users", F.round("map_at_k", 9).alias("map_at_k"), metrics.format_map(5, "map_at_k").alias("label"))


@query
def map_at_k(spark, base):
    """From the order tables to MAP@5: ratings, split, histories, five steps for all users, score."""
    truth = _id_truth(spark, base)
    scored = evaluation.score(truth, _sequences(spark, base, truth), 5)
    return scored.select("k", "users", F.round("map_at_k", 9).alias("map_at_k"))
