"""Jaccard join on word n-grams: an LSH forest of MinHash signatures, then exact verification.

Documents with the same set of shingles are one node. A signature holds ``TREES`` labels of ``DEPTH``
minima; a tree is the trie of one label over all nodes, kept as rows grouped by prefix. Nodes that
share a prefix of the present depth in any tree are candidates of each other. Starting from whole
labels, prefixes are shortened until links as similar as those found, and a link at the threshold
itself, are recalled well enough. Candidates are gathered in classes (components of the prefix groups), a
large class in blocks, so that no pair leaves a task. Of a class only pairs that share a prefix
themselves are compared exactly: what a chain of candidates brings together is no candidate pair.

Nodes are 63-bit hashes of shingle sets; two different sets meet in one of them with a chance of about
the square of their number over 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import materialize, set_aside, ship_code
from basketry.llm.graph import components

WORDS = 5
THRESHOLD = Fraction(4, 5)
TREES = 24
DEPTH = 5  # the longest label at which a link at the threshold is recalled well enough with so many trees
RECALL = 0.9999
BLOCK = 512  # nodes of a class that meet as many others in one task
BLOCK_BYTES = 8 << 20  # of shingle hashes in a block
BINS = 10  # of similarities from the threshold to 1
_COLUMNS = 8192


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words of a UTF-8 text.

    Words are the runs between ASCII white space. A text of fewer words is one shingle of all of them,
    one without words has none.
    """
    import xxhash

    found = text.split()
    if not found:
        return np.empty(0, dtype="u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), "u8", len(found))
    width = min(n, len(h))
    rolled = np.full(len(h) - width + 1, width, dtype="u8")
    with np.errstate(over="ignore"):
        for k in range(width):
            rolled = _mix(rolled * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k])
    return np.unique(rolled)


class Signer:
    """MinHash signatures: ``TREES * DEPTH`` minima of 32-bit linear hashes of the shingles."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH):
        rng = np.random.default_rng(20)
        self.a = rng.integers(0, 1 << 32, trees * depth, dtype="u4") | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * depth, dtype="u4")

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes >> np.uint64(32)).astype("u4")
        out = np.full(len(self.a), 0xFFFFFFFF, dtype="u4")
        with np.errstate(over="ignore"):
            for s in range(0, len(low), 1024):  # bounded memory for long texts
                part = low[s : s + 1024]
                np.minimum(out, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1), out=out)
        return out


def _node(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 1


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, bytes, signature) per document; the node is null without words."""
    ship_code()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            nodes, sizes, signatures = [], [], []
            for text in texts:
                hashes = shingles(text.as_py() or b"")
                nodes.append(_node(hashes) if len(hashes) else None)
                sizes.append(hashes.nbytes)
                signatures.append(signer(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())],
                names=["doc_id", "text_key", "node", "bytes", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, node long, bytes long, signature binary")


def text_key():
    return F.xxhash64(F.col("text").cast("string"))


def _prefixes(signed: DataFrame, depth: int) -> DataFrame:
    """(node, tree, prefix): the label of each tree cut to ``depth``, as a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="u4")
            labels = flat.reshape(batch.num_rows, TREES, DEPTH)[:, :, :depth].astype("u8")
            prefix = np.zeros(labels.shape[:2], dtype="u8")
            with np.errstate(over="ignore"):
                for k in range(depth):
                    prefix = _mix(prefix * np.uint64(0xD6E8FEB86659FD93) + labels[:, :, k] + np.uint64(1))
            trees = np.tile(np.arange(TREES, dtype="i4"), batch.num_rows)
            nodes = np.repeat(batch.column("node").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(trees), pa.array(prefix.ravel().view("i8"))], names=["node", "tree", "prefix"])

    rows = signed.filter("node is not null").select("node", "signature")
    return rows.mapInArrow(run, "node long, tree int, prefix long")


def cut_labels(signature: bytes, depth: int) -> np.ndarray:
    """The labels of all trees cut to ``depth``, each as one number."""
    labels = np.frombuffer(signature, dtype="u4").reshape(TREES, DEPTH)[:, :depth].astype("u8")
    prefix = np.zeros(TREES, dtype="u8")
    with np.errstate(over="ignore"):
        for k in range(depth):
            prefix = _mix(prefix * np.uint64(0xD6E8FEB86659FD93) + labels[:, k] + np.uint64(1))
    return prefix


def _classes(signed: DataFrame, depth: int) -> DataFrame:
    """(node, root): candidate classes of more than one node."""
    labels = materialize(_prefixes(signed, depth).distinct(), "prefixes")
    groups = labels.groupBy("tree", "prefix").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    edges = labels.join(groups.filter("n > 1"), ["tree", "prefix"]).select(F.col("first").alias("a"), F.col("node").alias("b"))
    return components(edges)


def _shares(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each set in ``left`` with each in ``right`` (positions)."""
    if len(left) * len(right) <= 9:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.r_[True, every[1:] != every[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # a shingle of one set alone is in no intersection
    owner, column = owner[often], column[often]
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1 if len(column) else column
    total = np.zeros((len(left), len(right)), dtype="f4")
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + _COLUMNS])
        dense = np.zeros((len(sets), _COLUMNS), dtype="f4")
        dense[owner[lo:hi], column[lo:hi] - start] = 1
        total += dense[left] @ dense[right].T
    return total.astype("i8")


def candidate_pairs(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which nodes of ``left`` share a prefix with which of ``right`` in any tree."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    for tree in range(labels.shape[1]):
        out |= labels[left, tree][:, None] == labels[right, tree][None, :]
    return out


def _shares_of_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs, 0 for others; one matrix product where most are wanted."""
    if wanted.sum() * 8 > wanted.size:
        return np.where(wanted, _shares(sets, left, right), 0)
    out = np.zeros(wanted.shape, dtype="i8")
    for i, j in zip(*np.nonzero(wanted)):
        out[i, j] = len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True))
    return out


def link_block(nodes, copies, sets, labels, blocks, first: int, second: int):
    """Exact links between the nodes of two blocks (or within one): for each node with a link its
    weight in documents and the smallest node it hangs together with here, and a histogram."""
    left = np.flatnonzero(blocks == first)
    right = np.flatnonzero(blocks == second)
    size = np.array([len(s) for s in sets])
    common = _shares_of_pairs(sets, left, right, candidate_pairs(labels, left, right))
    union = size[left][:, None] + size[right][None, :] - common
    linked = common * THRESHOLD.denominator >= THRESHOLD.numerator * union
    if first == second:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    where = (common[i, j] / union[i, j] - float(THRESHOLD)) / (1 - float(THRESHOLD)) * BINS
    counted = i < j if first == second else np.ones(len(i), dtype=bool)
    histogram = np.bincount(np.clip(where[counted].astype(int), 0, BINS - 1), minlength=BINS)
    weight = np.zeros(len(nodes), dtype="i8")
    np.add.at(weight, left[i], copies[right[j]])
    if first != second:
        np.add.at(weight, right[j], copies[left[i]])
    low, a, b = nodes.copy(), left[i], right[j]
    while True:  # smallest label along the links, until nothing moves
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, before[a])
        if (low == before).all():
            break
    return weight, low, histogram


def _verify(members: DataFrame, depth: int) -> DataFrame:
    """(node, copies, root, shingles, signature, block, first, second) -> links per node and block pair."""
    rows = members.repartition("root", "first", "second").sortWithinPartitions("root", "first", "second", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close():
            nodes = np.array([r[0] for r in held])
            nodes, at = np.unique(nodes, return_index=True)  # a node may come with several texts
            if len(nodes) < 2:
                return None
            copies, blocks = np.array([held[k][1] for k in at]), np.array([held[k][3] for k in at])
            labels = np.stack([cut_labels(held[k][4], depth) for k in at])
            sets = [np.frombuffer(held[k][2], dtype="u8") for k in at]
            weight, low, histogram = link_block(nodes, copies, sets, labels, blocks, key[1], key[2])
            got = np.flatnonzero(weight)
            if not len(got):
                return None
            bins = np.zeros((len(got), BINS), dtype="i8")
            bins[0] = histogram
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bins.size + 1, BINS, dtype="i4")), pa.array(bins.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(nodes[got]), pa.array(weight[got]), pa.array(low[got]), lists], names=["node", "weight", "low", "bins"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("root", "first", "second", "node", "copies", "shingles", "block", "signature")]
            for root, first, second, *row in zip(*columns):
                if (root, first, second) != key:
                    if held and (out := close()) is not None:
                        yield out
                    key, held = (root, first, second), []
                held.append(row)
        if held and (out := close()) is not None:
            yield out

    return rows.mapInArrow(run, "node long, weight long, low long, bins array<long>")


def chance(similarity: float, depth: int) -> float:
    """That two sets of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def expected_recall(bins: list[int], depth: int) -> float:
    """Share of links found at this depth, if links are as similar as those in the histogram."""
    low, width = float(THRESHOLD), (1 - float(THRESHOLD)) / BINS
    total = sum(n / chance(low + k * width, depth) for k, n in enumerate(bins))
    return sum(bins) / total if total else 1.0


def enough(bins: list[int], depth: int) -> bool:
    """Whether links as similar as those found are recalled at this depth, and any single link: the
    average alone would let many links of one hot class outvote a few near the threshold."""
    return min(expected_recall(bins, depth), chance(float(THRESHOLD), depth)) >= RECALL


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[int, float]]]:
    """(signed, linked, steps): ``linked`` has node, weight (documents linked, copies left out) and
    root for nodes with links; ``steps`` the depths tried with the recall estimated at each."""
    signed = materialize(sign(docs), "signed")
    # a node's documents may differ in white space: one text of each is looked up
    texts = signed.filter("node is not null").groupBy("node", "text_key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")
    )
    nodes = materialize(
        texts.groupBy("node").agg(F.min("text_key").alias("text_key"), F.sum("n").alias("copies"), F.max("bytes").alias("bytes")), "nodes"
    )
    texts = texts.select(F.col("node").alias("_node"), F.col("text_key").alias("_key"), "rep")
    depth, steps = DEPTH, []
    while True:
        classes = materialize(_classes(signed, depth).join(nodes, "node"), "classes")
        sizes = classes.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all"))
        parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_BYTES)).cast("int")
        wanted = classes.join(sizes.select("root", parts.alias("parts")), "root")
        wanted = wanted.join(texts, (F.col("node") == F.col("_node")) & (F.col("text_key") == F.col("_key"))).drop("_node", "_key")
        found = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"))
        found = found.join(wanted, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("rep")))
        found = _with_shingles(found.select("node", "copies", "root", "parts", "text"))
        block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        found = found.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        members = found.select("node", "copies", "root", "shingles", "signature", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
        linked = materialize(_verify(members, depth), "links")
        bins = linked.select(*[F.sum(F.col("bins")[k]).alias(f"b{k}") for k in range(BINS)]).first()
        bins = [int(n or 0) for n in bins]
        steps.append((depth, expected_recall(bins, depth)))
        # the longest prefix, shorter than this, that is enough for links like these and at the threshold
        if enough(bins, depth) or depth == 1:
            break
        depth = next((d for d in range(depth - 1, 0, -1) if enough(bins, d)), 1)
    roots = components(linked.select(F.col("low").alias("a"), F.col("node").alias("b")))
    weights = linked.groupBy("node").agg(F.sum("weight").alias("weight"))
    # the smallest node of a component may be no end of an edge (a, b) with a != b: it is its own root
    linked = weights.join(roots, "node", "left").select("node", "weight", F.coalesce("root", "node").alias("root"))
    return signed, materialize(linked.join(nodes.select("node", "copies"), "node"), "linked"), steps


def _with_shingles(rows: DataFrame) -> DataFrame:
    """The shingles of class members and, from these, their signatures once more: few rows, and no table
    has to carry signatures along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for s in range(0, batch.num_rows, 500):
                part = texts.slice(s, 500)
                found = [shingles(t.as_py() or b"") for t in part]
                hashes = pa.array([h.tobytes() for h in found], pa.binary())
                signatures = pa.array([signer(h).tobytes() for h in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(s, 500) for k in range(4)] + [hashes, signatures], names=["node", "copies", "root", "parts", "shingles", "signature"])

    return rows.mapInArrow(run, "node long, copies long, root long, parts int, shingles binary, signature binary")


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copies.

    ``n_links`` counts the other documents whose shingle sets have a Jaccard similarity of at least
    ``THRESHOLD``, copies included; ``class_id`` is the smallest id of the documents that hang together
    by links, the document's own id where it has none; ``copies`` are the documents with the same
    set, itself among them. Null and empty texts link to nothing. Null ids are linked like others, but
    name a class only if it has no other id; repeated rows are copies; other columns are ignored.
    """
    classes, _ = _documents(docs)
    return classes.select("doc_id", "class_id", "n_links", "copies")


def _documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = docs.select("doc_id", "text")
    signed, linked, _ = links(docs)
    ids = signed.select("doc_id", "text_key", "node")
    per_node = ids.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"))
    known = linked.select("node", "weight", "root")
    special = per_node.join(known, "node", "left").filter("copies > 1 or weight is not null")
    special = special.withColumn("root", F.coalesce("root", "node"))
    special = materialize(special, "special")
    lows = special.groupBy("root").agg(F.min("low").alias("class_id"))
    special = special.join(lows, "root")
    special = special.select("node", "class_id", "root", (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), "copies")
    special = materialize(special, "classes")
    some = ids.filter("node is not null").join(special, "node", "left")
    none = ids.filter("node is null").select("node", "doc_id", "text_key", *[F.lit(None).cast(t).alias(c) for c, t in special.dtypes if c != "node"])
    rows = some.unionByName(none).select(
        "doc_id", "text_key", "node", "root",
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.when(F.col("node").isNotNull(), F.lit(1)).otherwise(F.lit(0))).alias("copies"),
    )
    return rows, special


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, null ids last; of
    rows equal in id and text one. Documents without links all stay."""
    plain, back = set_aside(docs, "doc_id", "text")
    rows, _ = _documents(docs)
    rows = materialize(rows.select("doc_id", "text_key", "root"), "document-classes")
    grouped = rows.filter("root is not null")
    lows = grouped.groupBy("root").agg(F.min("doc_id").alias("low"))
    # several texts of the least id, or only null ids: the least text key decides
    first = grouped.join(lows, "root").filter(F.col("doc_id").eqNullSafe(F.col("low"))).groupBy("root", "low").agg(F.min("text_key").alias("_key"))
    stay = first.select(F.col("low").alias("_id"), "_key", F.lit(True).alias("_first"))
    # rows of an id and text that occur once are found by them; of the others one is taken
    linked = grouped.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("_n"))
    marks = linked.join(stay.withColumnsRenamed({"_id": "_i", "_key": "_k"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left").drop("_i", "_k")
    marks = materialize(marks, "marks")
    keyed = plain.withColumn("_text_key", text_key())
    joined = keyed.join(marks, (keyed["_text_key"] == marks["_key"]) & keyed["doc_id"].cast("long").eqNullSafe(marks["_id"]), "left")
    kept = joined.filter("_n is null or _first")
    single = kept.filter("_n is null or _n = 1").select(*back)
    if not marks.filter("_first and _n > 1").head(1):
        return single
    return single.unionByName(kept.filter("_n > 1").dropDuplicates(["_text_key", "doc_id"]).select(*back))
