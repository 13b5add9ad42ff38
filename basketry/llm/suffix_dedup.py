"""Removal of byte strings that occur more than once, by run-length indexes.

Every string of ``LENGTH`` bytes holds an anchor: the leftmost of its ``GRAM``-byte substrings with the
least hash. Equal strings have the same anchor at the same place, so repeats are found among places
with equal anchors, each with its context: all bytes that a string with this anchor may hold.

Contexts that occur more than once are repeats as a whole; counting decides. The others, at the borders
of repeats and around edits, are indexed group by group (``run_index``), together with one of each
repeated context. A group too large for one task is split by longer keys, cell by cell of the places
that the anchor may have in the string, until its parts are small or a key is the whole string.

Anchors, contexts and texts are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import materialize, ship_code
from basketry.llm.run_index import RunLengthIndex, repeated_parts

LENGTH = 200
GRAM = 50
SIDE = LENGTH - GRAM  # bytes that a string can have before or after its anchor
LARGE = 2048  # contexts of a group that one task indexes
CHUNK = 1 << 20  # bytes indexed at a time
_BUFFER = 1 << 20  # bytes of texts hashed at a time; positions in it need 21 bits
_POSITION = np.uint64((1 << 21) - 1)


class Hasher:
    """Polynomial hashes of byte ranges modulo 2**64, over random values of the bytes."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.value = rng.integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.power = self.inverse = np.ones(1, dtype="u8")

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            with np.errstate(over="ignore"):
                back = pow(self.base, -1, 1 << 64)
                self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, self.base, dtype="u8")])
                self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, back, dtype="u8")])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            return np.r_[np.uint64(0), np.cumsum(self.value[data] * self.power[: len(data)], dtype="u8")]

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (sums[end] - sums[start]) * self.inverse[start]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))


def anchors_of(hasher: Hasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(text, place, anchor, context) of all anchors in texts that lie one after the other in ``data``."""
    n = len(data)
    if n < LENGTH:
        return [np.empty(0, dtype="i8")] * 4
    sums = hasher.sums(data)
    at = np.arange(n - GRAM + 1)
    grams = hasher.ranges(sums, at, at + GRAM)
    # the position in the low bits: the least is also the leftmost
    least = (grams & ~_POSITION) | at.astype("u8")
    width, window = 1, SIDE + 1
    while 2 * width <= window:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[window - width : window - width + n - LENGTH + 1])
    text = np.repeat(np.arange(len(starts)), ends - starts)
    chosen = (least & _POSITION).astype("i8")[text[: n - LENGTH + 1] == text[LENGTH - 1 :]]  # strings within one text
    chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]] if len(chosen) else chosen
    own = text[chosen]
    low, high = np.maximum(chosen - SIDE, starts[own]), np.minimum(chosen + LENGTH, ends[own])
    context = hasher.ranges(sums, low, high)
    with np.errstate(over="ignore"):  # contexts cut short by the ends of a text differ from others
        context ^= ((chosen - low).astype("u8") * np.uint64(1 << 9) + (high - chosen).astype("u8")) * np.uint64(0x94D049BB133111EB)
    return own, chosen - starts[own], grams[chosen].view("i8"), context.view("i8")


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def anchors(docs: DataFrame) -> DataFrame:
    """(text_key, place, anchor, context) of every document of ``LENGTH`` bytes or more."""
    ship_code()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def out(keys: list[int], texts: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            data = np.frombuffer(b"".join(texts), dtype="u1")
            own, place, anchor, context = anchors_of(hasher, data, np.r_[0, ends[:-1]], ends)
            key = np.array(keys, dtype="i8")[own]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, place.astype("i4"), anchor, context)], names=["text_key", "place", "anchor", "context"])

        for batch in batches:
            texts, keys, held, size = batch.column("text").cast(pa.binary()), batch.column("text_key").to_pylist(), [], 0
            marks: list[int] = []
            for key, text in zip(keys, texts):
                text = text.as_py()
                if len(text) > _BUFFER:
                    for s in range(0, len(text), _BUFFER):
                        yield _part(out, key, text, s)
                elif len(text) >= LENGTH:
                    if size + len(text) > _BUFFER:
                        yield out(marks, held)
                        marks, held, size = [], [], 0
                    marks.append(key)
                    held.append(text)
                    size += len(text)
            if held:
                yield out(marks, held)

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _text_key().alias("text_key"))
    return rows.mapInArrow(run, "text_key long, place int, anchor long, context long")


def _part(out, key: int, text: bytes, start: int) -> pa.RecordBatch:
    """The anchors of a long text that lie in ``_BUFFER`` bytes from ``start`` on, found with all
    bytes that their contexts hold."""
    begin = max(0, start - SIDE)
    got = out([key], [text[begin : start + _BUFFER + LENGTH]])
    place = got.column("place").to_numpy().astype("i8") + begin
    got = got.set_column(1, "place", pa.array(place.astype("i4")))
    return got.filter(pa.array((place >= start) & (place < start + _BUFFER)))


def marks(docs: DataFrame) -> DataFrame:
    """(text_key, start, end): byte ranges covered by repeated strings, overlapping, not yet merged.

    A range may reach before the text or after its end, where its context is cut short.
    """
    places = materialize(anchors(docs), "anchors")
    kinds = places.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min("text_key").alias("text_key"), F.min_by("place", "text_key").alias("place")
    )
    kinds = materialize(kinds, "contexts")
    again = kinds.filter("n > 1").select("anchor", "context")
    whole = places.join(again, ["anchor", "context"], "left_semi")
    whole = whole.select("text_key", (F.col("place") - SIDE).alias("start"), (F.col("place") + LENGTH).alias("end"))
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    groups = groups.filter("kinds > 1 and least = 1").select("anchor", "kinds")
    wanted = materialize(kinds.join(groups, "anchor").select("anchor", "kinds", "n", "text_key", "place"), "wanted")
    contexts = materialize(_fetch(docs, wanted), "context-bytes")
    found = [whole, _indexed(contexts.filter(F.col("kinds") <= LARGE).withColumn("part", F.lit(0).cast("long")))]
    large = contexts.filter(F.col("kinds") > LARGE)
    if large.head(1):
        found += _split(large)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around each wanted place: anchor, kinds, text_key, place, before, after."""
    per_text = wanted.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "kinds", "place")).alias("places"))
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("_key"))
    # one document of each text
    firsts = rows.groupBy("_key").agg(F.min("doc_id").alias("first")).withColumnRenamed("_key", "text_key")
    per_text = per_text.join(firsts, "text_key")
    rows = rows.join(per_text, (F.col("_key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, key in enumerate(batch.column("text_key").to_pylist()):
                text, places = texts[i].as_py(), batch.column("places")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p["anchor"] for p in places], pa.int64()),
                        pa.array([p["kinds"] for p in places], pa.int64()),
                        pa.array([key] * len(places), pa.int64()),
                        pa.array([p["place"] for p in places], pa.int32()),
                        pa.array([text[max(0, p["place"] - SIDE) : p["place"]] for p in places], pa.binary()),
                        pa.array([text[p["place"] : p["place"] + LENGTH] for p in places], pa.binary()),
                    ],
                    names=["anchor", "kinds", "text_key", "place", "before", "after"],
                )

    rows = rows.select("text", "text_key", "places")
    # equal rows (of one id and text, or without ids) give equal contexts
    return rows.mapInArrow(run, "anchor long, kinds long, text_key long, place int, before binary, after binary").dropDuplicates(["anchor", "text_key", "place"])


def _indexed(contexts: DataFrame) -> DataFrame:
    """Repeats among the contexts of each (anchor, part): text_key, start, end."""
    rows = contexts.select("anchor", "part", "text_key", "place", "before", "after")
    rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "text_key", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, number = [], 0, None, -1
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("anchor", "part", "text_key", "place", "before", "after")]
            for anchor, part, key, place, before, after in zip(*columns):
                if (anchor, part) != last:
                    if size > CHUNK:
                        yield _repeats(held)
                        held, size = [], 0
                    last, number = (anchor, part), number + 1
                begin = place - len(before)
                if held and held[-1][0] == number and held[-1][1] == key and begin <= held[-1][2] + len(held[-1][3]):
                    # contexts of one text that overlap are one string: a byte is in the index once
                    old = held[-1]
                    more = (before + after)[old[2] + len(old[3]) - begin :]
                    held[-1] = (number, key, old[2], old[3] + more)
                    size += len(more)
                else:
                    held.append((number, key, begin, before + after))
                    size += len(before) + len(after)
        if held:
            yield _repeats(held)

    return rows.mapInArrow(run, "text_key long, start int, end int")


def _repeats(held: list[tuple]) -> pa.RecordBatch:
    text = np.frombuffer(b"".join(h[3] for h in held), dtype="u1")
    lengths = np.array([len(h[3]) for h in held])
    starts = np.cumsum(lengths) - lengths
    group = np.array([h[0] for h in held])
    begin, end, of = repeated_parts(text, starts, group, LENGTH)
    parts = np.cumsum(end - begin) - (end - begin)
    index = RunLengthIndex(np.concatenate([text[a:b] for a, b in zip(begin, end)]) if len(of) else text[:0], parts, group[of])
    at = index.long_matches(LENGTH)
    part = np.searchsorted(parts, at, side="right") - 1
    # strings that begin one after the other are one range
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(part) != 0)] if len(at) else np.empty(0, dtype=bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1 if len(first) else first
    owner = of[part]
    # from places among the parts to places in the texts
    shift = (begin - parts)[part[first]] + (np.array([h[2] for h in held]) - starts)[owner[first]]
    keys = np.array([h[1] for h in held], dtype="i8")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[owner[first]]),
            pa.array((at[first] + shift).astype("i4")),
            pa.array((at[last] + shift + LENGTH).astype("i4")),
        ],
        names=["text_key", "start", "end"],
    )


def _split(contexts: DataFrame) -> list[DataFrame]:
    """Repeats in groups of more than ``LARGE`` contexts.

    A cell (low, high) stands for the strings with ``low`` to ``high`` bytes before the anchor. Contexts
    that share such a string agree on the ``low`` bytes before the anchor and the ``LENGTH - high`` from
    it on; this is the key of the cell. Contexts that agree on all bytes of the cell's strings are
    repeats at once. Cells are halved until their keys have few contexts or are whole strings.
    """
    found = []
    rows = contexts.withColumn("low", F.lit(0)).withColumn("high", F.lit(SIDE))
    while True:
        halves = F.array(
            F.struct("low", F.expr("(low + high) div 2").cast("int").alias("high")),
            F.struct((F.expr("(low + high) div 2") + 1).cast("int").alias("low"), "high"),
        )
        rows = rows.withColumn("half", F.explode(halves)).withColumn("low", F.col("half.low")).withColumn("high", F.col("half.high")).drop("half")
        # the context must hold the cell's shortest string parts at all
        rows = rows.filter((F.length("before") >= F.col("low")) & (F.length("after") >= LENGTH - F.col("high")))
        key = F.xxhash64("low", "high", F.expr("substring(before, length(before) - low + 1, low)"), F.expr(f"substring(after, 1, {LENGTH} - high)"))
        full = F.when(
            (F.length("before") >= F.col("high")) & (F.length("after") >= LENGTH - F.col("low")),
            F.xxhash64(F.expr("substring(before, length(before) - high + 1, high)"), F.expr(f"substring(after, 1, {LENGTH} - low)"), F.lit(1)),
        )
        rows = materialize(rows.withColumn("part", key).withColumn("full", full), "cells")
        equal = rows.filter("full is not null").groupBy("anchor", "low", "high", "full").agg(F.count(F.lit(1)).alias("same")).filter("same > 1")
        equal = equal.select("anchor", "low", "high", "full", F.lit(True).alias("repeat"))
        rows = materialize(rows.join(equal, ["anchor", "low", "high", "full"], "left"), "cells")
        done = rows.filter("repeat")
        found.append(done.select("text_key", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + LENGTH).alias("end")))
        # repeats are settled, but one of each stays for the others to be compared with
        ones = done.groupBy("anchor", "low", "high", "full").agg(F.min("text_key").alias("text_key"), F.min_by("place", "text_key").alias("place"))
        stay = done.join(ones.select("anchor", "low", "high", "text_key", "place"), ["anchor", "low", "high", "text_key", "place"], "left_semi")
        open_ = rows.filter("repeat is null").unionByName(stay.select(*rows.columns)).drop("full", "repeat")
        sizes = open_.groupBy("anchor", "low", "high", "part").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        open_ = materialize(open_.join(sizes, ["anchor", "low", "high", "part"]), "open")
        few = open_.filter(F.col("members") <= LARGE).drop("members")
        found.append(_indexed(few.withColumn("part", F.xxhash64("part", "low", "high"))))
        rows = open_.filter((F.col("members") > LARGE) & (F.col("low") < F.col("high"))).drop("members", "part")
        if not rows.head(1):
            return found


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, binary).

    Removed is every byte of the UTF-8 text that is covered by a string of ``LENGTH`` bytes which also
    starts at another place, in this or another document; a copy of a document is another document.
    ``n_spans`` counts the maximal removed runs. A null text is empty; texts shorter than ``LENGTH`` stay
    whole; null ids, repeated rows (copies) and other columns do no harm; no rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # every copy of a text marks the same ranges, and every copy gets the list: each range is in it once
    ranges = marks(docs).groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _text_key().alias("text_key"))
    rows = rows.join(ranges, "text_key", "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column("text").cast(pa.binary()), batch.column("ranges")
            missing = ranges.is_null().to_pylist()
            offsets, flat = ranges.offsets.to_numpy(), ranges.values
            low, high = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            out = []
            for i in range(batch.num_rows):
                kept = data = texts[i].as_py()
                spans = removed = 0
                if not missing[i]:
                    s = slice(offsets[i], offsets[i + 1])
                    kept, spans = cut(data, low[s], high[s])
                    removed = len(data) - len(kept)
                out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*out))
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3]), pa.array(columns[4], pa.binary())] if out else None
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    result = rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result if with_text else result.drop("kept")


def cut(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside the ranges, and how many maximal ranges there are."""
    steps = np.zeros(len(data) + 1, dtype="i8")
    np.add.at(steps, np.clip(low, 0, len(data)), 1)
    np.add.at(steps, np.clip(high, 0, len(data)), -1)
    gone = np.cumsum(steps[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(data, dtype="u1")[~gone].tobytes(), spans
