"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from the frequencies of
its bytes and a few measures of its words; a gated attention, learned from the labels of whole
documents, says how much each passage counts, and the weighted mean of the encodings is scored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WHITE, ship_code
from basketry.llm.suffix_dedup import Hasher

PASSAGE = 128  # words
FIT_DOCS = 5_000  # labelled documents that the model is fitted on, picked by hash
FIT_BLOCK = 1 << 14  # passages that are in memory at a time when a model is fitted, or one document's
HIDDEN, GATE = 24, 12
ROUNDS, BATCH, RATE = 14, 128, 0.01
EXTRA = 5
WIDTH = 256 + EXTRA
CUT = 0.3
_BUFFER = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[list(WHITE.encode())] = True


def passages(hasher: Hasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, features) of every passage of the texts, in order; a text without words has one.

    Features: square roots of byte frequencies, then mean word length, share of distinct words and of
    distinct pairs of words, lines per word, and the logarithm of the words.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])  # a blank parts the texts
    data = np.frombuffer(b" ".join(texts) + b" ", dtype="u1")
    starts = np.r_[0, ends[:-1]]
    white = _WHITE[data]
    begin = ~white & np.r_[True, white[:-1]]
    first, last = np.flatnonzero(begin), np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    doc = np.searchsorted(starts, first, side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    rank = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    bags = np.maximum(1, -(-count // PASSAGE))
    base = np.cumsum(bags) - bags
    bag = base[doc] + rank // PASSAGE
    total = int(bags.sum())
    owner = np.repeat(np.arange(len(texts)), bags)
    # bytes belong to the passage of the last word that began, blanks before the first to the first
    of_byte = np.repeat(base, np.diff(np.r_[starts, len(data)]))
    seen = np.cumsum(begin)
    inside = seen > 0
    of_byte[inside] = np.maximum(of_byte[inside], bag[seen[inside] - 1])
    use = np.ones(len(data), dtype=bool)
    use[ends - 1] = False
    grid = np.bincount(of_byte[use] * 256 + data[use], minlength=total * 256).reshape(total, 256)
    size = np.maximum(grid.sum(axis=1), 1)
    words = np.bincount(bag, minlength=total)
    some = np.maximum(words, 1)
    hashes = hasher.ranges(hasher.sums(data), first, last)
    with np.errstate(over="ignore"):
        salt = (np.arange(total, dtype="u8") + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        single = bag[np.unique(hashes ^ salt[bag], return_index=True)[1]]
        same = np.flatnonzero(bag[1:] == bag[:-1])
        pair = hashes[same] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[same + 1]
        double = bag[same[np.unique(pair ^ salt[bag[same]], return_index=True)[1]]]
    kinds = np.bincount(single, minlength=total)
    pairs = np.bincount(double, minlength=total)
    extra = np.stack(
        [
            np.bincount(bag, weights=last - first, minlength=total) / some / 10,
            kinds / some,
            pairs / np.maximum(words - 1, 1),
            grid[:, 10] / some,
            np.log1p(words),
        ],
        axis=1,
    )
    return owner, np.concatenate([np.sqrt(grid / size[:, None]), extra], axis=1).astype("f4")


def _blocks(read: Callable[[int], np.ndarray], sizes: np.ndarray, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bags, whose each row is, rows) for the bags ``some``, as many at a time as ``FIT_BLOCK`` rows hold, or one."""
    start, total = 0, 0
    for i in range(len(some) + 1):
        if i == len(some) or (i > start and total + sizes[some[i]] > FIT_BLOCK):
            part = some[start:i]
            if len(part):
                yield part, np.repeat(np.arange(len(part)), sizes[part]), np.concatenate([read(k) for k in part])
            start, total = i, 0
        if i < len(some):
            total += sizes[some[i]]


class AttentionModel:
    """Encoder, gated attention and scorer; fitted by gradient descent with Adam."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fit(cls, read: Callable[[int], np.ndarray], sizes: np.ndarray, label: np.ndarray) -> AttentionModel:
        """``read`` gives the rows of a bag by its number, ``sizes`` says how many they are, ``label`` has 0 or 1 per bag."""
        rng = np.random.default_rng(3)
        blocks = lambda some: _blocks(read, sizes, some)
        every = np.arange(len(label))
        mean = sum(x.sum(axis=0, dtype="f8") for _, _, x in blocks(every)) / sizes.sum()
        scale = np.sqrt(sum(((x - mean) ** 2).sum(axis=0) for _, _, x in blocks(every)) / sizes.sum()) + 1e-3
        mean, scale = mean.astype("f4"), scale.astype("f4")
        w = {
            "encode": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "shift": np.zeros(HIDDEN),
            "value": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "attend": np.zeros(GATE), "score": rng.normal(0, HIDDEN**-0.5, HIDDEN), "bias": np.zeros(1),
        }
        model = cls(w | {"mean": mean, "scale": scale})
        moment = {k: np.zeros_like(v) for k, v in w.items()}
        spread = {k: np.zeros_like(v) for k, v in w.items()}
        step = 0
        for _ in range(ROUNDS):
            order = rng.permutation(len(label))
            for s in range(0, len(order), BATCH):
                some = order[s : s + BATCH]
                gradient = {k: np.zeros_like(v) for k, v in w.items()}
                for part, own, x in blocks(some):
                    for k, g in model._gradient(own, x, label[part]).items():
                        gradient[k] += g * (len(part) / len(some))
                step += 1
                for k, g in gradient.items():
                    g = g + 1e-4 * w[k]
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    spread[k] = 0.999 * spread[k] + 0.001 * g * g
                    model.w[k] = w[k] = w[k] - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
        return model

    def _forward(self, own: np.ndarray, x: np.ndarray):
        w, n = self.w, int(own[-1]) + 1
        z = np.clip((x - w["mean"]) / w["scale"], -8, 8)
        h = np.tanh(z @ w["encode"] + w["shift"])
        value, gate = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        a = (value * gate) @ w["attend"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, own, a)
        a = np.exp(a - top[own])
        a /= np.bincount(own, weights=a, minlength=n)[own]
        begin = np.searchsorted(own, np.arange(n))
        bag = np.add.reduceat(a[:, None] * h, begin, axis=0)
        p = 1 / (1 + np.exp(-np.clip(bag @ w["score"] + w["bias"][0], -30, 30)))
        return z, h, value, gate, a, bag, p

    def _gradient(self, own: np.ndarray, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        z, h, value, gate, a, bag, p = self._forward(own, x)
        d = (p - label) / len(label)
        d_bag = d[:, None] * w["score"][None, :]
        d_h = a[:, None] * d_bag[own]
        d_a = (h * d_bag[own]).sum(axis=1)
        d_a = a * (d_a - np.bincount(own, weights=a * d_a, minlength=len(label))[own])
        d_mix = d_a[:, None] * w["attend"][None, :]
        d_value, d_gate = d_mix * gate * (1 - value**2), d_mix * value * gate * (1 - gate)
        d_h = (d_h + d_value @ w["value"].T + d_gate @ w["gate"].T) * (1 - h**2)
        return {
            "encode": z.T @ d_h, "shift": d_h.sum(axis=0), "value": h.T @ d_value, "gate": h.T @ d_gate,
            "attend": (value * gate).T @ d_a, "score": bag.T @ d, "bias": np.array([d.sum()]),
        }

    def score(self, own: np.ndarray, x: np.ndarray) -> np.ndarray:
        """One score per bag."""
        return self._forward(own, x)[-1] if len(own) else np.empty(0)

    def attention(self, own: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The weight of each passage in its bag."""
        return self._forward(own, x)[4]


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: a fifth, by the checksum of the id."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0


def _bounded(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of a batch in parts of about ``_BUFFER`` bytes of text."""
    texts, part, size, start = batch.column("text").cast(pa.binary()), [], 0, 0
    for i, text in enumerate(texts):
        part.append(text.as_py() or b"")
        size += len(part[-1])
        if size > _BUFFER or i == batch.num_rows - 1:
            yield start, i + 1, part
            part, size, start = [], 0, i + 1


def train(docs: DataFrame, labels: DataFrame) -> AttentionModel | None:
    """A model from ``FIT_DOCS`` labelled documents at most that are not held out; None without any.

    All passages of these documents count. They come to the driver partition by partition and stay in
    a temporary file there, of ``4 * WIDTH`` bytes each; memory holds ``FIT_BLOCK`` of them.
    """
    ship_code()
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("int").alias("label")).filter(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(FIT_DOCS)
    # at most FIT_DOCS rows of two numbers
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, texts in _bounded(batch):
                own, x = passages(hasher, texts)
                count = np.bincount(own, minlength=len(texts))
                rank = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                part = batch.slice(lo, hi - lo)
                for s in range(0, len(own), 4096):
                    some = pa.array(own[s : s + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(some), part.column("label").take(some), pa.array(rank[s : s + 4096].astype("i4")),
                            pa.array([row.tobytes() for row in x[s : s + 4096]], pa.binary()),
                        ],
                        names=["doc_id", "label", "rank", "x"],
                    )

    found = rows.mapInArrow(run, "doc_id long, label int, rank int, x binary").repartition("doc_id").sortWithinPartitions("doc_id", "rank", "x")
    with tempfile.TemporaryFile() as file:
        bags: dict[int, list[int]] = {}  # doc_id -> label, first row, rows
        for n, row in enumerate(found.toLocalIterator()):
            bags.setdefault(row["doc_id"], [row["label"], n, 0])[2] += 1
            file.write(row["x"])
        if not bags:
            return None
        file.flush()
        label, first, sizes = np.array([bags[i] for i in sorted(bags)]).T

        def read(bag: int) -> np.ndarray:
            file.seek(int(first[bag]) * WIDTH * 4)
            return np.fromfile(file, "f4", int(sizes[bag]) * WIDTH).reshape(-1, WIDTH)

        return AttentionModel.fit(read, sizes, label.astype(float))


def score(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, passages.

    Scores depend on the text alone. Null and empty texts are one passage without words; without a
    model, as where nothing is labelled, every score is 0.5. Null ids are not held out; repeated rows
    are scored alike; other columns are ignored; no rows give no rows.
    """
    ship_code()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, texts in _bounded(batch):
                own, x = passages(hasher, texts)
                p = model.score(own, x) if model else np.full(hi - lo, 0.5)
                part = batch.slice(lo, hi - lo)
                count = np.bincount(own, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p.astype("f8")), pa.array((p >= CUT).astype("i4")), pa.array(count)],
                    names=["doc_id", "held_out", "score", "predicted", "passages"],
                )

    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), docs["text"].cast("string").alias("text"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages long")
