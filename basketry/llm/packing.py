"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to tiers of context sizes (powers of two). A window of a tier takes the longest
pieces that fit; its gap is filled from shorter tiers and, where nothing fits whole, with a part of a
longer piece, whose rest goes back to its tier. Every window is full, so nothing is padded; the last
tokens of a task go into windows of smaller and smaller powers of two. Windows of one tier are dealt
to step groups of equal tokens. Reading, tokenising and packing happen in one pass without a shuffle.
"""

from __future__ import annotations

import bisect
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from basketry.llm.common import ship_code
from basketry.session import small_batches

TIERS = (512, 1024, 2048, 4096)
END = 2  # the id after each document
POOL = 1 << 20  # tokens held back so that gaps find fitting pieces
STEP = 32 * 4096  # tokens of a step group
CACHE = 500_000  # distinct words whose ids a worker remembers, also while it does other work
CACHE_BYTES = 32 << 20  # and the bytes of these words and ids
MARKS = ".,"  # cut off the end of words
RUN = 50  # new words looked up as one text
RUNS = 64  # such texts at a time: what the tokenizer returns takes hundreds of bytes a word
SLICE = 5 << 20  # bytes of texts whose words are made distinct at a time, a little more than a batch
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_id long"
)


class WordIds:
    """Token ids of texts by a tokenizer that drops white space and never joins across it.

    Then the ids of a text are those of its words in a row. The words of many texts are made distinct
    first; a word seen before needs no new look at the tokenizer. Words are remembered in an Arrow array,
    in which a word's place is its number. What is remembered is forgotten when it exceeds ``CACHE`` words or ``CACHE_BYTES``. Shortcuts that rest on a habit of the tokenizer (letter
    case, marks at the end of a word, tokens that tell where a word ends) are taken where it has it.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._learn_habits()
        marks = self._ids(list(MARKS))
        lengths = np.array([1, *map(len, marks)])
        self._fixed = lengths, np.array([END, *(i for ids in marks for i in ids)], dtype="u4")
        self._forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_habits(self) -> None:
        letters = "abcdefghijklmnopqrstuvwxyz"
        mixed = [letters.upper(), *letters.upper(), "aBcDe", "Zz9Q", "T-Shirt", "IN'S"]
        self.folds_case = self._ids(mixed) == self._ids([w.lower() for w in mixed])
        stems = [*letters, *"0123456789", "ab", "the", "x1", "9y", "don't", "a-b", "été1", "w" * 30]
        plain = self._ids(stems)
        self.cuts_marks = all(
            self._ids([s + m for s in stems]) == [ids + mark for ids in plain] for m, mark in zip(MARKS, self._ids(list(MARKS)))
        )
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False) if suffix else {}
        self.ends_word = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.length = np.zeros(1 << 12, dtype="i8")
        self.begin = np.zeros(1 << 12, dtype="i8")
        self.ids = np.zeros(1 << 14, dtype="u4")
        self.used, self.stored, self.bytes = 0, 0, 0
        # END and the marks have names that no word has; a blank at an edge of a text makes an empty word
        self._store(np.append(self._fixed[0], 0), self._fixed[1])
        self._name([" ", *(" " + m for m in MARKS), ""])

    def _store(self, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Keep the ids of words in a row; gives the words' numbers."""
        first, count = self.stored, len(lengths)
        while first + count > len(self.length):
            self.length, self.begin = np.concatenate([self.length, self.length]), np.concatenate([self.begin, self.begin])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.length[first : first + count] = lengths
        self.begin[first : first + count] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used, self.stored = self.used + len(flat), first + count
        self.bytes += 4 * len(flat)
        return np.arange(first, first + count)

    def _name(self, words: list[str] | pa.Array) -> None:
        """The words of the numbers stored since the last call, in this order."""
        words = pa.array(words, pa.large_string())
        self.known = pa.concat_arrays([self.known, words])
        self.bytes += pc.sum(pc.binary_length(words)).as_py()

    def _gather(self, at: np.ndarray) -> np.ndarray:
        length = self.length[at]
        ends = np.cumsum(length)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - (ends - length), length)]

    def _encode(self, words: pa.Array) -> np.ndarray:
        """Look new words up; gives their numbers. Runs of them go as one text where the tokens that end words are as
        many as the words."""
        # letters alone first, so that a run of words is not given up for one with several parts
        order = np.argsort(~pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False), kind="stable")
        numbers = np.empty(len(words), dtype="i8")
        for first in range(0, len(order), RUN * RUNS):
            places = order[first : first + RUN * RUNS]
            some = words.take(pa.array(places)).to_pylist()
            rest = range(len(some))
            if self.ends_word.any():
                rest, runs = [], [range(len(some))[i : i + RUN] for i in range(0, len(some), RUN)]
                for run, ids in zip(runs, self._ids([" ".join(some[run.start : run.stop]) for run in runs])):
                    flat = np.array(ids, dtype="u4")
                    known = flat < len(self.ends_word)
                    ends = np.flatnonzero(known & self.ends_word[np.where(known, flat, 0)]) + 1
                    if len(ends) == len(run) and ends[-1] == len(flat):
                        numbers[places[run.start : run.stop]] = self._store(np.diff(ends, prepend=0), flat)
                    else:
                        rest += run
            if rest:
                found = self._ids([some[i] for i in rest])
                lengths = np.fromiter(map(len, found), "i8", len(rest))
                flat = np.fromiter((i for ids in found for i in ids), "u4", int(lengths.sum()))
                numbers[places[rest]] = self._store(lengths, flat)
        self._name(words.take(pa.array(np.argsort(numbers))))
        return numbers

    def _stems(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words without what the tokenizer ignores or cuts off: letter case, a mark behind a letter or
        digit. The second result says which mark: 0 for none, then the places in ``MARKS``."""
        marked = np.zeros(len(words), dtype="i8")
        if self.folds_case:
            # the name of a special token has a case
            words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        if self.cuts_marks:
            for k, mark in enumerate(MARKS):
                marked[pc.match_substring_regex(words, f"[0-9A-Za-z][{mark}]$").to_numpy(zero_copy_only=False)] = k + 1
            words = pc.if_else(pa.array(marked > 0), pc.utf8_slice_codeunits(words, 0, -1), words)
        return words, marked

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words; new ones are looked up first."""
        words = words.cast(pa.large_string())
        numbers = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype("i8")
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._encode(words.take(pa.array(new)))
        return numbers

    def __call__(self, text: bytes) -> np.ndarray:
        """The ids of one whole UTF-8 text, without an end mark."""
        return self.texts(pa.array([text], pa.binary()).cast(pa.string()))[0][:-1]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts in a row, ``END`` after each, and the number of ids of each text."""
        if self.stored > CACHE or self.bytes > CACHE_BYTES:
            self._forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        stems, marked = self._stems(coded.dictionary)
        stems = stems.dictionary_encode()
        stem = self._numbers(stems.dictionary)[stems.indices.to_numpy()]
        mark = np.where(marked > 0, marked, -1)  # MARKS have the numbers after that of END, which is 0
        word = coded.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        at = np.stack([stem[word], mark[word]], axis=1).ravel()
        at = np.insert(at, 2 * ends, 0)
        length = np.where(at >= 0, self.length[at], 0)
        counted = np.concatenate([[0], np.cumsum(length)])
        places = 2 * ends + np.arange(1, len(ends) + 1)
        return self._gather(at[at >= 0]), np.diff(counted[np.concatenate([[0], places])])


def worker_words(path: str) -> WordIds:
    """One ``WordIds`` for all tasks of a worker process. It hangs on ``sys.modules``, since functions
    sent to the workers by value have globals of their own in each task."""
    store = vars(sys.modules.setdefault("_basketry_worker", types.ModuleType("_basketry_worker")))
    if path not in store:
        store[path] = WordIds(path)
    return store[path]


class Packer:
    """Packs pieces of documents into full windows; holds about ``pool`` tokens."""

    def __init__(self, tiers: tuple[int, ...], pool: int, step: int, first_sequence: int):
        self.tiers, self.pool, self.step = sorted(tiers), pool, step
        self.largest, self.held, self.serial = self.tiers[-1], 0, 0
        self.sequence, self.first = first_sequence, first_sequence
        self.waiting: list[tuple[int, int]] = []  # (length, serial), sorted
        self.pieces: dict[int, tuple] = {}  # serial -> doc_id, its ids from a start on, start, tokens of the document
        self.dealt: dict[int, int] = {}  # windows per tier so far
        self.rows: list[tuple] = []

    def _put(self, doc_id, ids, start: int, total: int) -> None:
        self.serial += 1
        bisect.insort(self.waiting, (len(ids), self.serial))
        self.pieces[self.serial] = (doc_id, ids, start, total)
        self.held += len(ids)

    def _emit(self, size: int, parts: list[tuple]) -> None:
        n = self.dealt.get(size, 0)
        self.dealt[size] = n + 1
        step_id = self.first + (self.tiers.index(size) if size in self.tiers else len(self.tiers)) + (n * size // self.step) * (len(self.tiers) + 1)
        offset = 0
        for doc_id, ids, start, total in parts:
            crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
            self.rows.append((doc_id, start, len(ids), crc, total, self.sequence, offset, size, step_id))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        """Take a document; whole windows of a long one leave at once."""
        start = 0
        while len(ids) - start >= self.largest:
            self._emit(self.largest, [(doc_id, ids[start : start + self.largest], start, len(ids))])
            start += self.largest
        if start < len(ids):
            self._put(doc_id, ids[start:].copy(), start, len(ids))  # a view would hold its whole batch
        if self.held > self.pool:
            while self.held > self.pool // 2:
                self._window(self._route())

    def _route(self) -> int:
        """The tier of the longest piece that waits."""
        return self.tiers[bisect.bisect_left(self.tiers, self.waiting[-1][0])]

    def _window(self, size: int) -> None:
        """Fill one window of a size that is at most what is held."""
        parts, gap = [], size
        while gap:
            at = bisect.bisect_right(self.waiting, (gap, 1 << 62)) - 1
            cut = at < 0
            length, serial = self.waiting.pop(0 if cut else at)
            doc_id, ids, start, total = self.pieces.pop(serial)
            self.held -= length
            taken = min(length, gap)
            parts.append((doc_id, ids[:taken], start, total))
            if cut:
                self._put(doc_id, ids[taken:], start + taken, total)
            gap -= taken
        self._emit(size, parts)

    def finish(self) -> None:
        while self.held:
            size = self._route()
            self._window(size if size <= self.held else 1 << (self.held.bit_length() - 1))


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP) -> DataFrame:
    """One row per piece of a document in a sequence, see ``SCHEMA``.

    ``tokenizer`` is the path of a vocabulary file that the workers can read, of a tokenizer that
    drops white space. A document is its ids and ``END``; a null or empty text is just ``END``. Pieces
    of a document may lie in several sequences; each id lies in one. ``sequence_id`` and ``step_id`` are
    unique, not gapless: they start at the number of the task times 2**33. Null ids, ties and repeated
    rows are packed like others; other columns are ignored; no rows give no rows. Sets the size of the
    session's Arrow batches, see ``small_batches``.
    """
    ship_code()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = worker_words(tokenizer), Packer(tiers, pool, step, TaskContext.get().partitionId() << 33)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows))
            packer.rows = []
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

        for batch in batches:
            for some in _slices(batch):
                ids, counts = words.texts(some.column(1))
                at = 0
                for doc_id, count in zip(some.column(0).to_pylist(), counts.tolist()):
                    packer.add(doc_id, ids[at : at + count])
                    at += count
                if len(packer.rows) >= 20_000:
                    yield out()
            some = ids = None
            pa.default_memory_pool().release_unused()  # else it keeps most of what a batch needed
        packer.finish()
        if packer.rows:
            yield out()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``SLICE`` bytes of texts, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=0)).tolist()
    edges = sorted({0, *cuts, batch.num_rows})
    for first, last in zip(edges, edges[1:]):
        yield batch.slice(first, last - first)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
