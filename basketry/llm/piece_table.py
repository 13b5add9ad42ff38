"""Fill-in-the-middle arrangement of documents by piece tables.

A document becomes descriptors ``(buffer, start, length)`` over two buffers that never change: its text
and the sentinels. Cutting splits a descriptor, an arrangement is a permutation of descriptors, and the
inverse permutation restores the text. Digests stream over the descriptors, so that no text is put
together for them. All offsets are bytes of UTF-8; cuts fall between tokens, never inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basketry.llm.common import WHITE, ship_code

TEXT, MARKS = 0, 1  # the buffers
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 42
RATE = 50  # documents arranged, in a hundred
SPM = 80  # of these with the suffix first, in a hundred
#: descriptors of a cut document, in the order of its text: prefix, middle, suffix; then the sentinels
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
SCHEMA = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
    "pieces array<struct<buffer: int, start: long, length: long>>, output string, output_sha256 string"
)

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[ord(c) for c in WHITE]] = True
_MARKS = "".join(SENTINELS).encode()
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


@dataclass
class PieceTable:
    """Descriptors over immutable buffers."""

    buffers: tuple[bytes, ...]
    pieces: list[tuple[int, int, int]]

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls((text, _MARKS), [(TEXT, 0, len(text))])

    def cut(self, *offsets: int) -> None:
        """Split the descriptors at rising offsets of the whole; an offset at an edge makes an empty one."""
        out, before, at = [], 0, iter([*offsets, None])
        offset = next(at)
        for buffer, start, length in self.pieces:
            taken = 0
            while offset is not None and before + taken <= offset <= before + length:
                step = offset - before - taken
                out.append((buffer, start + taken, step))
                taken += step
                offset = next(at)
            out.append((buffer, start + taken, length - taken))
            before += length
        self.pieces = out

    def add_sentinels(self) -> None:
        at = 0
        for mark in SENTINELS:
            self.pieces.append((MARKS, at, len(mark)))
            at += len(mark)

    def arrange(self, order: tuple[int, ...]) -> None:
        self.pieces = [self.pieces[i] for i in order]

    def views(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield memoryview(self.buffers[buffer])[start : start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.views())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(int(i) for i in np.argsort(order))


def token_ends(text: bytes) -> np.ndarray:
    """Where the tokens end: after each word, which takes the white space before it, and at the end."""
    if not text:
        return np.zeros(0, dtype="i8")
    white = _WHITE[np.frombuffer(text, dtype="u1")]
    return np.append(np.flatnonzero(~white[:-1] & white[1:]) + 1, len(text))


def code_points(text: bytes, start: int, end: int) -> int:
    part = np.frombuffer(text, dtype="u1")[start:end]
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers from the id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def arranged(doc_id, text: bytes, seed: int, rate: int, spm: int) -> tuple[PieceTable, str, int, int | None, int | None]:
    """The piece table of one document's output, its form, tokens, and characters of prefix and middle."""
    h, ends, document = draws(doc_id, seed), token_ends(text), PieceTable.of(text)
    n = len(ends)
    if not text or h[2] % 100 >= rate or any(mark.encode() in text for mark in SENTINELS):
        return document, "plain", n, None, None
    form = "spm" if h[3] % 100 < spm else "psm"
    units = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, second = (int(ends[u - 1]) if u else 0 for u in units)
    document.cut(first, second)
    document.add_sentinels()
    document.arrange(ARRANGEMENTS[form])
    return document, form, n, code_points(text, 0, first), code_points(text, first, second)


def opened(output: bytes, form: str) -> PieceTable:
    """The piece table of the text that an output of ``arranged`` holds, over the output as buffer.

    A sentinel occurs in an output once: texts that hold one are left plain, and as it begins with the
    only ``<`` in it, it cannot arise where a piece and a sentinel meet.
    """
    whole = PieceTable.of(output)
    if form == "plain":
        return whole
    order, at, edges = ARRANGEMENTS[form], 0, []
    for piece in order:
        if piece >= len(SENTINELS):
            mark = SENTINELS[piece - len(SENTINELS)].encode()
            at = output.index(mark, at)
            edges += [at, at + len(mark)]
            at += len(mark)
    whole.cut(*edges[1:])  # the first edge is the start
    whole.arrange(inverse(order))
    del whole.pieces[len(SENTINELS) :]
    return whole


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Every document arranged for filling in its middle, see ``SCHEMA``.

    A unit is a word with the white space before it, or white space at the end. ``pieces`` are the
    descriptors of the output, ``output`` is its text. Prefix and middle are counted in code points and
    null in plain form. A null or empty text is an empty plain output; a null id is one like others;
    repeated rows give repeated rows; other columns are ignored; no rows give no rows. Rows do not
    depend on each other, so nothing is shuffled and a lost task is repeated alone.
    """
    ship_code()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1).cast(pa.binary())):
                table, *facts = arranged(doc_id, text.as_py() or b"", seed, rate, spm)
                pieces = [dict(zip(("buffer", "start", "length"), p)) for p in table.pieces]
                rows.append((doc_id, facts[1], facts[0], *facts[2:], pieces, table.bytes(), table.sha256()))
            yield _batch(rows, _TYPES, _NAMES)

    return _texts(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def restore(outputs: DataFrame, text: bool = True) -> DataFrame:
    """Outputs of ``transform`` (doc_id, form, output) -> doc_id, restored_sha256 and, if asked, ``text``.

    A null output is an empty one. Other columns are ignored; repeated rows stay.
    """
    ship_code()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, form, output in zip(*(batch.column(i).to_pylist() for i in (0, 2)), batch.column(1).cast(pa.binary())):
                table = opened(output.as_py() or b"", form)
                rows.append((doc_id, table.sha256(), *([table.bytes()] if text else [])))
            yield _batch(rows, [pa.int64(), pa.string(), pa.string()], ["doc_id", "restored_sha256", "text"])

    schema = "doc_id long, restored_sha256 string" + ", text string" * text
    return _texts(outputs, "doc_id", "output", "form").mapInArrow(run, schema)


def digest(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """The facts of ``transform`` with the digests of each output and of the text rebuilt from it.

    The same rules for odd rows as in ``transform``.
    """
    ship_code()
    outputs = transform(docs, seed, rate, spm)
    facts = [c for c in outputs.columns if c not in ("pieces", "output")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column("form").to_pylist()
            texts = batch.column("output").cast(pa.binary())
            found = [opened(text.as_py(), form).sha256() for form, text in zip(forms, texts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in facts), pa.array(found, pa.string())], names=[*facts, "restored_sha256"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outputs.schema if f.name in facts)
    return outputs.drop("pieces").mapInArrow(run, schema + ", restored_sha256 string")


def _texts(docs: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text), *others)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    made = [pa.array(c, pa.binary()).cast(k) if c and isinstance(c[0], bytes) else pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(made, names=names[: len(made)])


_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _PIECES, pa.string(), pa.string()]
