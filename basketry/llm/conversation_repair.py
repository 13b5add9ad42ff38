"""Repair of conversation structure: the cheapest edits that make roles take turns.

Rows are sorted over the whole cluster by conversation and turn. A task walks its rows: conversations
that begin and end inside it are repaired there, many at a time (``audit_paths``). The first and the last
conversation of a task, and any that is longer than a part, are written as parts of bounded size and put
together in steps that see only small facts of each part: texts seen in earlier parts, the least cost
between the states at both ends of a part, and, going back from the end, the cost that is left behind each
part. Then each part finds its own least edits for each state it may start in, and one walk along the
parts picks among them. Only the digest of a conversation, which is a chain by nature, reads its parts in
a row, and keeps none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from basketry.llm import audit_paths as ap
from basketry.llm.common import WHITE, materialize, ship_code

BLOCK_ROWS = 20_000  # rows of whole conversations that are repaired at a time
PART_ROWS = 4096  # rows of a part at most
CHARS = 1_000_000  # characters after which a block or a part is closed
TIE = 64  # characters of a text that decide between rows of equal turn and role, before its hash
LEGAL = {"su", "ua", "au"}
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows as the damage leaves them; dropped ones only mark that
    their conversation was there. Nulls count as one blank, but for the ids."""
    blank = F.lit(" ")
    conv, turn = conversations["conv_id"].cast("long"), conversations["turn"].cast("long")
    role, text = (F.coalesce(conversations[c].cast("string"), blank) for c in ("role", "text"))
    key = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d")
    )
    hurt = (
        F.when(F.col("_d").isin(0, 1), F.lit(""))
        .when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    times = F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), hurt.alias("text"),
        (F.col("_d") == 0).alias("dropped"), F.explode(times).alias("_time"),
    ).drop("_time")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows over the cluster by conversation and turn, nulls first; ties by role and text.

    Rows that are equal in all of this differ in their number, so that no key is too large to split.
    """
    rows = rows.withColumn("_tie", F.substring("text", 1, TIE)).withColumn("_hash", F.xxhash64("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    order: list[Column] = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_tie", "_hash", "_row")]
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(F.col("dropped"), "-").when(stripped == "", "b").when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", fault.alias("fault"))


def text_key(conv_id, role: str, text: str) -> bytes:
    """What makes two rows of a conversation duplicates."""
    return hashlib.md5(f"{conv_id}:{len(role)}:{role}:{text}".encode()).digest()


class Rows:
    """Rows of one conversation, or of a part of it."""

    def __init__(self, conv_id):
        self.conv_id, self.chars = conv_id, 0
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[str] = []

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if fault == "-":  # dropped
            return
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(text)

    def mark_repeats(self) -> list[tuple[int, bytes]]:
        """Mark duplicates inside; the places and keys of the others that are not blank."""
        first, seen = [], set()
        for at, (role, text, fault) in enumerate(zip(self.roles, self.texts, self.faults)):
            if fault == "b":
                continue
            key = text_key(self.conv_id, role, text)
            if key in seen:
                self.faults[at] = "d"
            else:
                seen.add(key)
                first.append((at, key))
        return first

    def kinds(self) -> bytes:
        return kinds(self.roles, self.faults)

    def gaps(self) -> tuple:
        """Smallest and largest turn and the number of distinct ones."""
        known = {t for t in self.turns if t is not None}
        return (min(known), max(known), len(known)) if known else (None, None, 0)

    def counts(self) -> tuple[int, int, int, int]:
        illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(self.roles, self.roles[1:]))
        return self.faults.count("b"), self.faults.count("d"), self.faults.count("t"), illegal


def kinds(roles: list[str], faults: list[str]) -> bytes:
    """Turns as ``audit_paths`` wants them."""
    out = []
    for role, fault in zip(roles, faults):
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        out.append("d" if fault in "bd" else initial.upper() if fault == "t" else initial)
    return "".join(out).encode()


def repair_whole(conversations: list[Rows]) -> list[tuple]:
    """``RESULT`` rows of whole conversations."""
    for rows in conversations:
        rows.mark_repeats()
    costs, audits = ap.whole([rows.kinds() for rows in conversations])
    out = []
    for rows, cost, audit in zip(conversations, costs, audits):
        low, high, distinct = rows.gaps()
        turns, _ = ap.repaired(audit, rows.roles, rows.texts)
        digest = hashlib.sha256("\n".join(turns).encode()).hexdigest()
        out.append((rows.conv_id, high - low + 1 - distinct if distinct else 0, *rows.counts(), cost, audit.decode(), digest))
    return out


_RESULT_NAMES = [part.split()[0] for part in RESULT.split(", ")]
_PART_FIELDS = ["part", "low", "high", "distinct", "roles", "texts", "faults", "places", "keys"]
_PART_TYPES = [*[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.binary())]
_RESULT_TYPES = [*[pa.int64()] * 7, pa.string(), pa.string()]
_GATHERED = (
    RESULT
    + ", part long, low long, high long, distinct long, roles array<string>, texts array<string>, faults string, places array<int>, keys array<binary>"
)


def _gather(block_rows: int, part_rows: int, chars: int):
    """Walk the sorted rows of a task: results of whole conversations, parts of the others."""

    def whole(block: list[Rows]) -> pa.RecordBatch:
        columns = list(zip(*repair_whole(block)))
        arrays = [pa.array(c, k) for c, k in zip(columns, _RESULT_TYPES)]
        return pa.RecordBatch.from_arrays(arrays + [pa.nulls(len(block), k) for k in _PART_TYPES], names=_RESULT_NAMES + _PART_FIELDS)

    def part(rows: Rows, number: int) -> pa.RecordBatch:
        first = rows.mark_repeats()
        own = [number, *rows.gaps(), rows.roles, rows.texts, "".join(rows.faults), [a for a, _ in first], [k for _, k in first]]
        arrays = [pa.array([rows.conv_id], pa.int64())] + [pa.nulls(1, k) for k in _RESULT_TYPES[1:]]
        return pa.RecordBatch.from_arrays(arrays + [pa.array([v], k) for v, k in zip(own, _PART_TYPES)], names=_RESULT_NAMES + _PART_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block, held, held_chars = [], 0, 0
        rows, apart = None, True  # the first conversation may have begun in the task before
        for batch in batches:
            for conv_id, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if rows is None:
                    rows = Rows(conv_id)
                elif conv_id != rows.conv_id:
                    if apart:
                        yield part(rows, number)
                        number += 1
                    else:
                        block.append(rows)
                        held, held_chars = held + len(rows.turns) + 1, held_chars + rows.chars
                        if held >= block_rows or held_chars >= chars:
                            yield whole(block)
                            block, held, held_chars = [], 0, 0
                    rows, apart = Rows(conv_id), False
                elif len(rows.turns) >= part_rows or rows.chars >= chars:
                    yield part(rows, number)
                    number += 1
                    rows, apart = Rows(conv_id), True
                rows.add(turn, role, text, fault)
        if block:
            yield whole(block)
        if rows is not None:  # it may go on in the next task
            yield part(rows, number)

    return run


def _by_part(df: DataFrame, schema: str, work) -> DataFrame:
    """Apply ``work`` (a list of rows as dicts -> a list of tuples) to the rows of each Arrow batch."""
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*work(batch.to_pylist()))) or [()] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made)], schema=made)

    return df.mapInArrow(run, schema)


def _facts(rows: list[dict]) -> list[tuple]:
    """Small facts of parts, with texts seen in earlier parts marked."""
    out = []
    for r in rows:
        faults = list(r["faults"])
        for at in r["again"] or ():
            faults[at] = "d"
        some = Rows(r["conv_id"])
        some.roles, some.faults = r["roles"], faults
        ends = (some.roles[0][:1], some.roles[-1][:1]) if some.roles else (None, None)
        out.append((r["conv_id"], r["part"], r["low"], r["high"], r["distinct"], *some.counts(), *ends, some.kinds()))
    return out


def _crossings(rows: list[dict]) -> list[tuple]:
    costs = ap.crossing([r["kinds"] for r in rows], np.array([r["last"] for r in rows], dtype=bool))
    return [(r["conv_id"], r["part"], c.ravel().tolist()) for r, c in zip(rows, costs)]


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the parts of each conversation from its end: what it still costs behind each part."""
    conv_id, cost = object(), None
    for batch in batches:
        behind = []
        for own, crossing in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if own != conv_id:
                conv_id, cost = own, np.zeros(ap.STATES, dtype="i8")  # the last part has its own end
            behind.append(cost.tolist())
            cost = np.minimum((np.array(crossing).reshape(ap.STATES, ap.STATES) + cost).min(axis=1), ap.FAR)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(behind, pa.list_(pa.int64()))], names=["part", "behind"])


def _audits(rows: list[dict]) -> list[tuple]:
    last = np.array([r["last"] for r in rows], dtype=bool)
    end = np.where(last[:, None], ap.FINAL, np.array([r["behind"] for r in rows]).reshape(-1, ap.STATES))
    found = zip(rows, *ap.parts([r["kinds"] for r in rows], end, last))
    return [(r["part"], [a.decode() for a in audits], states.tolist(), int(cost[ap.EMPTY])) for r, audits, states, cost in found]


_FACT_SCHEMA = (
    "conv_id long, part long, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, "
    "first string, final string, kinds binary"
)
_PICKED = [*_FACT_SCHEMA.replace(" long", "").replace(" string", "").replace(" binary", "").split(", ")[:-1], "audits", "states", "cost", "roles", "texts"]


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the parts of each conversation from its start and keep sums, the audit and a digest."""
    now = None

    def done(now: dict) -> tuple:
        gaps = now["high"] - now["low"] + 1 - now["distinct"] if now["distinct"] else 0
        sums = [now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return (now["conv_id"], gaps, *sums, "".join(now["audit"]), now["sha"].hexdigest())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _RESULT_TYPES)], names=_RESULT_NAMES)

    for batch in batches:
        ended = []
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            if now is None or r["conv_id"] != now["conv_id"]:
                if now is not None:
                    ended.append(done(now))
                now = {"conv_id": r["conv_id"], "state": ap.EMPTY, "audit": [], "sha": hashlib.sha256(), "any": False, "cost": r["cost"]}
                now |= {c: 0 for c in ("distinct", "blank", "duplicate", "truncated", "illegal")} | {"low": None, "high": None, "final": None}
            for c in ("blank", "duplicate", "truncated", "illegal"):
                now[c] += r[c]
            if r["distinct"]:
                now["distinct"] += r["distinct"] - (now["high"] == r["low"])  # a turn on both sides of the border
                now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
            if r["first"] is not None:
                now["illegal"] += now["final"] is not None and now["final"] + r["first"] not in LEGAL
                now["final"] = r["final"]
            audit, state = r["audits"][now["state"]], r["states"][now["state"]]
            for turn in ap.repaired(audit.encode(), r["roles"], r["texts"], now["state"])[0]:
                now["sha"].update((("\n" if now["any"] else "") + turn).encode())
                now["any"] = True
            now["audit"].append(audit)
            now["state"] = state
        if ended:
            yield batch_of(ended)
    if now is not None:
        yield batch_of([done(now)])


def _put_together(parts: DataFrame) -> DataFrame:
    """``RESULT`` rows from the parts of conversations."""
    # of texts that stand in several parts, the earliest stays; a text stands once in the list of a part
    places = parts.select("part", F.explode(F.arrays_zip("places", "keys")).alias("_p")).select("part", "_p.*")
    first = places.groupBy("keys").agg(F.min("part").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = places.join(first.select("keys", "_first").repartition("keys", "_first"), "keys").filter("part > _first")
    again = again.groupBy("part").agg(F.collect_list("places").alias("again"))
    marked = parts.select("conv_id", "part", "low", "high", "distinct", "roles", "faults").join(again, "part", "left")
    facts = materialize(_by_part(marked, _FACT_SCHEMA, _facts), "part-facts")
    ends = facts.groupBy("conv_id").agg(F.max("part").alias("part")).select("part", F.lit(True).alias("_last"))
    placed = facts.select("conv_id", "part", "kinds").join(ends, "part", "left")
    placed = materialize(placed.select("conv_id", "part", "kinds", F.coalesce("_last", F.lit(False)).alias("last")), "part-ends")
    crossed = _by_part(placed, "conv_id long, part long, crossing array<long>", _crossings)
    backward = crossed.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.desc("part"))
    behind = backward.mapInArrow(_costs_behind, "part long, behind array<long>")
    found = _by_part(
        placed.join(behind, "part").select("part", "kinds", "last", "behind"),
        "part long, audits array<string>, states array<long>, cost long", _audits,
    )
    rows = parts.select("part", "roles", "texts").join(facts.drop("kinds"), "part").join(materialize(found, "part-audits"), "part")
    forward = rows.select(*_PICKED).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    return forward.mapInArrow(_stitch, RESULT)


def repair(
    conversations: DataFrame, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS, chars: int = CHARS
) -> DataFrame:
    """Damage the rows, then find each conversation's faults and cheapest repair: one ``RESULT`` row for
    every conv_id, null included.

    Null turns come first; rows of equal turn are taken by role, then by the first ``TIE`` characters of
    the text, then by its hash. Null roles and texts are one blank; a role that begins with none of s, u
    and a must be rerolled or deleted. Repeated rows are duplicates. A conversation without rows after the
    damage has zeros, an empty audit and the digest of nothing. Other columns are ignored; no rows give
    no rows. A conversation of any length is held in parts; its audit, one letter an edit, is one value.
    """
    ship_code()
    gathered = materialize(_in_order(damage(conversations)).mapInArrow(_gather(block_rows, part_rows, chars), _GATHERED), "gathered")
    done = gathered.filter("part is null").select(*_RESULT_NAMES)
    return done.unionByName(_put_together(gathered.filter("part is not null").drop(*_RESULT_NAMES[1:])))
