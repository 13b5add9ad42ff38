"""Keep an index in step with a change table as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from basketry.operators.embed import Model
from basketry.operators.index import embed_changes, latest_changes, live_rows
from basketry.session import materialize


def change_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New files of an append-only change table."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


_CHANGE = "id long, text string, version long, op string"
_STATE = "winners binary"
_HELD = pa.schema([("id", pa.string()), ("text", pa.string()), ("version", pa.int64()), ("op", pa.string())])
# Ids that share a state, by hash. A state is called for once a batch, which costs more than to compare its changes. A
# stream that goes on from a checkpoint needs the number it was started with.
STATE_BUCKETS = 8192


def _winners(rows: pa.Table) -> pa.Table:
    """The winning change of each id, see ``change_order``; of equal ones the first."""
    ranks = {
        "version": rows.column("version"),
        "deleted": pc.fill_null(pc.equal(rows.column("op"), "delete"), False).cast(pa.int8()),
        "text": pc.fill_null(rows.column("text"), ""),
    }
    first = pa.array(range(rows.num_rows), pa.int64())
    keys = [*((name, "descending") for name in ranks), ("first", "ascending")]
    order = pc.sort_indices(pa.table({**ranks, "first": first}), sort_keys=keys)
    placed = pa.table({"id": rows.column("id").take(order), "place": first})
    return rows.take(order.take(placed.group_by("id").aggregate([("place", "min")]).column("place_min")))


def winning_changes(changes: DataFrame, buckets: int = STATE_BUCKETS) -> DataFrame:
    """The changes of a stream that win over all before them, at most one of an id in a batch.

    The state holds, per id, the change that won so far, see ``change_order``. A late or repeated change
    loses against it and goes no further; deletes stay in the state.
    """

    def settle(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else _HELD.empty_table()
        held = held.append_column("fresh", pa.array([False] * held.num_rows, pa.bool_()))
        for rows in batches:
            arrived = pa.table([pa.array(rows[f.name], f.type, from_pandas=True) for f in _HELD], schema=_HELD)
            arrived = arrived.append_column("fresh", pa.array([True] * len(rows), pa.bool_()))
            held = _winners(pa.concat_tables([held, arrived]).combine_chunks())
        won = held.filter(held.column("fresh")).select(_HELD.names).to_pydict()
        if won["id"]:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _HELD) as writer:
                writer.write_table(held.select(_HELD.names))
            state.update((sink.getvalue().to_pybytes(),))
            won["id"] = [None if i is None else int(i) for i in won["id"]]
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in won.items()})

    # ids as text, which pandas leaves as they are where one is null
    rows = changes.select(
        F.col("id").cast("long").cast("string").alias("id"), "text", F.col("version").cast("long").alias("version"), "op",
        F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(buckets)).alias("bucket"),
    )
    return rows.groupBy("bucket").applyInPandasWithState(settle, _CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout)


def start_sync(
    changes: DataFrame, log_path: str, checkpoint_path: str, model: Model, available_now: bool = True
) -> StreamingQuery:
    """Write the winning changes of each micro-batch, embedded, to ``log_path``.

    Only they are embedded: what is late dies in the keyed state. A batch goes to a folder named after
    its number and overwrites it, so a batch that runs again leaves one copy.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # read by the embedder more than once, which must not repeat the step through the state
        rows = materialize(batch, "winners")
        embed_changes(rows, model).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    writer = winning_changes(changes).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def index_state(spark: SparkSession, log_path: str, *later_paths: str) -> DataFrame:
    """For each id the change that holds over all batches of the logs, deletes included.

    Of the later logs only batches after the last one of ``log_path`` are read; other folders are
    skipped when files are listed for reading.
    """
    log = _log(spark, log_path)
    last = log.agg(F.max("batch")).first()[0]
    log = log.drop("batch")
    for path in later_paths:
        more = _log(spark, path)
        log = log.unionByName(more.filter(F.col("batch") > last).drop("batch"))
    return latest_changes(log)


def synced_index(spark: SparkSession, *log_paths: str) -> DataFrame:
    """The index ``(id, text, version, embedding, norm)`` as of the last finished batch."""
    return live_rows(index_state(spark, *log_paths))


def compact_log(spark: SparkSession, log_path: str, new_path: str) -> None:
    """Write the state as a log of one batch, to read in place of the batches it was made of.

    The batch has the number of the last one in it. Batches that the stream adds later are read
    together with it, those before are not: ``synced_index(spark, new, old)``.
    """
    last = _log(spark, log_path).agg(F.max("batch")).first()[0]
    state = latest_changes(_log(spark, log_path).filter(F.col("batch") <= last).drop("batch"))
    state.write.mode("errorifexists").parquet(f"{new_path}/batch={last}")
