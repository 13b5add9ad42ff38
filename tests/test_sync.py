"""Batch and streaming index sync."""

import itertools
import math

import pytest

from basketry.operators import index
from basketry.session import materialize
from basketry.sources import schemas, sinks
from basketry.streaming import index_sync

CHANGES = [
    (1, "toaster", 1, "upsert"),
    (2, "kettle", 1, "upsert"),
    (1, "toaster oven", 2, "upsert"),
    (2, None, 2, "delete"),
]


def model():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def changes(spark, rows):
    return spark.createDataFrame(rows, schemas.CATALOGUE_CHANGES)


def live(df):
    return sorted((r.id, r.text, r.version) for r in index.live_rows(df).collect())


def test_any_order_gives_the_same_rows(spark):
    for order in itertools.permutations(CHANGES):
        assert live(index.latest_changes(changes(spark, list(order)))) == [(1, "toaster oven", 2)]


def test_late_changes_do_no_harm(spark):
    extra = [*CHANGES, (3, "b", 4, "upsert"), (3, "a", 4, "upsert"), (4, "x", 1, "upsert"), (4, None, 1, "delete")]
    expected = [(1, "toaster oven", 2), (3, "b", 4)]
    for seed in range(4):
        rows = extra[seed:] + extra[:seed]
        state = index.embed_changes(index.latest_changes(changes(spark, rows[:1])), model)
        for i in range(1, len(rows), 3):
            state = materialize(index.sync_index(state, changes(spark, rows[i : i + 3]), model), "state")
        assert live(state) == expected
        norms = {r.id: r.norm for r in index.live_rows(state).collect()}
        assert norms[1] == pytest.approx(math.hypot(12, 1))


def test_stream_in_two_runs_and_a_repeated_batch(spark, tmp_path):
    table, log, progress = (str(tmp_path / n) for n in ("changes", "log", "progress"))

    def run():
        stream = index_sync.change_stream(spark, table, schemas.CATALOGUE_CHANGES)
        index_sync.start_sync(stream, log, progress, model).awaitTermination()

    sinks.append_changes(changes(spark, CHANGES[2:]), table)
    run()
    assert live(index_sync.index_state(spark, log)) == [(1, "toaster oven", 2)]
    sinks.append_changes(changes(spark, [*CHANGES[:2], (5, "lamp", 1, "upsert")]), table)
    run()
    expected = [(1, "toaster oven", 2), (5, "lamp", 1)]
    assert live(index_sync.index_state(spark, log)) == expected
    batch = index.live_rows(index.latest_changes(spark.read.parquet(table)))
    assert sorted((r.id, r.text, r.version) for r in batch.collect()) == expected
    # all again, as if the progress had been lost: the log takes the same batches once more
    progress = str(tmp_path / "progress2")
    run()
    assert live(index_sync.index_state(spark, log)) == expected
    synced = index_sync.synced_index(spark, log)
    assert synced.columns == ["id", "text", "version", "embedding", "norm"] and synced.count() == 2
    asked = spark.createDataFrame([(0, "lamp")], "query_id int, text string")
    assert index.search_text_with_model(asked, synced, 1, model).first().text == "lamp"


def test_compacted_log(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    for batch, part in enumerate((CHANGES[:2], CHANGES[2:3])):
        index.embed_changes(changes(spark, part), model).write.parquet(f"{old}/batch={batch}")
    index_sync.compact_log(spark, old, new)
    assert [p.name for p in (tmp_path / "new").glob("batch=*")] == ["batch=1"]
    # the stream goes on in the old log
    index.embed_changes(changes(spark, CHANGES[3:]), model).write.parquet(f"{old}/batch=2")
    state = index_sync.index_state(spark, new, old)
    assert live(state) == live(index_sync.index_state(spark, old)) == [(1, "toaster oven", 2)]
    # of the old log only the later batch is read
    text = state._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in text and "> 1)" in text


def test_snapshot_diff_turns_old_into_new(spark):
    from basketry.operators.changes import snapshot_changes

    old = {1: "a", 2: "b", 3: None, 4: "d", 5: ""}
    new = {1: "a", 2: "B", 3: None, 5: None, 6: "f", 7: None}
    frames = [spark.createDataFrame([(i, t, "x") for i, t in s.items()], "id long, text string, op string") for s in (old, new)]
    diff = snapshot_changes(*frames, version=9)
    got = {(r.id, r.text, r.version, r.op) for r in diff.collect()}
    assert got == {(2, "B", 9, "upsert"), (4, None, 9, "delete"), (5, None, 9, "upsert"), (6, "f", 9, "upsert"), (7, None, 9, "upsert")}
    assert snapshot_changes(frames[1], frames[1], version=1).count() == 0
    applied = dict(old)
    for i, text, _, op in got:
        applied.pop(i, None) if op == "delete" else applied.update({i: text})
    assert applied == new


def test_merge_rewrites_only_the_buckets_of_changes(spark, tmp_path):
    import glob
    import os

    path = str(tmp_path / "state")
    rows = [(i, f"text {i}", 1, "upsert") for i in range(200)]
    index.write_state(index.embed_changes(changes(spark, rows), model), path, 16)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    before = files()
    late = [(3, "new text", 2, "upsert"), (3, "old text", 0, "upsert"), (5, None, 2, "delete"), (3, "new text", 2, "upsert")]
    touched = index.merge_changes(spark, path, changes(spark, late), model, 16)
    assert 1 <= touched <= 2
    after = files()
    kept = {f for f in before if f in after and before[f] == after[f]}
    assert {os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in kept} == {os.path.dirname(f) for f in set(after) - set(before)}
    assert len({os.path.dirname(f) for f in kept}) == 16 - touched
    want = [(i, f"text {i}", 1) for i in range(200) if i not in (3, 5)] + [(3, "new text", 2)]
    assert live(index.read_state(spark, path).drop("bucket")) == sorted(want)
    assert index.merge_changes(spark, path, changes(spark, late).filter("false"), model, 16) == 0
    assert files() == after


def test_late_changes_die_in_the_keyed_state(spark, tmp_path):
    table, log, progress = (str(tmp_path / n) for n in ("changes", "log", "progress"))

    def run(rows):
        sinks.append_changes(changes(spark, rows), table)
        stream = index_sync.change_stream(spark, table, schemas.CATALOGUE_CHANGES)
        index_sync.start_sync(stream, log, progress, model).awaitTermination()

    first = [(1, "a", 5, "upsert"), (2, "b", 3, "upsert"), (2, "bb", 3, "upsert"), (3, None, 4, "delete"), (4, None, 2, "upsert")]
    late = [(1, "old", 4, "upsert"), (1, "a", 5, "upsert"), (2, None, 3, "delete"), (3, "x", 1, "upsert"), (5, "new", 1, "upsert"), (5, "newer", 2, "upsert")]
    run(first)
    run(late)
    written = spark.read.parquet(f"{log}/batch=*")
    assert sorted((r.id, r.version, r.op) for r in written.collect()) == [
        (1, 5, "upsert"), (2, 3, "delete"), (2, 3, "upsert"), (3, 4, "delete"), (4, 2, "upsert"), (5, 2, "upsert"),
    ]
    batch = index.latest_changes(changes(spark, first + late))
    assert live(index_sync.index_state(spark, log)) == live(batch) == [(1, "a", 5), (5, "newer", 2)]


def test_many_ids_share_a_state(spark, tmp_path, monkeypatch):
    """the function of the state is called per bucket of ids, not per id, and keeps every id apart."""
    table, log, progress = (str(tmp_path / n) for n in ("changes", "log", "progress"))
    parts = [[(i * 7 % 300, f"text {i * 11 % 13}", i * step % 17, "delete" if i % 5 == 0 else "upsert") for i in range(900)] for step in (1, 5)]
    parts[1] += [(2**60 + 1, "far", 1, "upsert"), (None, "no id", 1, "upsert")]
    calls = []

    def run(rows):
        sinks.append_changes(changes(spark, rows), table)
        stream = index_sync.change_stream(spark, table, schemas.CATALOGUE_CHANGES)
        query = index_sync.start_sync(stream, log, progress, model)
        query.awaitTermination()
        calls.append(sum(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"][:1] if p["numInputRows"]))

    monkeypatch.setattr(index_sync.winning_changes, "__defaults__", (8,))
    for part in parts:
        run(part)
    assert max(calls) <= 8
    want = index.latest_changes(changes(spark, parts[0] + parts[1])).collect()
    got = index_sync.index_state(spark, log).select("id", "text", "version", "op").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, (tuple(r) for r in want)))
    written = spark.read.option("basePath", log).parquet(f"{log}/batch=*").groupBy("batch", "id").count()
    assert written.filter("count > 1").count() == 0
