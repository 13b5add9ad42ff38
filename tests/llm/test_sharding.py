import zlib

from basketry.llm import queries, sharding


def check(rows, shards, docs):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, zlib.crc32((t or "").encode())) for i, t in docs
    )
    assert all(0 <= r.shard < shards for r in rows)
    total, biggest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(shards):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= 2 * biggest


def test_query(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.QUERIES["op9_sharding"](spark, base).collect()
    check(rows, 24, docs)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert {r.doc_id: r.size for r in rows} == {i: len(t.encode()) + 8 for i, t in docs}


def test_hot_group_is_cut(spark, docs_frame):
    rows = [(i, "hot text" if i % 3 else f"text {i}") for i in range(3000)]
    placed = sharding.shard_documents(docs_frame(rows), 6).collect()
    check(placed, 6, rows)
    hot = zlib.crc32(b"hot text")
    assert len({r.shard for r in placed if r.text_crc32 == hot}) >= 4  # two thirds of all bytes
    again = sharding.shard_documents(docs_frame(rows).repartition(7), 6).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in placed} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_copies_stay_together(spark, docs_frame):
    rows = [(i, f"text {i // 4}") for i in range(4000)]
    placed = sharding.shard_documents(docs_frame(rows), 8).collect()
    shards = {}
    for r in placed:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7  # only at borders


def test_odd_rows(spark, odd):
    rows = sharding.shard_documents(odd, 3).collect()
    check(rows, 3, odd.select("doc_id", "text").collect())


def test_no_rows(spark, odd):
    empty = sharding.shard_documents(odd.limit(0), 3)
    assert empty.count() == 0 and {"shard", "slot"} <= set(empty.columns)


def test_written_shards(spark, docs_frame, tmp_path):
    docs = docs_frame([(i, f"text {i}" * (i % 7)) for i in range(200)])
    placed = sharding.shard_documents(docs, 4)
    sharding.write_shards(docs.select("doc_id", "text"), placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}


def test_a_hot_key_is_dealt_to_parts(spark, docs_frame):
    """Half of all rows are one and the same: they are spread over many parts and still neighbours."""
    from pyspark.sql import functions as F

    rows = [(None, "the same words", "en", "a")] * 3000 + [(i, f"text number {i}", "en", "a") for i in range(3000)]
    placed = sharding.shard_documents(docs_frame(rows), 8).collect()
    assert len(placed) == 6000
    size = {}
    for r in placed:
        size.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in placed)
    for shard, own in size.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= 2 * max(r.size for r in placed)
    hot = sorted({r.shard for r in placed if r.doc_id is None})
    assert hot == list(range(hot[0], hot[-1] + 1)) and len(hot) >= 4
    keyed = docs_frame(rows).select(F.lit(1).alias("_range"), F.lit(7).alias("k"), F.lit(10).alias("s"), F.monotonically_increasing_id().alias("_id"))
    parts = sharding._with_parts(keyed, "k", "s", 1000.0).groupBy("_part").count().collect()
    assert len(parts) == 60 and max(r["count"] for r in parts) < 200
