"""State store, listings and the stream."""

import json
from datetime import datetime, timedelta

import pytest

from tessera.sources.gallery import gallery_listing, photos
from tessera.sources.sinks import EmbeddingCache, delivered
from tessera.sources.state_store import Conflict, StateStore
from tessera.streaming.ingest import MARKS, distinct_marks, marks_per_hour, merge_into


def test_state_store_swaps_versions(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    assert store.current() is None and store.read("a int").count() == 0
    store.write(spark.createDataFrame([(1,)], "a int"))
    first = store.current()
    old = store.read("a int")
    store.write(old.union(spark.createDataFrame([(2,)], "a int")))
    assert store.current() != first and sorted(r.a for r in store.read("a int").collect()) == [1, 2]


def test_state_store_loses_no_update_of_two_writers(spark, tmp_path):
    one, two = StateStore(spark, str(tmp_path / "state")), StateStore(spark, str(tmp_path / "state"))
    n = one.number()
    one.write(spark.createDataFrame([(1,)], "a int"), after=n)
    with pytest.raises(Conflict):
        two.write(spark.createDataFrame([(2,)], "a int"), after=n)
    seen = []

    def late(old):  # somebody else commits while this one computes, once
        if not seen:
            one.update("a int", lambda o: o.union(spark.createDataFrame([(3,)], "a int")))
        seen.append(1)
        return old.union(spark.createDataFrame([(2,)], "a int"))

    two.update("a int", late)
    assert sorted(r.a for r in one.read("a int").collect()) == [1, 2, 3] and len(seen) == 2


def test_embedding_cache(spark, tmp_path):
    cache = EmbeddingCache(StateStore(spark, str(tmp_path / "cache")))
    cache.put(spark.createDataFrame([("k1", [1.0]), ("k1", [1.0]), ("k2", [2.0]), (None, [9.0]), ("k3", None)], "cache_key string, embedding array<float>"))
    cache.put(spark.createDataFrame([("k1", [7.0]), ("k3", [3.0])], "cache_key string, embedding array<float>"))
    assert {r.cache_key: r.embedding for r in cache.read().collect()} == {"k1": [1.0], "k2": [2.0], "k3": [3.0]}
    cache.clear()
    assert cache.read().count() == 0


def test_delivery_tries_again_and_tells_the_kind(spark):
    def send(row):
        if row["name"] == "gone":
            raise ConnectionError
        return {"good": (200, ""), "noface": (400, "No face found"), "busy": (503, "later")}[row["name"]]

    rows = spark.createDataFrame([(1, "good"), (2, "noface"), (3, "busy"), (4, "gone")], "id int, name string")
    got = {r.id: (r.ok, r.kind, r.status, r.tries) for r in delivered(rows, "id", send).collect()}
    assert got == {1: (True, "ok", 200, 1), 2: (False, "permanent", 400, 3), 3: (False, "transient", 503, 3), 4: (False, "network", None, 3)}


def test_photos_fall_back_to_previews(spark):
    kind = "origin string, height int, width int, n_channels int, data binary"
    originals = spark.createDataFrame([("file:/o/a.jpg", 2, 2, 1, b"big!")], kind)
    previews = spark.createDataFrame([("file:/p/a.jpg", 1, 1, 1, b"s"), ("file:/p/b.jpg", 1, 1, 1, b"t")], kind)
    wanted = spark.createDataFrame([("x", "a.jpg"), ("y", "b.jpg"), ("z", "c.jpg")], "asset_id string, file_name string")
    got = {r.asset_id: (r.source, None if r.data is None else bytes(r.data)) for r in photos(wanted, originals, previews).collect()}
    assert got == {"x": (0, b"big!"), "y": (1, b"t"), "z": (None, None)}


def test_gallery_listing(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"Ann": ["a_1.webp", "a_2.webp"], "train": ["x"], "Bob": 3, "Cy": "text"}))
    (tmp_path / "bad.json").write_text("[1, 2]")
    assert {(r.person, r.file_name) for r in gallery_listing(spark, str(tmp_path)).collect()} == {("Ann", "a_1.webp"), ("Ann", "a_2.webp")}


def test_stream_folds_marks_and_replays_change_nothing(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("p", "a", 1, 0.5, t), ("p", "a", 1, 0.5, t), ("p", "a", 2, None, t + timedelta(hours=2)), ("q", "b", 3, 0.1, t + timedelta(hours=3))]
    src = tmp_path / "in"
    df = spark.createDataFrame(rows, "person string, asset_id string, seq bigint, score double, recorded_ts timestamp")
    df.write.parquet(str(src))
    store = StateStore(spark, str(tmp_path / "state"))
    for run in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(src))
        q = distinct_marks(stream).writeStream.foreachBatch(merge_into(store)).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted((r.person, r.asset_id, r.score, r.first_seq, r.last_seq) for r in store.read(MARKS).collect())
        assert got == [("p", "a", 0.5, 1, 2), ("q", "b", 0.1, 3, 3)]
    hours = marks_per_hour(spark.readStream.schema(df.schema).parquet(str(src)))
    q = hours.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("hours").collect()) == 4
