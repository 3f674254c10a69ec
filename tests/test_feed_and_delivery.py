"""The feed as a source of its own, and delivery as a stateful processor, each with a restart in the middle."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from quillspark.sources.delta import DeltaFeed, DeltaReader, Expired
from quillspark.streaming import delivery

CLIENT = "quillspark.sources.delta:FolderClient"


def page(root, drive, generation, n, rows):
    folder = root / drive / str(generation)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{n:05d}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_feed_stream_with_expiry_after_several_batches(spark, tmp_path):
    root = tmp_path / "feed"
    page(root, "d1", 0, 0, [{"item_id": "a", "name": "a.txt"}, {"item_id": "b", "name": "b.txt"}])
    page(root, "d1", 0, 1, [{"item_id": "a", "name": "a2.txt"}])
    page(root, "d2", 0, 0, [{"item_id": "x", "is_deleted": True}])
    spark.dataSource.register(DeltaFeed)
    seen = []

    def run():
        stream = spark.readStream.format("delta_feed").option("client", CLIENT).option("path", str(root)).load()
        q = stream.writeStream.foreachBatch(lambda df, epoch: seen.append(sorted((r.drive_id, r.generation, r.full_walk, r.arrival, r.item_id, r.name, r.is_deleted) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(90)
        out = [r for batch in seen for r in batch]
        seen.clear()
        return out

    assert run() == [("d1", 0, True, 0, "a", "a.txt", False), ("d1", 0, True, 1, "b", "b.txt", False), ("d1", 0, True, 2, "a", "a2.txt", False), ("d2", 0, True, 0, "x", None, True)]
    page(root, "d1", 0, 2, [{"item_id": "c", "name": "c.txt"}])
    assert run() == [("d1", 0, False, 0, "c", "c.txt", False)]  # only what is behind the token, and no other drive
    assert run() == []
    page(root, "d1", 1, 0, [{"item_id": "a", "name": "a2.txt"}, {"item_id": "d", "name": "d.txt"}])  # old tokens are void
    page(root, "d2", 0, 1, [{"item_id": "y", "name": "y.txt"}])
    assert run() == [("d1", 1, True, 0, "a", "a2.txt", False), ("d1", 1, True, 1, "d", "d.txt", False), ("d2", 0, False, 0, "y", "y.txt", False)]
    page(root, "d1", 1, 1, [{"item_id": "e", "name": "e.txt"}])
    assert run() == [("d1", 1, False, 0, "e", "e.txt", False)]


def test_a_token_that_expires_between_planning_and_reading(tmp_path):
    root = tmp_path / "feed"
    page(root, "d", 0, 0, [{"item_id": "a"}])
    reader = DeltaReader({"client": CLIENT, "path": str(root)})
    start = reader.latestOffset()
    page(root, "d", 0, 1, [{"item_id": "b"}])
    (planned,) = reader.partitions(start, reader.latestOffset())
    assert [r[1] for r in reader.read(planned)] == ["b"]
    page(root, "d", 3, 0, [{"item_id": "a"}, {"item_id": "c"}])
    with pytest.raises(Expired):
        reader.client.page("d", "0:1")
    assert [(r[1], r[-3], r[-2]) for r in reader.read(planned)] == [("a", 3, True), ("c", 3, True)]
    shutil.rmtree(root)


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(delivery.PROVIDER[0])
    spark.conf.set(*delivery.PROVIDER)
    yield spark
    spark.conf.set(delivery.PROVIDER[0], before)


def test_redelivery_survives_a_restart(rocks, tmp_path):
    spark, src = rocks, tmp_path / "in"
    src.mkdir()
    put = lambda n, rows: (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("key", "id", "outcome"), r))) for r in rows))
    got = []

    def start():
        stream = spark.readStream.schema("key string, id string, outcome string").json(str(src))
        out = delivery.deliver(stream, delivery.Delivery(base_s=6.0, attempts=3))
        keep = lambda df, epoch: got.extend((r.key, r.attempt, r.action) for r in df.collect())
        return out.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def until(n):
        q, end = start(), time.time() + 90
        try:
            while time.time() < end and len(got) < n and q.isActive:
                time.sleep(0.2)
            assert q.exception() is None, q.exception()
        finally:
            q.stop()

    put(0, [("a", "1", "transient"), ("b", "1", "permanent"), ("c", "1", "ok"), ("a", "1", "transient")])
    until(3)
    assert sorted(got) == [("a", 1, "retry"), ("b", 1, "dead"), ("c", 1, "done")]  # an outcome that comes twice counts once
    until(4)  # stopped while waiting: the timer is in the checkpoint
    assert got[3:] == [("a", 2, "redeliver")]
    put(1, [("a", "2", "transient"), ("b", "9", "transient"), ("a", "3", "transient")])
    until(6)
    assert got[4:6] == [("a", 2, "retry"), ("a", 3, "dead")]  # b is settled for as long as its time to live


def test_silence_by_event_time_with_a_restart(rocks, tmp_path):
    spark, beats = rocks, tmp_path / "in"
    beats.mkdir()
    got = []

    def put(n, rows):
        (beats / f"{n}.json").write_text("\n".join(json.dumps({"worker": w, "at": t}) for w, t in rows))
        os.utime(beats / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))

    def run():
        stream = spark.readStream.schema("worker string, at timestamp").option("maxFilesPerTrigger", 1).json(str(beats))
        keep = lambda df, epoch: got.extend((r.worker, r.last_ms) for r in df.collect())
        q = delivery.silent(stream).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(90)

    put(0, [("w1", "2024-01-01 00:00:00"), ("w2", "2024-01-01 00:00:10")])
    run()
    assert got == []
    put(1, [("w2", "2024-01-01 00:02:30")])  # the stream's time goes on behind a restart
    put(2, [("w2", "2024-01-01 00:02:31")])
    run()
    assert [w for w, _ in got] == ["w1"]
    assert spark.range(1).select(F.timestamp_millis(F.lit(got[0][1])).cast("string")).first()[0] == "2024-01-01 00:00:00"
