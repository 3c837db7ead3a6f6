"""The partitioned store, and streams against their batch forms and plain loops."""

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from kgspark.operators import upsert
from kgspark.sources.store import SnapshotStore
from kgspark.streaming import stateful, streams

EDGE = "a_id long, b_id long, message_id string, confidence double, seen_at timestamp, context string"
STORE = "a_id long, b_id long, weight long, confidence double, last_seen timestamp, message_ids array<string>, context string"
PAIR = ["least(a_id, b_id)", "greatest(a_id, b_id)"]
DAY = datetime.datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_versions_and_labels(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.read("t") is None and store.read("t", label="x") is None
    store.write("t", spark.range(2))
    store.write("t", spark.range(5), label="grow")
    store.write("t", spark.range(9))
    assert [store.read("t", back=k).count() for k in range(3)] == [9, 5, 2] and store.read("t", back=3) is None
    assert store.read("t", label="grow").count() == 2 and store.labelled("t", "grow").count() == 5 and store.read("t", version=2).count() == 9
    store.vacuum("t", keep=1)
    assert store.versions("t") == [2] and rows(store.read("t"), "id") == [(i,) for i in range(9)]
    store.write("empty", spark.range(0))
    assert store.read("empty").count() == 0 and store.read("empty").columns == ["id"]


def test_a_batch_rewrites_the_partitions_it_hits(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), parts=64)
    base = spark.range(1000).select("id", F.lit("old").alias("v"))
    store.write("t", base, ["id"])
    new = base.where("id % 100 = 3").withColumn("v", F.lit("new")).unionByName(spark.createDataFrame([(5000, "new")], "id long, v string"))
    merged = lambda old, batch: upsert.upsert(old, batch, "id")
    assert store.merge("t", new, ["id"], merged, schema=base.schema)
    hit = {str(r[0]) for r in new.select(F.pmod(F.xxhash64("id"), F.lit(64))).distinct().collect()}
    assert store.touched("t", 1) == hit and len(hit) <= 11
    assert rows(store.read("t"), "id", "v") == sorted([(i, "new" if i % 100 == 3 else "old") for i in range(1000)] + [(5000, "new")])
    assert rows(store.read("t", back=1), "id", "v") == [(i, "old") for i in range(1000)]
    read = store._read(store.latest("t"), hit)
    assert 0 < read.count() < 400  # only these partitions' files
    with pytest.raises(ValueError):
        store.merge("t", new, ["id"], lambda old, batch: old.withColumn("id", F.col("id") + 1), schema=base.schema)


def test_epochs_of_streams(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    put = lambda ids, stream, epoch: store.merge("t", spark.createDataFrame([(i,) for i in ids], "id long"), ["id"], lambda old, new: old.unionByName(new), schema=spark.range(1).schema, stream=stream, epoch=epoch)
    assert put([1], "a", 0) and put([2], "b", 0) and put([3], "a", 1)
    assert not put([1], "a", 0) and not put([3], "a", 1) and not put([2], "b", 0)
    assert put([4], "b", 1) and rows(store.read("t"), "id") == [(1,), (2,), (3,), (4,)]


def test_two_writers(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), parts=4)
    gate, failed = threading.Barrier(2), []

    def put(i):
        def merged(old, new):
            if first[i]:
                first[i] = False
                gate.wait(60)  # both have read the same version
            return old.unionByName(new)

        try:
            store.merge("t", spark.createDataFrame([(i,)], "id long"), ["id"], merged, schema=spark.range(1).schema)
        except Exception as e:  # noqa: BLE001  shown by the assertion
            failed.append(e)

    first = {1: True, 2: True}
    threads = [threading.Thread(target=put, args=(i,)) for i in first]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert not failed and rows(store.read("t"), "id") == [(1,), (2,)] and store.versions("t") == [0, 1]


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(query):
    query.trigger(availableNow=True).start().awaitTermination(180)


def test_foreach_batch_write_equals_batch_upsert(spark, tmp_path):
    data = spark.createDataFrame([(1 + i % 2, 5, f"m{i % 5}", 0.1 * i, None, "c") for i in range(12)], EDGE)
    for part in range(3):
        data.where(f"cast(confidence * 10 as int) % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store, none = SnapshotStore(spark, str(tmp_path / "store")), spark.createDataFrame([], STORE)
    write = streams.graph_writer(store, "edges", PAIR, upsert.upsert_edges, none.schema, "one")
    for _ in range(2):  # the second run finds nothing new
        run(stream_of(spark, str(tmp_path / "in"), EDGE).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")))
    want = upsert.upsert_edges(none, data)
    assert rows(store.read("edges"), "a_id", "b_id", "weight", "message_ids") == rows(want, "a_id", "b_id", "weight", "message_ids")
    # Another stream starts its epochs anew, and none of its batches is lost.
    more = spark.createDataFrame([(7 + i, 19, f"x{i}", 0.5, None, None) for i in range(3)], EDGE)
    for i in range(3):
        more.where(f"a_id = {7 + i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
    write = streams.graph_writer(store, "edges", PAIR, upsert.upsert_edges, none.schema, "two")
    run(stream_of(spark, str(tmp_path / "in2"), EDGE).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c2")))
    assert rows(store.read("edges").where("b_id = 19"), "weight") == [(1,)] * 3


MESSAGES = "session_id long, id long, ts timestamp"


def messages(spark, triples):
    return spark.createDataFrame([(s, i, DAY + datetime.timedelta(seconds=t)) for s, i, t in triples], MESSAGES)


def appended(spark, where, *parts):
    for part in parts:
        messages(spark, part).coalesce(1).write.mode("append").parquet(where)


def test_batch_numbers_go_on_after_a_timeout(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go():
        q = stateful.batch_stream(stream_of(spark, source, MESSAGES), 4, 1)
        stateful.run_all(q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")), spark, idle=False)

    appended(spark, source, [(1, i, i) for i in range(6)], [(2, 100, 0)])
    go()
    assert (1, 0, [0, 1, 2, 3], "full") in rows(spark.read.parquet(out), "session_id", "batch", "ids", "reason")
    import time

    time.sleep(1.5)
    appended(spark, source, [(3, 200, 0)])
    go()  # restarts from the checkpoint; the held rows have waited long enough
    got = rows(spark.read.parquet(out).where("reason = 'timeout'"), "session_id", "batch", "ids")
    assert (1, 1, [4, 5]) in got and (2, 0, [100]) in got
    time.sleep(1.5)
    appended(spark, source, [(1, 10 + i, 20 + i) for i in range(4)])
    go()
    assert (1, 2, [10, 11, 12, 13], "full") in rows(spark.read.parquet(out), "session_id", "batch", "ids", "reason")
    keys = rows(spark.read.parquet(out), "session_id", "batch")
    assert len(keys) == len(set(keys))


def test_the_counter_keeps_its_state(spark, tmp_path):
    for ids in (range(5), range(5, 12)):
        appended(spark, str(tmp_path / "in"), [(1, i, i) for i in ids])
        run(stateful.checkpoint_stream(stream_of(spark, str(tmp_path / "in"), MESSAGES), 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "count") == [(3, 4), (7, 8), (11, 12)]


def test_triggers_equal_the_loop(spark, tmp_path):
    rnd, triples, t = random.Random(4), [], 0
    for k in range(300):
        t += rnd.choice((1, 2, 5, 120))
        triples.append((rnd.randrange(3), rnd.randrange(9), t))
    want, held = [], {}
    for s, entity, at in triples:
        mine = held.setdefault(s, {})
        if mine and at - max(mine.values()) >= 90:
            want.append((s, len(mine), "quiet"))
            mine.clear()
        mine[entity] = at
        if len(mine) >= 4:
            want.append((s, 4, "many"))
            mine.clear()
    want += [(s, len(m), "quiet") for s, m in held.items() if m and t - max(m.values()) >= 90]
    data = messages(spark, triples).withColumnRenamed("id", "entity_id")
    got = stateful.run_out(stateful.refine_stream(stateful.replayed(data, str(tmp_path / "in"), slices=4), 4, 90), str(tmp_path))
    assert rows(got, "session_id", "n", "reason") == sorted(want)


def test_a_replayed_table_comes_in_order(spark, tmp_path):
    triples = [(i % 3, i, (i * 7) % 50) for i in range(50)]
    got = stateful.run_out(stateful.checkpoint_stream(stateful.replayed(messages(spark, triples), str(tmp_path / "in")), 5), str(tmp_path))
    assert rows(got, "session_id", "id") == rows(streams.checkpoint_events(messages(spark, triples), 5), "session_id", "id")


def test_counters_of_many_sessions_share_a_call(spark, tmp_path, monkeypatch):
    """Over several micro-batches, with sessions of large, negative and missing ids."""
    monkeypatch.setattr(stateful, "COUNTERS", 3)
    pick = random.Random(6)
    said = [(pick.choice([None, 0, -5, 2**62 + 1, 2**62 + 2, *range(20, 40)]), i, DAY + datetime.timedelta(seconds=i // 2)) for i in range(400)]
    df = spark.createDataFrame(said, "session_id long, id long, ts timestamp")
    stream = stateful.checkpoint_stream(stateful.replayed(df, str(tmp_path / "in")), 4)
    assert "_group" in stream._jdf.queryExecution().analyzed().toString()
    count, want = {}, []
    for session, i, _ in said:
        count[session] = count.get(session, 0) + 1
        if count[session] % 4 == 0:
            want.append((session, i, count[session]))
    got = [tuple(r) for r in stateful.run_out(stream, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
