"""Streams run to their end over the given tables, and writes through the partitioned store."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import upsert
from kgspark.operators.recovery import folder, saved
from kgspark.plans.registry import query
from kgspark.plans.write_queries import A8, EV, M, ORACLE_D22, edge_out, merges, undone, user_events
from kgspark.sources.store import SnapshotStore
from kgspark.streaming import stateful, streams

PAIR = ["least(a_id, b_id)", "greatest(a_id, b_id)"]


@query("a8_upsert_edges", A8)
def a8(t):
    """Through the store: the batch rewrites the partitions that its pairs fall into."""
    old = t.related_to.where("(a_id + b_id) % 2 = 0")
    rows = t.edge_rows.unionByName(t.edge_rows.withColumns({"message_id": F.concat("message_id", F.lit("n")), "confidence": F.lit(0.99)}))
    store = SnapshotStore(t.spark, folder(t.spark), parts=8)
    store.write("edges", old, PAIR)
    store.merge("edges", rows, PAIR, upsert.upsert_edges, schema=old.schema)
    return edge_out(store.read("edges"))


@query("a8_upsert_small_batch", """
WITH b AS (SELECT * FROM kg_edge_rows WHERE b_id % 100 = 7), n AS (SELECT a_id, b_id, max(confidence) AS confidence, array_agg(DISTINCT message_id || 'n') AS message_ids FROM b GROUP BY a_id, b_id)
SELECT o.a_id, o.b_id, CAST(o.weight + coalesce(len(n.message_ids), 0) AS BIGINT) AS weight, round(greatest(o.confidence, n.confidence), 6) AS confidence, array_to_string(list_sort(list_concat(o.message_ids, coalesce(n.message_ids, []))), ',') AS evidence
FROM kg_related_to o LEFT JOIN n ON n.a_id = o.a_id AND n.b_id = o.b_id""")
def a8_small(t):
    """A batch of about one key in a hundred."""
    store = SnapshotStore(t.spark, folder(t.spark), parts=32)
    store.write("edges", t.related_to, PAIR)
    store.merge("edges", t.edge_rows.where("b_id % 100 = 7").withColumn("message_id", F.concat("message_id", F.lit("n"))), PAIR, upsert.upsert_edges, schema=t.related_to.schema)
    return edge_out(store.read("edges"))


@query("s6_stored_messages", "SELECT id, CASE WHEN turn % 2 = 0 THEN 'edited' ELSE content END AS content FROM kg_messages UNION ALL SELECT id + 500000000, content FROM kg_messages WHERE turn = 0")
def s6(t):
    m = t.messages.select("id", "content", "turn")
    new = m.where("turn % 2 = 0").select("id", F.lit("edited").alias("content"), "turn").unionByName(m.where("turn = 0").withColumn("id", F.col("id") + 500000000))
    store = SnapshotStore(t.spark, folder(t.spark), parts=8)
    store.write("messages", m, ["id"])
    store.merge("messages", new, ["id"], lambda old, batch: upsert.upsert(old, upsert.newest_by_key(batch, ["id"], [F.desc("turn")]), "id"), schema=m.schema)
    return store.read("messages").select("id", "content")


@query("t3_streamed_edges", "SELECT a_id, b_id, weight, round(confidence, 6) AS confidence, array_to_string(message_ids, ',') AS evidence FROM kg_related_to")
def t3(t):
    """Two streams of edge rows merged into one stored table, epoch by epoch."""
    store, where = SnapshotStore(t.spark, folder(t.spark), parts=8), folder(t.spark)
    rows = t.edge_rows.withColumn("ts", F.col("seen_at"))
    for name, part in (("even", "a_id % 2 = 0"), ("odd", "a_id % 2 = 1")):
        write = streams.graph_writer(store, "edges", PAIR, upsert.upsert_edges, t.related_to.select("a_id", "b_id", "weight", "confidence", "last_seen", "message_ids", "context").schema, name)
        stream = stateful.replayed(rows.where(part), f"{where}/{name}", "a_id")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/{name}_state").trigger(availableNow=True).start().awaitTermination()
    return edge_out(store.read("edges"))


def streamed(t, events=None):
    return stateful.replayed(user_events(t) if events is None else events, folder(t.spark))


@query("t2_streamed_batches", f"SELECT id, CAST((rn - 1) // 8 AS BIGINT) AS batch FROM (SELECT *, count(*) OVER (PARTITION BY session_id, (rn - 1) // 8) AS k FROM {EV}) WHERE k = 8")
def t2(t):
    """The full batches; what is left waits for the timeout."""
    got = stateful.run_out(stateful.batch_stream(streamed(t)), folder(t.spark), idle=False)
    return got.where("reason = 'full'").select(F.explode("ids").alias("id"), "batch")


@query("t7_streamed_checkpoints", f"SELECT session_id, id, CAST(rn AS BIGINT) AS count FROM {EV} WHERE rn % 24 = 0")
def t7(t):
    return stateful.run_out(stateful.checkpoint_stream(streamed(t)), folder(t.spark))


@query("t8_streamed_heartbeats", f"SELECT session_id, id, CAST(rn AS BIGINT) AS count FROM {EV} WHERE rn % 40 = 0 AND rn % 8 = 0")
def t8(t):
    return stateful.run_out(stateful.heartbeat_stream(streamed(t)), folder(t.spark))


@query("t9_streamed_triggers")
def t9(t):
    """When the dirty entities of a session are due, by number or after six quiet hours."""
    dirty = t.events.select((F.col("user_id") % 40).alias("session_id"), F.concat("event_type", F.col("user_id").cast("string")).alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"))
    return stateful.run_out(stateful.refine_stream(streamed(t, dirty), 5, 6 * 3600), folder(t.spark))


@query("t10_streamed_sessions", f"""
WITH l AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut, id FROM {EV}), g AS (SELECT *, sum(cut) OVER (PARTITION BY session_id ORDER BY ts, id) AS g FROM l)
SELECT session_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM g GROUP BY session_id, g HAVING max(ts) + INTERVAL 7 HOUR <= (SELECT max(ts) FROM events)""")
def t10(t):
    """The sessions that ended before the watermark, an hour behind the newest event."""
    got = streams.activity_sessions(streamed(t).withWatermark("ts", "1 hour"), "6 hours")
    return stateful.run_out(got, folder(t.spark)).select("session_id", F.unix_timestamp("start").alias("start"), "n")


LATE = f"SELECT 'edge' AS kind, '99-' || primary_id AS key, CAST(1 AS BIGINT) AS v FROM {M} UNION ALL SELECT 'fact', 'late' || primary_id, primary_id FROM {M}"


@query("d22_undo_stored", f"{ORACLE_D22} UNION ALL {LATE}")
def d22(t):
    """A merge, two later writes and the undo, all in the store; what was written later stays."""
    p = saved(merges(t).withColumn("new_id", F.col("secondary_id") + 90000000))
    keys = {"entities": ["id"], "facts": ["id"], "edges": PAIR, "part_of": ["child_id"]}
    facts = t.facts.withColumn("source_entity_id", F.when(F.col("vec_id") % 2 == 0, 1000 + F.col("vec_id") % 40).otherwise(F.col("source_entity_id"))).select("id", "source_entity_id")
    first = {"entities": t.entities.select("id", "canonical_name"), "facts": facts, "edges": t.related_to, "part_of": t.part_of}
    store = SnapshotStore(t.spark, folder(t.spark), parts=8)
    for name, df in first.items():
        store.write(name, df, keys[name])
    old = {n: store.read(n) for n in first}
    merged = {"entities": old["entities"].join(p.select(F.col("secondary_id").alias("id")), "id", "left_anti"), "facts": upsert.merge_facts(old["facts"], p), "edges": upsert.merge_edges(old["edges"], p), "part_of": upsert.merge_part_of(old["part_of"], p)}
    for name, df in merged.items():
        store.write(name, df.select(*old[name].columns), keys[name], label="merge")
    late = p.select(F.lit(99).cast("long").alias("a_id"), F.col("primary_id").alias("b_id"), F.lit("late").alias("message_id"), F.lit(0.5).alias("confidence"), F.lit(None).cast("timestamp").alias("seen_at"), F.lit(None).cast("string").alias("context"))
    store.merge("edges", late, PAIR, upsert.upsert_few_edges, schema=store.read("edges").schema)
    told = p.select(F.concat(F.lit("late"), F.col("primary_id").cast("string")).alias("id"), F.col("primary_id").alias("source_entity_id"))
    store.merge("facts", told, keys["facts"], lambda have, new: upsert.upsert(have, new, "id"), schema=facts.schema)
    return undone(upsert.undo_stored(store, "merge", p))
