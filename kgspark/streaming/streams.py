"""Streams of messages: deduplication, batching, counters, windows and failure routing, with their batch forms."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.scalars import msg_hash

#: Parts of error texts, whatever their case, that make an error one to retry.
TRANSIENT = (
    "ConnectionError", "TimeoutError", "socket.timeout", "Connection refused", "ECONNRESET", "Service Unavailable", "Bad Gateway", "Gateway Timeout", "rate limit", "Too Many Requests", "BusyLoadingError",
    "overloaded", "serialization error", "conflicting transactions", "Cannot get shared access", "Cannot get unique access", "Cannot get read only access", "Storage access timeout", "access timeout", "TransientError",
)


def dedup_stream(messages: DataFrame, ttl: str = "300 seconds") -> DataFrame:
    """Of equal messages (session, content, time) one within the ttl."""
    keyed = messages.withColumn("hash", msg_hash(F.col("session_id"), F.col("content"), F.unix_timestamp("ts")))
    return keyed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["hash"])


def dedup_batch(messages: DataFrame) -> DataFrame:
    return messages.withColumn("hash", msg_hash(F.col("session_id"), F.col("content"), F.unix_timestamp("ts"))).dropDuplicates(["hash"])


def micro_batches(messages: DataFrame, size: int = 8) -> DataFrame:
    """Adds batch: messages of a session in time order, so many a batch."""
    rn = F.row_number().over(W.partitionBy("session_id").orderBy("ts", "id"))
    return messages.withColumn("batch", F.ceil(rn / size))


def graph_writer(store, table: str, key: list[str], merged: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType, stream: str):
    """For foreachBatch: merges a batch into the partitions of a stored table that it touches, once for each epoch of the stream."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # read for its partitions, and again for the merge
        store.merge(table, batch, key, merged, schema=schema, stream=stream, epoch=epoch)
        batch.unpersist()

    return write


def route_failures(rows: DataFrame, bad: Column, stage: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters with stage, error, attempt and payload)."""
    letters = rows.where(bad).select(F.lit(stage).alias("stage"), F.lit("invalid row").alias("error"), F.lit(0).alias("attempt"), F.to_json(F.struct(*rows.columns)).alias("payload"))
    return rows.where(~bad), letters


def plan_replay(dlq: DataFrame, most: int = 2) -> DataFrame:
    """Adds action (retry, or park with a reason) and next_attempt: transient errors are retried until the attempts are used up."""
    error = F.lower(F.coalesce("error", F.lit("")))
    transient = functools.reduce(operator.or_, [F.contains(error, F.lit(t.lower())) for t in TRANSIENT])
    reason = F.when(F.get_json_object("payload", "$").isNull(), "corrupt").when(~transient, "fatal").when(F.col("attempt") >= most, "exhausted")
    got = dlq.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "retry").otherwise("park"))
    return got.withColumn("next_attempt", F.when(F.col("action") == "retry", F.col("attempt") + 1))


def stop_after(results: DataFrame, n: int = 5, key: str = "stage") -> DataFrame:
    """results (key, id, ok) up to and with the n-th failure in a row per key."""
    w = W.partitionBy(key).orderBy("id")
    run = results.withColumn("_g", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("_k", F.count_if(~F.col("ok")).over(W.partitionBy(key, "_g").orderBy("id").rowsBetween(W.unboundedPreceding, 0)))
    stop = F.max(F.when(~F.col("ok") & (F.col("_k") >= n), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    return run.withColumn("_s", F.coalesce(stop, F.lit(0))).where("_s = 0").drop("_g", "_k", "_s")


def revalidate(batches: DataFrame, entities: DataFrame) -> DataFrame:
    """batches (id, entity_ids) with only live ids, sorted."""
    each = batches.select("id", F.explode("entity_ids").alias("e"))
    live = each.join(entities.select(F.col("id").alias("e")), "e", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("e")).alias("entity_ids"))
    return batches.select("id").join(live, "id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<bigint>")))


def checkpoint_events(messages: DataFrame, n: int = 24) -> DataFrame:
    """The messages that complete a group of n in their session."""
    rn = F.row_number().over(W.partitionBy("session_id").orderBy("ts", "id"))
    return messages.withColumn("rn", rn).where(F.col("rn") % n == 0)


def heartbeats(messages: DataFrame, n: int = 40, size: int = 8) -> DataFrame:
    """Every n-th message of a session at which no partial batch is pending."""
    return checkpoint_events(messages, n).where(F.col("rn") % size == 0)


def activity_sessions(events: DataFrame, gap: str = "90 seconds", key: str = "session_id") -> DataFrame:
    got = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def refine_due(dirty: DataFrame, now: Column, many: int = 15, quiet_s: int = 90) -> DataFrame:
    """dirty (session_id, entity_id, ts) -> sessions due: many dirty entities, or any and quiet long enough."""
    got = dirty.groupBy("session_id").agg(F.count_distinct("entity_id").alias("n"), (F.unix_timestamp(now) - F.unix_timestamp(F.max("ts"))).alias("quiet_s"))
    return got.withColumn("due", (F.col("n") >= many) | (F.col("quiet_s") >= quiet_s))


def event_log(events: DataFrame, verbose: bool = False) -> DataFrame:
    got = events.select("ts", "session_id", "component", "event", "data", "verbose_only")
    return got if verbose else got.where("not verbose_only")
