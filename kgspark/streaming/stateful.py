"""Streams with state of their own: batches by count or timeout, counters, and triggers by volume or quiet.

State is a few numbers a session, or what one open batch holds; it travels with
the rows in Arrow batches.  Rows of a micro-batch are taken in order of (ts, id).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Groups of sessions whose counters are kept together.
COUNTERS = 1024


def in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(["ts", "id"], kind="stable")


def batch_stream(messages: DataFrame, size: int = 8, timeout_s: int = 300) -> DataFrame:
    """session_id, batch (from 0), ids, reason of messages (session_id, id, ts): a full batch at once, a partial one when its
    session has been quiet for the timeout. Numbers go on after a timeout, so (session_id, batch) is a key."""

    def step(key, parts, state: GroupState):
        held, n = state.get if state.exists else ([], 0)
        held, out = list(held), []
        if state.hasTimedOut:
            out.append((key[0], n, held, "timeout"))
            held, n = [], n + 1
        else:
            held += in_order(parts)["id"].tolist()
            while len(held) >= size:
                out.append((key[0], n, held[:size], "full"))
                held, n = held[size:], n + 1
        state.update((held, n))
        if held:
            state.setTimeoutDuration(timeout_s * 1000)
        yield pd.DataFrame(out, columns=["session_id", "batch", "ids", "reason"])

    schema = "session_id long, batch long, ids array<long>, reason string"
    return messages.select("session_id", "id", "ts").groupBy("session_id").applyInPandasWithState(step, schema, "ids array<long>, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def checkpoint_stream(messages: DataFrame, n: int = 24, step: int = 1) -> DataFrame:
    """session_id, id, count of the messages that complete a group of n in their session, if their number is a multiple of step too."""

    def count(key, parts, state: GroupState):
        rows = in_order(parts)
        seen = pd.Series(*reversed(state.get)) if state.exists else pd.Series(dtype="int64")
        of = rows.groupby("session_id", sort=False)
        number = of.cumcount() + 1 + rows["session_id"].map(seen).fillna(0).astype("int64")
        new = seen.add(of.size(), fill_value=0).astype("int64")
        state.update((new.index.astype("int64").tolist(), new.tolist()))
        hit = (number % n == 0) & (number % step == 0)
        session = rows["session_id"][hit]
        yield pd.DataFrame({"session_id": session if key[0] >= 0 else pd.Series([None] * len(session), dtype=object, index=session.index), "id": rows["id"][hit], "count": number[hit]})

    # A group is many sessions, so the calls do not grow with them; those without an id are one session, in a group of its own.
    group = F.when(F.col("session_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("session_id"), F.lit(COUNTERS))).cast("int").alias("_group")
    rows = messages.select(group, F.coalesce("session_id", F.lit(0)).cast("long").alias("session_id"), "id", "ts")
    return rows.groupBy("_group").applyInPandasWithState(count, "session_id long, id long, count long", "sessions array<long>, n array<long>", "append", GroupStateTimeout.NoTimeout)


def heartbeat_stream(messages: DataFrame, n: int = 40, size: int = 8) -> DataFrame:
    """Every n-th message of a session at which no partial batch of the size is pending."""
    return checkpoint_stream(messages, n, size)


def refine_stream(dirty: DataFrame, many: int = 15, quiet_s: int = 90, delay: str = "0 seconds") -> DataFrame:
    """session_id, n, reason (many or quiet): when the dirty entities (session_id, entity_id, ts) of a session are due, which
    empties them: there are many of them, or none has changed for a while of event time."""

    def step(key, parts, state: GroupState):
        out, held = [], dict(zip(*state.get)) if state.exists else {}
        if state.hasTimedOut:
            out.append((key[0], len(held), "quiet"))
            held = {}
        else:
            for entity, ts in in_order(parts)[["id", "ts"]].itertuples(index=False):
                ms = ts.value // 1_000_000
                if held and ms - max(held.values()) >= quiet_s * 1000:
                    out.append((key[0], len(held), "quiet"))
                    held = {}
                held[entity] = ms
                if len(held) >= many:
                    out.append((key[0], len(held), "many"))
                    held = {}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max(max(held.values()) + quiet_s * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "n", "reason"])

    rows = dirty.select("session_id", F.col("entity_id").cast("string").alias("id"), "ts").withWatermark("ts", delay)
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id long, n long, reason string", "ids array<string>, ts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def replayed(df: DataFrame, where: str, key: str = "session_id", slices: int = 2) -> DataFrame:
    """df as a stream in order of ts: written to a folder in so many slices of time, one after the other, and read back in that order.

    A key's rows of a slice share a file, so they are in order however files are dealt to micro-batches.
    """
    spark = df.sparkSession
    edges = df.agg(*[F.percentile_approx("ts", i / slices).alias(f"q{i}") for i in range(1, slices)]).first() if slices > 1 else []
    bounds = [None, *sorted({x for x in edges if x is not None}), None]
    for low, high in zip(bounds, bounds[1:]):
        part = df if low is None else df.where(F.col("ts") > F.lit(low))
        part = part if high is None else part.where(F.coalesce(F.col("ts") <= F.lit(high), F.lit(low is None)))
        part.repartition(key).write.mode("append").parquet(where)
    files = len(spark.read.schema(df.schema).parquet(where).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // slices)).parquet(where)


def run_all(writer, spark: SparkSession, idle: bool = True) -> None:
    """Runs a stream to the end of the rows there are now. Without idle no batch runs without rows: a stream that waits for
    processing time would run such batches for ever, and its timeouts come with the next rows as well."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(idle).lower())
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


def run_out(stream: DataFrame, where: str, idle: bool = True) -> DataFrame:
    """What a stream of the rows there are now has written, in a folder of its own."""
    out = f"{where}/{uuid.uuid4().hex}"
    run_all(stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state"), stream.sparkSession, idle)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")
