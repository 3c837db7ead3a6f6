"""Discussions: opening, messages, closing, spawns, listings and retention.

discussions: id, status, opened_at, closed_at; messages: id, discussion_id, ts, content; spawns: parent_id, child_id, detail, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.graph import ancestry


def open_discussions(discussions: DataFrame, new: DataFrame) -> DataFrame:
    """new: id, opened_at. Known ids stay as they are."""
    fresh = new.join(discussions.select("id"), "id", "left_anti").select("id", F.lit("open").alias("status"), "opened_at", F.lit(None).cast("timestamp").alias("closed_at"))
    return discussions.select(*fresh.columns).unionByName(fresh)


def append_messages(messages: DataFrame, new: DataFrame, discussions: DataFrame) -> DataFrame:
    """Messages of open discussions are added; those whose id is known, or whose discussion is closed or unknown, are not."""
    live = discussions.where("status = 'open'").select(F.col("id").alias("discussion_id"))
    fine = new.join(live, "discussion_id", "left_semi").join(messages.select("id"), "id", "left_anti")
    return messages.unionByName(fine.select(*messages.columns))


def close(discussions: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Open ones of these ids become closed now."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    shut = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "open")
    got = discussions.join(hit, "id", "left").withColumn("_shut", shut)
    return got.withColumns({"status": F.when(F.col("_shut"), "closed").otherwise(F.col("status")), "closed_at": F.when(F.col("_shut"), now).otherwise(F.col("closed_at"))}).select(*discussions.columns)


def record_spawns(spawns: DataFrame, new: DataFrame) -> DataFrame:
    """A child is spawned once: its first record stays."""
    both = spawns.unionByName(new.select(*spawns.columns))
    rn = F.row_number().over(W.partitionBy("child_id").orderBy("ts", "parent_id"))
    return both.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def spawn_tree(spawns: DataFrame) -> DataFrame:
    """spawns with depth: the number of spawns from a root."""
    depth = ancestry(spawns.select("child_id", "parent_id"), spawns.select(F.col("child_id").alias("id"))).select(F.col("id").alias("child_id"), (F.size("chain") - 1).alias("depth"))
    return spawns.join(depth, "child_id")


def listing(discussions: DataFrame, messages: DataFrame) -> DataFrame:
    """Every discussion with its number of messages and time of the last one."""
    last = messages.groupBy(F.col("discussion_id").alias("id")).agg(F.count(F.lit(1)).alias("n_messages"), F.max("ts").alias("last_at"))
    return discussions.join(last, "id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def transcript(messages: DataFrame) -> DataFrame:
    """Messages with their place in time within the discussion."""
    return messages.withColumn("place", F.row_number().over(W.partitionBy("discussion_id").orderBy("ts", "id")))


def insights(facts: DataFrame, n: int) -> DataFrame:
    """The newest n facts that discussions produced (source 'llm')."""
    return facts.where("source = 'llm'").orderBy(F.desc("created_at"), "id").limit(n)


def expire(discussions: DataFrame, messages: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(discussions opened at most so many days ago, their messages)."""
    kept = discussions.where(F.unix_timestamp("opened_at") >= F.unix_timestamp(now) - days * 86400)
    return kept, messages.join(kept.select(F.col("id").alias("discussion_id")), "discussion_id", "left_semi")
