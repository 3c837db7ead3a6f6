"""Messages around hits, evidence, windows of turns and their trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.greedy import kept_items


def hydrate(refs: DataFrame, hot: DataFrame, archive: DataFrame) -> DataFrame:
    """refs (key, message_ids) -> key, message_id, content: the hot store first, then the archive; unknown ids are dropped."""
    each = refs.select("key", F.explode("message_ids").alias("message_id"))
    got = each.join(hot.select("message_id", F.col("content").alias("_h")), "message_id", "left").join(archive.select("message_id", F.col("content").alias("_a")), "message_id", "left")
    return got.select("key", "message_id", F.coalesce("_h", "_a").alias("content")).where("content is not null")


def facts_with_source(facts: DataFrame, messages: DataFrame) -> DataFrame:
    return facts.join(messages.select(F.col("id").alias("source_msg_id"), F.col("content").alias("source_text")), "source_msg_id", "left")


def surrounding(messages: DataFrame, hits: DataFrame, forward: int = 3, total: int = 10, scope: str = "session") -> DataFrame:
    """hit_id, id, ts, is_hit: messages around each hit, up to total - forward - 1 before it and forward after it."""
    keys = ["session_id"] if scope == "session" else []
    placed = messages.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("ts", "id")))
    h = placed.join(hits.select(F.col("hit_id").alias("id")), "id", "left_semi").select(F.col("id").alias("hit_id"), F.col("rn").alias("h_rn"), *[F.col(k).alias(f"h_{k}") for k in keys])
    span = F.explode(F.sequence(F.col("h_rn") - (total - forward - 1), F.col("h_rn") + forward)).alias("rn")
    wanted = h.select("hit_id", span, *[F.col(f"h_{k}").alias(k) for k in keys])
    return wanted.join(placed.select("id", "ts", "rn", *keys), ["rn", *keys]).select("hit_id", "id", "ts", (F.col("id") == F.col("hit_id")).alias("is_hit"))


def fresh_hits(context: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (hit_id, rank) that no kept hit of better rank already shows in its context."""
    shown = context.where("not is_hit").select(F.col("hit_id").alias("by"), F.col("id"))
    ranked = shown.join(hits.select(F.col("hit_id").alias("id"), F.col("rank").alias("id_rank")), "id").join(hits.select(F.col("hit_id").alias("by"), F.col("rank").alias("by_rank")), "by")
    return hits.join(kept_items(ranked.where("by_rank < id_rank")).withColumnRenamed("id", "hit_id"), "hit_id", "left_anti")


def balanced_window(turns: DataFrame, n: int, ratio: float = 0.75) -> DataFrame:
    """The last n turns per session with at most ratio of them the user's; the rest the newest assistant turns."""
    quota = int(n * ratio)
    rn = F.row_number().over(W.partitionBy("session_id", "role").orderBy(F.desc("ts"), F.desc("turn_id")))
    ranked = turns.where(F.col("role").isin("user", "assistant")).withColumn("rn", rn)
    users = F.least(F.count_if(F.col("role") == "user").over(W.partitionBy("session_id")), F.lit(quota))
    got = ranked.withColumn("users", users)
    return got.where(F.when(F.col("role") == "user", F.col("rn") <= quota).otherwise(F.col("rn") <= n - F.col("users"))).drop("rn", "users")


def turns_before(turns: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """targets (session_id, msg_id) -> the n turns strictly before the message's; none for a message after the log head."""
    # A turn of equal time is not before the message: places are counted up to the first turn of its time.
    by_time = W.partitionBy("session_id").orderBy("ts", "turn_id")
    placed = turns.withColumn("pos", F.row_number().over(by_time)).withColumn("first", F.min("pos").over(W.partitionBy("session_id", "ts")))
    at = placed.where("user_msg_id is not null").select("session_id", F.col("user_msg_id").alias("msg_id"), "first")
    t = targets.join(at, ["session_id", "msg_id"]).select("session_id", "msg_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rn"), "first")
    wanted = t.select("session_id", "msg_id", "rn", (F.col("first") - F.col("rn")).alias("pos"))
    return wanted.join(placed.select("session_id", "pos", "turn_id"), ["session_id", "pos"]).select("session_id", "msg_id", "turn_id", "rn")


def trim_history(turns: DataFrame, n: int = 10_000) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn_id")))
    return turns.withColumn("rn", rn).where(F.col("rn") <= n).drop("rn")


def accumulate(*results: DataFrame, cap: int = 30) -> DataFrame:
    """key, score, content of several searches: the first of a key wins, then the best by score (null: 0.5)."""
    union = None
    for i, r in enumerate(results):
        r = r.select("key", "score", "content", F.lit(i).alias("_i"))
        union = r if union is None else union.unionByName(r)
    first = union.groupBy("key").agg(F.min_by(F.struct("score", "content"), F.struct("_i", F.coalesce("score", F.lit(0.5)))).alias("v"))
    return first.select("key", F.coalesce("v.score", F.lit(0.5)).alias("score"), "v.content").orderBy(F.desc("score"), "key").limit(cap)


def transcript(turns: DataFrame, keys: list[str]) -> DataFrame:
    """One text per group: [ROLE]: content lines in time order."""
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.col("content"))
    rows = F.sort_array(F.collect_list(F.struct("ts", "turn_id", line.alias("line"))))
    return turns.groupBy(*keys).agg(F.array_join(rows["line"], "\n").alias("transcript"))


def idle(events: DataFrame, now, threshold: int) -> DataFrame:
    """session_id, idle_s, is_idle."""
    last = events.groupBy("session_id").agg(F.max("ts").alias("last"))
    return last.select("session_id", (F.unix_timestamp(now) - F.unix_timestamp("last")).alias("idle_s")).withColumn("is_idle", F.col("idle_s") >= threshold)
