"""Counts, roll-ups and rankings over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.graph import active, fact_lists, undirected
from kgspark.operators.recovery import saved


def graph_stats(entities: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(entities, "entities").crossJoin(count(active(facts), "facts")).crossJoin(count(edges, "relationships"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def top_connected(edges: DataFrame, n: int) -> DataFrame:
    degree = undirected(edges.select("a_id", "b_id")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return degree.orderBy(F.desc("degree"), "id").limit(n)


def notable(entities: DataFrame, facts: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    degree = undirected(edges.select("a_id", "b_id")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("connection_count"))
    known = active(facts).groupBy(F.col("source_entity_id").alias("id")).agg(F.count(F.lit(1)).alias("fact_count"))
    got = entities.join(degree, "id", "left").join(known, "id", "left").na.fill(0, ["connection_count", "fact_count"])
    return got.select("id", "canonical_name", "type", "topic", "connection_count", "fact_count").orderBy(F.desc("connection_count"), F.desc("fact_count"), "id").limit(n)


def _since(c: str, now: Column, days: int) -> Column:
    return F.unix_timestamp(c) > F.unix_timestamp(now) - days * 86400


def recently_active(entities: DataFrame, facts: DataFrame, now: Column, days: int, n: int) -> DataFrame:
    k = facts.where(_since("created_at", now, days)).groupBy(F.col("source_entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_facts"))
    return entities.select("id", "canonical_name").join(k, "id").orderBy(F.desc("n_facts"), "id").limit(n)


def recent_facts(entities: DataFrame, facts: DataFrame, now: Column, days: int, n: int) -> DataFrame:
    got = facts.where(_since("created_at", now, days)).join(entities.select(F.col("id").alias("source_entity_id"), F.col("canonical_name").alias("entity")), "source_entity_id")
    return got.orderBy(F.desc("created_at"), "id").limit(n).select("id", "entity", F.substring("content", 1, 100).alias("content"))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """model (null: all), tokens, cost; models without a price are left out."""
    got = usage.join(prices, "model")
    cost = (F.col("prompt_tokens") * F.col("input") + F.col("completion_tokens") * F.col("output")) / 1e6
    return got.rollup("model").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum(cost).alias("cost"))


def generic_tokens(names: DataFrame, least: int = 10) -> DataFrame:
    """token, n: tokens of the names of at least so many entities."""
    each = names.select("id", F.explode(F.split("name", r"\s+")).alias("token")).where("token <> ''").distinct()
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def joined_text(df: DataFrame, keys: list[str], order: list[str], col: str, sep: str = "\n", prefix: str = "") -> DataFrame:
    """One text per group: col's values in the given order."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(col).alias("_v"))))["_v"]
    agg = F.array_join(F.transform(items, lambda v: F.concat(F.lit(prefix), v)), sep).alias("text")
    return df.groupBy(*keys).agg(agg)


def assign_ids(new: DataFrame, existing: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """Dense ids after the largest existing one, in key order: counts per range partition, then numbers within it."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ranged = saved(new.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    before = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("i0")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    got = ranged.join(F.broadcast(before.select("_p", "before", "i0")), "_p").crossJoin(F.broadcast(top))
    return got.withColumn("id", F.col("top") + 1 + F.col("before") + F.col("_i") - F.col("i0")).drop("_p", "_i", "before", "i0", "top")


def hot_context(entities: DataFrame, facts: DataFrame, edges: DataFrame, hot: DataFrame, msg_limit: int = 10, slim: bool = False, n: int = 3) -> DataFrame:
    """hot (topic) -> its n most recent entities: rn, id, canonical_name, told (active facts newest first, or aliases if slim), evidence.

    evidence: the first msg_limit message ids of the entity's heaviest edges, 5 of them or 20 if slim.
    """
    top = saved(top_per_group(entities.join(hot.select("topic"), "topic", "left_semi"), ["topic"], [F.col("last_mentioned").desc_nulls_last(), "id"], n))
    near = undirected(edges).join(top.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "weight", "message_ids")
    strong = top_per_group(near, ["src"], [F.desc("weight"), "dst"], 20 if slim else 5, "k")
    ids = F.flatten(F.sort_array(F.collect_list(F.struct("k", "message_ids")))["message_ids"])
    proof = strong.groupBy(F.col("src").alias("id")).agg(F.slice(ids, 1, msg_limit).alias("evidence"))
    if slim:
        told = top.select("id", F.array_compact(F.array("alias1")).alias("told"))
    else:
        mine = facts.join(top.select(F.col("id").alias("source_entity_id")), "source_entity_id", "left_semi")
        told = fact_lists(mine).select(F.col("entity_id").alias("id"), F.col("facts").alias("told"))
    return top.join(told, "id", "left").join(proof, "id", "left").select("topic", "rn", "id", "canonical_name", "told", "evidence")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """df with each row's number in its group by order, ascending: rows are sorted in ranges, so a group of any size is many tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    keys = before.select(F.struct(*by).alias("_by"), F.col("_range").alias("_r"), "_before")
    rn = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order))
    got = ranged.withColumn("_rn", rn).join(keys, (F.col("_range") == F.col("_r")) & F.struct(*by).eqNullSafe(F.col("_by")))
    return got.withColumn(name, (F.col("_rn") + F.col("_before")).cast("int")).select(*df.columns, name)
