"""Scans, filters and listings of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.graph import alias_names, fact_lists, visible

STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "by", "for", "with", "from", "is", "was", "be", "it", "as", "that", "this")
PRONOUNS = ("i", "me", "my", "you", "your", "he", "him", "his", "she", "her", "we", "us", "our", "they", "them", "their", "it", "its")


def entities_by_ids(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return entities.join(ids.select("id"), "id", "left_semi").withColumn("last_mentioned", F.unix_timestamp("last_mentioned"))


def entities_by_names(entities: DataFrame, facts: DataFrame, names: DataFrame) -> DataFrame:
    """Entities with a name or alias equal to one given, whatever the case, and their active facts."""
    hit = alias_names(entities).join(names.select(F.lower("name").alias("name")).distinct(), "name").select("id").distinct()
    return entities.join(hit, "id").join(fact_lists(facts).withColumnRenamed("entity_id", "id"), "id", "left")


def live_ids(ids: DataFrame, entities: DataFrame, live: bool = True) -> DataFrame:
    return ids.join(entities.select("id"), "id", "left_semi" if live else "left_anti")


def list_entities(entities: DataFrame, type: str | None = None, topic: str | None = None, search: str | None = None) -> DataFrame:
    got = entities
    if type is not None:
        got = got.where(F.col("type") == type)
    if topic is not None:
        got = got.where(F.col("topic") == topic)
    if search is not None:
        got = got.where(F.contains(F.lower("canonical_name"), F.lit(search.lower())))
    return got


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def fact_summary(facts: DataFrame, n: int = 2) -> DataFrame:
    """entity_id, summary: the first n active facts joined by '. ', null without any."""
    first = F.slice(F.sort_array(F.collect_list(F.struct("created_at", "id", "content"))), 1, n)["content"]
    return facts.where("invalid_at is null").groupBy(F.col("source_entity_id").alias("entity_id")).agg(F.array_join(first, ". ").alias("summary"))


def valid_mention(name: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    low = F.lower(name)
    return F.length(name).between(2, 100) & ~low.isin(*stop_words, *PRONOUNS) & F.rlike(name, F.lit(r"\p{L}"))


def valid_mentions(mentions: DataFrame, generic: DataFrame | None = None, topics: DataFrame | None = None, stop_words: DataFrame | None = None) -> DataFrame:
    """mentions (name, label, and topic if topics are given) that may become entities.

    generic: phrase, generic; a generic phrase needs a label other than none or general.  topics: key (lower-cased names and
    aliases of active topics); a topic other than General must be one of them.  stop_words: word, in place of STOP_WORDS, of any
    number, case and language; nulls and repeated words change nothing.
    """
    if stop_words is None:
        got = mentions.where(valid_mention(F.col("name")))
    else:
        stopped = stop_words.select(F.lower("word").alias("_s")).where("_s is not null").distinct()
        got = mentions.where(valid_mention(F.col("name"), ())).join(stopped, F.lower("name") == F.col("_s"), "left_anti")
    if generic is not None:
        dull = generic.where("generic").select(F.lower("phrase").alias("_g")).distinct()
        vague = F.lower(F.coalesce("label", F.lit(""))).isin("", "general")
        got = got.join(dull, vague & (F.lower("name") == F.col("_g")), "left_anti")
    if topics is not None:
        keys = topics.select(F.col("key").alias("_k")).distinct().withColumn("_known", F.lit(True))
        free = F.coalesce("topic", F.lit("")).isin("", "General")
        got = got.join(keys, F.lower("topic") == F.col("_k"), "left").where(free | F.col("_known")).drop("_k", "_known")
    return got


def refinement_plan(dirty: DataFrame, mentions: DataFrame, failed: DataFrame, now: Column, targeted: bool = False, again_s: int = 60) -> DataFrame:
    """dirty (id, checkpoint, refined_at) -> id, status: clear without new turns, keep dirty after a failed invalidation, else checkpoint.

    In targeted mode entities refined less than again_s seconds ago are skipped.
    """
    n = new_turns(dirty, mentions).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    got = dirty.join(n, "id", "left").join(failed.select("id").distinct().withColumn("_failed", F.lit(True)), "id", "left")
    recent = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("refined_at") < again_s, F.lit(False)) & F.lit(targeted)
    return got.select("id", F.when(recent, "skip").when(F.col("k").isNull(), "clear").when(F.col("_failed"), "keep dirty").otherwise("checkpoint").alias("status"))


def word_frequencies(texts: DataFrame, col: str = "text") -> DataFrame:
    """word, freq: share of all words of the corpus."""
    words = texts.select(F.explode(F.split(F.lower(col), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = words.agg(F.sum("n").alias("total"))
    return words.crossJoin(F.broadcast(total)).select("word", (F.col("n") / F.col("total")).alias("freq"))


def generic_phrases(phrases: DataFrame, freq: DataFrame, rare: float = 5e-6, common: float = 5e-4) -> DataFrame:
    """phrase, generic: several words, none of them rare, together more frequent than common."""
    words = phrases.select("phrase").distinct().select("phrase", F.explode(F.split(F.lower("phrase"), r"\s+")).alias("word"))
    got = words.join(freq, "word", "left").groupBy("phrase").agg(F.count(F.lit(1)).alias("k"), F.min(F.coalesce("freq", F.lit(0.0))).alias("least"), F.sum(F.coalesce("freq", F.lit(0.0))).alias("total"))
    return got.select("phrase", ((F.col("k") > 1) & (F.col("least") >= rare) & (F.col("total") > common)).alias("generic"))


def uncovered(cands: DataFrame, covered: DataFrame) -> DataFrame:
    """cands (msg_id, name) that neither contain nor lie in a covered text of their message, at word boundaries."""
    pad = lambda c: F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    other = covered.select(F.col("msg_id").alias("_m"), pad("name").alias("_n"))
    mine = pad(cands["name"])
    return cands.join(other, (cands["msg_id"] == other["_m"]) & (F.contains(mine, other["_n"]) | F.contains(other["_n"], mine)), "left_anti")


def new_turns(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """mentions (entity_id, msg_id) later than the entity's checkpoint."""
    e = entities.select(F.col("id").alias("entity_id"), F.coalesce("checkpoint", F.lit(0)).alias("_c"))
    return mentions.join(e, "entity_id").where(F.col("msg_id") > F.col("_c")).drop("_c")


def last_turns(turns: DataFrame, n: int, up_to: Column | None = None) -> DataFrame:
    """The last n turns of every session (before the given message), in order."""
    got = turns if up_to is None else turns.where(F.col("turn_id") < up_to)
    rn = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn_id")))
    return got.withColumn("rn", rn).where(F.col("rn") <= n).drop("rn")


def topic_visible(df: DataFrame, topics: list[str] | None) -> DataFrame:
    return df.where(visible(F.col("topic"), topics))
