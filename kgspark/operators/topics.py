"""Topic settings: normalising, assignment, selection, edits and guards. The settings table is small by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROTECTED = ("General", "Identity")


def alias_table(topics: DataFrame) -> DataFrame:
    every = F.concat(F.array(F.lower("name")), F.transform(F.split("aliases", ","), lambda a: F.trim(F.lower(a))))
    return topics.where("active").select("name", F.explode(every).alias("key")).groupBy("key").agg(F.min("name").alias("canonical"))


def normalize_topic(df: DataFrame, topics: DataFrame, col: str = "topic") -> DataFrame:
    """Adds canonical: the topic an alias means, else General if that is active, else null."""
    general = topics.where("active and name = 'General'").select(F.lit("General").alias("_g"))
    got = df.join(alias_table(topics), F.lower(F.col(col)) == F.col("key"), "left").join(F.broadcast(general), F.lit(True), "left")
    return got.withColumn("canonical", F.coalesce("canonical", "_g")).drop("key", "_g")


def assign_topic(df: DataFrame, topics: DataFrame, col: str = "type") -> DataFrame:
    """Adds topic and candidates: the one topic of the label, General without any, ambiguous with several."""
    labels = topics.where("active").select("name", F.explode(F.split("labels", ",")).alias("label")).groupBy("label").agg(F.sort_array(F.collect_set("name")).alias("candidates"))
    got = df.join(labels, F.lower(F.col(col)) == F.col("label"), "left").drop("label")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return got.withColumn("assigned", F.when(n == 1, F.col("candidates")[0]).when(n > 1, "ambiguous").otherwise("General"))


def active_topics(topics: DataFrame) -> DataFrame:
    return topics.where(F.coalesce("active", F.lit(True)))


def hot_topics(topics: DataFrame) -> DataFrame:
    return active_topics(topics).where("hot")


def validate_hot(asked: DataFrame, topics: DataFrame) -> DataFrame:
    """asked (topic) -> topic, canonical, valid; each canonical topic once."""
    return normalize_topic(asked.select("topic").distinct(), topics).withColumn("valid", F.col("canonical").isNotNull())


def topic_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    o, n = old.select("name", F.col("active").alias("_o")), new.select("name", F.col("active").alias("_n"))
    both = o.join(n, "name", "full_outer")
    return both.select("name", F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") & ~F.col("_n"), "deactivated").when(~F.col("_o") & F.col("_n"), "activated").otherwise("unchanged").alias("change"))


#: The form of a label, and how long it may be.
LABEL, LABEL_LENGTH = "^[a-z][a-z0-9 _-]*$", 30


def guard_topics(old: DataFrame, new: DataFrame, cap: int = 3) -> DataFrame:
    """The new settings made safe: removed topics return as they were, protected ones keep their old entry, at most cap new ones.

    Labels are trimmed and lower-cased, and those of another form go. If more than half of the active topics would be
    deactivated the old settings are returned as they were.
    """
    o = old.select("name", F.coalesce("active", F.lit(True)).alias("o_active"), F.col("labels").alias("o_labels"))
    n = new.select("name", F.coalesce("active", F.lit(True)).alias("n_active"), F.col("labels").alias("n_labels"))
    both = o.join(n, "name", "full_outer").withColumn("is_new", F.col("o_active").isNull())
    as_was = ~F.col("is_new") & (F.col("n_active").isNull() | F.col("name").isin(*PROTECTED))
    both = both.select("name", "is_new", "o_active", "o_labels", F.when(as_was, F.col("o_active")).otherwise(F.col("n_active")).alias("active"), F.when(as_was, F.col("o_labels")).otherwise(F.col("n_labels")).alias("labels"))
    off = both.agg((F.count_if(F.col("o_active") & ~F.col("active")) * 2 > F.count_if("o_active")).alias("rejected"))
    both = both.withColumn("rn", F.row_number().over(W.partitionBy("is_new").orderBy("name"))).where(~F.col("is_new") | (F.col("rn") <= cap))
    words = F.transform(F.split(F.coalesce("labels", F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    clean = F.array_join(F.filter(words, lambda x: F.rlike(x, F.lit(LABEL)) & (F.length(x) <= LABEL_LENGTH)), ",")
    got = both.join(off, F.lit(True)).where(~(F.col("rejected") & F.col("is_new")))
    return got.select("name", F.when(F.col("rejected"), F.col("o_active")).otherwise(F.col("active")).alias("active"), F.when(F.col("rejected"), F.col("o_labels")).otherwise(clean).alias("labels"))


def edit_topics(topics: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: name, op (add, replace, toggle, remove), labels. Other topics are untouched."""
    e = edits.select("name", "op", F.col("labels").alias("e_labels"))
    got = topics.join(e, "name", "full_outer")
    there, op = F.col("active").isNotNull(), F.coalesce("op", F.lit(""))
    got = got.where(~((op == "remove") | ~there & op.isin("toggle", "")))
    return got.select("name", F.when(~there, True).when(op == "toggle", ~F.col("active")).otherwise(F.col("active")).alias("active"), F.when(~there | (op == "replace"), F.col("e_labels")).otherwise(F.col("labels")).alias("labels"))


def label_block(topics: DataFrame) -> DataFrame:
    """One text: a line per active topic with its labels."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.replace("labels", F.lit(","), F.lit(", ")))
    return active_topics(topics).where("name <> 'Identity'").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("block"))
