"""Facts on a name: by the name itself, by vectors near it, or by messages that match the question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import cosine
from kgspark.operators.graph import alias_names
from kgspark.operators.recovery import saved
from kgspark.operators.search import bm25
from kgspark.operators.vectors import vector_topk

OUT = ("qid", "resolution", "entity_id", "similarity", "evidence")


def fact_check(asked: DataFrame, entities: DataFrame, facts: DataFrame, messages: DataFrame, *, near: int = 5, floor: float = 0.69, many: int = 1000, cut: int = 500, hits: int = 8) -> DataFrame:
    """qid, resolution, entity_id, similarity, evidence (fact or message id) of asked (qid, name, vec, question, question_vec).

    Each branch takes what the one before has not resolved:
      exact: entities of that name or alias, with all their facts, old ones too;
      vector: the nearest entities (id, vec) of a cosine of floor or more, with their facts; where a name's entities have more than
        many facts together, each keeps the cut facts nearest to the question (a fact without a vector counts as 0; ties: the smaller id);
      fallback: the messages (id, text) that match the question best.
    An entity without facts has one row without evidence, and so has a question without any message.
    """
    a = saved(asked.select("qid", "name", "vec", "question", "question_vec"))
    mine = facts.select(F.col("source_entity_id").alias("entity_id"), F.col("id").alias("evidence"), F.col("vec").alias("_f"))
    named = alias_names(entities).select(F.col("id").alias("entity_id"), "name").distinct()
    exact = saved(a.select("qid", F.lower("name").alias("name")).join(named, "name").select("qid", "entity_id").distinct())
    by_name = exact.join(mine, "entity_id", "left").select("qid", F.lit("exact").alias("resolution"), "entity_id", F.lit(1.0).alias("similarity"), "evidence")

    rest = a.join(exact, "qid", "left_anti")
    found = saved(vector_topk(rest.select("qid", "vec"), entities.select("id", "vec"), near, floor).select("qid", F.col("id").alias("entity_id"), F.col("score").alias("similarity")))
    sizes = mine.join(found.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n"))
    full = found.join(sizes, "entity_id", "left").groupBy("qid").agg(F.sum("_n").alias("_all")).where(F.col("_all") > many).select("qid")
    told = found.join(mine, "entity_id", "left").select("qid", "entity_id", "similarity", "evidence", "_f")
    close = F.row_number().over(W.partitionBy("qid", "entity_id").orderBy(F.round("_c", 9).desc(), "evidence"))
    some = told.join(full, "qid", "left_semi").join(a.select("qid", "question_vec"), "qid").withColumn("_c", cosine(F.col("question_vec"), F.col("_f"))).withColumn("_r", close).where(F.col("_r") <= cut)
    by_vector = told.join(full, "qid", "left_anti").drop("_f").unionByName(some.select("qid", "entity_id", "similarity", "evidence")).withColumn("resolution", F.lit("vector")).select(*OUT)

    left = rest.join(found.select("qid").distinct(), "qid", "left_anti")
    matched = bm25(messages, left.select("qid", F.col("question").alias("text")), hits).select("qid", F.col("id").cast("string").alias("evidence"), F.col("score").alias("similarity"))
    by_message = left.select("qid").join(matched, "qid", "left").select("qid", F.lit("fallback").alias("resolution"), F.lit(None).cast("long").alias("entity_id"), "similarity", "evidence")
    return by_name.unionByName(by_vector).unionByName(by_message)
