"""Sequential rules ("take the first, skip what it rules out, go on") as fixpoints that give the same rows.

Rounds decide many items at once: an item is decided as soon as everything
ahead of it that could rule it out is.  Long chains would need a round each, so
after ROUNDS the connected parts of what is open are told apart; a part of at
most PART rows is decided by the plain loop in one task, larger ones go on.
There is no limit to the number of rounds: each decides some item.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.recovery import saved

ROUNDS, PART = 4, 50_000
#: Rows of small groups that are decided in one task, about.
DEALT = 10_000


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (of one type). node, part: every node with the smallest node of its connected part (large-star and small-star rounds)."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before, after = None, mark(now)
    while before != after:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.u", "e.v").where("u <> v").distinct())
        before, after = after, mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("part"))).distinct()


def _small_parts(rows: DataFrame, key: str, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of parts with at most PART rows, with part; the other rows). key: a node column of rows."""
    dealt = saved(rows.join(components(edges).withColumnRenamed("node", key), key))
    small = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= PART).select("part")
    return dealt.join(small, "part", "left_semi"), dealt.join(small, "part", "left_anti").drop("part")


def kept_items(rules: DataFrame) -> DataFrame:
    """rules: by, id, by_rank, id_rank (by comes first and, if it is kept, rules out id). id of the items ruled out.

    Equal to going through the items by rank and keeping each that no kept one rules out.
    """
    kind = rules.schema["id"].dataType.simpleString()

    def loop(pdf: pd.DataFrame) -> pd.DataFrame:
        out: set = set()
        for by, item in pdf.sort_values(["by_rank", "id_rank"])[["by", "id"]].itertuples(index=False):
            if by not in out:  # all rules on `by` come from items before it, which were gone through already
                out.add(item)
        return pd.DataFrame({"id": pd.Series(list(out), dtype=object)})

    gone, open_ = None, saved(rules)
    while True:
        for _ in range(ROUNDS):
            if open_.isEmpty():
                return rules.select("id").where("false") if gone is None else gone.distinct()
            sure = open_.select(F.col("by").alias("x")).distinct().join(open_.select(F.col("id").alias("x")), "x", "left_anti")  # nothing undecided rules them out
            now = saved(open_.join(sure.withColumnRenamed("x", "by"), "by", "left_semi").select("id").distinct())
            gone = now if gone is None else gone.unionByName(now)
            open_ = saved(open_.join(now, "id", "left_anti").join(now.withColumnRenamed("id", "by"), "by", "left_anti").select(*rules.columns))
        small, large = _small_parts(open_, "id", open_.select(F.col("by").alias("a"), F.col("id").alias("b")))
        gone = gone.unionByName(saved(small.groupBy("part").applyInPandas(loop, f"id {kind}")))
        open_ = saved(large)


def disjoint(pairs: DataFrame, a: str, b: str, rank: str, within: str | None = None) -> DataFrame:
    """The pairs that the loop by rank keeps when each id of a and b may be used once. Ranks are distinct.

    within: a column of groups that have no id in common. Those of at most PART rows are decided at once, many in one task.
    """
    kind = pairs.schema[a].dataType.simpleString()

    def loop(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for x, y in pdf.sort_values("place")[["x", "y"]].itertuples(index=False):
            if x not in used and y not in used:
                used |= {x, y}
                out.append((x, y))
        return pd.DataFrame(out, columns=["x", "y"])

    def looped(rows: DataFrame, part: str) -> DataFrame:
        placed = rows.withColumn("place", F.row_number().over(W.partitionBy(part).orderBy(rank))).select(part, F.col(a).alias("x"), F.col(b).alias("y"), "place")
        return saved(placed.groupBy(part).applyInPandas(loop, f"x {kind}, y {kind}").select(F.col("x").alias(a), F.col("y").alias(b)))

    pairs = saved(pairs)  # by which they are chosen, and which are given back
    kept, rest = None, pairs.where(F.col(a) != F.col(b))
    if within is None:
        rest = saved(rest)
    else:
        small = saved(rest.groupBy(within).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") <= PART))
        tasks = 1 + (small.agg(F.sum("_k")).first()[0] or 0) // DEALT
        kept = looped(rest.join(small, within, "left_semi").withColumn("_part", F.pmod(F.xxhash64(within), F.lit(tasks))), "_part")
        rest = saved(rest.join(small, within, "left_anti").select(*pairs.columns))
    while True:
        for _ in range(ROUNDS):
            if rest.isEmpty():
                return pairs.where("false") if kept is None else pairs.join(kept.distinct(), [a, b], "left_semi").dropDuplicates([a, b]).select(*pairs.columns)
            best = rest.select(F.explode(F.array(a, b)).alias("x"), rank).groupBy("x").agg(F.min(rank).alias("least"))
            at = lambda c: best.select(F.col("x").alias(c), F.col("least").alias(f"_{c}"))  # noqa: B023, E731
            now = saved(rest.join(at(a), a).join(at(b), b).where((F.col(rank) == F.col(f"_{a}")) & (F.col(rank) == F.col(f"_{b}"))).select(a, b))
            kept = now if kept is None else kept.unionByName(now)
            used = now.select(F.explode(F.array(a, b)).alias("x"))
            rest = saved(rest.join(used.withColumnRenamed("x", a), a, "left_anti").join(used.withColumnRenamed("x", b), b, "left_anti").select(*pairs.columns))
        small, large = _small_parts(rest, a, rest.select(F.col(a).alias("a"), F.col(b).alias("b")))
        kept = kept.unionByName(looped(small, "part"))
        rest = saved(large.select(*pairs.columns))
