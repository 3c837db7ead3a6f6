"""Keyed upserts, merges, deletions and their undo, each as a function from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.graph import PROTECTED, alias_names, undirected
from kgspark.operators.greedy import disjoint
from kgspark.operators.recovery import broadcast_few, saved


def newest_by_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of batch replace those of the same key; others are added. The batch's keys are distinct."""
    return store.join(batch.select(key), key, "left_anti").unionByName(batch)


def update_columns(store: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Non-null values of updates overwrite; other columns and rows stay."""
    cols = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return store.join(u, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in store.columns])


def edge_batch(rows: DataFrame) -> DataFrame:
    """Edge rows (a_id, b_id, message_id, confidence, seen_at, context) added up per unordered pair."""
    pair = rows.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "message_id", "confidence", "seen_at", "context").where("a_id <> b_id")
    return pair.groupBy("a_id", "b_id").agg(
        F.max("confidence").alias("confidence"), F.max("seen_at").alias("last_seen"), F.max("context").alias("context"), F.sort_array(F.collect_set("message_id")).alias("message_ids")
    )


def upsert_edges(store: DataFrame, rows: DataFrame) -> DataFrame:
    """weight grows by the number of message ids not seen before; confidence and last_seen are the largest."""
    new = edge_batch(rows).select("a_id", "b_id", *[F.col(c).alias(f"_{c}") for c in ("confidence", "last_seen", "context", "message_ids")])
    both = store.join(new, ["a_id", "b_id"], "full_outer")
    none = F.array().cast("array<string>")
    old, add = F.coalesce("message_ids", none), F.coalesce("_message_ids", none)
    return both.select(
        "a_id", "b_id", (F.coalesce("weight", F.lit(0)) + F.size(F.array_except(add, old))).cast("long").alias("weight"), F.greatest("confidence", "_confidence").alias("confidence"),
        F.greatest("last_seen", "_last_seen").alias("last_seen"), F.sort_array(F.array_union(old, add)).alias("message_ids"), F.coalesce("_context", "context").alias("context"),
    )


def _sorted_ids() -> Column:
    return F.sort_array(F.array_distinct(F.coalesce("message_ids", F.array().cast("array<string>"))))


def upsert_few_edges(store: DataFrame, rows: DataFrame) -> DataFrame:
    """As upsert_edges; only stored edges of the batch's pairs meet it, the others pass, unshuffled if the batch has few pairs."""
    rows = saved(rows)
    pairs = broadcast_few(rows.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).where("a_id <> b_id").distinct())
    hit = upsert_edges(store.join(pairs, ["a_id", "b_id"], "left_semi"), rows)
    rest = store.join(pairs, ["a_id", "b_id"], "left_anti").withColumns({"weight": F.coalesce("weight", F.lit(0)).cast("long"), "message_ids": _sorted_ids()})
    return rest.select(*hit.columns).unionByName(hit)


def upsert_entities(store: DataFrame, batch: DataFrame) -> DataFrame:
    """store and batch: id, canonical_name, aliases, confidence, embedding. Aliases unite; a null embedding keeps the old one."""
    b = batch.select("id", *[F.col(c).alias(f"_{c}") for c in batch.columns if c != "id"])
    none = F.array().cast("array<string>")
    return store.join(b, "id", "full_outer").select(
        "id", F.coalesce("_canonical_name", "canonical_name").alias("canonical_name"), F.sort_array(F.array_union(F.coalesce("aliases", none), F.coalesce("_aliases", none))).alias("aliases"),
        F.coalesce("_confidence", "confidence").alias("confidence"), F.coalesce("_embedding", "embedding").alias("embedding"),
    )


def append_aliases(store: DataFrame, new: DataFrame) -> DataFrame:
    """new: id, name."""
    got = new.groupBy("id").agg(F.collect_set("name").alias("_new"))
    none = F.array().cast("array<string>")
    return store.join(got, "id", "left").withColumn("aliases", F.sort_array(F.array_union(F.coalesce("aliases", none), F.coalesce("_new", none)))).drop("_new")


def guard_protected(pairs: DataFrame, protected: int = PROTECTED) -> DataFrame:
    """primary_id, secondary_id: the protected entity is always primary; self pairs are dropped."""
    swap = F.col("secondary_id") == protected
    return pairs.where("primary_id <> secondary_id").select(F.when(swap, F.col("secondary_id")).otherwise(F.col("primary_id")).alias("primary_id"), F.when(swap, F.col("primary_id")).otherwise(F.col("secondary_id")).alias("secondary_id"), *[c for c in pairs.columns if c not in ("primary_id", "secondary_id")])


def disjoint_pairs(pairs: DataFrame) -> DataFrame:
    """primary_id, secondary_id, rank (distinct): greedy in order of rank, each id is used once."""
    return disjoint(pairs, "primary_id", "secondary_id", "rank")


def _moved(df: DataFrame, col: str, pairs: DataFrame) -> DataFrame:
    p = pairs.select(F.col("secondary_id").alias(col), F.col("primary_id").alias("_to"))
    return df.join(p, col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to").select(*df.columns)


def merge_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of secondaries move to primaries; weights of equal pairs add up, evidence unites. An edge alone in its pair is not gathered."""
    got = _moved(_moved(edges, "a_id", pairs), "b_id", pairs).where("a_id <> b_id")
    got = got.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), F.col("weight").cast("long").alias("weight"), "confidence", "last_seen", "message_ids", "context")
    got = got.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("a_id", "b_id")))
    some = got.where("_n > 1").groupBy("a_id", "b_id").agg(
        F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.max("last_seen").alias("last_seen"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("message_ids")))).alias("message_ids"), F.max("context").alias("context")
    )
    return got.where("_n = 1").drop("_n").withColumn("message_ids", _sorted_ids()).unionByName(some)


def merge_entities(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """entities: id, canonical_name, aliases, confidence, last_mentioned, and more. Names unite, confidence and last mention are the largest."""
    gone = entities.join(pairs.select(F.col("secondary_id").alias("id"), "primary_id"), "id")
    gain = gone.groupBy(F.col("primary_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.array("canonical_name"))))).alias("_a"), F.max("confidence").alias("_c"), F.max("last_mentioned").alias("_l"))
    left = entities.join(pairs.select(F.col("secondary_id").alias("id")), "id", "left_anti").join(gain, "id", "left")
    none = F.array().cast("array<string>")
    return left.withColumns({"aliases": F.sort_array(F.array_union("aliases", F.coalesce("_a", none))), "confidence": F.greatest("confidence", "_c"), "last_mentioned": F.greatest("last_mentioned", "_l")}).drop("_a", "_c", "_l")


def merge_facts(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    return _moved(facts, "source_entity_id", pairs)


def merge_part_of(part_of: DataFrame, pairs: DataFrame) -> DataFrame:
    """Children move; a secondary's parent moves only if the primary has none."""
    owned = part_of.select(F.col("child_id").alias("primary_id")).distinct()
    blocked = pairs.join(owned, "primary_id", "left_semi").select(F.col("secondary_id").alias("child_id"))
    rest = part_of.join(blocked, "child_id", "left_anti").select(*part_of.columns)
    return _moved(_moved(rest, "child_id", pairs), "parent_id", pairs).where("child_id <> parent_id").distinct()


def alias_transfer(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, name: the alias index after a merge."""
    return _moved(alias_names(entities), "id", pairs).distinct()


def delete_entities(ids: DataFrame, entities: DataFrame, facts: DataFrame, edges: DataFrame, part_of: DataFrame) -> dict[str, DataFrame]:
    """The tables without these entities and all that hangs on them; the protected one stays."""
    gone = ids.where(F.col("id") != PROTECTED).select("id")
    off = lambda df, c: df.join(gone.withColumnRenamed("id", c), c, "left_anti").select(*df.columns)
    return {"entities": off(entities, "id"), "facts": off(facts, "source_entity_id"), "edges": off(off(edges, "a_id"), "b_id"), "part_of": off(off(part_of, "child_id"), "parent_id")}


def delete_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    keys = pairs.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))
    return edges.join(keys, ["a_id", "b_id"], "left_anti").select(*edges.columns)


def store_proposals(pairs: DataFrame, merged: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """a_id, b_id, expires_at of the pairs to review: none that holds an id which was merged away (id)."""
    free = pairs.join(merged.select(F.col("id").alias("a_id")), "a_id", "left_anti").join(merged.select(F.col("id").alias("b_id")), "b_id", "left_anti")
    return free.select("a_id", "b_id", (F.unix_timestamp(now) + days * 86400).alias("expires_at"))


def close_proposals(proposals: DataFrame, done: DataFrame) -> DataFrame:
    """Approved or rejected pairs (a_id, b_id) leave the queue."""
    return proposals.join(done.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").select(*proposals.columns)


def _touched(df: DataFrame, ids: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of which one end or both are among the (distinct) ids, once."""
    at = lambda c, how, of: of.join(ids.withColumnRenamed("id", c), c, how).select(*df.columns)
    return at(a, "left_semi", df).unionByName(at(b, "left_semi", at(a, "left_anti", df)))


def snapshot(pairs: DataFrame, entities: DataFrame, facts: DataFrame, edges: DataFrame, part_of: DataFrame) -> dict[str, DataFrame]:
    """What a merge of these pairs (primary_id, secondary_id) changes, as it was before: the secondaries' rows and facts, both sides' edges and places."""
    gone = pairs.select(F.col("secondary_id").alias("id"))
    both = pairs.select(F.explode(F.array("primary_id", "secondary_id")).alias("id")).distinct()
    of_gone = lambda df, c: df.join(gone.withColumnRenamed("id", c), c, "left_semi")
    return {"entities": of_gone(entities, "id"), "facts": of_gone(facts, "source_entity_id").select("id", "source_entity_id"), "edges": _touched(edges, both, "a_id", "b_id"), "part_of": _touched(part_of, both, "child_id", "parent_id").distinct()}


def undo_merge(now: dict[str, DataFrame], before: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """pairs: primary_id, secondary_id, new_id. The merged tables with the secondaries back under their new ids.

    Edges and places in the hierarchy that touch a merged entity give way to those of the snapshot, so the primary loses what
    it did not have before; facts go back as well.
    """
    new = pairs.select(F.col("secondary_id").alias("_old"), F.col("new_id").alias("_new"))

    def renamed(df: DataFrame, *cols: str) -> DataFrame:
        for c in cols:
            df = df.join(new, df[c] == new["_old"], "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
        return df

    ids = pairs.select(F.explode(F.array("primary_id", "secondary_id")).alias("id")).distinct()
    off = lambda df, c: df.join(ids.withColumnRenamed("id", c), c, "left_anti")
    edges = off(off(now["edges"], "a_id"), "b_id").select(*now["edges"].columns).unionByName(renamed(before["edges"], "a_id", "b_id").select(*now["edges"].columns))
    back = renamed(before["facts"], "source_entity_id").select("id", F.col("source_entity_id").alias("_owner"))
    facts = now["facts"].join(back, "id", "left").withColumn("source_entity_id", F.coalesce("_owner", "source_entity_id")).select(*now["facts"].columns)
    places = off(off(now["part_of"], "child_id"), "parent_id").select("child_id", "parent_id").unionByName(renamed(before["part_of"], "child_id", "parent_id").select("child_id", "parent_id"))
    return {"entities": now["entities"].unionByName(renamed(before["entities"], "id").select(*now["entities"].columns)), "facts": facts, "edges": edges, "part_of": places.distinct()}


def later_edges(now: DataFrame, then: DataFrame) -> DataFrame:
    """Edges of now with the message ids that then did not have; weight is their number."""
    old = then.select("a_id", "b_id", F.col("message_ids").alias("_then"))
    got = now.join(old, ["a_id", "b_id"], "left").withColumn("message_ids", F.array_except("message_ids", F.coalesce("_then", F.array().cast("array<string>")))).drop("_then")
    return got.where(F.size("message_ids") > 0).withColumn("weight", F.size("message_ids").cast("long"))


def added_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """edges (one a pair) and more (of the same columns): message ids united, weights added up, the larger confidence and the later time.

    Edges of no pair of more are not gathered.
    """
    more = saved(more)
    pairs = broadcast_few(more.select("a_id", "b_id").distinct())
    rest = edges.join(pairs, ["a_id", "b_id"], "left_anti").withColumn("message_ids", _sorted_ids())
    both = edges.join(pairs, ["a_id", "b_id"], "left_semi").select(*edges.columns).unionByName(more.select(*edges.columns)).groupBy("a_id", "b_id")
    got = both.agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.max("last_seen").alias("last_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("message_ids")))).alias("message_ids"), F.max("context").alias("context"))
    return rest.select(*edges.columns).unionByName(got.select(*edges.columns))


def undo_stored(store, label: str, pairs: DataFrame) -> dict[str, DataFrame]:
    """The stored tables (entities, facts, edges, part_of) with the labelled merge of pairs (primary_id, secondary_id, new_id) taken back.

    What the merge changed comes from the version before it; edges of the merged entities that were written since are added to what comes back.
    """
    names = ("entities", "facts", "edges", "part_of")
    then = {n: store.labelled(n, label) for n in names}
    if any(v is None for v in then.values()):
        raise ValueError(f"no stored merge {label}")
    now, old = {n: store.read(n) for n in names}, {n: store.read(n, label=label) for n in names}
    before = snapshot(pairs, old["entities"], old["facts"], old["edges"], old["part_of"])
    got = undo_merge(now, before, pairs)
    both = pairs.select(F.explode(F.array("primary_id", "secondary_id")).alias("id")).distinct()
    late = later_edges(_touched(now["edges"], both, "a_id", "b_id"), _touched(then["edges"], both, "a_id", "b_id"))
    return got | {"edges": added_edges(got["edges"], late)}


def finalize_merges(entities: DataFrame, facts: DataFrame, names: DataFrame, dirty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names (id, name: suggested ones of primaries) -> (id, canonical_name, text to embed of the renamed, dirty ids with the primaries)."""
    renamed = update_columns(entities, names.select("id", F.col("name").alias("canonical_name")), "id").join(names.select("id"), "id", "left_semi")
    lines = F.sort_array(F.collect_list(F.struct("created_at", "id", "content")))["content"]
    mine = facts.where("invalid_at is null").join(names.select(F.col("id").alias("source_entity_id")), "source_entity_id", "left_semi")
    told = mine.groupBy(F.col("source_entity_id").alias("_id")).agg(F.array_join(lines, " ").alias("_t"))
    text = renamed.join(told, F.col("id") == F.col("_id"), "left").select("id", "canonical_name", F.concat_ws(". ", "canonical_name", "_t").alias("text"))
    return text, dirty.select("id").unionByName(names.select("id")).distinct()


def retain(facts: DataFrame, now: Column, days: int) -> DataFrame:
    """Facts invalidated longer than so many days ago go."""
    old = F.coalesce(F.unix_timestamp("invalid_at") < F.unix_timestamp(now) - days * 86400, F.lit(False))
    return facts.where(~old)
