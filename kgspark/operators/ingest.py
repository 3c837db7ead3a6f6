"""From messages to mentions, resolved ids, connections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.splitting import text_spans
from kgspark.operators.recovery import saved
from kgspark.operators.scan import uncovered, valid_mentions
from kgspark.operators.stats import assign_ids
from kgspark.operators.upsert import upsert_edges


def word_list(text) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}']+"), lambda t: t != "")


def tag_known(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """msg_id, name, id: every known alias that occurs as whole tokens, whatever the case.

    Runs of as many tokens as some alias has meet the aliases by their tokens.
    """
    known = aliases.select(F.lower("alias").alias("name"), "id", word_list("alias").alias("words")).where(F.size("words") > 0)
    lengths = [r[0] for r in known.select(F.size("words")).distinct().collect()]  # one number per length
    tokens, n = F.col("tokens"), F.size("tokens")
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(F.array().cast("array<string>"))
    grams = F.flatten(F.transform(F.array(*map(F.lit, sorted(lengths) or [1])), runs))
    got = messages.select(F.col("id").alias("msg_id"), word_list("content").alias("tokens")).select("msg_id", F.explode(F.array_distinct(grams)).alias("run"))
    return got.join(known.select(F.array_join("words", " ").alias("run"), "name", "id"), "run").select("msg_id", "name", "id").distinct()


def filter_spans(spans: DataFrame, least: float = 0.5, generic: DataFrame | None = None, stop_words: DataFrame | None = None) -> DataFrame:
    """spans (msg_id, name, label, score) that are sure enough, start with a capital or have a digit, and are valid mentions.

    generic: phrase, generic (see generic_phrases); generic names count only under a specific label.
    """
    sure = spans.where((F.col("score") >= least) & F.rlike("name", F.lit(r"^\p{Lu}|[0-9]")))
    return valid_mentions(sure, generic=generic, stop_words=stop_words)


def merge_mentions(known: DataFrame, tagged: DataFrame, found: DataFrame, sure: float = 0.8) -> DataFrame:
    """Known ones first, then tagged, then sure discovered ones; each drops out where an earlier kind covers it."""
    k = known.select("msg_id", "name", F.lit("known").alias("kind"))
    t = uncovered(tagged.select("msg_id", "name"), k).withColumn("kind", F.lit("tagged"))
    both = k.unionByName(t)
    return both.unionByName(uncovered(found.where(F.col("score") >= sure).select("msg_id", "name"), both).withColumn("kind", F.lit("found")))


def resolve_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """pairs (name_a, name_b) with a_id, b_id by name or alias (smallest id); null where a name is unknown."""
    first = names.groupBy("name").agg(F.min("id").alias("id"))
    at = lambda c, i: first.select(F.col("name").alias(f"_{c}"), F.col("id").alias(i))
    got = pairs.withColumn("_name_a", F.lower("name_a")).withColumn("_name_b", F.lower("name_b"))
    return got.join(at("name_a", "a_id"), "_name_a", "left").join(at("name_b", "b_id"), "_name_b", "left").drop("_name_a", "_name_b")


def resolve_mentions(mentions: DataFrame, candidates: DataFrame, names: DataFrame, least: float = 0.85) -> DataFrame:
    """mentions (msg_id, name), candidates (mention, id, score), names (id, name: known ones) -> one row per lower-cased name.

    mention, id (the best candidate's, else a new one after the largest), is_new, new_alias (the entity did not have the name), msg_ids.
    """
    best = candidates.where(F.col("score") >= least).groupBy("mention").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"))
    each = mentions.select("msg_id", F.lower("name").alias("mention")).groupBy("mention").agg(F.sort_array(F.collect_set("msg_id")).alias("msg_ids"))
    found = saved(each.join(best, "mention", "left"))
    had = names.select("id", F.lower("name").alias("mention")).distinct().withColumn("_had", F.lit(True))
    old = found.where("id is not null").join(had, ["id", "mention"], "left").select("mention", "id", F.lit(False).alias("is_new"), F.col("_had").isNull().alias("new_alias"), "msg_ids")
    new = assign_ids(found.where("id is null").drop("id"), names, ["mention"]).select("mention", "id", F.lit(True).alias("is_new"), F.lit(False).alias("new_alias"), "msg_ids")
    return old.unionByName(new)


def find_or_create(names: DataFrame, exact: DataFrame, vector: DataFrame, least: float = 0.88) -> DataFrame:
    """names (name) -> id and method: by name or alias, else by vector candidates (name, id, score), else new."""
    e = exact.groupBy("name").agg(F.min("id").alias("e_id"))
    v = vector.where(F.col("score") >= least).groupBy("name").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("v_id"))
    got = names.select(F.lower("name").alias("name")).distinct().join(e, "name", "left").join(v, "name", "left")
    return got.select("name", F.coalesce("e_id", "v_id").alias("id"), F.when(F.col("e_id").isNotNull(), "name").when(F.col("v_id").isNotNull(), "vector").otherwise("new").alias("method"))


def valid_connections(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Connections of known messages; a missing context falls back to the relationship; one row per message."""
    got = rows.join(messages.select(F.col("id").alias("msg_id")), "msg_id", "left_semi").withColumn("context", F.coalesce("context", "relationship"))
    item = F.struct("a_id", "b_id", "context")
    return got.groupBy("msg_id").agg(F.sort_array(F.collect_list(item)).alias("connections"))


def register_aliases(new: DataFrame, owned: DataFrame) -> DataFrame:
    """new (id, name): names nobody owns yet, each to its first claimant by id."""
    free = new.select("id", F.lower("name").alias("name")).join(owned.select(F.lower("name").alias("name")).distinct(), "name", "left_anti")
    return free.groupBy("name").agg(F.min("id").alias("id"))


def chunk(docs: DataFrame, size: int, overlap: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, total_chunks, text: fixed strides of characters."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / step)).cast("int")
    got = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), n.alias("total_chunks"))
    return got.select("id", "total_chunks", "_t", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_index")).select("id", "chunk_index", "total_chunks", F.substring(F.col("_t"), F.col("chunk_index") * step + 1, F.lit(size)).alias("text"))


def split_chunks(docs: DataFrame, size: int, overlap: int, id_col: str = "id", text_col: str = "text", kind: Column | None = None) -> DataFrame:
    """id, chunk_index, total_chunks, fresh (characters that repeat the chunk before), text: chunks that break where the text does.

    kind: the file type, which says what to break before. Null and empty texts have no chunks.
    """
    kind = F.lit("") if kind is None else F.lower(F.coalesce(kind, F.lit("")))
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), kind.alias("_k")).withColumn("_s", text_spans(F.col("_t"), F.col("_k"), size, overlap))
    each = cut.select("id", "_t", F.size("_s").alias("total_chunks"), F.posexplode("_s").alias("chunk_index", "_x"))
    return each.select("id", "chunk_index", "total_chunks", (F.col("_x.fresh") - F.col("_x.start")).alias("fresh"), F.substring(F.col("_t"), F.col("_x.start") + 1, F.col("_x.end") - F.col("_x.start")).alias("text"))


def split_parents_and_children(docs: DataFrame, kind: Column | None = None, parent=(2000, 200), child=(512, 50)) -> DataFrame:
    """parent_id, id, chunk_index, fresh, text of child chunks inside parent chunks, both broken where the text does."""
    p = split_chunks(docs, *parent, kind=kind)
    p = p.select(F.concat_ws("_parent_", F.col("id").cast("string"), F.col("chunk_index").cast("string")).alias("parent_id"), "text")
    return split_chunks(p, *child, id_col="parent_id").select(F.col("id").alias("parent_id"), F.concat_ws("_child_", "id", F.col("chunk_index").cast("string")).alias("id"), "chunk_index", "fresh", "text")


def parent_child_chunks(docs: DataFrame, parent=(2000, 200), child=(512, 50)) -> DataFrame:
    """parent_id, id, chunk_index, text of child chunks inside parent chunks."""
    p = chunk(docs, *parent).select(F.concat_ws("_parent_", F.col("id").cast("string"), F.col("chunk_index").cast("string")).alias("parent_id"), "text")
    c = chunk(p, *child, id_col="parent_id")
    return c.select(F.col("id").alias("parent_id"), F.concat_ws("_child_", "id", F.col("chunk_index").cast("string")).alias("id"), "chunk_index", "text")


def shape_messages(df: DataFrame) -> DataFrame:
    return df.select("id", "content", F.coalesce("role", F.lit("user")).alias("role"), "ts")


def bootstrap_entities(mentions: DataFrame) -> DataFrame:
    """mentions (msg_id, name, type): one entity per lower-cased name with its first spelling and message count."""
    return mentions.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "msg_id").alias("canonical_name"), F.min_by("type", "msg_id").alias("type"), F.count_distinct("msg_id").alias("n_messages"))


def bootstrap(mentions: DataFrame, pairs: DataFrame, facts: DataFrame, entities: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """A bulk load beside what is stored: entities (id, key, canonical_name, type, n_messages), edges, facts (entity_id, content).

    mentions: msg_id, name, type; pairs: name_a, name_b, message_id, confidence, seen_at, context; facts: name, content.
    Names already stored keep their ids; pairs and facts whose name nobody has are dropped.
    """
    known = entities.groupBy(F.lower("canonical_name").alias("key")).agg(F.min("id").alias("id"))
    each = saved(bootstrap_entities(mentions).join(known, "key", "left"))
    new = assign_ids(each.where("id is null").drop("id"), entities, ["key"])
    loaded = saved(each.where("id is not null").unionByName(new.select(*each.columns)))
    at = lambda c: loaded.select(F.col("key").alias(f"_{c}"), F.col("id").alias(f"{c}_id"))
    rows = pairs.withColumn("_a", F.lower("name_a")).withColumn("_b", F.lower("name_b")).join(at("a"), "_a").join(at("b"), "_b")
    told = facts.join(loaded.select(F.col("key").alias("_k"), F.col("id").alias("entity_id")), F.lower("name") == F.col("_k")).select("entity_id", "content")
    return {"entities": loaded, "edges": upsert_edges(edges, rows.select("a_id", "b_id", "message_id", "confidence", "seen_at", "context")), "facts": told.distinct()}


def forget_notes(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Notes of these ids go, whatever their topic."""
    return notes.join(ids.select("id"), "id", "left_anti").select(*notes.columns)


def note_verdicts(notes: DataFrame, topics: DataFrame, existing: DataFrame, longest: int = 200, cap: int = 10) -> DataFrame:
    """notes (id, topic, content, created_at) with reason: null where accepted."""
    have = existing.groupBy("topic").agg(F.count(F.lit(1)).alias("have"))
    on = topics.where("active").select(F.col("name").alias("topic"), F.lit(True).alias("on"))
    got = notes.join(have, "topic", "left").join(on, "topic", "left")
    bad = F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) == 0, "empty").when(F.length("content") > longest, "too long").when(F.col("on").isNull(), "inactive topic")
    got = got.withColumn("reason", bad)
    rn = F.row_number().over(W.partitionBy("topic", F.col("reason").isNull()).orderBy("created_at", "id"))
    full = F.col("reason").isNull() & (rn + F.coalesce("have", F.lit(0)) > cap)
    return got.withColumn("reason", F.when(full, "full").otherwise(F.col("reason"))).drop("have", "on")
