"""Upserts, merges, clean-up, ingest and the batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import facts as fact_ops
from kgspark.operators import discussions, graph, ingest, scan, search, stats, upsert
from kgspark.plans.fixtures import NOW
from kgspark.plans.read_queries import now
from kgspark.plans.registry import query
from kgspark.sources import sessions
from kgspark.streaming import streams

EDGE_OUT = "a_id, b_id, weight, round(confidence, 6) AS confidence, array_to_string(message_ids, ',') AS evidence"


def edge_out(df):
    return df.select("a_id", "b_id", F.col("weight").cast("long").alias("weight"), F.round("confidence", 6).alias("confidence"), F.array_join("message_ids", ",").alias("evidence"))


@query("s6_upsert_messages", "SELECT id, CASE WHEN turn % 2 = 0 THEN 'edited' ELSE content END AS content FROM kg_messages UNION ALL SELECT id + 500000000, content FROM kg_messages WHERE turn = 0")
def s6(t):
    m = t.messages.select("id", "content", "turn")
    new = m.where("turn % 2 = 0").select("id", F.lit("edited").alias("content"), "turn").unionByName(m.where("turn = 0").withColumn("id", F.col("id") + 500000000))
    return upsert.upsert(m, upsert.newest_by_key(new, ["id"], [F.desc("turn")]), "id").select("id", "content")


@query("s12_delete_files", "SELECT doc_id AS file_id, k AS chunk FROM (SELECT doc_id, unnest(range(greatest(1, CAST(ceil((length(text) - 200) / 1800.0) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0) WHERE doc_id % 7 <> 0")
def s12(t):
    d = t.documents.select(F.col("doc_id").alias("id"), "text")
    parents = ingest.chunk(d, 2000, 200).select(F.concat_ws("_parent_", F.col("id").cast("string"), F.col("chunk_index").cast("string")).alias("parent_id"))
    files = t.documents.select(F.col("doc_id").cast("string").alias("file_id"))
    left = sessions.delete_files(t.documents.where("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("file_id")), files, parents, files)
    return left["parents"].select(F.col("file_id").cast("long").alias("file_id"), F.split("parent_id", "_parent_")[1].cast("long").alias("chunk"))


A8 = """WITH old AS (SELECT * FROM kg_related_to WHERE (a_id + b_id) % 2 = 0),
new AS (SELECT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id, max(confidence) AS confidence, array_agg(DISTINCT message_id) AS message_ids FROM (SELECT * FROM kg_edge_rows UNION ALL SELECT a_id, b_id, message_id || 'n', 0.99, seen_at, context FROM kg_edge_rows) GROUP BY 1, 2)
SELECT coalesce(o.a_id, n.a_id) AS a_id, coalesce(o.b_id, n.b_id) AS b_id, CAST(coalesce(o.weight, 0) + len(list_filter(coalesce(n.message_ids, []), lambda x: NOT list_contains(coalesce(o.message_ids, []), x))) AS BIGINT) AS weight, round(greatest(o.confidence, n.confidence), 6) AS confidence,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(o.message_ids, []), coalesce(n.message_ids, [])))), ',') AS evidence FROM old o FULL JOIN new n ON o.a_id = n.a_id AND o.b_id = n.b_id"""


def stored(t):
    return t.entities.select("id", "canonical_name", F.array("alias1").alias("aliases"), "confidence", F.col("vec_id").alias("embedding"))


@query("a9_upsert_entities", """
SELECT id, CASE WHEN id % 3 = 0 THEN canonical_name || '!' ELSE canonical_name END AS canonical_name, array_to_string(list_sort(CASE WHEN id % 3 = 0 THEN list_distinct([alias1, 'alias' || id % 2]) ELSE [alias1] END), ',') AS aliases, vec_id AS embedding FROM kg_entities
UNION ALL SELECT id + 9000000, canonical_name, alias1, vec_id FROM kg_entities WHERE type = 'nation'""")
def a9(t):
    e = stored(t)
    new = e.where("id % 3 = 0").withColumns({"canonical_name": F.concat("canonical_name", F.lit("!")), "aliases": F.array(F.concat(F.lit("alias"), (F.col("id") % 2).cast("string"))), "embedding": F.lit(None).cast("long")})
    new = new.unionByName(stored_type(t, "nation").withColumn("id", F.col("id") + 9000000))
    return upsert.upsert_entities(e, new).select("id", "canonical_name", F.array_join("aliases", ",").alias("aliases"), "embedding")


def stored_type(t, kind):
    return t.entities.where(F.col("type") == kind).select("id", "canonical_name", F.array("alias1").alias("aliases"), "confidence", F.col("vec_id").alias("embedding"))


@query("a10_append_aliases", "SELECT id, array_to_string(list_sort(CASE WHEN id % 2 = 0 THEN list_distinct([alias1, lower(canonical_name), 'x']) ELSE [alias1] END), ',') AS aliases FROM kg_entities")
def a10(t):
    new = t.entities.where("id % 2 = 0").select("id", F.explode(F.array(F.lower("canonical_name"), F.lit("x"))).alias("name"))
    return upsert.append_aliases(stored(t), new).select("id", F.array_join("aliases", ",").alias("aliases"))


def merges(t):
    """Supplier 2k absorbs supplier 2k+1."""
    s = t.supplier.where("s_suppkey % 2 = 0").select((1000 + F.col("s_suppkey")).alias("primary_id"), (1001 + F.col("s_suppkey")).alias("secondary_id"))
    return s.join(t.supplier.select((1000 + F.col("s_suppkey")).alias("secondary_id")), "secondary_id", "left_semi")


M = "(SELECT 1000 + s_suppkey AS primary_id, 1001 + s_suppkey AS secondary_id FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier))"


@query("a12_merge_edges", f"""
SELECT coalesce(m.primary_id, a_id) AS a_id, b_id, CAST(sum(weight) AS BIGINT) AS weight, round(max(confidence), 6) AS confidence, array_to_string(list_sort(list_distinct(flatten(array_agg(message_ids)))), ',') AS evidence FROM kg_related_to LEFT JOIN {M} m ON m.secondary_id = a_id GROUP BY 1, 2""")
def a12(t):
    return edge_out(upsert.merge_edges(t.related_to, merges(t)).withColumn("message_ids", F.sort_array("message_ids")))


@query("a12_merge_entities", f"""
SELECT e.id, array_to_string(list_sort(CASE WHEN s.id IS NULL THEN [e.alias1] ELSE list_distinct([e.alias1, s.alias1, s.canonical_name]) END), ',') AS aliases, CAST(epoch(greatest(e.last_mentioned, s.last_mentioned)) AS BIGINT) AS last_mentioned
FROM kg_entities e LEFT JOIN {M} m ON m.primary_id = e.id LEFT JOIN kg_entities s ON s.id = m.secondary_id WHERE e.id NOT IN (SELECT secondary_id FROM {M})""")
def a12e(t):
    e = t.entities.withColumn("aliases", F.array("alias1"))
    return upsert.merge_entities(e, merges(t)).select("id", F.array_join("aliases", ",").alias("aliases"), F.unix_timestamp("last_mentioned").alias("last_mentioned"))


@query("a12_merge_hierarchy", f"SELECT DISTINCT child_id, parent_id FROM kg_part_of WHERE child_id NOT IN (SELECT secondary_id FROM {M})")
def a12h(t):
    return upsert.merge_part_of(t.part_of, merges(t))


@query("a13_alias_transfer", f"SELECT DISTINCT coalesce(m.primary_id, id) AS id, name FROM (SELECT id, lower(canonical_name) AS name FROM kg_entities UNION SELECT id, lower(alias1) FROM kg_entities) n LEFT JOIN {M} m ON m.secondary_id = n.id")
def a13(t):
    return upsert.alias_transfer(t.entities, merges(t))


@query("a20_assign_ids", "SELECT url, (SELECT max(id) FROM kg_entities) + row_number() OVER (ORDER BY url, page_id) AS id FROM pages")
def a20(t):
    return stats.assign_ids(t.pages.select("url", "page_id"), t.entities, ["url", "page_id"]).select("url", "id")


@query("u1_array_union", "SELECT b_id AS id, array_to_string(list_sort(array_agg(DISTINCT x)), ',') AS ids FROM (SELECT b_id, unnest(message_ids) AS x FROM kg_related_to) GROUP BY b_id")
def u1(t):
    """The evidence of all edges of an entity."""
    each = t.related_to.select(F.col("b_id").alias("id"), F.explode("message_ids").alias("x"))
    return each.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("x")), ",").alias("ids"))


@query("d5_proposals", f"""
SELECT a_id, b_id, CAST(epoch({NOW}) + 7 * 86400 AS BIGINT) AS expires_at FROM kg_related_to WHERE weight = 2 AND a_id NOT IN (SELECT secondary_id FROM {M}) AND b_id NOT IN (SELECT secondary_id FROM {M}) AND (a_id + b_id) % 5 <> 0""")
def d5(t):
    queue = upsert.store_proposals(t.related_to.where("weight = 2"), merges(t).select(F.col("secondary_id").alias("id")), now())
    return upsert.close_proposals(queue, t.related_to.where("(a_id + b_id) % 5 = 0"))


@query("d6_disjoint_pairs", """
WITH RECURSIVE p AS MATERIALIZED (SELECT a_id, b_id, row_number() OVER (ORDER BY weight DESC, a_id, b_id) AS k FROM kg_related_to WHERE weight >= 2),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a_id, CAST(NULL AS BIGINT) AS b_id
 UNION ALL SELECT q.k, list_concat(used, [q.a_id, q.b_id]), q.a_id, q.b_id FROM g, LATERAL (SELECT * FROM p WHERE p.k > g.k AND NOT list_contains(g.used, p.a_id) AND NOT list_contains(g.used, p.b_id) ORDER BY p.k LIMIT 1) q)
SELECT a_id AS primary_id, b_id AS secondary_id FROM g WHERE k > 0""")
def d6(t):
    p = t.related_to.where("weight >= 2").select(F.col("a_id").alias("primary_id"), F.col("b_id").alias("secondary_id"), F.struct(-F.col("weight"), "a_id", "b_id").alias("rank"))
    return upsert.disjoint_pairs(p).select("primary_id", "secondary_id")


@query("d7_build_hierarchy", """
SELECT child_id, parent_id FROM kg_part_of UNION SELECT b_id, a_id FROM kg_related_to JOIN kg_entities a ON a.id = a_id JOIN kg_entities b ON b.id = b_id WHERE weight >= 3 AND a.type = 'supplier' AND b.type = 'customer' AND a_id % 3 = b_id % 3""")
def d7(t):
    e = t.entities.withColumn("topic", F.col("id") % 3)
    new = graph.hierarchy_candidates(t.related_to, e, t.part_of, t.rules, 3).where("parent_type = 'supplier'")
    return t.part_of.unionByName(new.select("child_id", "parent_id")).distinct()


@query("d12_apply_contradictions", f"SELECT id, CASE WHEN vec_id % 10 = 0 AND invalid_at IS NULL THEN CAST(epoch({NOW}) AS BIGINT) ELSE CAST(floor(epoch(invalid_at)) AS BIGINT) END AS invalid_at FROM kg_facts")
def d12(t):
    judged = t.facts.where("vec_id % 5 = 0").select(F.col("id").alias("old_id"), (F.col("vec_id") % 2 == 0).alias("flag"))
    return fact_ops.apply_judgements(t.facts, judged, now()).select("id", F.unix_timestamp("invalid_at").alias("invalid_at"))


@query("d13_create_facts", "SELECT id, source_entity_id FROM kg_facts WHERE source_entity_id IN (SELECT id FROM kg_entities WHERE id % 3 <> 0)")
def d13(t):
    return fact_ops.create_facts(t.facts, t.entities.where("id % 3 <> 0"))[0].select("id", "source_entity_id")


@query("d14_sane_sources", "SELECT id, CASE WHEN source_msg_id IN (SELECT id FROM kg_messages) THEN source_msg_id END AS source_msg_id FROM kg_facts")
def d14(t):
    return fact_ops.sane_sources(t.facts, t.messages.select(F.col("id").alias("msg_id"))).select("id", "source_msg_id")


def name_mentions(t):
    return t.orders.select(F.col("o_orderkey").alias("msg_id"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("name"))


MENTIONS = "(SELECT o_orderkey AS msg_id, lower('Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0')) AS mention FROM orders)"


MENTIONS_D = "(SELECT msg_id, CASE WHEN msg_id % 3 = 0 THEN mention || '.' ELSE mention END AS mention FROM " + MENTIONS + ")"


@query("d15_resolve_mentions", f"""
WITH e AS (SELECT mention, array_to_string(list_sort(array_agg(DISTINCT msg_id)), ',') AS msg_ids, (SELECT min(id) FROM kg_entities WHERE lower(canonical_name) = mention OR lower(canonical_name) || '.' = mention) AS eid FROM {MENTIONS_D} GROUP BY mention),
n AS (SELECT *, row_number() OVER (PARTITION BY eid IS NULL ORDER BY mention) AS k FROM e)
SELECT mention, coalesce(eid, (SELECT max(id) FROM kg_entities) + k) AS id, eid IS NULL AS is_new, eid IS NOT NULL AND right(mention, 1) = '.' AS new_alias, msg_ids FROM n""")
def d15(t):
    """Every third mention is spelled with a full stop, which a candidate bridges."""
    dotted = F.when(F.col("msg_id") % 3 == 0, F.concat("name", F.lit("."))).otherwise(F.col("name"))
    names = graph.alias_names(t.entities)
    c = names.select(F.explode(F.array("name", F.concat("name", F.lit(".")))).alias("mention"), "id", F.lit(0.9).alias("score"))
    got = ingest.resolve_mentions(name_mentions(t).withColumn("name", dotted), c, names)
    return got.withColumn("msg_ids", F.array_join(F.col("msg_ids").cast("array<string>"), ","))


@query("d17_attach_facts", f"SELECT msg_id, id AS entity_id, 'llm' AS source, CAST(0.9 AS DOUBLE) AS confidence FROM {MENTIONS} JOIN (SELECT min(id) AS id, lower(canonical_name) AS mention FROM kg_entities GROUP BY 2) USING (mention)")
def d17(t):
    c = graph.alias_names(t.entities).select(F.col("name").alias("mention"), "id", F.lit(1.0).alias("score"))
    best = search.resolve_best(c, t.entities).select("mention", F.col("id").alias("entity_id"))
    return name_mentions(t).withColumn("mention", F.lower("name")).join(best, "mention").select("msg_id", "entity_id", F.lit("llm").alias("source"), F.lit(0.9).alias("confidence"))


@query("d18_find_or_create", f"""
SELECT mention AS name, coalesce(id, CASE WHEN CAST(right(mention, 2) AS INTEGER) < 50 THEN 1000 + CAST(right(mention, 2) AS BIGINT) END) AS id, CASE WHEN id IS NOT NULL THEN 'name' WHEN CAST(right(mention, 2) AS INTEGER) < 50 THEN 'vector' ELSE 'new' END AS method
FROM (SELECT DISTINCT mention, (SELECT min(id) FROM kg_entities WHERE lower(canonical_name) = mention) AS id FROM {MENTIONS})""")
def d18(t):
    """The vector table's best candidate of a name is an entity by its last two digits, near enough for those under 50."""
    tail = F.substring("name", -2, 2).cast("long")
    near = name_mentions(t).select(F.lower("name").alias("name"), (1000 + tail).alias("id"), F.when(tail < 50, 0.9).otherwise(0.5).alias("score")).distinct()
    return ingest.find_or_create(name_mentions(t), graph.alias_names(t.entities), near.unionByName(near.withColumns({"id": F.col("id") + 1, "score": F.col("score") - 0.01})))


@query("d20_delete_entities", """
SELECT (SELECT count(*) FROM kg_entities WHERE id = 1 OR id NOT IN (SELECT id FROM kg_ids)) AS entities, (SELECT count(*) FROM kg_facts WHERE source_entity_id NOT IN (SELECT id FROM kg_ids)) AS facts, (SELECT count(*) FROM kg_related_to WHERE a_id NOT IN (SELECT id FROM kg_ids) AND b_id NOT IN (SELECT id FROM kg_ids)) AS edges,
 (SELECT count(*) FROM kg_part_of WHERE child_id NOT IN (SELECT id FROM kg_ids) AND parent_id NOT IN (SELECT id FROM kg_ids WHERE id <> 1)) AS part_of""")
def d20(t):
    left = upsert.delete_entities(t.ids, t.entities, t.facts, t.related_to, t.part_of)
    got = None
    for k, df in left.items():
        one = df.agg(F.count(F.lit(1)).alias(k))
        got = one if got is None else got.crossJoin(one)
    return got


DISC = "SELECT session_id AS id, min(ts) AS opened_at FROM kg_messages GROUP BY session_id"


def talks(t):
    d = t.messages.groupBy(F.col("session_id").alias("id")).agg(F.min("ts").alias("opened_at"))
    none = d.where("false").select("id", F.lit("open").alias("status"), "opened_at", F.lit(None).cast("timestamp").alias("closed_at"))
    return discussions.open_discussions(none, d), t.messages.select("id", F.col("session_id").alias("discussion_id"), "ts", "content")


@query("d21_retention", f"""
SELECT 'fact' AS kind, id FROM kg_facts WHERE invalid_at IS NULL OR floor(epoch(invalid_at)) >= epoch({NOW}) - 14 * 86400
UNION ALL SELECT 'message', CAST(m.id AS VARCHAR) FROM kg_messages m JOIN ({DISC}) d ON d.id = m.session_id WHERE floor(epoch(opened_at)) >= epoch({NOW}) - 30 * 86400
UNION ALL SELECT 'discussion', CAST(id AS VARCHAR) FROM ({DISC}) WHERE floor(epoch(opened_at)) >= epoch({NOW}) - 30 * 86400""")
def d21(t):
    kept, said = discussions.expire(*talks(t), now(), 30)
    got = upsert.retain(t.facts, now(), 14).select(F.lit("fact").alias("kind"), "id")
    for kind, df in (("message", said), ("discussion", kept)):
        got = got.unionByName(df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id")))
    return got


BACK = f"(SELECT secondary_id AS o, secondary_id + 90000000 AS n FROM {M})"


ORACLE_D22 = f"""
SELECT 'edge' AS kind, coalesce(n, a_id) || '-' || b_id AS key, weight AS v FROM kg_related_to LEFT JOIN {BACK} ON o = a_id
UNION ALL SELECT 'fact', id, coalesce(n, source_entity_id) FROM (SELECT id, CASE WHEN vec_id % 2 = 0 THEN 1000 + vec_id % 40 ELSE source_entity_id END AS source_entity_id FROM kg_facts) LEFT JOIN {BACK} ON o = source_entity_id
UNION ALL SELECT 'entity', canonical_name, coalesce(n, id) FROM kg_entities LEFT JOIN {BACK} ON o = id
UNION ALL SELECT DISTINCT 'part', coalesce(n, child_id) || '-' || parent_id, CAST(1 AS BIGINT) FROM kg_part_of LEFT JOIN {BACK} ON o = child_id"""


def undone(got):
    """The tables that an undo gives back, as rows of one table."""
    pair = lambda a, b: F.concat_ws("-", F.col(a).cast("string"), F.col(b).cast("string"))
    out = got["edges"].select(F.lit("edge").alias("kind"), pair("a_id", "b_id").alias("key"), F.col("weight").cast("long").alias("v"))
    out = out.unionByName(got["facts"].select(F.lit("fact").alias("kind"), F.col("id").alias("key"), F.col("source_entity_id").cast("long").alias("v")))
    out = out.unionByName(got["entities"].select(F.lit("entity").alias("kind"), F.col("canonical_name").alias("key"), F.col("id").alias("v")))
    return out.unionByName(got["part_of"].select(F.lit("part").alias("kind"), pair("child_id", "parent_id").alias("key"), F.lit(1).cast("long").alias("v")))


@query("d22_undo_merge", ORACLE_D22)
def d22(t):
    p = merges(t).withColumn("new_id", F.col("secondary_id") + 90000000)
    facts = t.facts.withColumn("source_entity_id", F.when(F.col("vec_id") % 2 == 0, 1000 + F.col("vec_id") % 40).otherwise(F.col("source_entity_id"))).select("id", "source_entity_id")
    names = t.entities.select("id", "canonical_name")
    before = upsert.snapshot(p, names, facts, t.related_to, t.part_of)
    after = {"entities": names.join(p.select(F.col("secondary_id").alias("id")), "id", "left_anti"), "facts": upsert.merge_facts(facts, p), "edges": upsert.merge_edges(t.related_to, p), "part_of": upsert.merge_part_of(t.part_of, p)}
    return undone(upsert.undo_merge(after, before, p))


@query("d23_update_columns", "SELECT id, CASE WHEN id % 4 = 0 THEN 'renamed' ELSE canonical_name END AS canonical_name, type FROM kg_entities")
def d23(t):
    u = t.entities.where("id % 4 = 0").select("id", F.lit("renamed").alias("canonical_name"), F.lit(None).cast("string").alias("type"))
    return upsert.update_columns(t.entities, u, "id").select("id", "canonical_name", "type")


@query("d24_delete_edges", "SELECT a_id, b_id FROM kg_related_to WHERE NOT (a_id % 10 = 3 AND b_id % 2 = 0)")
def d24(t):
    return upsert.delete_edges(t.related_to, t.related_to.where("a_id % 10 = 3 and b_id % 2 = 0").select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))).select("a_id", "b_id")


@query("d25_note_verdicts", """
WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'EUROPE' ELSE 'ASIA' END AS topic, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END AS content, CASE WHEN p_partkey % 3 = 0 THEN 'empty' WHEN p_partkey % 5 = 0 THEN 'inactive topic' END AS reason FROM part)
SELECT id, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY topic, reason IS NULL ORDER BY id) + 2 > 10 THEN 'full' ELSE reason END AS reason FROM n QUALIFY id % 11 <> 0""")
def d25(t):
    n = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, "EUROPE").otherwise("ASIA").alias("topic"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")).alias("content"), F.col("p_partkey").alias("created_at"))
    judged = ingest.note_verdicts(n, t.topics, n.where("topic = 'ASIA' and id < 3").select("topic")).select("id", "reason")
    return ingest.forget_notes(judged, n.where("id % 11 = 0"))


@query("d26_preferences", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND event_id % 9 <> 0")
def d26(t):
    some = t.events.where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")
    return some.join(some.where("event_id % 9 = 0").select("event_id"), "event_id", "left_anti")


@query("d27_discussions", f"""
SELECT d.id, CASE WHEN d.id % 2 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN d.id % 2 = 0 THEN CAST(epoch({NOW}) AS BIGINT) END AS closed_at, n + CASE WHEN d.id % 2 = 1 THEN 1 ELSE 0 END AS n_messages
FROM ({DISC}) d JOIN (SELECT session_id AS id, count(*) AS n FROM kg_messages GROUP BY 1) c ON c.id = d.id""")
def d27(t):
    """All are opened and filled, the even ones closed, and then each is sent one more message and a known one again."""
    d, said = talks(t)
    d = discussions.close(d, d.where("id % 2 = 0"), now())
    more = said.groupBy("discussion_id").agg(F.max("id").alias("id"), F.max("ts").alias("ts")).select((F.col("id") + 500000000).alias("id"), "discussion_id", "ts", F.lit("more").alias("content"))
    said = discussions.append_messages(said, more.unionByName(said.where("id % 10 = 0")), d)
    got = discussions.listing(d, said)
    return got.select("id", "status", F.unix_timestamp("closed_at").alias("closed_at"), F.col("n_messages").cast("long").alias("n_messages"))


@query("d28_shape_messages", "SELECT id, coalesce(CASE WHEN turn = 0 THEN NULL ELSE role END, 'user') AS role FROM kg_messages")
def d28(t):
    return ingest.shape_messages(t.messages.withColumn("role", F.when(F.col("turn") != 0, F.col("role")))).select("id", "role")


@query("d29_bootstrap", """
WITH m AS (SELECT lower(p_name) AS key, count(DISTINCT p_partkey) AS n_messages, min_by(p_type, p_partkey) AS type FROM part GROUP BY 1), n AS (SELECT m.*, min(e.id) AS eid FROM m LEFT JOIN kg_entities e ON lower(e.canonical_name) = key GROUP BY ALL),
i AS (SELECT *, coalesce(eid, (SELECT max(id) FROM kg_entities) + row_number() OVER (PARTITION BY eid IS NULL ORDER BY key)) AS id FROM n),
x AS (SELECT DISTINCT least(a.id, b.id) AS a_id, greatest(a.id, b.id) AS b_id, p_partkey FROM (SELECT p_partkey, lower(p_name) AS x, lower(lead(p_name) OVER (ORDER BY p_partkey)) AS y FROM part) JOIN i a ON a.key = x JOIN i b ON b.key = y WHERE a.id <> b.id)
SELECT 'entity' AS kind, key, id, n_messages AS n FROM i UNION ALL SELECT 'edge', CAST(a_id AS VARCHAR), b_id, count(DISTINCT p_partkey) FROM x GROUP BY ALL UNION ALL SELECT 'fact', 'is a ' || p_type, i.id, CAST(1 AS BIGINT) FROM (SELECT DISTINCT lower(p_name) AS key, p_type FROM part) JOIN i USING (key)""")
def d29(t):
    m = t.part.select(F.col("p_partkey").alias("msg_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    after = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("name_b"))
    pairs = t.part.join(after, "p_partkey").select(F.col("p_name").alias("name_a"), "name_b", F.col("p_partkey").cast("string").alias("message_id"), F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp").alias("seen_at"), F.lit("x").alias("context"))
    got = ingest.bootstrap(m, pairs, t.part.select(F.col("p_name").alias("name"), F.concat(F.lit("is a "), F.col("p_type")).alias("content")), t.entities, t.related_to.where("false"))
    out = got["entities"].select(F.lit("entity").alias("kind"), "key", "id", F.col("n_messages").alias("n"))
    out = out.unionByName(got["edges"].select(F.lit("edge").alias("kind"), F.col("a_id").cast("string").alias("key"), F.col("b_id").alias("id"), F.col("weight").alias("n")))
    return out.unionByName(got["facts"].select(F.lit("fact").alias("kind"), F.col("content").alias("key"), F.col("entity_id").alias("id"), F.lit(1).cast("long").alias("n")))


@query("d30_register_aliases", "SELECT name, min(id) AS id FROM (SELECT 2000000 + p_partkey AS id, lower(p_brand || '/' || p_type) AS name FROM part UNION ALL SELECT 2000000 + p_partkey, lower(p_name) FROM part) WHERE name NOT IN (SELECT lower(alias1) FROM kg_entities) AND name NOT IN (SELECT lower(canonical_name) FROM kg_entities) GROUP BY name")
def d30(t):
    new = t.part.select((2000000 + F.col("p_partkey")).alias("id"), F.explode(F.array(F.concat_ws("/", "p_brand", "p_type"), F.col("p_name"))).alias("name"))
    return ingest.register_aliases(new, graph.alias_names(t.entities))


@query("d31_finalize_merges", """
WITH p AS (SELECT 1000000 + c_custkey AS id, c_name || ' (merged)' AS name FROM customer WHERE c_custkey % 2 = 0), f AS (SELECT source_entity_id AS id, string_agg(content, ' ' ORDER BY created_at, id) AS x FROM kg_facts WHERE invalid_at IS NULL GROUP BY 1)
SELECT coalesce(p.id, d.id) AS id, p.name AS canonical_name, CASE WHEN p.id IS NOT NULL THEN concat_ws('. ', p.name, f.x) END AS text FROM p FULL JOIN (SELECT DISTINCT source_entity_id AS id FROM kg_facts WHERE vec_id % 3 = 0) d ON d.id = p.id LEFT JOIN f ON f.id = p.id""")
def d31(t):
    names = t.customer.where("c_custkey % 2 = 0").select((1000000 + F.col("c_custkey")).alias("id"), F.concat("c_name", F.lit(" (merged)")).alias("name"))
    told, dirty = upsert.finalize_merges(t.entities, t.facts, names, t.facts.where("vec_id % 3 = 0").select(F.col("source_entity_id").alias("id")).distinct())
    return dirty.join(told, "id", "left").select("id", "canonical_name", "text")


@query("d32_refinement_plan", f"""
WITH d AS (SELECT source_entity_id AS id, max(created_at) AS seen FROM kg_facts GROUP BY 1), n AS (SELECT source_entity_id AS id, count(*) AS k FROM kg_facts WHERE source_msg_id > coalesce((source_entity_id - 1000000) * 400, 0) GROUP BY 1)
SELECT d.id, CASE WHEN n.k IS NULL THEN 'clear' WHEN d.id % 7 = 0 THEN 'keep dirty' ELSE 'checkpoint' END AS status, CASE WHEN epoch({NOW}) - floor(epoch(seen)) < 86400 THEN 'skip' WHEN n.k IS NULL THEN 'clear' WHEN d.id % 7 = 0 THEN 'keep dirty' ELSE 'checkpoint' END AS targeted FROM d LEFT JOIN n USING (id)""")
def d32(t):
    dirty = t.facts.groupBy(F.col("source_entity_id").alias("id")).agg(F.max("created_at").alias("refined_at")).withColumn("checkpoint", (F.col("id") - 1000000) * 400)
    m = t.facts.select(F.col("source_entity_id").alias("entity_id"), F.col("source_msg_id").alias("msg_id"))
    failed = dirty.where("id % 7 = 0").select("id")
    some = scan.refinement_plan(dirty, m, failed, now(), targeted=True, again_s=86400).withColumnRenamed("status", "targeted")
    return scan.refinement_plan(dirty, m, failed, now()).join(some, "id")


@query("d33_guard_protected", "SELECT CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE CAST(100 + n_nationkey AS BIGINT) END AS primary_id, CASE WHEN n_nationkey % 4 = 0 THEN CAST(100 + n_nationkey AS BIGINT) ELSE CAST(2 + n_regionkey AS BIGINT) END AS secondary_id FROM nation")
def d33(t):
    p = t.nation.select((100 + F.col("n_nationkey")).cast("long").alias("primary_id"), F.when(F.col("n_nationkey") % 4 == 0, F.lit(1)).otherwise(2 + F.col("n_regionkey")).cast("long").alias("secondary_id"))
    return upsert.guard_protected(p)


@query("t1_dedup", "SELECT session_id, min(id) AS id FROM kg_messages GROUP BY session_id, content, ts")
def t1(t):
    twice = t.messages.unionByName(t.messages)
    return streams.dedup_batch(twice).select("session_id", "id")


@query("t2_micro_batches", "SELECT id, CAST(ceil(row_number() OVER (PARTITION BY session_id ORDER BY ts, id) / 8.0) AS BIGINT) AS batch FROM kg_messages")
def t2(t):
    return streams.micro_batches(t.messages).select("id", "batch")


@query("t3_drained_edges", "SELECT a_id, b_id, weight, round(confidence, 6) AS confidence, array_to_string(message_ids, ',') AS evidence FROM kg_related_to")
def t3(t):
    first = upsert.upsert_edges(t.related_to.where("false"), t.edge_rows.where("a_id % 2 = 0"))
    return edge_out(upsert.upsert_edges(first, t.edge_rows.where("a_id % 2 = 1")))


@query("t4_route_failures", "SELECT stage, count(*) AS n FROM (SELECT CASE WHEN value < 1 THEN 'dead' ELSE 'good' END AS stage FROM events) GROUP BY stage")
def t4(t):
    good, dead = streams.route_failures(t.events, F.col("value") < 1, "dead")
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("stage"), "n").unionByName(dead.groupBy("stage").agg(F.count(F.lit(1)).alias("n")))


TRANSIENT_SQL = " OR ".join(f"contains(lower(error), '{x.lower()}')" for x in streams.TRANSIENT)


@query("t5_plan_replay", f"""
SELECT id, CASE WHEN ok AND attempt < 2 THEN 'retry' ELSE 'park' END AS action, CASE WHEN NOT ok THEN 'fatal' WHEN attempt >= 2 THEN 'exhausted' END AS reason, CASE WHEN ok AND attempt < 2 THEN attempt + 1 END AS next_attempt
FROM (SELECT *, {TRANSIENT_SQL} AS ok FROM kg_dlq)""")
def t5(t):
    return streams.plan_replay(t.dlq).select("id", "action", "reason", "next_attempt")


@query("t5_stop_after_failures", """
WITH r AS (SELECT user_id AS stage, event_id AS id, value >= 12 AS ok FROM events), g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY stage ORDER BY id) AS grp FROM r),
k AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY stage, grp ORDER BY id) AS k FROM g), s AS (SELECT *, max(CASE WHEN NOT ok AND k >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY stage ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM k)
SELECT stage, id FROM s WHERE coalesce(st, 0) = 0""")
def t5b(t):
    return streams.stop_after(t.events.select(F.col("user_id").alias("stage"), F.col("event_id").alias("id"), (F.col("value") >= 12).alias("ok"))).select("stage", "id")


@query("t6_revalidate", "SELECT o_orderkey AS id, array_to_string(list_sort(list_distinct(array_agg(1000 + l_suppkey) FILTER (l_suppkey % 2 = 0))), ',') AS entity_ids FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def t6(t):
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(1000 + F.col("l_suppkey")).alias("entity_ids"))
    got = streams.revalidate(b, t.entities.where("id % 2 = 0"))
    return got.select("id", F.when(F.size("entity_ids") > 0, F.array_join(F.col("entity_ids").cast("array<string>"), ",")).alias("entity_ids"))


EV = "(SELECT user_id AS session_id, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


def user_events(t):
    return t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))


@query("t7_checkpoints", f"SELECT session_id, id FROM {EV} WHERE rn % 24 = 0")
def t7(t):
    return streams.checkpoint_events(user_events(t)).select("session_id", "id")


@query("t8_heartbeats", f"SELECT session_id, id FROM {EV} WHERE rn % 40 = 0 AND rn % 8 = 0")
def t8(t):
    return streams.heartbeats(user_events(t)).select("session_id", "id")


@query("t9_refine_due", f"SELECT user_id % 40 AS session_id, count(DISTINCT event_type || user_id) AS n, CAST(epoch({NOW}) - floor(epoch(max(ts))) AS BIGINT) AS quiet_s, count(DISTINCT event_type || user_id) >= 15 OR CAST(epoch({NOW}) - floor(epoch(max(ts))) AS BIGINT) >= 90000 AS due FROM events GROUP BY 1")
def t9(t):
    dirty = t.events.select((F.col("user_id") % 40).alias("session_id"), F.concat("event_type", F.col("user_id").cast("string")).alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.refine_due(dirty, now(), quiet_s=90000)


@query("t10_activity_sessions", f"""
WITH l AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut, id FROM {EV}), g AS (SELECT *, sum(cut) OVER (PARTITION BY session_id ORDER BY ts, id) AS g FROM l)
SELECT session_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM g GROUP BY session_id, g""")
def t10(t):
    return streams.activity_sessions(user_events(t), "6 hours").select("session_id", F.unix_timestamp("start").alias("start"), "n")


@query("t11_late_guard", "SELECT DISTINCT session_id, user_msg_id AS msg_id FROM kg_turns WHERE user_msg_id IS NOT NULL AND turn_id > 0")
def t11(t):
    from kgspark.operators.context import turns_before

    late = t.turns.where("user_msg_id is not null").select("session_id", F.col("user_msg_id").alias("msg_id"))
    unknown = late.withColumn("msg_id", F.col("msg_id") + 777)  # newer than the log's head: nothing comes back
    return turns_before(t.turns, late.unionByName(unknown), 3).select("session_id", "msg_id").distinct()


@query("t12_event_log", "SELECT user_id AS session_id, event_type AS event, count(*) AS n FROM events WHERE value >= 1 GROUP BY 1, 2")
def t12(t):
    e = t.events.select("ts", F.col("user_id").alias("session_id"), F.lit("app").alias("component"), F.col("event_type").alias("event"), F.col("props").alias("data"), (F.col("value") < 1).alias("verbose_only"))
    return streams.event_log(e).groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query("x3_filter_spans", """
WITH s AS (SELECT id AS msg_id, w AS name, CASE WHEN length(w) % 2 = 0 THEN 'General' ELSE 'person' END AS label FROM (SELECT id, unnest(string_split(content, ' ')) AS w FROM kg_messages))
SELECT msg_id, name FROM s WHERE length(name) BETWEEN 2 AND 100 AND regexp_matches(name, '\\p{L}') AND regexp_matches(name, '^\\p{Lu}|[0-9]') AND NOT (label = 'General' AND length(name) = 4)
 AND lower(name) NOT IN ('the','a','an','and','or','of','to','in','on','at','by','for','with','from','is','was','be','it','as','that','this','i','me','my','you','your','he','him','his','she','her','we','us','our','they','them','their','its')""")
def x3(t):
    """Names of four letters count as generic; labels alternate with the length."""
    spans = t.messages.select(F.col("id").alias("msg_id"), F.explode(F.split("content", " ")).alias("name"), F.lit(0.7).alias("score")).withColumn("label", F.when(F.length("name") % 2 == 0, "General").otherwise("person"))
    generic = spans.select(F.lower("name").alias("phrase"), (F.length("name") == 4).alias("generic")).distinct()
    return ingest.filter_spans(spans, generic=generic).select("msg_id", "name")


@query("x4_merge_mentions", """
WITH k AS (SELECT id AS msg_id, string_split(content, ' ')[1] AS name FROM kg_messages), g AS (SELECT id AS msg_id, array_to_string(string_split(content, ' ')[1:2], ' ') AS name FROM kg_messages UNION ALL SELECT id, 'zz ' || turn FROM kg_messages),
t AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.msg_id = g.msg_id AND (contains(' ' || lower(g.name) || ' ', ' ' || lower(k.name) || ' ') OR contains(' ' || lower(k.name) || ' ', ' ' || lower(g.name) || ' '))))
SELECT msg_id, name, 'known' AS kind FROM k UNION ALL SELECT msg_id, name, 'tagged' FROM t UNION ALL SELECT id, 'qq', 'found' FROM kg_messages WHERE turn % 2 = 0""")
def x4(t):
    known = t.messages.select(F.col("id").alias("msg_id"), F.split("content", " ")[0].alias("name"))
    tagged = t.messages.select(F.col("id").alias("msg_id"), F.array_join(F.slice(F.split("content", " "), 1, 2), " ").alias("name")).unionByName(t.messages.select(F.col("id").alias("msg_id"), F.concat(F.lit("zz "), F.col("turn").cast("string")).alias("name")))
    found = t.messages.select(F.col("id").alias("msg_id"), F.explode(F.array(F.lit("qq"), F.concat(F.lit("zz "), F.col("turn").cast("string")))).alias("name"), F.when(F.col("turn") % 2 == 0, 0.9).otherwise(0.5).alias("score"))
    return ingest.merge_mentions(known, tagged, found)


@query("x5_judgements", "SELECT d.doc_id, quality = 1 AS flag, CASE WHEN toxic = 1 THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def x5(t):
    j = t.labels.select("doc_id", (F.col("quality") == 1).alias("flag"), F.when(F.col("toxic") == 1, 0.5).otherwise(0.95).alias("confidence"))
    got = t.documents.select("doc_id").join(j, "doc_id", "left")
    return got.select("doc_id", "flag", F.coalesce("confidence", F.lit(0.95)).alias("confidence"))


@query("x6_valid_connections", "SELECT o_orderkey AS msg_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 1")
def x6(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("msg_id"), F.col("l_partkey").alias("a_id"), F.col("l_suppkey").alias("b_id"), F.col("l_returnflag").alias("context"), F.col("l_linestatus").alias("relationship"))
    return ingest.valid_connections(rows, t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"))).select("msg_id", F.size("connections").cast("long").alias("n"))
