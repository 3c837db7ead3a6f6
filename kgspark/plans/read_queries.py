"""Scans, filters, topics, statistics and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import scalars
from kgspark.functions.render import rendered
from kgspark.operators import context, scan, stats, topics
from kgspark.operators.graph import active
from kgspark.plans.fixtures import NOW
from kgspark.plans.registry import query
from kgspark.sources import sessions

EPOCH = lambda c: F.unix_timestamp(c).alias(c)


def now():
    return F.expr(NOW)


@query("s1_entity_scan", "SELECT id, canonical_name, type, topic, confidence FROM kg_entities WHERE id IS NOT NULL")
def s1(t):
    return t.entities.where("id is not null").select("id", "canonical_name", "type", "topic", "confidence")


@query("s2_entities_by_ids", "SELECT id, canonical_name, topic, CAST(epoch(last_mentioned) AS BIGINT) AS last_mentioned FROM kg_entities WHERE id IN (SELECT id FROM kg_ids)")
def s2(t):
    return scan.entities_by_ids(t.entities, t.ids).select("id", "canonical_name", "topic", "last_mentioned")


@query("s3_entities_by_names", """
SELECT e.id, canonical_name, (SELECT count(*) FROM kg_facts f WHERE f.source_entity_id = e.id AND invalid_at IS NULL) AS n_facts
FROM kg_entities e WHERE lower(canonical_name) IN (SELECT lower(name) FROM kg_names) OR lower(alias1) IN (SELECT lower(name) FROM kg_names)""")
def s3(t):
    return scan.entities_by_names(t.entities, t.facts, t.names).select("id", "canonical_name", F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


@query("s4_live_ids", "SELECT id FROM kg_ids WHERE id IN (SELECT id FROM kg_entities)")
def s4(t):
    return scan.live_ids(t.ids, t.entities)


@query("s5_messages_by_ids", "SELECT id, content FROM kg_messages WHERE id IN (SELECT source_msg_id FROM kg_facts)")
def s5(t):
    return t.messages.join(t.facts.select(F.col("source_msg_id").alias("id")), "id", "left_semi").select("id", "content")


@query("s7_turns", """
SELECT session_id, turn_id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id DESC) AS rn FROM kg_turns) WHERE rn <= 3""")
def s7(t):
    lines = t.turns.select("session_id", "ts", F.to_json(F.struct("turn_id", "role", "content", "user_msg_id")).alias("value"))
    return scan.last_turns(sessions.parse_turns(lines), 3).select("session_id", "turn_id", "role", "content")


@query("s8_export_sessions", """
SELECT session_id, count(*) AS n, string_agg(role || ':' || content, '|' ORDER BY ts, turn_id) AS messages FROM
 (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id DESC) AS rn FROM kg_turns) WHERE rn <= 4 GROUP BY session_id""")
def s8(t):
    m = F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"]))
    return sessions.export_sessions(t.turns, 4).select("session_id", "n", F.array_join(m, "|").alias("messages"))


@query("s9_import_sessions", """
SELECT CAST(session_id AS VARCHAR) AS session_id, role, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS store,
 CASE WHEN turn % 3 = 0 THEN CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) ELSE CAST(epoch(ts) AS BIGINT) END AS ts FROM kg_messages WHERE role IS NOT NULL AND content <> ''""")
def s9(t):
    raw = t.messages.select(F.col("session_id").cast("string").alias("session_id"), "role", "content", F.when(F.col("turn") % 3 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"))
    return sessions.clean_import(raw, now()).select("session_id", "role", "store", EPOCH("ts"))


@query("s10_list_sessions", """
SELECT session_id, CAST(epoch(max(ts)) AS BIGINT) AS last_active, count(*) AS n_turns, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(ts)) <= 86400 AS is_active FROM kg_turns GROUP BY session_id ORDER BY last_active DESC, session_id LIMIT 20 OFFSET 5""")
def s10(t):
    return sessions.list_sessions(t.turns, now(), 20, 5).withColumn("last_active", F.unix_timestamp("last_active"))


@query("s11_files", """
SELECT doc_id, size FROM (SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE trim(text, ' ') <> '' AND doc_id % 3 <> 2) WHERE rn <= 100""")
def s11(t):
    d = t.documents.select("doc_id", F.col("source").alias("session_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.when(F.col("doc_id") % 3 == 2, "exe").otherwise("txt").alias("extension"), F.octet_length("text").cast("long").alias("size"), "text")
    return sessions.accept_files(d).select("doc_id", "size")


@query("s13_delete_sessions", """
SELECT 'messages' AS "table", count(*) AS removed FROM kg_messages WHERE session_id IN (SELECT id - 1000000 FROM kg_ids WHERE id > 1000000) UNION ALL
SELECT 'turns', count(*) FROM kg_turns WHERE session_id IN (SELECT id - 1000000 FROM kg_ids WHERE id > 1000000)""")
def s13(t):
    gone = t.ids.where("id > 1000000").select((F.col("id") - 1000000).alias("session_id"))
    return sessions.delete_sessions(gone, messages=t.messages, turns=t.turns)[1]


@query("s14_upsert_sessions", """
WITH s AS (SELECT session_id, min(role) AS title, CAST(epoch(max(ts)) AS BIGINT) AS la FROM kg_turns GROUP BY session_id)
SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'renamed' ELSE title END AS title, la AS last_active FROM s""")
def s14(t):
    s = t.turns.groupBy("session_id").agg(F.min("role").alias("title"), F.unix_timestamp(F.max("ts")).alias("last_active"))
    return sessions.upsert_sessions(s, s.where("session_id % 2 = 0").select("session_id", F.lit("renamed").alias("title"), F.lit(None).cast("long").alias("last_active")))


@query("s15_edit_topics", """
SELECT name, CASE WHEN name = 'ASIA' THEN NOT active ELSE active END AS active, CASE WHEN name = 'General' THEN 'x' ELSE labels END AS labels FROM kg_topics WHERE name <> 'PROMO' AND name IN (SELECT topic FROM kg_entities)
UNION ALL SELECT r_name || '!', TRUE, 'new' FROM region""")
def s15(t):
    used = t.topics.join(t.entities.select(F.col("topic").alias("name")), "name", "left_semi").where("name <> 'PROMO'")
    edits = t.region.select(F.concat("r_name", F.lit("!")).alias("name"), F.lit("add").alias("op"), F.lit("new").alias("labels"))
    one = t.spark.createDataFrame([("ASIA", "toggle", None), ("General", "replace", "x"), ("nowhere", "toggle", None)], "name string, op string, labels string")
    return topics.edit_topics(used, edits.unionByName(one))


@query("s16_append_turns", """
SELECT session_id, role, b + rn - 1 AS turn_id, CASE WHEN role = 'user' THEN b + rn - 1 ELSE b + rn - 1 + 1000000000 END AS msg_id FROM
 (SELECT m.session_id, role, row_number() OVER (PARTITION BY m.session_id ORDER BY turn) AS rn, c.b FROM kg_messages m JOIN (SELECT session_id, max(turn_id) + 1 AS b FROM kg_turns GROUP BY session_id) c ON c.session_id = m.session_id)""")
def s16(t):
    new = t.messages.select("session_id", F.col("turn").alias("seq"), "role", "content")
    return sessions.append_turns(t.turns, new).select("session_id", "role", "turn_id", "msg_id")


@query("p1_list_entities", "SELECT id, canonical_name, CAST(epoch(last_mentioned) AS BIGINT) AS last_mentioned FROM kg_entities WHERE type = 'part' AND contains(lower(canonical_name), 'ring') ORDER BY kg_entities.last_mentioned DESC, id LIMIT 50 OFFSET 10")
def p1(t):
    return scan.page(scan.list_entities(t.entities, type="part", search="RING"), [F.desc("last_mentioned"), "id"], 50, 10).select("id", "canonical_name", EPOCH("last_mentioned"))


@query("p2_fact_summary", "SELECT source_entity_id AS entity_id, string_agg(content, '. ' ORDER BY created_at, id) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY source_entity_id ORDER BY created_at, id) AS rn FROM kg_facts WHERE invalid_at IS NULL) WHERE rn <= 2 GROUP BY 1")
def p2(t):
    return scan.fact_summary(t.facts)


@query("p3_active_facts", "SELECT id, source_entity_id, content FROM kg_facts WHERE invalid_at IS NULL")
def p3(t):
    return active(t.facts).select("id", "source_entity_id", "content")


ACTIVE = ["General", "AFRICA", "AMERICA", "ASIA", "MIDDLE EAST", "AUTOMOBILE", "FURNITURE", "MACHINERY", "HOUSEHOLD"]
ACTIVE_SQL = "(" + ", ".join(f"'{x}'" for x in ACTIVE) + ")"


@query("p4_topic_visible", f"SELECT id, topic FROM kg_entities WHERE topic IS NULL OR topic IN {ACTIVE_SQL}")
def p4(t):
    return scan.topic_visible(t.entities, ACTIVE).select("id", "topic")


@query("p5_valid_mentions", """
WITH m AS (SELECT DISTINCT w AS name, CASE WHEN length(w) % 3 = 0 THEN 'general' ELSE 'person' END AS label, CASE length(w) % 4 WHEN 0 THEN 'General' WHEN 1 THEN 'cars' WHEN 2 THEN 'EUROPE' END AS topic FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM conversations)),
k AS (SELECT lower(name) AS key FROM kg_topics WHERE active UNION SELECT trim(lower(unnest(string_split(aliases, ',')))) FROM kg_topics WHERE active)
SELECT name, label, topic FROM m WHERE length(name) BETWEEN 2 AND 100 AND regexp_matches(name, '\\p{L}') AND NOT (label = 'general' AND length(name) = 6) AND (topic IS NULL OR topic = 'General' OR lower(topic) IN (SELECT key FROM k))
 AND lower(name) NOT IN ('the','a','an','and','or','of','to','in','on','at','by','for','with','from','is','was','be','it','as','that','this','i','me','my','you','your','he','him','his','she','her','we','us','our','they','them','their','its')""")
def p5(t):
    """Names of six letters count as generic; labels and topics follow from the length."""
    n = F.length("name")
    words = t.conversations.select(F.explode(F.split("text", r"\s+")).alias("name")).distinct().withColumn("label", F.when(n % 3 == 0, "general").otherwise("person")).withColumn("topic", F.when(n % 4 == 0, "General").when(n % 4 == 1, "cars").when(n % 4 == 2, "EUROPE"))
    return scan.valid_mentions(words, words.select(F.col("name").alias("phrase"), (n == 6).alias("generic")), topics.alias_table(t.topics)).select("name", "label", "topic")


@query("p6_generic_phrases", """
WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY word),
f AS (SELECT word, n / (SELECT sum(n) FROM w) AS freq FROM w),
p AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:2], ' ') AS phrase FROM conversations),
x AS (SELECT phrase, unnest(string_split_regex(lower(phrase), '\\s+')) AS word FROM p)
SELECT phrase, count(*) > 1 AND min(coalesce(freq, 0)) >= 5e-6 AND sum(coalesce(freq, 0)) > 5e-4 AS generic FROM x LEFT JOIN f USING (word) GROUP BY phrase""")
def p6(t):
    phrases = t.conversations.select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("phrase"))
    return scan.generic_phrases(phrases, scan.word_frequencies(t.conversations))


@query("p7_uncovered", """
WITH c AS (SELECT id AS msg_id, list_extract(string_split(content, ' '), 1) AS name FROM kg_messages), d AS (SELECT id AS msg_id, array_to_string(string_split(content, ' ')[1:2], ' ') AS name FROM kg_messages WHERE id % 2 = 0)
SELECT msg_id, name FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.msg_id = c.msg_id AND (contains(' ' || lower(d.name) || ' ', ' ' || lower(c.name) || ' ') OR contains(' ' || lower(c.name) || ' ', ' ' || lower(d.name) || ' ')))""")
def p7(t):
    c = t.messages.select(F.col("id").alias("msg_id"), F.split("content", " ")[0].alias("name"))
    d = t.messages.where("id % 2 = 0").select(F.col("id").alias("msg_id"), F.array_join(F.slice(F.split("content", " "), 1, 2), " ").alias("name"))
    return scan.uncovered(c, d)


@query("p8_normalize_topic", """
WITH k AS (SELECT name, unnest(list_concat([lower(name)], list_transform(string_split(aliases, ','), lambda a: trim(lower(a))))) AS key FROM kg_topics WHERE active), a AS (SELECT key, min(name) AS canonical FROM k GROUP BY key)
SELECT id, topic, coalesce(canonical, (SELECT 'General' FROM kg_topics WHERE active AND name = 'General')) AS canonical FROM kg_entities LEFT JOIN a ON lower(topic) = key""")
def p8(t):
    return topics.normalize_topic(t.entities.select("id", "topic"), t.topics)


@query("p9_assign_topic", """
WITH l AS (SELECT label, count(DISTINCT name) AS n, min(name) AS name FROM (SELECT name, unnest(string_split(labels, ',')) AS label FROM kg_topics WHERE active) GROUP BY label)
SELECT id, CASE WHEN n = 1 THEN l.name WHEN n > 1 THEN 'ambiguous' ELSE 'General' END AS assigned FROM kg_entities LEFT JOIN l ON lower(type) = label""")
def p9(t):
    return topics.assign_topic(t.entities.select("id", "type"), t.topics).select("id", "assigned")


@query("p10_validate_hot", """
WITH k AS (SELECT name, unnest(list_concat([lower(name)], list_transform(string_split(aliases, ','), lambda a: trim(lower(a))))) AS key FROM kg_topics WHERE active), a AS (SELECT key, min(name) AS canonical FROM k GROUP BY key)
SELECT topic, coalesce(canonical, 'General') AS canonical, TRUE AS valid FROM (SELECT DISTINCT topic FROM kg_entities) LEFT JOIN a ON lower(topic) = key""")
def p10(t):
    return topics.validate_hot(t.entities, t.topics)


@query("p11_guard_topics", """
WITH o AS (SELECT name, active, labels FROM kg_topics), n AS (SELECT topic AS name, max(id) % 2 = 0 AS active, 'ok, Good Label,b@d,' || max(type) AS labels FROM kg_entities WHERE topic IS NOT NULL GROUP BY topic),
b AS (SELECT coalesce(o.name, n.name) AS name, o.active AS oa, o.labels AS ol, o.name IS NULL AS fresh, o.name IS NOT NULL AND (n.name IS NULL OR o.name IN ('General', 'Identity')) AS was, n.active AS na, n.labels AS nl FROM o FULL JOIN n ON o.name = n.name),
c AS (SELECT name, oa, ol, fresh, CASE WHEN was THEN oa ELSE na END AS act, CASE WHEN was THEN ol ELSE nl END AS lab, row_number() OVER (PARTITION BY fresh ORDER BY name) AS rn FROM b),
r AS (SELECT 2 * count(*) FILTER (oa AND NOT act) > count(*) FILTER (oa) AS rej FROM c)
SELECT name, CASE WHEN rej THEN oa ELSE act END AS active, CASE WHEN rej THEN ol ELSE array_to_string(list_filter(list_transform(string_split(lab, ','), lambda x: lower(trim(x))), lambda x: regexp_matches(x, '^[a-z][a-z0-9 _-]*$') AND length(x) <= 30), ',') END AS labels FROM c, r WHERE NOT (rej AND fresh) AND (NOT fresh OR rn <= 3)""")
def p11(t):
    new = t.entities.where("topic is not null").groupBy(F.col("topic").alias("name")).agg((F.max("id") % 2 == 0).alias("active"), F.concat(F.lit("ok, Good Label,b@d,"), F.max("type")).alias("labels"))
    return topics.guard_topics(t.topics, new)


@query("p12_sanitize", """SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[+\\-&|!(){}\\[\\]^"~*?:\\\\/]', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM documents""")
def p12(t):
    return t.documents.select("doc_id", scalars.sanitize(F.col("text")).alias("q"))


@query("p13_message_ids", "SELECT id, CASE WHEN id % 2 = 0 THEN 'msg_' || id ELSE 'turn_' || id END AS label, CASE WHEN id % 2 = 0 THEN id ELSE id + 1000000000 END AS parsed FROM kg_messages")
def p13(t):
    i = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + scalars.ASSISTANT_IDS)
    return t.messages.select("id", scalars.format_msg_id(i).alias("label")).withColumn("parsed", scalars.parse_msg_id(F.col("label")))


@query("p14_normalize_ts", "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS s FROM events")
def p14(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.floor(us / 1e6).cast("long").cast("string")).when(k == 1, F.floor(us / 1000).cast("long").cast("string")).when(k == 2, us.cast("string")).when(k == 3, (us * 1000).cast("string")).when(k == 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("never")
    return t.events.select("event_id", scalars.normalize_ts(text).alias("s"))


@query("p15_new_turns", "SELECT m.entity_id, count(*) AS n FROM (SELECT source_entity_id AS entity_id, source_msg_id AS msg_id FROM kg_facts) m JOIN kg_entities e ON e.id = m.entity_id WHERE msg_id > coalesce(vec_id * 100, 0) GROUP BY 1")
def p15(t):
    e = t.entities.select("id", (F.col("vec_id") * 100).alias("checkpoint"))
    return scan.new_turns(e, t.facts.select(F.col("source_entity_id").alias("entity_id"), F.col("source_msg_id").alias("msg_id"))).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("a1_graph_stats", "SELECT (SELECT count(*) FROM kg_entities) AS entities, (SELECT count(*) FROM kg_facts WHERE invalid_at IS NULL) AS facts, (SELECT count(*) FROM kg_related_to) AS relationships")
def a1(t):
    return stats.graph_stats(t.entities, t.facts, t.related_to)


@query("a2_count_by_type", "SELECT type, count(*) AS n FROM kg_entities WHERE type IS NOT NULL GROUP BY type")
def a2(t):
    return stats.count_by(t.entities, "type")


@query("a3_count_by_topic", "SELECT topic, count(*) AS n FROM kg_entities WHERE topic IS NOT NULL GROUP BY topic")
def a3(t):
    return stats.count_by(t.entities, "topic")


@query("a4_top_connected", "SELECT id, count(*) AS degree FROM (SELECT a_id AS id FROM kg_related_to UNION ALL SELECT b_id FROM kg_related_to) GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def a4(t):
    return stats.top_connected(t.related_to, 20)


@query("a5_notable", """
WITH d AS (SELECT id, count(*) AS c FROM (SELECT a_id AS id FROM kg_related_to UNION ALL SELECT b_id FROM kg_related_to) GROUP BY id), f AS (SELECT source_entity_id AS id, count(*) AS c FROM kg_facts WHERE invalid_at IS NULL GROUP BY 1)
SELECT e.id, canonical_name, type, topic, coalesce(d.c, 0) AS connection_count, coalesce(f.c, 0) AS fact_count FROM kg_entities e LEFT JOIN d ON d.id = e.id LEFT JOIN f ON f.id = e.id ORDER BY connection_count DESC, fact_count DESC, e.id LIMIT 25""")
def a5(t):
    return stats.notable(t.entities, t.facts, t.related_to, 25)


@query("a6_recently_active", f"SELECT e.id, canonical_name, count(*) AS n_facts FROM kg_facts f JOIN kg_entities e ON e.id = f.source_entity_id WHERE epoch(created_at) > epoch({NOW}) - 7 * 86400 GROUP BY 1, 2 ORDER BY n_facts DESC, e.id LIMIT 20")
def a6(t):
    return stats.recently_active(t.entities, t.facts, now(), 7, 20)


@query("a7_recent_facts", f"SELECT f.id, canonical_name AS entity, substr(content, 1, 100) AS content FROM kg_facts f JOIN kg_entities e ON e.id = f.source_entity_id WHERE epoch(created_at) > epoch({NOW}) - 7 * 86400 ORDER BY created_at DESC, f.id LIMIT 50")
def a7(t):
    return stats.recent_facts(t.entities, t.facts, now(), 7, 50)


@query("a14_generic_tokens", "SELECT token, count(DISTINCT id) AS n FROM (SELECT id, unnest(string_split_regex(lower(canonical_name) || ' ' || lower(alias1), '\\s+')) AS token FROM kg_entities) WHERE token <> '' GROUP BY token HAVING count(DISTINCT id) >= 10")
def a14(t):
    return stats.generic_tokens(t.entities.select("id", F.concat_ws(" ", F.lower("canonical_name"), F.lower("alias1")).alias("name")))


@query("a15_usage_cost", "SELECT model, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(sum((prompt_tokens * input + completion_tokens * output) / 1e6), 4) AS cost FROM kg_usage JOIN kg_model_prices USING (model) GROUP BY ROLLUP (model)")
def a15(t):
    return stats.usage_cost(t.usage, t.model_prices).withColumn("cost", F.round("cost", 4))


@query("a16_token_estimate", "SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY source")
def a16(t):
    return t.documents.groupBy("source").agg(F.sum(scalars.token_estimate(F.col("text"))).alias("tokens"))


@query("a17_recent_discussions", "SELECT session_id, count(*) AS n FROM kg_messages GROUP BY session_id ORDER BY max(ts) DESC, session_id LIMIT 15")
def a17(t):
    return t.messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).orderBy(F.desc("last"), "session_id").limit(15).drop("last")


@query("a18_memory_blocks", """
SELECT topic, string_agg(canonical_name, chr(10) ORDER BY last_mentioned, id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY last_mentioned, id) AS rn FROM kg_entities WHERE topic = 'General' OR topic IN (SELECT name FROM kg_topics WHERE hot AND active)) WHERE rn <= 10 GROUP BY topic""")
def a18(t):
    hot = topics.hot_topics(t.topics).select("name").unionByName(t.topics.where("name = 'General'").select("name")).distinct()
    some = t.entities.join(hot.withColumnRenamed("name", "topic"), "topic", "left_semi")
    return stats.joined_text(stats.top_per_group(some, ["topic"], ["last_mentioned", "id"], 10), ["topic"], ["last_mentioned", "id"], "canonical_name")


@query("a19_working_memory", "SELECT session_id, string_agg('- ' || content, chr(10) ORDER BY ts, id) AS text FROM kg_messages WHERE role = 'user' GROUP BY session_id")
def a19(t):
    return stats.joined_text(t.messages.where("role = 'user'"), ["session_id"], ["ts", "id"], "content", prefix="- ")


@query("a21_profile_text", "SELECT e.id, canonical_name || '. ' || string_agg(content, ' ' ORDER BY created_at, f.id) AS text FROM kg_entities e JOIN kg_facts f ON f.source_entity_id = e.id AND invalid_at IS NULL GROUP BY e.id, canonical_name")
def a21(t):
    text = stats.joined_text(active(t.facts), ["source_entity_id"], ["created_at", "id"], "content", sep=" ")
    return t.entities.join(text, F.col("id") == F.col("source_entity_id")).select("id", F.concat("canonical_name", F.lit(". "), "text").alias("text"))


@query("w1_newest_facts", "SELECT id, source_entity_id, rn FROM (SELECT id, source_entity_id, invalid_at, row_number() OVER (PARTITION BY source_entity_id ORDER BY created_at DESC, id) AS rn FROM kg_facts WHERE invalid_at IS NULL AND source_entity_id IN (SELECT id FROM kg_entities)) WHERE rn <= 5")
def w1(t):
    from kgspark.operators.facts import newest_facts

    return newest_facts(t.facts, t.entities).select("id", "source_entity_id", F.col("rn").cast("long").alias("rn"))


@query("w2_fact_timeline", "SELECT id, content, source_msg_id, CAST(floor(epoch(invalid_at)) AS BIGINT) AS invalid_at FROM kg_facts WHERE source_entity_id IN (SELECT id FROM kg_ids)")
def w2(t):
    return t.facts.join(t.ids.select(F.col("id").alias("source_entity_id")), "source_entity_id", "left_semi").select("id", "content", "source_msg_id", EPOCH("invalid_at"))


@query("w3_balanced_window", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY ts DESC, turn_id DESC) AS rn, least(count(*) FILTER (role = 'user') OVER (PARTITION BY session_id), 3) AS u FROM kg_turns WHERE role IN ('user', 'assistant'))
SELECT session_id, turn_id, role FROM r WHERE CASE WHEN role = 'user' THEN rn <= 3 ELSE rn <= 4 - u END""")
def w3(t):
    return context.balanced_window(t.turns, 4).select("session_id", "turn_id", "role")


@query("w4_turns_before", """
SELECT t.session_id, m.user_msg_id AS msg_id, t.turn_id FROM kg_turns m JOIN kg_turns t ON t.session_id = m.session_id AND t.ts < m.ts WHERE m.user_msg_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY t.session_id, m.user_msg_id ORDER BY t.ts DESC, t.turn_id DESC) <= 2""")
def w4(t):
    return context.turns_before(t.turns, t.turns.where("user_msg_id is not null").select("session_id", F.col("user_msg_id").alias("msg_id")), 2).drop("rn")


@query("w5_trim_history", "SELECT session_id, turn_id FROM kg_turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id DESC) <= 4")
def w5(t):
    return context.trim_history(t.turns, 4).select("session_id", "turn_id")


@query("w7_recent_events", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def w7(t):
    return stats.top_per_group(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("w8_idle", f"SELECT user_id AS session_id, CAST(epoch({NOW}) - floor(epoch(max(ts))) AS BIGINT) AS idle_s, CAST(epoch({NOW}) - floor(epoch(max(ts))) AS BIGINT) >= 90000 AS is_idle FROM events GROUP BY user_id")
def w8(t):
    return context.idle(t.events.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts")), now(), 90000)


@query("w9_accumulate", """
WITH u AS (SELECT id AS key, 0 AS i, round(turn / 10.0, 6) AS score, content FROM kg_messages WHERE turn < 4 UNION ALL SELECT id, 1, CAST(NULL AS DOUBLE), 'late' FROM kg_messages WHERE turn >= 3)
SELECT key, coalesce(score, 0.5) AS score, content FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) AS rn FROM u) WHERE rn = 1 ORDER BY coalesce(score, 0.5) DESC, key LIMIT 30""")
def w9(t):
    a = t.messages.where("turn < 4").select(F.col("id").alias("key"), F.round(F.col("turn") / 10.0, 6).alias("score"), "content")
    b = t.messages.where("turn >= 3").select(F.col("id").alias("key"), F.lit(None).cast("double").alias("score"), F.lit("late").alias("content"))
    return context.accumulate(a, b)


@query("f5_message_hash", "SELECT id, substr(sha256(session_id || ':' || content || ':' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)), 1, 12) AS hash FROM kg_messages")
def f5(t):
    return t.messages.select("id", scalars.msg_hash(F.col("session_id"), F.col("content"), F.unix_timestamp("ts")).alias("hash"))


@query("f6_date_label", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN substr('about ' || event_type, 1, 10) ELSE 'unknown' END AS label FROM events")
def f6(t):
    k = F.col("event_id") % 3
    return t.events.select("event_id", scalars.date_label(F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.concat(F.lit("about "), "event_type"))).alias("label"))


@query("f7_sigmoid", "SELECT event_id, round(1 / (1 + exp(-greatest(-500, least(500, value - 10)))), 6) AS s FROM events")
def f7(t):
    return t.events.select("event_id", F.round(scalars.sigmoid(F.col("value") - 10), 6).alias("s"))


@query("f9_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f9(t):
    got = F.from_json("props", "map<string,bigint>")
    back = F.from_json(F.to_json(got), "map<string,bigint>")
    return t.events.select("event_id", back["k"].alias("k"))


@query("f10_transcript", "SELECT session_id, string_agg('[' || upper(role) || ']: ' || content, chr(10) ORDER BY ts, turn_id) AS transcript FROM kg_turns GROUP BY session_id")
def f10(t):
    return context.transcript(t.turns, ["session_id"])


@query("f11_render", "SELECT id, '- ' || canonical_name || ' (' || coalesce(type, 'unknown') || ', ' || coalesce(topic, 'unknown') || ')' AS line FROM kg_entities")
def f11(t):
    return t.entities.select("id", rendered("entity").alias("line"))


@query("f12_html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS s FROM pages""")
def f12(t):
    return t.pages.select("page_id", scalars.html_escape(F.col("html")).alias("s"))


@query("f13_label_block", "SELECT string_agg('- ' || name || ': ' || replace(labels, ',', ', '), chr(10) ORDER BY '- ' || name || ': ' || replace(labels, ',', ', ')) AS block FROM kg_topics WHERE active AND name IN (SELECT topic FROM kg_entities)")
def f13(t):
    return topics.label_block(t.topics.join(t.entities.select(F.col("topic").alias("name")), "name", "left_semi"))


@query("u4_topic_delta", """
WITH n AS (SELECT topic AS name, max(id) % 2 = 0 AS active FROM kg_entities WHERE topic IS NOT NULL GROUP BY topic)
SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.active AND NOT n.active THEN 'deactivated' WHEN NOT o.active AND n.active THEN 'activated' ELSE 'unchanged' END AS change FROM kg_topics o FULL JOIN n ON o.name = n.name""")
def u4(t):
    return topics.topic_delta(t.topics, t.entities.where("topic is not null").groupBy(F.col("topic").alias("name")).agg((F.max("id") % 2 == 0).alias("active")))
