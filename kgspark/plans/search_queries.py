"""Vector, text and hybrid search, resolution and fact reconciliation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import scalars
from kgspark.functions.udfs import hashed_embedding, ratio
from kgspark.operators import facts as fact_ops
from kgspark.operators import discussions, factcheck, graph, ingest, search, stats
from kgspark.operators.recovery import saved
from kgspark.plans.read_queries import ACTIVE, ACTIVE_SQL
from kgspark.plans.registry import query


def vecs(t):
    return t.vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def asked(t):
    return t.vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
TOPK = f"""SELECT q.vec_id AS qid, v.vec_id AS id, round({COS.format(a='q.embedding', b='v.embedding')}, 4) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.embedding', b='v.embedding')}, 9) DESC, v.vec_id) AS INTEGER) AS rank FROM kg_vectors q, kg_vectors v WHERE q.vec_id % 20 = 0 QUALIFY rank <= {{k}}"""


@query("r1_vector_topk", TOPK.format(k=10))
def r1(t):
    return search.vector_topk(asked(t), vecs(t), 10).withColumn("score", F.round("score", 4))


@query("r2_vector_topk_floor", f"SELECT * FROM ({TOPK.format(k=10)}) WHERE score >= 0.3")
def r2(t):
    return search.vector_topk(asked(t), vecs(t), 10, floor=0.29995).withColumn("score", F.round("score", 4)).where("score >= 0.3")


@query("r3_knn_self", f"SELECT q.vec_id AS id, v.vec_id AS other FROM kg_vectors q, kg_vectors v QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.embedding', b='v.embedding')}, 9) DESC, v.vec_id) <= 10 AND q.vec_id <> v.vec_id")
def r3(t):
    return search.knn_self(vecs(t), 10).select("id", "other")


def fact_vecs(t):
    return t.facts.join(t.vectors, "vec_id", "left").withColumnRenamed("embedding", "vec")


FV = "(SELECT f.*, v.embedding AS vec FROM kg_facts f LEFT JOIN kg_vectors v ON v.vec_id = f.vec_id)"


@query("r4_relevant_facts", f"""
SELECT source_entity_id AS entity_id, f.id, CAST(row_number() OVER (PARTITION BY source_entity_id ORDER BY round({COS.format(a='f.vec', b='q.embedding')}, 9) DESC, f.id) AS INTEGER) AS rank FROM {FV} f JOIN kg_vectors q ON q.vec_id = f.source_entity_id - 1000000 WHERE invalid_at IS NULL AND vec IS NOT NULL QUALIFY rank <= 2""")
def r4(t):
    q = t.vectors.select((F.col("vec_id") + 1000000).alias("entity_id"), F.col("embedding").alias("qvec"))
    return search.relevant_facts(fact_vecs(t), q, 2).select("entity_id", "id", "rank")


BM25 = """WITH w AS (SELECT id, term FROM (SELECT id, unnest(string_split(lower(text), ' ')) AS term FROM ({corpus})) WHERE term <> ''), l AS (SELECT id, count(*) AS dl FROM w GROUP BY id), s AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
q AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest(string_split(lower(text), ' ')) AS term FROM ({queries})) WHERE term <> '' GROUP BY qid, term), tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT qid, id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (id), s GROUP BY qid, id)"""
DOCS = "SELECT doc_id AS id, text FROM documents"
QS = "SELECT qid, text FROM kg_queries"


def docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


@query("r7_bm25", BM25.format(corpus=DOCS, queries=QS) + " SELECT qid, id, round(score, 4) AS score FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 20")
def r7(t):
    return search.bm25(docs(t), t.queries, 20).select("qid", "id", F.round("score", 4).alias("score"))


MSGS = "SELECT id, content AS text FROM kg_messages"
SAN = """SELECT qid, trim(regexp_replace(regexp_replace(text, '[+\\-&|!(){}\\[\\]^"~*?:\\\\/]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM kg_queries"""


@query("r6_message_search", BM25.format(corpus=MSGS, queries=SAN) + " SELECT qid, id, round(score, 4) AS score FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 10")
def r6(t):
    q = t.queries.select("qid", scalars.sanitize(F.col("text")).alias("text"))
    return search.bm25(t.messages.select("id", F.col("content").alias("text")), q, 10).select("qid", "id", F.round("score", 4).alias("score"))


EQ = f"SELECT row_number() OVER (ORDER BY p_name) AS qid, p_name AS text FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey < 40)"


@query("r5_entity_search", BM25.format(corpus=f"SELECT id, canonical_name || ' ' || alias1 AS text FROM kg_entities WHERE topic IS NULL OR topic IN {ACTIVE_SQL}", queries="SELECT n_nationkey AS qid, n_name AS text FROM nation") + f""",
h AS (SELECT qid, id, round(score, 4) AS score, canonical_name FROM b JOIN kg_entities USING (id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 5),
fx AS (SELECT source_entity_id AS id, string_agg(content, ';' ORDER BY created_at DESC, fid DESC) AS facts FROM (SELECT *, id AS fid, row_number() OVER (PARTITION BY source_entity_id ORDER BY created_at DESC, id DESC) AS k FROM kg_facts WHERE invalid_at IS NULL) WHERE k <= 5 GROUP BY 1),
un AS (SELECT a_id AS src, b_id AS dst, weight FROM kg_related_to UNION ALL SELECT b_id, a_id, weight FROM kg_related_to), cx AS (SELECT src AS id, array_to_string(array_agg(dst ORDER BY k), ',') AS connections FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM un) WHERE k <= 5 GROUP BY 1)
SELECT qid, h.id, score, canonical_name, facts, (SELECT min(parent_id) FROM kg_part_of WHERE child_id = h.id) AS parent_id, (SELECT count(*) FROM kg_part_of WHERE parent_id = h.id) AS n_children, connections FROM h LEFT JOIN fx USING (id) LEFT JOIN cx USING (id)""")
def r5(t):
    q = t.nation.select(F.col("n_nationkey").alias("qid"), F.col("n_name").alias("text"))
    got = search.entity_cards(search.search_entity(t.entities, q, ACTIVE, 5), t.facts, t.part_of, t.related_to)
    return got.select("qid", "id", F.round("score", 4).alias("score"), "canonical_name", F.array_join("facts", ";").alias("facts"), "parent_id", "n_children", F.array_join(F.col("connections").cast("array<string>"), ",").alias("connections"))


def hybrid_parts(t):
    v = search.vector_topk(t.vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), vecs(t), 50)
    return v, search.bm25(docs(t), t.queries, 50)


HY = BM25.format(corpus=DOCS, queries=QS) + f""", tx AS (SELECT qid, id, score / max(score) OVER (PARTITION BY qid) AS s FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 50)),
vx AS (SELECT q.vec_id AS qid, v.vec_id AS id, {COS.format(a='q.embedding', b='v.embedding')} AS s FROM kg_vectors q, kg_vectors v WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.embedding', b='v.embedding')}, 9) DESC, v.vec_id) <= 50),
h AS (SELECT coalesce(vx.qid, tx.qid) AS qid, coalesce(vx.id, tx.id) AS id, coalesce(vx.s, 0) + coalesce(tx.s, 0) AS score FROM vx FULL JOIN tx ON vx.qid = tx.qid AND vx.id = tx.id)"""


@query("r8_hybrid_search", HY + " SELECT qid, id, round(score, 4) AS score FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 20")
def r8(t):
    return search.hybrid(*hybrid_parts(t), 20).select("qid", "id", F.round("score", 4).alias("score"))


@query("r9_rerank", HY + """, c AS (SELECT qid, id FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 45),
o AS (SELECT c.qid, c.id, len(list_intersect(list_distinct(string_split(lower(q.text), ' ')), list_distinct(string_split(lower(d.text), ' ')))) / len(list_distinct(string_split(lower(q.text), ' '))) AS score FROM c JOIN kg_queries q ON q.qid = c.qid JOIN documents d ON d.doc_id = c.id)
SELECT qid, id, round(score, 4) AS score FROM o QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 8""")
def r9(t):
    cands = search.hybrid(*hybrid_parts(t), 45)
    return search.rerank(cands, docs(t), t.queries, search.overlap_score).select("qid", "id", F.round("score", 4).alias("score"))


CH = "SELECT id || '_parent_' || k AS id, doc_id, doc_id * 1000000 + k AS k, substr(text, 1 + k * 1800, 2000) AS text FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 200) / 1800.0) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0)"


@query("r10_parent_retrieval", BM25.format(corpus=CH, queries=QS) + f""", c AS (SELECT qid, id FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 35)
 UNION SELECT qid, id FROM (SELECT q.qid, ch.id FROM kg_queries q JOIN kg_vectors qv ON qv.vec_id = q.qid, ({CH}) ch JOIN kg_vectors v ON v.vec_id = ch.doc_id QUALIFY row_number() OVER (PARTITION BY q.qid ORDER BY round({COS.format(a='qv.embedding', b='v.embedding')}, 9) DESC, ch.k) <= 35)),
p AS (SELECT DISTINCT qid, split_part(id, '_parent_', 1) AS parent_id FROM c),
s2 AS (SELECT p.qid, parent_id, len(list_intersect(list_distinct(string_split(lower(q.text), ' ')), list_distinct(string_split(lower(d.text), ' ')))) / len(list_distinct(string_split(lower(q.text), ' '))) AS raw FROM p JOIN kg_queries q ON q.qid = p.qid JOIN documents d ON CAST(d.doc_id AS VARCHAR) = parent_id)
SELECT qid, parent_id, round(1 / (1 + exp(-raw)), 4) AS score FROM s2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, parent_id) <= 8""")
def r10(t):
    """Children by text and by vector (a chunk has its document's vector), their documents rescored."""
    c = ingest.chunk(docs(t), 2000, 200).select(F.col("id").alias("doc_id"), F.concat_ws("_parent_", F.col("id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "text", (F.col("id") * 1000000 + F.col("chunk_index")).alias("k"))
    kids = c.select("id", F.col("doc_id").cast("string").alias("parent_id"))
    q = t.queries.join(t.vectors, F.col("qid") == F.col("vec_id")).select("qid", F.col("embedding").alias("vec"))
    near = search.vector_topk(q, c.join(t.vectors, F.col("doc_id") == F.col("vec_id")).select(F.col("k").alias("id"), F.col("embedding").alias("vec")), 35)
    near = near.select("qid", F.concat(F.floor(F.col("id") / 1000000).cast("string"), F.lit("_parent_"), (F.col("id") % 1000000).cast("string")).alias("id"), "score")
    hits = search.bm25(c, t.queries, 35).select("qid", "id", "score").unionByName(near)
    parents = docs(t).select(F.col("id").cast("string").alias("parent_id"), "text")
    return search.parent_retrieval(hits, kids, 8, parents, t.queries, search.overlap_score).select("qid", "parent_id", "score")


@query("x2_chunks", f"""
SELECT id AS parent_id, id || '_child_' || j AS id, CAST(j AS INTEGER) AS chunk_index, substr(text, 1 + j * 462, 512) AS text FROM (SELECT id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 50) / 462.0) AS BIGINT)))) AS j FROM ({CH}))""")
def x2(t):
    return ingest.parent_child_chunks(docs(t))


@query("x2_split_chunks")
def x2b(t):
    """Chunks that break at paragraphs, lines and words."""
    return ingest.split_parents_and_children(docs(t))


@query("x1_hashed_embedding", "SELECT id, array_to_string(list_transform(range(16), lambda i: CAST(len(list_filter(list_transform(list_filter(string_split(lower(content), ' '), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16), lambda s: s = i)) AS VARCHAR)), ',') AS vec FROM kg_messages")
def x1(t):
    return t.messages.select("id", F.array_join(F.transform(hashed_embedding(F.col("content"), 16), lambda x: x.cast("int").cast("string")), ",").alias("vec"))


@query("f1_cosine", f"SELECT vec_id, round({COS.format(a='embedding', b='list_reverse(embedding)')}, 6) AS c FROM embeddings")
def f1(t):
    return t.embeddings.select("vec_id", F.round(scalars.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("c"))


@query("f2_l2norm", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings")
def f2(t):
    return t.embeddings.select("vec_id", F.round(scalars.l2norm(F.col("embedding"))[0], 6).alias("first"))


@query("f3_substring_match", "SELECT p_partkey, contains(lower(p_name), lower(p_type)) OR contains(lower(p_type), lower(p_name)) OR contains(lower(p_brand || p_name), lower(p_name)) AS hit FROM part")
def f3(t):
    return t.part.select("p_partkey", (scalars.substring_match(F.col("p_name"), F.col("p_type")) | scalars.substring_match(F.concat("p_brand", "p_name"), F.col("p_name"))).alias("hit"))


def lcs_sql(a, b):
    """Length of the longest common subsequence of two short columns in SQL: a row of the table as the bits of a number."""
    full = f"((CAST(1 AS HUGEINT) << CAST(length({a}) AS INTEGER)) - 1)"
    bits = f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = c THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)), 0)::HUGEINT)"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count(list_reduce({bits}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})) END"


def ratio_sql(a, b):
    return f"(200.0::DOUBLE * ({lcs_sql(a, b)}) / (length({a}) + length({b})))"


@query("f4_indel_ratio", f"SELECT p_partkey, round({ratio_sql('p_name', 'b')}, 6) AS ratio, round({ratio_sql('p_name', 'b')}, 6) AS native FROM (SELECT p_partkey, p_name, p_type || ' ' || p_name AS b FROM part)")
def f4(t):
    # A small file is few tasks, and the rows are much work.
    pairs = t.part.select("p_partkey", F.col("p_name").alias("a"), F.concat("p_type", F.lit(" "), "p_name").alias("b")).repartition("p_partkey")
    return pairs.select("p_partkey", F.round(ratio("a", "b"), 6).alias("ratio"), F.round(scalars.indel_ratio(F.col("a"), F.col("b")), 6).alias("native"))


def mentions(t):
    return t.supplier.select(F.concat(F.lower("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("x")).otherwise(F.lit(""))).alias("mention"))


# Of these names, one word each or much shorter, none is alike by words or parts, so the weighted ratio is the plain one.
FUZZY = f"""m AS (SELECT lower(s_name) || CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '' END AS mention, s_suppkey FROM supplier), n AS (SELECT DISTINCT id, lower(name) AS name FROM (SELECT id, canonical_name AS name FROM kg_entities UNION ALL SELECT id, alias1 FROM kg_entities) WHERE name IS NOT NULL),
f AS (SELECT mention, id, max(r) / 100 AS score FROM (SELECT mention, id, {ratio_sql('mention', 'name')} AS r FROM m, n WHERE abs(length(mention) - length(name)) * 100 <= 15 * (length(mention) + length(name))) WHERE r >= 85 GROUP BY mention, id QUALIFY row_number() OVER (PARTITION BY mention ORDER BY round(max(r), 7) DESC, id) <= 5)"""


@query("r11_fuzzy_candidates", f"WITH {FUZZY} SELECT mention, id, round(score, 6) AS score FROM f")
def r11(t):
    return search.fuzzy_candidates(mentions(t), graph.alias_names(t.entities), 85, 5).select("mention", "id", F.round("score", 6).alias("score"))


def turned_parts(t):
    """Mentions of parts with their words in another order, and some cut short or misspelt."""
    words, k = F.split("p_name", " "), F.col("p_partkey") % 4
    said = F.when(k == 0, F.array_join(F.reverse(words), " ")).when(k == 1, F.concat_ws(" ", F.element_at(words, -1), F.element_at(words, 1))).when(k == 2, F.substring("p_name", 1, 9)).otherwise(F.concat("p_name", F.lit("s")))
    return t.part.select(said.alias("mention")).distinct()


@query("r11_weighted_candidates")
def r11b(t):
    """The weighted ratio in full: words in any order, subsets and parts, of every part's name."""
    names = t.part.groupBy(F.lower("p_name").alias("name")).agg((2000000 + F.min("p_partkey")).alias("id"))
    return search.fuzzy_candidates(turned_parts(t), names, 85, 50).select("mention", "id", F.round("score", 6).alias("score"))


def fused(t):
    fuzzy = search.fuzzy_candidates(mentions(t), graph.alias_names(t.entities), 85, 5)
    exact = graph.alias_names(t.entities).select(F.col("name").alias("mention"), "id", F.lit(1.0).alias("score")).join(mentions(t), "mention", "left_semi")
    # A mention's vector is that of its supplier; the five nearest suppliers of a cosine of 0.85 or more are candidates too.
    own = t.supplier.select(F.concat(F.lower("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("x")).otherwise(F.lit(""))).alias("mention"), F.col("s_suppkey").alias("qid"))
    v = t.vectors.join(t.supplier.select(F.col("s_suppkey").alias("vec_id")), "vec_id", "left_semi")
    near = search.vector_topk(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), v.select((F.col("vec_id") + 1000).alias("id"), F.col("embedding").alias("vec")), 5, floor=0.85)
    return search.fuse(exact, fuzzy, own.join(near, "qid").select("mention", "id", "score"))


@query("r12_candidate_fusion", f"""WITH {FUZZY}, x AS (SELECT mention, id, CAST(1 AS DOUBLE) AS score FROM m JOIN n ON n.name = m.mention),
v AS (SELECT vec_id, embedding FROM kg_vectors JOIN supplier ON s_suppkey = vec_id), k AS (SELECT q.vec_id AS qid, v.vec_id + 1000 AS id, {COS.format(a='q.embedding', b='v.embedding')} AS score FROM v q, v QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.embedding', b='v.embedding')}, 9) DESC, v.vec_id) <= 5)
SELECT mention, id, round(max(score), 6) AS score FROM (SELECT mention, id, score FROM x UNION ALL SELECT mention, id, score FROM f UNION ALL SELECT mention, id, score FROM k JOIN m ON m.s_suppkey = k.qid WHERE score >= 0.85) GROUP BY mention, id""")
def r12(t):
    return fused(t).select("mention", "id", F.round("score", 6).alias("score"))


@query("r13_resolve_best", "SELECT lower(s_name) || CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '' END AS mention, 1000 + s_suppkey AS id, s_name AS canonical_name FROM supplier WHERE s_suppkey % 2 = 1")
def r13(t):
    got = search.resolve_best(fused(t), t.entities)
    return got.join(t.supplier.where("s_suppkey % 2 = 1").select(F.lower("s_name").alias("mention")), "mention", "left_semi")


@query("r14_fact_check", """
WITH w AS (SELECT ' ' || array_to_string(list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}'']+'), lambda x: x <> ''), ' ') || ' ' AS words FROM kg_messages)
SELECT n.name, CASE WHEN e.id IS NOT NULL THEN 'name' ELSE 'messages' END AS resolution, coalesce(e.id, -1) AS entity_id, CASE WHEN e.id IS NOT NULL THEN (SELECT count(*) FROM kg_facts f WHERE f.source_entity_id = e.id) ELSE (SELECT count(*) FROM w WHERE contains(words, ' ' || array_to_string(list_filter(string_split_regex(lower(n.name), '[^\\p{L}\\p{N}'']+'), lambda x: x <> ''), ' ') || ' ')) END AS evidence
FROM (SELECT c_name AS name FROM customer UNION ALL SELECT alias FROM kg_term_aliases) n LEFT JOIN kg_entities e ON lower(e.canonical_name) = lower(n.name)""")
def r14(t):
    names = t.customer.select(F.col("c_name").alias("name")).unionByName(t.term_aliases.select(F.col("alias").alias("name")))
    exact = names.join(t.entities.select(F.lower("canonical_name").alias("k"), F.col("id").alias("entity_id")), F.lower("name") == F.col("k")).select("name", "entity_id")
    by_name = exact.join(t.facts.groupBy(F.col("source_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n")), "entity_id", "left").select("name", F.lit("name").alias("resolution"), "entity_id", F.coalesce("n", F.lit(0)).alias("evidence"))
    rest = names.join(exact.select("name"), "name", "left_anti")
    found = ingest.tag_known(t.messages, rest.select(F.col("name").alias("alias"), F.lit(0).alias("id"))).groupBy(F.col("name").alias("k")).agg(F.count_distinct("msg_id").alias("n"))
    hits = rest.join(found, F.lower("name") == F.col("k"), "left").select("name", F.coalesce("n", F.lit(0)).alias("evidence"))
    return by_name.unionByName(hits.select("name", F.lit("messages").alias("resolution"), F.lit(-1).cast("long").alias("entity_id"), "evidence"))


ASKED = """a AS (SELECT c_custkey AS qid, c_name AS name, embedding AS vec, '' AS question, embedding AS question_vec FROM customer LEFT JOIN kg_vectors ON vec_id = c_custkey
 UNION ALL SELECT 1000000 + vec_id, 'someone ' || vec_id, embedding, '', list_reverse(embedding) FROM kg_vectors UNION ALL SELECT 2000000 + item_id, 'item ' || item_id, list_reverse(embedding), text, embedding FROM benchmark LEFT JOIN kg_vectors ON vec_id = item_id)"""


@query("r14_fact_cascade", BM25.format(corpus=MSGS, queries="SELECT 2000000 + item_id AS qid, text FROM benchmark") + f""", {ASKED},
x AS (SELECT DISTINCT qid, e.id AS entity_id FROM a JOIN (SELECT id, lower(canonical_name) AS name FROM kg_entities UNION SELECT id, lower(alias1) FROM kg_entities) e ON e.name = lower(a.name)),
rest AS (SELECT * FROM a WHERE qid NOT IN (SELECT qid FROM x)), ev AS (SELECT id, embedding AS vec FROM kg_entities e JOIN kg_vectors v ON v.vec_id = e.vec_id),
n AS (SELECT qid, id AS entity_id, s AS similarity FROM (SELECT qid, ev.id, {COS.format(a='rest.vec', b='ev.vec')} AS s, row_number() OVER (PARTITION BY qid ORDER BY round({COS.format(a='rest.vec', b='ev.vec')}, 9) DESC, ev.id) AS k FROM rest, ev WHERE rest.vec IS NOT NULL) WHERE k <= 5 AND s >= 0.69),
t AS (SELECT qid, n.entity_id, similarity, f.id AS evidence, count(f.id) OVER (PARTITION BY qid) AS total, row_number() OVER (PARTITION BY qid, n.entity_id ORDER BY round(coalesce({COS.format(a='a.question_vec', b='f.vec')}, 0), 9) DESC, f.id) AS k FROM n JOIN a USING (qid) LEFT JOIN {FV} f ON f.source_entity_id = n.entity_id),
m AS (SELECT qid, id, score FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 8)
SELECT qid, 'exact' AS resolution, entity_id, 1.0::DOUBLE AS similarity, f.id AS evidence FROM x LEFT JOIN kg_facts f ON f.source_entity_id = entity_id
UNION ALL SELECT qid, 'vector', entity_id, round(similarity, 6), evidence FROM t WHERE total <= 60 OR k <= 20
UNION ALL SELECT rest.qid, 'fallback', CAST(NULL AS BIGINT), round(m.score, 6), CAST(m.id AS VARCHAR) FROM rest LEFT JOIN m ON m.qid = rest.qid WHERE rest.qid NOT IN (SELECT qid FROM n)""")
def r14b(t):
    """Customers by name, vectors of entities under other names, and questions whose vectors are near to nothing."""
    v = t.vectors
    a = t.customer.join(v, F.col("c_custkey") == F.col("vec_id"), "left").select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("name"), F.col("embedding").alias("vec"), F.lit("").alias("question"), F.col("embedding").alias("question_vec"))
    a = a.unionByName(v.select((1000000 + F.col("vec_id")).alias("qid"), F.concat(F.lit("someone "), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vec"), F.lit("").alias("question"), F.reverse("embedding").alias("question_vec")))
    q = t.benchmark.join(v, F.col("item_id") == F.col("vec_id"), "left")
    a = a.unionByName(q.select((2000000 + F.col("item_id")).alias("qid"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), F.reverse("embedding").alias("vec"), F.col("text").alias("question"), F.col("embedding").alias("question_vec")))
    e = t.entities.join(v, "vec_id", "left").select("id", "canonical_name", "alias1", F.col("embedding").alias("vec"))
    got = factcheck.fact_check(a, e, fact_vecs(t), t.messages.select("id", F.col("content").alias("text")), many=60, cut=20)
    return got.withColumn("similarity", F.round("similarity", 6))


@query("r16_preferences", "SELECT user_id, event_id, event_type AS kind FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) <= 3")
def r16(t):
    some = t.events.where(F.col("event_type").isin("click", "view")).withColumnRenamed("event_type", "kind")
    return stats.top_per_group(some, ["user_id", "kind"], [F.desc("ts"), "event_id"], 3).select("user_id", "event_id", "kind")


@query("r17_transcripts", """
SELECT 'said' AS kind, session_id AS key, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS INTEGER) AS place, CAST(id AS VARCHAR) AS id FROM kg_messages
UNION ALL SELECT 'discussion', session_id, CAST(row_number() OVER (ORDER BY min(ts) DESC, session_id) AS INTEGER), CAST(count(*) AS VARCHAR) FROM kg_messages GROUP BY session_id
UNION ALL SELECT 'insight', CAST(0 AS BIGINT), CAST(0 AS INTEGER), id FROM (SELECT id FROM kg_facts WHERE source = 'llm' ORDER BY created_at DESC, id LIMIT 20)""")
def r17(t):
    """Transcripts in time order, all discussions newest first, and the newest insights."""
    said = t.messages.select("id", F.col("session_id").alias("discussion_id"), "ts", "content")
    all_ = discussions.listing(said.groupBy(F.col("discussion_id").alias("id")).agg(F.min("ts").alias("opened_at")), said)
    newest = all_.withColumn("place", F.row_number().over(W.orderBy(F.desc("opened_at"), "id")))
    out = discussions.transcript(said).select(F.lit("said").alias("kind"), F.col("discussion_id").alias("key"), "place", F.col("id").cast("string").alias("id"))
    out = out.unionByName(newest.select(F.lit("discussion").alias("kind"), F.col("id").alias("key"), "place", F.col("n_messages").cast("string").alias("id")))
    return out.unionByName(discussions.insights(t.facts, 20).select(F.lit("insight").alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("place"), "id"))


@query("r18_spawn_tree", """
WITH RECURSIVE p AS (SELECT child_id, min(parent_id) AS parent_id FROM kg_part_of GROUP BY child_id), c AS (SELECT child_id, parent_id AS at, 1 AS depth FROM p UNION ALL SELECT c.child_id, p.parent_id, depth + 1 FROM c JOIN p ON p.child_id = c.at)
SELECT child_id, parent_id, type AS detail, CAST(max(depth) AS INTEGER) AS depth FROM p JOIN kg_entities ON id = child_id JOIN c USING (child_id) GROUP BY ALL""")
def r18(t):
    spawns = t.part_of.join(t.entities.select(F.col("id").alias("child_id"), F.col("type").alias("detail"), F.col("last_mentioned").alias("ts")), "child_id").select("parent_id", "child_id", "detail", "ts")
    return discussions.spawn_tree(discussions.record_spawns(spawns.where("child_id % 2 = 0"), spawns)).select("child_id", "parent_id", "detail", "depth")


@query("r19_proposals", "SELECT CAST(row_number() OVER (PARTITION BY context ORDER BY last_seen, a_id, b_id) AS INTEGER) AS place, context, a_id, b_id FROM kg_related_to")
def r19(t):
    return stats.numbered(t.related_to, ["context"], ["last_seen", "a_id", "b_id"]).select("place", "context", "a_id", "b_id")


def merge_candidates(t, k=50):
    """D1 over all entities with vectors."""
    knn = search.knn_self(t.entities.join(t.vectors, "vec_id").select("id", F.col("embedding").alias("vec")), k)
    return fact_ops.merge_pairs(knn, t.entities, stats.generic_tokens(t.entities.select("id", F.lower("canonical_name").alias("name")), 400))


@query("d1_merge_pairs")
def d1(t):
    return merge_candidates(t).select("lo", "hi", F.round("score", 6).alias("score"))


NAMED = f"""c AS (SELECT DISTINCT least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi FROM (SELECT id, lower(canonical_name) AS name FROM kg_entities UNION SELECT id, lower(alias1) FROM kg_entities) a JOIN (SELECT id, lower(canonical_name) AS name FROM kg_entities UNION SELECT id, lower(alias1) FROM kg_entities) b ON a.name = b.name AND a.id < b.id),
p AS (SELECT lo, hi, {ratio_sql('na', 'nb')} AS score, coalesce({COS.format(a='va', b='vb')}, 0) AS cos, ta IS NOT DISTINCT FROM tb AS same_type, pa IS DISTINCT FROM pb AS cross_topic
 FROM (SELECT lo, hi, lower(a.canonical_name) AS na, lower(b.canonical_name) AS nb, a.type AS ta, b.type AS tb, a.topic AS pa, b.topic AS pb, va.embedding AS va, vb.embedding AS vb FROM c JOIN kg_entities a ON a.id = lo JOIN kg_entities b ON b.id = hi LEFT JOIN kg_vectors va ON va.vec_id = a.vec_id LEFT JOIN kg_vectors vb ON vb.vec_id = b.vec_id)),
un AS (SELECT a_id AS src, b_id AS dst FROM kg_related_to UNION SELECT b_id, a_id FROM kg_related_to), s AS (SELECT lo, hi, count(*) AS shared FROM p JOIN un x ON x.src = lo JOIN un y ON y.src = hi AND y.dst = x.dst WHERE x.dst <> 1 GROUP BY lo, hi)"""


@query("d2_classify_pairs", f"""WITH {NAMED} SELECT lo AS a_id, hi AS b_id, round(score, 6) AS score, round(cos, 6) AS cos, cross_topic, coalesce(shared, 0) AS shared FROM p LEFT JOIN s USING (lo, hi)
WHERE NOT EXISTS (SELECT 1 FROM un WHERE src = lo AND dst = hi) AND NOT EXISTS (SELECT 1 FROM kg_part_of WHERE (child_id = lo AND parent_id = hi) OR (child_id = hi AND parent_id = lo)) AND (NOT cross_topic OR same_type AND score >= 85) AND (coalesce(shared, 0) = 0 OR same_type AND score >= 95)""")
def d2(t):
    """Pairs that share a name, with their ratio and cosine."""
    e = t.entities.join(t.vectors, "vec_id", "left").select("id", "canonical_name", "alias1", "type", "topic", F.col("embedding").alias("vec"))
    got = fact_ops.classify_named(e, t.related_to, t.part_of)
    return got.select("a_id", "b_id", F.round("score", 6).alias("score"), F.round("cos", 6).alias("cos"), "cross_topic", "shared")


@query("d2_classify_neighbours")
def d2b(t):
    """D1's own pairs, classified."""
    got = fact_ops.classify_pairs(saved(merge_candidates(t)), t.entities, t.related_to, t.part_of)
    return got.select("a_id", "b_id", F.round("score", 6).alias("score"), "cross_topic", "shared")


P3 = "(SELECT a_id, b_id, round(confidence - (weight % 3) * 0.1, 6) AS cos, a_id % 2 = b_id % 2 AS same_topic, weight > 2 AS alias_hit, weight % 2 AS facts_a, 1 AS facts_b FROM kg_related_to)"


def graded(t):
    return t.related_to.select("a_id", "b_id", F.round(F.col("confidence") - F.col("weight") % 3 * 0.1, 6).alias("cos"), (F.col("a_id") % 2 == F.col("b_id") % 2).alias("same_topic"), (F.col("weight") > 2).alias("alias_hit"), (F.col("weight") % 2).alias("facts_a"), F.lit(1).alias("facts_b"))


@query("d3_merge_decision", f"SELECT a_id, b_id, CASE WHEN alias_hit AND same_topic THEN 'auto' WHEN facts_a < 1 OR facts_b < 1 THEN 'reject' WHEN cos >= 0.93 AND same_topic THEN 'auto' WHEN cos < 0.65 THEN 'reject' ELSE 'review' END AS decision FROM {P3}")
def d3(t):
    return fact_ops.decide(graded(t)).select("a_id", "b_id", "decision")


@query("d4_review_decision", "SELECT a_id, b_id, CASE WHEN s >= 0.93 THEN 'auto' WHEN s >= 0.65 THEN 'review' ELSE 'reject' END AS decision FROM (SELECT a_id, b_id, CASE WHEN quality = 1 THEN 0.95 ELSE 0.475 END AS s FROM kg_related_to JOIN labels ON doc_id = a_id % 400 WHERE weight >= 2)")
def d4(t):
    pairs = t.related_to.where("weight >= 2").withColumn("pair", F.col("a_id") % 400)
    judged = t.labels.select(F.col("doc_id").alias("pair"), (F.col("quality") == 1).alias("flag"), F.lit(0.95).alias("confidence"))
    return fact_ops.review(pairs.drop("confidence"), judged).select("a_id", "b_id", "decision")


@query("d8_duplicate_facts", f"""
WITH p AS (SELECT DISTINCT source_entity_id AS primary_id, source_entity_id + 1 AS secondary_id FROM kg_facts WHERE source_entity_id % 2 = 0), v AS (SELECT source_entity_id, id, vec FROM {FV} WHERE invalid_at IS NULL AND vec IS NOT NULL)
SELECT primary_id, secondary_id, a.id, round(max({COS.format(a='a.vec', b='b.vec')}), 4) AS score FROM p JOIN v a ON a.source_entity_id = secondary_id JOIN v b ON b.source_entity_id = primary_id GROUP BY 1, 2, 3 HAVING max({COS.format(a='a.vec', b='b.vec')}) >= 0.2""")
def d8(t):
    p = t.facts.where("source_entity_id % 2 = 0").select(F.col("source_entity_id").alias("primary_id"), (F.col("source_entity_id") + 1).alias("secondary_id")).distinct()
    return fact_ops.duplicate_facts(fact_vecs(t), p, 0.2).withColumn("score", F.round("score", 4))


@query("d9_dedupe_facts", f"""
WITH RECURSIVE v AS (SELECT source_entity_id AS e, id, vec, created_at, row_number() OVER (PARTITION BY source_entity_id ORDER BY created_at, id) AS k FROM {FV} WHERE invalid_at IS NULL AND vec IS NOT NULL),
d AS MATERIALIZED (SELECT a.e, b.k, array_agg(a.k) AS bys FROM v a JOIN v b ON a.e = b.e AND a.k < b.k WHERE {COS.format(a='a.vec', b='b.vec')} >= 0.2 GROUP BY a.e, b.k),
g AS (SELECT DISTINCT e, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone FROM v
 UNION ALL SELECT g.e, g.k + 1, CASE WHEN d.k IS NOT NULL AND len(list_filter(d.bys, lambda x: NOT list_contains(g.gone, x))) > 0 THEN list_append(g.gone, g.k + 1) ELSE g.gone END FROM g JOIN v ON v.e = g.e AND v.k = g.k + 1 LEFT JOIN d ON d.e = g.e AND d.k = g.k + 1)
SELECT v.id FROM (SELECT e, max_by(gone, k) AS gone FROM g GROUP BY e) x JOIN v ON v.e = x.e AND list_contains(x.gone, v.k)""")
def d9(t):
    return fact_ops.dedupe_facts(fact_vecs(t), 0.2)


@query("d10_apply_fact_updates")
def d10(t):
    u = t.facts.where("invalid_at is null").select(F.col("source_entity_id").alias("entity_id"), F.col("vec_id").alias("seq"), F.concat("content", F.lit("0")).alias("content"), F.when(F.col("vec_id") % 2 == 0, F.col("content")).alias("supersedes"), F.lit(None).cast("string").alias("invalidates"))
    return fact_ops.apply_fact_updates(t.facts, u)


@query("d11_contradictions", f"""
WITH v AS (SELECT * FROM {FV} WHERE vec IS NOT NULL), p AS (SELECT n.source_entity_id AS entity_id, n.id, o.id AS old_id, {COS.format(a='n.vec', b='o.vec')} AS score FROM v n JOIN v o ON o.source_entity_id = n.source_entity_id AND o.invalid_at IS NULL AND n.id <> o.id AND n.content <> o.content AND n.source_msg_id > o.source_msg_id WHERE n.vec_id % 2 = 0)
SELECT entity_id, id, old_id, round(score, 4) AS score, CAST(ceil(row_number() OVER (PARTITION BY entity_id ORDER BY round(score, 9) DESC, id, old_id) / 4.0) AS BIGINT) AS batch FROM p WHERE score >= 0.1 AND score < 0.95""")
def d11(t):
    f = fact_vecs(t)
    new = f.where("vec_id % 2 = 0").select("id", F.col("source_entity_id").alias("entity_id"), "content", "vec", "source_msg_id")
    return fact_ops.contradiction_pairs(new, f, 0.1, 0.95).withColumn("score", F.round("score", 4))


@query("d16_boost", "SELECT s_name AS mention, 1000 + s_suppkey AS id, round(0.8 + CASE WHEN s_suppkey % 2 = 0 THEN 0.05 ELSE 0 END + least(0.05, 0.03 * (s_suppkey % 3)), 6)::DOUBLE AS score FROM supplier")
def d16(t):
    c = t.supplier.select(F.col("s_name").alias("mention"), (1000 + F.col("s_suppkey")).alias("id"), F.lit(0.8).alias("score"), "s_suppkey")
    j = c.select("mention", "id", (F.col("s_suppkey") % 2 == 0).alias("flag"))
    return fact_ops.boost(c, j, c.select("mention", "id", (F.col("s_suppkey") % 3).alias("overlap")), co_occurrence=True).withColumn("score", F.round("score", 6))
