"""Steps whose work or disk must not grow with the square of the input, held against plain rules on small tables."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions import splitting
from kgspark.functions.scalars import cosine, indel_ratio
from kgspark.functions.udfs import lcs_length, ratio, ratio_of, weighted_ratio_of
from kgspark.operators import facts, graph, greedy, recovery, search, upsert, vectors
from kgspark.plans.fixtures import Tables
from kgspark.plans.registry import graph_queries, search_queries
from kgspark.sources.store import SnapshotStore


SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_same_name_pairs_are_made_once_and_not_shuffled(spark):
    pick = random.Random(5)
    named = [(i, pick.choice(["a", "b", "c"])) for i in range(40)] + [(i, pick.choice(["b", "c", "d", f"own{i}"])) for i in range(40)] + [(None, "a"), (41, None)]
    names = spark.createDataFrame(named, "id long, name string")
    of = {i: {n for j, n in named if i == j and n} for i in range(42)}
    want = [(x, y) for x, y in combinations(range(42), 2) if of[x] & of[y]]
    for block in (3, 2048):
        assert rows(graph.same_name_pairs(names, block), "lo", "hi") == want
    entities = names.groupBy("id").agg(F.min("name").alias("canonical_name"), F.max("name").alias("alias1"))
    got = graph.alias_collisions(entities)
    assert rows(got, "lo", "hi") == want
    above = plan(got).split("Join")[0]  # nothing over the join gathers the pairs again
    assert "Aggregate" not in above and "Distinct" not in above


def test_shared_neighbours_by_each_way(spark):
    pick = random.Random(6)
    hub = [(1000, i) for i in range(200, 260)] + [(1001, i) for i in range(230, 290)] + [(i, 1) for i in range(200, 240)]
    edges = sorted({(pick.randrange(20), 100 + pick.randrange(30)) for _ in range(150)} | set(hub))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    few, many = [(0, 1), (3, 3), (1000, 1001), (1000, 5000), (200, 201)], [(a, b) for a in range(20) for b in range(20)]
    to_hub = [(1000, a) for a in range(20)] + [(1000, a) for a in range(200, 290)]
    e = spark.createDataFrame(edges, "a_id long, b_id long")
    for pairs in (few, many, to_hub, [(b, a) for a, b in to_hub], few + few, []):
        got = graph.shared_neighbors(e, spark.createDataFrame(pairs, "a_id long, b_id long"))
        assert rows(got, "a_id", "b_id", "shared") == sorted((a, b, len((near.get(a, set()) & near.get(b, set())) - {1})) for a, b in pairs)


def test_first_of_a_block_equals_a_full_sort():
    pick = np.random.default_rng(3)
    for k in (1, 4, 9, 20):
        order, ids = -pick.integers(0, 4, (7, 9)) / 3, pick.permutation(9)
        row, col = vectors._first(order, ids, k)
        want = np.lexsort((np.broadcast_to(ids, order.shape), order), axis=1)[:, :k]
        assert (row == np.repeat(np.arange(7), want.shape[1])).all() and (ids[col] == ids[want].ravel()).all()


def test_buckets_are_hashed_once_a_row(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, -float(i % 3)]) for i in range(20)], "id long, vec array<double>")
    got = vectors.Lsh(tables=3).keys(df)
    assert "UDF" not in plan(got) and got.where("size(_keys) = 3").count() == 20


def test_ratios_only_where_they_can_count(spark):
    entities = spark.createDataFrame([(1, "Acme Works"), (2, "Acme Work"), (3, "Other thing"), (4, "Name four")], "id long, canonical_name string")
    knn = spark.createDataFrame([(1, 2, 0.2), (1, 3, 0.95), (2, 4, 0.3)], "id long, other long, score double")
    got = facts.merge_pairs(knn, entities, spark.createDataFrame([("thing",)], "token string"))
    assert [(r.lo, r.hi, r.score > 90) for r in got.orderBy("lo", "hi").collect()] == [(1, 2, True), (1, 3, False)]
    udf = str(got._jdf.queryExecution().optimizedPlan())
    assert "arrays_overlap" not in udf.split("ArrowEvalPython")[-1]  # what is asked of the ratio was filtered and stored before


def test_fuzzy_candidates_of_full_mentions_equal_all_pairs(spark):
    pick = random.Random(8)
    known = sorted({f"unit#{pick.randrange(400):06d}" for _ in range(120)} | {"unit#000001 b", "big unit#000007", "unité#000003", "u", "longer names here"})
    asked = sorted({f"unit#{i:06d}" + ("x" if i % 2 else "") for i in range(0, 400, 23)} | {"un", "unit#000001b", "names here longer"})
    names = spark.createDataFrame(list(enumerate(known)), "id long, name string")
    got = search.fuzzy_candidates(spark.createDataFrame([(m,) for m in asked], "mention string"), names, 85, 5)
    want = []
    for m in asked:
        scored = [(-round((100.0 if m == n else ratio_of(m, n) if len(m) < 4 else weighted_ratio_of(m, n)) / 100, 9), i) for i, n in enumerate(known)]
        want += [(m, i, -s) for s, i in sorted(x for x in scored if x[0] <= -0.85)[:5]]
    assert rows(got.select("mention", "id", F.round("score", 9).alias("score")), "mention", "id", "score") == sorted(want)
    sides = spark.createDataFrame([(s, s in asked, s in known, " " not in s and s.isascii()) for s in {*asked, *known}], "s string, is_m boolean, is_n boolean, short boolean")
    words = [[s for s in x if " " not in s and s.isascii()] for x in (asked, known)]
    apart = lambda a, b: len(a) + len(b) - 2 * lcs_length(a, b)
    assert rows(search._close_words(sides), "mention", "name") == sorted((a, b) for a in words[0] for b in words[1] if apart(a, b) <= search.EDITS)


def test_indel_ratio_keeps_its_row_in_words_of_bits(spark):
    pick = random.Random(9)
    said = lambda n, letters: "".join(pick.choice(letters) for _ in range(n))
    texts = [("", ""), ("a", ""), ("", "b"), (None, "a"), ("a", None)] + [(said(n, s), said(m, s)) for s in ("ab", "abcdefgh ") for n in (1, 61, 62, 63, 124, 125, 190) for m in (1, 62, 63, 150)]
    got = spark.createDataFrame(texts, "a string, b string").withColumn("r", indel_ratio(F.col("a"), F.col("b")))
    assert "bit_count" in plan(got)  # 62 letters a step, not a step for each pair of letters
    for r in got.collect():
        assert r.r is None if r.a is None or r.b is None else abs(r.r - ratio_of(r.a, r.b)) < 1e-9


def test_a_stored_partition_is_written_in_shares(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), parts=1)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write("t", spark.range(1000), ["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert store.read("t").columns == ["id"] and rows(store.read("t"), "id") == [(i,) for i in range(1000)]
    assert len(store.read("t").inputFiles()) > 1  # not one task with all rows of the partition


def test_edges_are_gathered_by_one_shuffle(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    t._made["edge_rows"] = spark.createDataFrame([(1, 2, "m", 0.5, None, "x"), (1, 2, "m", 0.7, None, "y"), (1, 2, "k", 0.1, None, None)], "a_id long, b_id long, message_id string, confidence double, seen_at timestamp, context string")
    got = t.related_to
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the plan before it ran
    assert [tuple(r) for r in got.collect()] == [(1, 2, 2, 0.7, None, ["k", "m"], "y")]


def test_pairs_of_a_name_are_classified_by_kinds(spark, monkeypatch):
    pick = random.Random(10)
    one = lambda i: (i, pick.choice(["Red bolt", "red bolt", "Hot ring", "red bolts", None]), pick.choice(["bolt", "ring", None]), pick.choice(["part", None]), pick.choice(["x", "y", None]), [pick.random(), 1.0] if i % 3 == 0 else None)
    entities = spark.createDataFrame([one(i) for i in range(2, 60)], "id long, canonical_name string, alias1 string, type string, topic string, vec array<double>")
    edges = spark.createDataFrame([(pick.randrange(2, 30), pick.randrange(2, 30)) for _ in range(40)] + [(5, 1), (7, 1)], "a_id long, b_id long")
    part_of = spark.createDataFrame([(i, i + 1) for i in range(20, 40)], "child_id long, parent_id long")
    a, b = (entities.select(F.col("id").alias(i), F.lower("canonical_name").alias(f"n_{i}"), F.col("vec").alias(f"v_{i}")) for i in ("lo", "hi"))
    p = graph.alias_collisions(entities).join(a, "lo").join(b, "hi").select("lo", "hi", ratio("n_lo", "n_hi").alias("score"), cosine(F.col("v_lo"), F.col("v_hi")).alias("cos"))
    cols = ["a_id", "b_id", F.round("score", 6), F.round("cos", 9), "cross_topic", "shared"]
    want = rows(facts.classify_pairs(p, entities, edges, part_of), *cols)
    assert len(want) > 50
    for block in (2, 64):
        monkeypatch.setattr(facts, "KIND_BLOCK", block)
        monkeypatch.setattr(facts, "NAME_KINDS", block)
        assert rows(facts.classify_named(entities, edges, part_of), *cols) == want


def test_nearest_rows_by_cells_equal_a_full_sort(spark, monkeypatch):
    for name, size in (("CELL", 16), ("QUERY_ROWS", 5), ("CORPUS_ROWS", 7)):
        monkeypatch.setattr(vectors, name, size)
    pick = np.random.default_rng(4)
    v = [[float(x) for x in row] for row in pick.integers(-2, 3, (60, 3))]
    corpus, asked = (spark.createDataFrame(list(enumerate(v[:n])), f"{i} long, vec array<double>") for i, n in (("id", 60), ("qid", 40)))
    found = vectors.vector_topk(asked, corpus, 4)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text  # a task is given the rows of one cell, not a batch of rows that each hold a block
    m = np.array(v)
    norm = np.linalg.norm(m, axis=1)
    cos = m @ m.T / np.where(norm == 0, 1, norm)[:, None] / np.where(norm == 0, 1, norm)[None, :]
    want = [(i, j) for i in range(40) for j in sorted(range(60), key=lambda j: (-round(cos[i, j], 9), j))[:4]]
    assert rows(found, "qid", "id") == sorted(want)


def test_pairs_without_links_leave_the_path_search_at_once(spark, monkeypatch):
    stored, keep = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: stored.append(keep(df)) or stored[-1])
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a_id long, b_id long")
    asked = spark.createDataFrame([(1, 3), (1, 3), *((1, n) for n in range(10, 60)), *((n, 3) for n in range(10, 60))], "a_id long, b_id long")
    assert sorted(map(tuple, graph.shortest_paths(edges, asked).collect())) == [(1, 3, [1, 2, 3])] * 2
    assert max(df.count() for df in stored if {"a_id", "b_id"} <= set(df.columns)) == 1


class Asked:
    """Tables that note what is asked of them."""

    def __init__(self, tables):
        self.tables, self.names = tables, []

    def __getattr__(self, name):
        self.names.append(name)
        return getattr(self.tables, name)


@pytest.mark.parametrize("name", ["f8", "j11"])
def test_links_are_derived_once_for_the_steps_of_paths(spark, name):
    t = Asked(Tables(spark, SF))
    getattr(graph_queries, name)(t)
    assert t.names.count("related_to") == 1


def test_pairs_of_small_groups_are_chosen_without_rounds(spark, monkeypatch):
    monkeypatch.setattr(greedy, "DEALT", 7)
    monkeypatch.setattr(greedy, "components", lambda edges: pytest.fail("parts are known"))
    pick = random.Random(3)
    pairs = [(k, f"u{k}:{x}", f"f{k}:{y}", pick.random()) for k in range(8) for x in range(12) for y in range(12) if abs(x - y) < 2]
    used, want = set(), []
    for _, u, f, _ in sorted(pairs, key=lambda p: p[3]):
        if not {u, f} & used:
            used |= {u, f}
            want.append((u, f))
    assert rows(greedy.disjoint(spark.createDataFrame(pairs, "k long, u string, f string, rank double"), "u", "f", "rank", "k"), "u", "f") == sorted(want)


@pytest.mark.parametrize("whole", [0, 1000])
def test_texts_meet_once_or_within_their_group(spark, monkeypatch, whole):
    monkeypatch.setattr(search, "WHOLE", whole)
    pick, asked = random.Random(8), []
    rate = search.ratio
    monkeypatch.setattr(search, "ratio", lambda *a: asked.append(a) or rate(*a))
    said = [(k, i, pick.choice(["click 1", "click 12", "click 21", "view 7", "Click 1", "", None])) for k in (1, 2) for i in range(25)]
    left, right = spark.createDataFrame(said, "k long, l long, text string"), spark.createDataFrame(said[::2], "k long, r long, text string")
    want = [(k, i, j) for k, i, x in said for m, j, y in said[::2] if k == m and x is not None and y is not None and ratio_of(x, y) > 90]
    assert rows(search.alike_texts(left, right, 90), "k", "l", "r") == sorted(want)
    assert asked == [("lt", "rt")]


def test_long_texts_are_split_a_few_at_a_time(spark):
    df = spark.createDataFrame([("a b", "py"), (None, ""), ("", None)], "text string, kind string")
    cut = df.select(splitting.text_spans(F.col("text"), F.col("kind"), 2, 1).alias("s"))
    assert "Arrow" not in cut._jdf.queryExecution().executedPlan().toString()
    assert [[tuple(x) for x in r.s] for r in cut.collect()] == [splitting.spans("a b", 2, 1), [], []]


@pytest.mark.parametrize("few", [0, 1000])
def test_edges_of_other_pairs_pass_ungathered(spark, monkeypatch, few):
    monkeypatch.setattr(recovery, "FEW", few)
    pick = random.Random(4)
    keys = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    one = lambda a, b: (a, b, 2, pick.random(), None, [f"m{a}", f"m{b}x"], "c")
    schema = "a_id long, b_id long, weight long, confidence double, last_seen timestamp, message_ids array<string>, context string"
    edges = spark.createDataFrame([one(*k) for k in pick.sample(keys, 40)], schema)
    batch = spark.createDataFrame([(b, a, f"m{pick.randrange(12)}", pick.random(), None, None) for a, b in pick.sample(keys, 9)] + [(3, 3, "m", 0.5, None, None)], "a_id long, b_id long, message_id string, confidence double, seen_at timestamp, context string")
    assert rows(upsert.upsert_few_edges(edges, batch), *edges.columns) == rows(upsert.upsert_edges(edges, batch), *edges.columns)
    pairs = spark.createDataFrame([(1, 2), (4, 3), (1, 5)], "primary_id long, secondary_id long")
    to, want = {2: 1, 3: 4, 5: 1}, {}
    for r in edges.collect():
        a, b = sorted(to.get(x, x) for x in (r.a_id, r.b_id))
        if a != b:
            w, m = want.get((a, b), (0, set()))
            want[a, b] = (w + r.weight, m | set(r.message_ids))
    assert rows(upsert.merge_edges(edges, pairs), "a_id", "b_id", "weight", "message_ids") == sorted((*k, w, sorted(m)) for k, (w, m) in want.items())
    before = upsert.snapshot(pairs, edges.selectExpr("a_id as id"), edges.selectExpr("a_id as id", "b_id as source_entity_id"), edges, edges.selectExpr("a_id as child_id", "b_id as parent_id"))["edges"]
    assert rows(before, "a_id", "b_id") == [(r.a_id, r.b_id) for r in sorted(edges.collect()) if {r.a_id, r.b_id} & {1, 2, 3, 4, 5}]
    assert not [x for x in plan(before).splitlines() if "Aggregate" in x and "message_ids" in x]


@pytest.mark.parametrize("lsh", [None, vectors.Lsh()])
def test_rows_of_every_length_have_neighbours(spark, lsh):
    v = spark.createDataFrame([(i, [float(i + 1), 1.0, 0.5]) for i in range(6)] + [(10, [1.0, 2.0]), (11, [2.0, 4.0])] + [(20, [3.0]), (21, [5.0])], "id long, vec array<double>")
    got = {(r.id, r.other) for r in vectors.knn_self(v, 3, lsh).collect()}
    assert {(10, 11), (11, 10), (20, 21), (21, 20), (0, 1)} <= got


def test_nearest_rows_by_packs_equal_a_full_sort_and_no_vector_is_shuffled(spark, monkeypatch):
    for name, size in (("PACK", 40), ("TASK_ROWS", 30), ("PART_ROWS", 60)):
        monkeypatch.setattr(vectors, name, size)
    pick = np.random.default_rng(6)
    v = [[float(x) for x in row] for row in pick.integers(-1, 2, (80, 3))] + [[float(i + 1)] * 3 for i in range(40)]
    df = spark.createDataFrame(list(enumerate(v)), "id long, vec array<double>")
    m = np.array(v)
    norm = np.linalg.norm(m, axis=1)
    cos = m @ m.T / np.where(norm == 0, 1, norm)[:, None] / np.where(norm == 0, 1, norm)[None, :]
    for k in (2, 30):
        want = [(i, j) for i in range(120) for j in sorted(range(120), key=lambda j: (-round(cos[i, j], 9), j))[:k] if i != j]
        assert rows(vectors.knn_self(df, k), "id", "other") == sorted(want)
    text = vectors.self_topk(df.groupBy("vec").agg(F.min("id").alias("qid"), F.collect_list("id").alias("ids")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in text and "vecs" not in "".join(x for x in text.splitlines() if "Exchange" in x)


def test_merge_pairs_look_at_all_neighbours(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(search_queries.search, "knn_self", lambda v, k, *more: asked.append(more) or vectors.knn_self(v, k, *more))
    assert search_queries.d1(Tables(spark, SF)).columns == ["lo", "hi", "score"] and asked == [()]


def test_neighbours_leave_by_hashes_before_names_are_joined(spark):
    entities = spark.createDataFrame([(1, "Acme Works"), (2, "Acme Work"), (3, "Other thing"), (4, "Name four")], "id long, canonical_name string")
    knn = spark.createDataFrame([(1, 2, 0.2), (2, 1, 0.2), (1, 3, 0.95), (2, 4, 0.3)], "id long, other long, score double")
    made, keep = [], facts.saved
    monkeypatch = pytest.MonkeyPatch()
    monkeypatch.setattr(facts, "saved", lambda df: made.append(plan(df)) or keep(df))
    got = facts.merge_pairs(knn, entities, spark.createDataFrame([("thing",)], "token string"))
    monkeypatch.undo()
    assert rows(got, "lo", "hi") == [(1, 2), (1, 3)] and "xxhash64" in made[0]


@pytest.mark.parametrize("few", [0, 1000])
def test_edges_are_gathered_at_the_ends_of_pairs_that_can_count(spark, monkeypatch, few):
    monkeypatch.setattr(recovery, "FEW", few)
    stored, keep = [], facts.saved
    monkeypatch.setattr(facts, "saved", lambda df: stored.append(keep(df)) or stored[-1])
    entities = spark.createDataFrame([(i, "part", "x" if i < 10 else "y") for i in range(2, 14)], "id long, type string, topic string")
    edges = spark.createDataFrame([(2, 3), (4, 7), (5, 7), (8, 9), (12, 13), (4, 1), (5, 1), (11, 12), (4, 7)], "a_id long, b_id long")
    pairs = spark.createDataFrame([(2, 3, 99.0, 0.5), (4, 5, 96.0, 0.5), (4, 6, 40.0, 0.5), (9, 10, 80.0, 0.5), (5, 6, 0.0, 0.5), (4, 7, 99.0, 0.1), (11, 12, 99.0, 0.1)], "lo long, hi long, score double, cos double")
    part_of = spark.createDataFrame([(5, 6)], "child_id long, parent_id long")
    got = facts.classify_pairs(pairs, entities, edges, part_of)
    assert rows(got, "a_id", "b_id", "shared") == [(4, 5, 1), (4, 6, 0)]
    assert rows(stored[-1], "a_id", "b_id") == [(2, 3), (4, 1), (4, 7), (5, 1), (5, 7), (11, 12), (12, 13)]


def test_fuzzy_candidates_are_told_apart_before_they_are_rated(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(search, "saved", lambda df: asked.append(recovery.saved(df)) or asked[-1])
    known = [f"supplier#{i:06d}" for i in range(60)] + [f"brand#{i} {x} {y} standard" for i in range(1, 20) for x in ("small", "hot") for y in ("widget", "bolt")]
    names = spark.createDataFrame([(1000 * c + i, n) for c in range(9) for i, n in enumerate(known)] + [(5, known[0])], "id long, name string")
    mentions = spark.createDataFrame([(n + "x" * (i % 2),) for i, n in enumerate(known[:60])], "mention string")
    got = search.fuzzy_candidates(mentions, names, 85, 5)
    want = []
    for m in (r.mention for r in mentions.collect()):
        best = {}
        for i, n in enumerate(known):
            s = -round(100.0 if m == n else weighted_ratio_of(m, n), 7)
            for x in [1000 * c + i for c in range(9)] + [5] * (i == 0):
                best[x] = min(best.get(x, 0.0), s)
        want += [(m, x) for s, x in sorted((s, x) for x, s in best.items() if s <= -85)[:5]]
    assert rows(got, "mention", "id") == sorted(want)
    of = {tuple(df.columns): df for df in asked}
    assert of["id", "name"].groupBy("name").count().where("count > 5").isEmpty()  # of equal names the ids that can be among the k
    met = [df for df in asked if df.columns == ["mention", "name"]]
    assert sum(df.count() for df in met) < 60  # of 60 * 76 mentions and names of parts, which share pairs of digits


def test_ids_of_a_name_meet_by_blocks_of_kinds(spark, monkeypatch):
    pick, dealt, keep = random.Random(11), [], graph.same_name_pairs
    monkeypatch.setattr(graph, "same_name_pairs", lambda *a: dealt.append(a[0]) or keep(*a))
    named = [(i, pick.choice(["Red bolt", "hot ring", "new rod"]), pick.choice(["RED BOLT", "rod", f"own {i}", None])) for i in range(90)] + [(95, None, None)]
    entities = spark.createDataFrame(named, "id long, canonical_name string, alias1 string")
    of = {i: {x.lower() for x in n if x} for i, *n in named}
    want = [(x, y) for x, y in combinations(sorted(of), 2) if of[x] & of[y]]
    for kind, block in ((3, 2), (4096, 32)):
        monkeypatch.setattr(graph, "KIND_BLOCK", kind)
        monkeypatch.setattr(graph, "NAME_KINDS", block)
        assert rows(graph.alias_collisions(entities), "lo", "hi") == want
    assert dealt[-1].count() < 20  # kinds, not ids, are dealt to the blocks of a name


@pytest.mark.parametrize("few", [0, 1000])
def test_edges_of_entities_without_a_shared_name_are_not_gathered(spark, monkeypatch, few):
    monkeypatch.setattr(facts, "FEW", few)
    stored, keep = [], facts.saved
    monkeypatch.setattr(facts, "saved", lambda df: stored.append(keep(df)) or stored[-1])
    entities = spark.createDataFrame([(i, n, None, "part", "x", None) for i, n in ((2, "bolt"), (3, "Bolt"), (4, "bolt"), (5, "own"), (6, "other"), (7, "more"))], "id long, canonical_name string, alias1 string, type string, topic string, vec array<double>")
    edges = spark.createDataFrame([(2, 5), (3, 5), (5, 6), (6, 7), (4, 3), (2, 5)], "a_id long, b_id long")
    got = facts.classify_named(entities, edges, spark.createDataFrame([(7, 6)], "child_id long, parent_id long"))
    assert rows(got, "a_id", "b_id", "shared") == [(2, 3, 1), (2, 4, 0)]
    edges = next(df for df in stored if df.columns == ["a_id", "b_id"])
    assert rows(edges, "a_id", "b_id") == [(2, 5), (3, 4), (3, 5)] + ([(5, 6), (6, 7)] if few == 0 else [])
    members = next(df for df in stored if "members" in df.columns)
    assert members.where("array_contains(names, 'own')").isEmpty()
