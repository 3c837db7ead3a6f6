"""Decisions on odd inputs, properties of upserts and merges, streams against their batch forms."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kgspark.functions import scalars, splitting
from kgspark.functions.udfs import embed, lcs_length, partial_ratio_of, ratio, ratio_of, weighted_ratio_of
from kgspark.operators import context, discussions, facts, graph, greedy, ingest, search, stats, topics, upsert, vectors
from kgspark.sources import sessions
from kgspark.streaming import streams

EDGE = "a_id long, b_id long, message_id string, confidence double, seen_at timestamp, context string"
STORE = "a_id long, b_id long, weight long, confidence double, last_seen timestamp, message_ids array<string>, context string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_edge_upsert_twice_is_once(spark):
    new = spark.createDataFrame([(2, 1, "m1", 0.5, None, "x"), (1, 2, "m1", 0.9, None, None), (1, 2, "m2", 0.1, None, "y"), (3, 3, "m", 1.0, None, "self")], EDGE)
    once = upsert.upsert_edges(spark.createDataFrame([], STORE), new)
    twice = upsert.upsert_edges(once, new)
    assert rows(once, "a_id", "b_id", "weight", "confidence") == rows(twice, "a_id", "b_id", "weight", "confidence") == [(1, 2, 2, 0.9)]


def test_long_chains(spark):
    part_of = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (600, 500)], "child_id long, parent_id long")
    got = {r.id: r.chain for r in graph.ancestry(part_of, spark.createDataFrame([(0,), (150,), (200,), (500,), (600,)], "id long")).collect()}
    assert got == {0: list(range(201)), 150: list(range(150, 201)), 200: [200], 500: [500, 501, 502], 600: [600, 500, 501, 502]}
    pairs = [(i, i + 1, i) for i in range(200)]
    kept = upsert.disjoint_pairs(spark.createDataFrame(pairs, "primary_id long, secondary_id long, rank long"))
    assert rows(kept, "primary_id", "secondary_id") == [(i, i + 1) for i in range(0, 200, 2)]
    shown = spark.createDataFrame([(i, i + 1, False) for i in range(199)] + [(i, i, True) for i in range(200)], "hit_id long, id long, is_hit boolean")
    hits = spark.createDataFrame([(i, i) for i in range(200)], "hit_id long, rank long")
    assert rows(context.fresh_hits(shown, hits), "hit_id") == [(i,) for i in range(0, 200, 2)]


@pytest.mark.parametrize("part", [0, 50_000])
def test_sequential_rules_equal_the_loop(spark, monkeypatch, part):
    monkeypatch.setattr(greedy, "PART", part)
    monkeypatch.setattr(greedy, "ROUNDS", 1)
    rnd = random.Random(part)
    rules = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)})
    gone = set()
    for item in range(60):
        if any(by not in gone for by, x in rules if x == item):
            gone.add(item)
    df = spark.createDataFrame([(a, b, a, b) for a, b in rules], "by long, id long, by_rank long, id_rank long")
    assert {r.id for r in greedy.kept_items(df).collect()} == gone
    assert greedy.kept_items(df.where("false")).count() == 0
    pairs = [(a, b, rnd.random()) for a, b in rules]
    used, want = set(), []
    for a, b, _ in sorted(pairs, key=lambda x: x[2]):
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b))
    got = greedy.disjoint(spark.createDataFrame(pairs, "p long, q long, rank double"), "p", "q", "rank")
    assert rows(got, "p", "q") == sorted(want)


def test_aliases_of_any_length_are_found(spark):
    m = spark.createDataFrame([(1, "I met the Grand Old Duke-of York today"), (2, "york, YORK")], "id long, content string")
    a = spark.createDataFrame([("grand old duke of york today", 7), ("York", 8), ("duke", 9), ("!", 10)], "alias string, id long")
    assert rows(ingest.tag_known(m, a), "msg_id", "name", "id") == [(1, "duke", 9), (1, "grand old duke of york today", 7), (1, "york", 8), (2, "york", 8)]
    assert ingest.tag_known(m, a.where("false")).count() == 0


def test_name_candidates_lose_no_pair(spark):
    rnd = random.Random(2)
    word = lambda k, of="abn": "".join(rnd.choice(of) for _ in range(rnd.randrange(1, k)))
    several = lambda: (" " * rnd.choice((1, 1, 2))).join(word(7, "abcdefgh") for _ in range(rnd.randrange(1, 5)))
    base = [several() for _ in range(60)]
    turned = [" ".join(rnd.sample(x.split(), len(x.split()))) for x in base] + [x[2:] for x in base] + [x + " " + word(9) for x in base] + [x[:6] for x in base]
    names = sorted({word(9) for _ in range(150)} | set(base) | {several() for _ in range(100)} | {"jon", "karen", "kaen", "john", "smith bob", "a", "x", "b b"})
    mentions = sorted({word(9) for _ in range(80)} | set(turned) | {"john", "kaen", "bob smith", "xabx", "abab abab", ""})
    got = search.fuzzy_candidates(spark.createDataFrame([(m,) for m in [*mentions, None]], "mention string"), spark.createDataFrame(list(enumerate(names)), "id long, name string"), 85, 10_000)
    of = lambda m, n: 100 if m == n else ratio_of(m, n) if len(m) < 4 else weighted_ratio_of(m, n)
    want = {(m, i): round(of(m, n), 6) for m in mentions if m for i, n in enumerate(names) if of(m, n) >= 85}
    assert {(r.mention, r.id): round(r.score * 100, 6) for r in got.collect()} == want
    assert ("john", names.index("jon")) in want and want["bob smith", names.index("smith bob")] == 95 and len(want) > 500


def test_partial_ratio_is_the_best_window():
    rnd = random.Random(5)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 9))) for _ in "ab")
        short, long = sorted((a, b), key=len)
        m = len(short)
        windows = lambda x: {x[:i] for i in range(1, m)} | {x[i : i + m] for i in range(len(x) - m + 1)} | {x[i:] for i in range(max(0, len(x) - m + 1), len(x))}
        want = max(ratio_of(short, w) for w in windows(long))
        if len(a) == len(b):
            want = max(want, max(ratio_of(long, w) for w in windows(short)))
        assert partial_ratio_of(a, b) == want


def nearest(rows, k, qid=None):
    """(id, other) of the k nearest by cosine, itself counted and dropped, per length."""
    out = set()
    for i, v in rows:
        near = sorted((-round(np.dot(v, w) / ((np.linalg.norm(v) or 1) * (np.linalg.norm(w) or 1)), 9), j) for j, w in rows if len(w) == len(v))[:k]
        out |= {(i, j) for _, j in near if j != i}
    return out


def odd_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300, [0.0] * 8), (301, [0.0] * 8), (400, [1.0, 2.0]), (401, [2.0, 4.0]), (402, [1.0, -1.0])]
    odd = [(500, None), (501, []), (502, [1.0] * 7 + [float("nan")]), (503, [None] * 8), (504, [float("inf")] * 8)]
    return rows, odd


def test_neighbours_of_odd_vectors(spark):
    rows, odd = odd_vectors()
    v = spark.createDataFrame(rows + odd, "id long, vec array<double>").repartition(4)
    for k in (1, 5, 60):
        assert {(r.id, r.other) for r in vectors.knn_self(v, k).collect()} == nearest(rows, k)
    got = vectors.vector_topk(v.withColumnRenamed("id", "qid"), v, 4)
    assert {(r.qid, r.id) for r in got.where("qid <> id").collect()} <= nearest(rows, 5) and got.where("rank > 4").isEmpty()
    assert vectors.knn_self(v.where("false"), 3).isEmpty() and vectors.knn_self(v.where("false"), 3, vectors.Lsh()).isEmpty()


def test_buckets_hold_most_neighbours(spark):
    rows, odd = odd_vectors()
    main = [(i, v) for i, v in rows if len(v) == 8]
    v = spark.createDataFrame(rows + odd, "id long, vec array<double>")
    want, got = nearest(main, 10), {(r.id, r.other) for r in vectors.knn_self(v, 10, vectors.Lsh(12, 4, 0.5)).collect()}
    assert len(want & got) > 0.9 * len(want)
    hit, met = vectors.recall(v.where("id < 120"), 10, vectors.Lsh(12, 4, 0.5), v.where("id < 20").withColumnRenamed("id", "qid"))
    assert hit > 0.9 and met < 0.6


def test_near_pairs_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)  # one key is many blocks
    rows_, odd = odd_vectors()
    keyed = [(i % 2 if i % 3 else 0, f"v{i}", v) for i, v in rows_ + odd]
    df = spark.createDataFrame(keyed, "k long, l string, vec array<double>").repartition(3)
    cos = lambda v, w: np.dot(v, w) / ((np.linalg.norm(v) or 1) * (np.linalg.norm(w) or 1))
    fine = {i for i, _ in rows_}
    want = {(k, a, b) for k, a, v in keyed for m, b, w in keyed if k == m and int(a[1:]) in fine and int(b[1:]) in fine and len(v) == len(w) and cos(v, w) >= 0.9}
    assert {(r.k, r.l, r.r) for r in vectors.near_pairs(df, df.withColumnRenamed("l", "r"), 0.9).collect()} == want and len(want) > 500
    assert vectors.near_pairs(df.where("false"), df.withColumnRenamed("l", "r"), 0.9).isEmpty()


def test_merge_pairs_by_name_and_by_vector(spark):
    e = spark.createDataFrame([(1, "Bob Smith"), (2, "Smith Bob"), (3, "Roberta"), (4, "Roberta Corp"), (5, "Corp"), (6, "Ann Corp")], "id long, canonical_name string")
    knn = spark.createDataFrame([(1, 2, 0.1), (3, 4, 0.2), (5, 4, 0.95), (2, 3, 0.9), (2, 6, 0.89), (4, 3, 0.3)], "id long, other long, score double")
    got = rows(facts.merge_pairs(knn, e, spark.createDataFrame([("corp",)], "token string")), "lo", "hi", "score")
    # Roberta Corp and Corp are alike by name, but share a generic word only.
    assert got == [(1, 2, 95.0), (2, 3, 0.0), (3, 4, 90.0)]


def test_turns_of_equal_time_are_not_before(spark):
    t = spark.createDataFrame([(1, i, ts, u) for i, (ts, u) in enumerate([(1, None), (2, 10), (2, 11), (3, 12)])], "session_id long, turn_id long, ts long, user_msg_id long")
    got = context.turns_before(t, spark.createDataFrame([(1, 11), (1, 12), (1, 99)], "session_id long, msg_id long"), 2)
    assert rows(got, "msg_id", "turn_id", "rn") == [(11, 0, 1), (12, 1, 2), (12, 2, 1)]


def smallest_path(edges, a, b, most):
    """Breadth first over whole paths in order, so the first one to arrive is the shortest and smallest."""
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    paths, been = [[a]], {a}
    for _ in range(most + 1):
        done = [p for p in paths if p[-1] == b]
        if done:
            return min(done)
        paths = sorted(p + [n] for p in paths for n in near.get(p[-1], ()) if n not in been)
        first = {}
        for p in paths:
            first.setdefault(p[-1], p)
        paths = list(first.values())
        been |= set(first)
    return None


def test_stop_words_of_a_table_replace_the_short_list(spark):
    spans = spark.createDataFrame([("Und", 0.9), ("The", 0.9), ("Ada", 0.9), ("We", 0.9), ("Ada", 0.1), ("7", 0.9), (None, 0.9)], "name string, score double").withColumn("label", F.lit("person"))
    words = spark.createDataFrame([("und",), ("UND",), (None,), ("oder",)], "word string")
    assert rows(ingest.filter_spans(spans), "name") == [("Ada",), ("Und",)]
    assert rows(ingest.filter_spans(spans, stop_words=words), "name") == [("Ada",), ("The",)]
    assert rows(ingest.filter_spans(spans, stop_words=words.where("false")), "name") == [("Ada",), ("The",), ("Und",)]


@pytest.mark.parametrize("most", [1, 3, 4])
def test_paths_from_both_ends_equal_a_plain_search(spark, most):
    """With a hub, a long chain, parts that do not meet, unknown and null ids, equal ends, repeated pairs and edges, a self-loop."""
    draw = random.Random(most)
    links = [(draw.randrange(40), draw.randrange(40)) for _ in range(45)] + [(50, n) for n in range(0, 40, 3)] + [(n, n + 1) for n in range(60, 70)] + [(7, 7), (60, 61), (61, 60)]
    asked = [(draw.randrange(40), draw.randrange(40)) for _ in range(120)] + [(50, n) for n in range(40)] + [(n, 50) for n in range(40)]
    asked += [(60, n) for n in range(60, 71)] + [(70, 66), (1, 60), (99, 1), (1, 99), (99, 99), (60, 64), (60, 64)]
    edges = spark.createDataFrame(links + [(None, 1), (2, None)], "a_id long, b_id long")
    got = graph.shortest_paths(edges, spark.createDataFrame(asked + [(None, 1), (1, None), (None, None)], "a_id long, b_id long"), most)
    want = [(a, b, p) for a, b in asked for p in [smallest_path(links, a, b, most)] if p]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("most", [2, 3, 4, 5])
def test_few_pairs_of_hubs_meet_half_way(spark, monkeypatch, most):
    draw, met = random.Random(10 + most), []
    links = [(hub, 1000 * hub + n) for hub in range(4) for n in range(60)] + [(1000 * draw.randrange(4) + draw.randrange(60), 1000 * draw.randrange(4) + draw.randrange(60)) for _ in range(80)]
    asked = [(0, 1), (1, 2), (3, 0), (5, 2007), (3001, 1059)]
    meet = graph._met
    monkeypatch.setattr(graph, "_met", lambda *a: met.append(1) or meet(*a))
    got = graph.shortest_paths(spark.createDataFrame(links, "a_id long, b_id long"), spark.createDataFrame(asked, "a_id long, b_id long"), most)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, p) for a, b in asked for p in [smallest_path(links, a, b, most)] if p)
    assert met


def test_paths_of_empty_tables(spark):
    none = spark.createDataFrame([], "a_id long, b_id long")
    some = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    assert graph.shortest_paths(none, some).count() == 0
    assert graph.shortest_paths(some, none).count() == 0


def test_hidden_paths_are_locked(spark):
    e = spark.createDataFrame([(1, "a", "x"), (2, "b", "off"), (3, "c", None), (4, "d", "x"), (5, "e", "off")], "id long, canonical_name string, topic string")
    edges = spark.createDataFrame([(1, 2, ["m1"]), (2, 3, ["m2"]), (1, 4, ["m3"]), (3, 4, ["m4"]), (4, 5, ["m5"])], "a_id long, b_id long, message_ids array<string>")
    edges = edges.unionByName(spark.createDataFrame([(1, 5, ["m6"]), (5, 3, ["m7"])], edges.schema))
    got = graph.topic_paths(edges.where("a_id <> 3"), e, spark.createDataFrame([(1, 3), (1, 4)], "a_id long, b_id long"), ["x", "General"])
    assert rows(got, "a_id", "b_id", "path", "shortcut", "hidden") == [(1, 3, [1, 2, 3], True, True), (1, 4, [1, 4], False, False)]
    steps = graph.redacted(graph.path_steps(got, e, edges), ["x", "General"])
    assert rows(steps.fillna({"locked_reason": "-"}), "a_id", "b_id", "step", "locked", "locked_reason") == [(1, 3, 0, True, "Inactive topic(s): off"), (1, 3, 1, True, "Inactive topic(s): off"), (1, 4, 0, False, "-")]
    around = graph.topic_paths(edges, e, spark.createDataFrame([(1, 3)], "a_id long, b_id long"), ["x", "General"])
    assert rows(around, "path", "shortcut", "hidden") == [([1, 4, 3], True, False)]


def test_ancestry_survives_a_cycle(spark):
    part_of = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "child_id long, parent_id long")
    got = graph.ancestry(part_of, spark.createDataFrame([(1,), (9,)], "id long"))
    assert rows(got, "id", "chain") == [(1, [1, 2, 3]), (9, [9])]


def test_disjoint_pairs_equal_the_greedy_loop(spark):
    rnd = random.Random(4)
    pairs = [(a, b, i) for i, (a, b) in enumerate((rnd.randrange(20), 20 + rnd.randrange(20)) for _ in range(60))]
    used, want = set(), []
    for a, b, i in pairs:
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b))
    got = upsert.disjoint_pairs(spark.createDataFrame(pairs, "primary_id long, secondary_id long, rank long"))
    assert rows(got, "primary_id", "secondary_id") == sorted(want)


def test_protected_entity_is_always_primary(spark):
    p = spark.createDataFrame([(5, 1), (1, 7), (3, 3)], "primary_id long, secondary_id long")
    assert rows(upsert.guard_protected(p), "primary_id", "secondary_id") == [(1, 5), (1, 7)]


def test_dedupe_facts_is_a_fixpoint(spark):
    v = [[1.0, 0.0], [1.0, 0.05], [0.0, 1.0], [1.0, 0.1]]
    data = [(f"f{i}", 1, f"2024-01-0{i + 1}", x, None) for i, x in enumerate(v)] + [("n", 1, "2024-01-09", None, None)]
    f = spark.createDataFrame(data, "id string, source_entity_id long, created_at string, vec array<double>, invalid_at string")
    assert rows(facts.dedupe_facts(f, 0.96), "id") == [("f1",), ("f3",)]


def test_fact_updates(spark):
    f = spark.createDataFrame([("f1", 1, "likes tea", "2024-01-01", None)], "id string, source_entity_id long, content string, created_at string, invalid_at string")
    u = spark.createDataFrame([(1, 1, "likes coffee", "likes tea", None), (1, 2, "Likes Coffee ", None, None), (2, 1, "new", None, None)], "entity_id long, seq long, content string, supersedes string, invalidates string")
    assert rows(facts.apply_fact_updates(f, u).fillna("-"), "entity_id", "action", "fact_id", "content") == [(1, "add", "-", "likes coffee"), (1, "invalidate", "f1", "likes tea"), (2, "add", "-", "new")]


def test_fact_updates_equal_the_loop(spark):
    rnd, have, new, want = random.Random(8), [], [], []
    words = ["likes tea", "likes teas", "likes green tea", "works at north", "works at the north", "is old", "is cold", "a", "b"]
    for e in range(40):
        mine = [(f"f{e}_{i}", e, rnd.choice(words) + rnd.choice(["", " ", "!"]), f"2024-01-0{rnd.randrange(1, 6)}", rnd.choice([None, None, "x"])) for i in range(rnd.randrange(0, 9))]
        told = []
        for s in range(rnd.randrange(0, 9)):
            kind = rnd.randrange(3)
            told.append((e, s, rnd.choice([*words, "New " + rnd.choice(words), None]), rnd.choice(words) if kind == 1 else None, rnd.choice(words).upper() if kind == 2 else None))
        live, added = [(i, c) for i, _, c, t, gone in sorted(sorted(mine), key=lambda r: r[3], reverse=True) if gone is None], set()
        for _, _, content, over, out in told:
            target = over if over is not None else out
            if target is not None:
                hit = next((x for x in live if ratio_of(x[1].strip().lower(), target.strip().lower()) > 90), None)
                if hit:
                    live.remove(hit)
                    want.append((e, "invalidate", hit[0], hit[1]))
            if content is not None and (target is None or over is not None):
                said = content.strip().lower()
                if said not in added and said not in {c.strip().lower() for _, c in live}:
                    added.add(said)
                    want.append((e, "add", "-", content))
        have, new = have + mine, new + told
    rnd.shuffle(new)
    f = spark.createDataFrame(have, "id string, source_entity_id long, content string, created_at string, invalid_at string")
    u = spark.createDataFrame(new, "entity_id long, seq long, content string, supersedes string, invalidates string")
    assert rows(facts.apply_fact_updates(f, u).fillna("-"), "entity_id", "action", "fact_id", "content") == sorted(want) and len(want) > 60


def test_ratio_forms_agree(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(6))) for _ in range(60)]
    df = spark.createDataFrame(list(zip(words, words[::-1])), "a string, b string")
    for a, b, x, y in df.select("a", "b", ratio("a", "b"), scalars.indel_ratio(F.col("a"), F.col("b"))).collect():
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, c in enumerate(a):
            for j, d in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(a, b) == table[-1][-1] and x == pytest.approx(y) == pytest.approx(ratio_of(a, b))


def test_cosine_of_bad_vectors_is_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([], []), (None, [1.0]), ([0.0], [1.0]), ([None], [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(scalars.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_search_on_empty_tables(spark):
    docs, q = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "a b")], "qid long, text string")
    assert search.bm25(docs, q).count() == 0
    v = spark.createDataFrame([], "id long, vec array<float>")
    assert search.vector_topk(v.withColumnRenamed("id", "qid"), v, 3).count() == 0


def test_topic_guard_rejects_mass_deactivation(spark):
    old = spark.createDataFrame([("General", True, "a"), ("X", True, "b"), ("Y", True, "c"), ("Z", True, "d")], "name string, active boolean, labels string")
    new = old.where("name <> 'General'").withColumn("active", F.lit(False))
    assert rows(topics.guard_topics(old, new), "name", "active") == [("General", True), ("X", True), ("Y", True), ("Z", True)]


def test_numbered_rows_of_large_groups(spark):
    df = spark.range(500).select((F.col("id") % 3 == 0).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 101).alias("x"), "id")
    w = Window.partitionBy("g").orderBy("x", "id")
    assert rows(stats.numbered(df, ["g"], ["x", "id"]), "id", "place") == rows(df.withColumn("place", F.row_number().over(w)), "id", "place")


def test_malformed_turns_are_skipped(spark):
    lines = spark.createDataFrame([('{"turn_id": 1, "role": "user", "content": "hi"}',), ("{broken",), ('{"turn_id": 2, "role": "user"}',)], "value string")
    assert rows(sessions.parse_turns(lines), "turn_id", "content") == [(1, "hi")]


def test_chunks_break_where_the_text_does(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcé\U0001f600") for _ in range(rnd.choice((1, 3, 9, 9, 70))))
    texts = ["".join(word() + rnd.choice((" ", " ", " ", "\n", "\n\n")) for _ in range(rnd.randrange(1, 300))) for _ in range(40)]
    texts += ["", "x" * 1000, " " * 300, "\n\n" * 90, "short", "class A:\n    def f():\n        pass\n" * 30]
    for size, overlap in ((50, 10), (120, 0), (64, 40)):
        for t in texts:
            got = splitting.spans(t, size, overlap, splitting.SEPARATORS["py"] if "class" in t else splitting.PLAIN)
            assert "".join(t[f:e] for _, f, e in got) == t
            for (s, f, e), before in zip(got, [None, *got]):
                assert s <= f < e and e - s <= size and f - s <= overlap and (before is None or s >= before[0] and f == before[2])
            # A word is cut only if it is longer than a chunk.
            assert all(e == len(t) or t[e] in " \n" or max(map(len, t[max(0, e - size) : e + size].split())) >= size for _, _, e in got)
    # Paragraphs are kept whole before lines, lines before words.
    assert [t for t in ("one two\nthree\n\nfour five",) for s, f, e in splitting.spans(t, 16, 0) if t[f:e] in ("one two\nthree", "\n\nfour five")] and len(splitting.spans("one two\nthree\n\nfour five", 16, 0)) == 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, text string").withColumn("total_chunks", F.lit(7))
    back = {}
    for r in sorted(ingest.split_chunks(df, 64, 20).collect()):
        back[r.id] = back.get(r.id, "") + r.text[r.fresh :]
    assert back == {i: t for i, t in enumerate(texts) if t}
    kids = ingest.split_parents_and_children(df, F.lit("md"), (200, 20), (64, 10))
    assert kids.where("length(text) > 64").isEmpty() and kids.select("parent_id").distinct().count() > 40


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff")
    (tmp_path / "b.exe").write_bytes(b"no")
    (tmp_path / "c.md").write_bytes(b"")
    assert rows(sessions.read_text_files(spark, str(tmp_path)), "name") == [("a.txt",)]


def test_embed_runs_the_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert rows(embed(df, "text", lambda: lambda texts: [[len(t)] for t in texts]), "id", "vec") == [(1, [2.0]), (2, [0.0])]


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


MESSAGES = "session_id long, id long, content string, ts timestamp"


def test_stream_dedup_equals_batch(spark, tmp_path):
    data = spark.createDataFrame([(1, i, f"m{i % 4}", None) for i in range(12)], MESSAGES).withColumn("ts", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id % 4)"))
    for part in range(3):
        data.where(f"id % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streams.dedup_stream(stream_of(spark, str(tmp_path / "in"), MESSAGES)).writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("dedup_out"), "content") == rows(streams.dedup_batch(data), "content")


def test_discussions(spark):
    at = "timestamp '2024-01-01 00:00:00'"
    none = spark.sql(f"SELECT 1L AS id, 'open' AS status, {at} AS opened_at, CAST(NULL AS timestamp) AS closed_at").where("false")
    d = discussions.open_discussions(none, spark.sql(f"SELECT id, {at} AS opened_at FROM range(3)"))
    assert discussions.open_discussions(d, d.select("id", "opened_at")).count() == 3
    d = discussions.close(d, spark.range(1), F.expr(at))
    d2 = discussions.close(d, spark.range(1), F.expr("timestamp '2025-01-01 00:00:00'"))
    assert rows(d2.where("closed_at is not null"), "id", "status") == [(0, "closed")] and d2.exceptAll(d).count() == 0
    said = spark.sql(f"SELECT id, id % 3 AS discussion_id, {at} AS ts, 'x' AS content FROM range(6)")
    got = discussions.append_messages(said.where("id < 1"), said.unionByName(said.withColumn("id", F.col("id") + 10).withColumn("discussion_id", F.lit(9).cast("long"))), d)
    assert rows(got, "id", "discussion_id") == [(0, 0), (1, 1), (2, 2), (4, 1), (5, 2)]
    spawns = spark.createDataFrame([(1, 2, "a", 1), (2, 3, "b", 2), (9, 3, "later", 5)], "parent_id long, child_id long, detail string, ts long")
    assert rows(discussions.spawn_tree(discussions.record_spawns(spawns.where("false"), spawns)), "child_id", "parent_id", "depth") == [(2, 1, 1), (3, 2, 2)]
