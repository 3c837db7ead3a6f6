"""Edges, neighbours, hierarchy and paths over edge tables. No RDDs, no collected graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.recovery import saved

PROTECTED = 1
#: Ids of one name that meet at once.
NAME_BLOCK = 2048
#: Ids of a block of entities with the same names, and blocks of a name that meet at once.
KIND_BLOCK, NAME_KINDS = 4096, 32


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions: src, dst and the edge's own columns."""
    rest = [c for c in edges.columns if c not in ("a_id", "b_id")]
    one = edges.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), *rest)
    return one.unionByName(edges.select(F.col("b_id").alias("src"), F.col("a_id").alias("dst"), *rest))


def neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return undirected(edges).select(F.col("src").alias("id"), F.col("dst").alias("neighbor_id")).join(ids.select("id"), "id", "left_semi").distinct()


def neighbor_entities(edges: DataFrame, entities: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    near = neighbors(edges, ids).join(entities.select(F.col("id").alias("neighbor_id"), F.col("canonical_name").alias("neighbor_name"), "last_mentioned"), "neighbor_id")
    order = W.partitionBy("id").orderBy(F.col("last_mentioned").desc_nulls_last(), "neighbor_id")
    return near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select("id", "rn", "neighbor_id", "neighbor_name")


def active(facts: DataFrame) -> DataFrame:
    return facts.where("invalid_at is null")


def fact_lists(facts: DataFrame) -> DataFrame:
    """id, facts (active contents, newest first), n_facts."""
    newest = F.sort_array(F.collect_list(F.struct("created_at", "id", "content")), asc=False)
    return active(facts).groupBy(F.col("source_entity_id").alias("entity_id")).agg(newest["content"].alias("facts"), F.count(F.lit(1)).alias("n_facts"))


def visible(topic: Column, topics: list[str] | None) -> Column:
    """No filter, no topic, or an active topic."""
    return F.lit(True) if topics is None else F.coalesce(topic.isin(topics), F.lit(True))


def related(edges: DataFrame, entities: DataFrame, facts: DataFrame, names: DataFrame, topics: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Entities related to those of the given names, with evidence; heaviest and latest first."""
    wanted = names.select(F.lower("name").alias("name")).distinct()
    sources = entities.select(F.col("id").alias("src"), F.col("canonical_name").alias("source"), F.lower("canonical_name").alias("name")).join(wanted, "name").drop("name")
    target = entities.where(visible(F.col("topic"), topics)).select(F.col("id").alias("dst"), F.col("canonical_name").alias("target"), "type", "topic")
    got = saved(undirected(edges).join(sources, "src").join(target, "dst"))
    theirs = facts.join(got.select(F.col("dst").alias("source_entity_id")), "source_entity_id", "left_semi")
    got = got.join(fact_lists(theirs).withColumnRenamed("entity_id", "dst"), "dst", "left")
    got = got.select("source", F.col("dst").alias("target_id"), "target", "type", "topic", "weight", "confidence", "last_seen", "context", "message_ids", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), "facts")
    return got if limit is None else got.orderBy(F.desc("weight"), F.desc("last_seen"), "target_id", "source").limit(limit)


def connection_counts(edges: DataFrame, entities: DataFrame, ids: DataFrame, topics: list[str]) -> DataFrame:
    """Visible and hidden edges per id."""
    near = undirected(edges).join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(entities.select(F.col("id").alias("dst"), "topic"), "dst")
    seen = visible(F.col("topic"), topics)
    return near.groupBy(F.col("src").alias("id")).agg(F.count_if(seen).alias("visible"), F.count_if(~seen).alias("hidden"))


def entity_relationships(edges: DataFrame, entities: DataFrame, ids: DataFrame) -> DataFrame:
    near = undirected(edges).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return near.join(entities.select(F.col("id").alias("dst"), F.col("canonical_name").alias("neighbor")), "dst").withColumnsRenamed({"src": "id", "dst": "neighbor_id"})


def pair_key(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def has_edge(pairs: DataFrame, edges: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """pairs (a_id, b_id) with found: joined by an edge in either direction."""
    keys = edges.select(*pair_key(a, b)).distinct().withColumn("_hit", F.lit(True))
    got = pairs.select("a_id", "b_id", *pair_key("a_id", "b_id")).join(keys, ["lo", "hi"], "left")
    return got.select("a_id", "b_id", F.coalesce("_hit", F.lit(False)).alias("found"))


def parents(part_of: DataFrame, entities: DataFrame, facts: DataFrame, ids: DataFrame, up: bool = True) -> DataFrame:
    me, other = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    near = part_of.join(ids.select(F.col("id").alias(me)), me, "left_semi").select(F.col(me).alias("id"), F.col(other).alias("other_id"))
    near = near.join(entities.select(F.col("id").alias("other_id"), F.col("canonical_name").alias("name"), "type"), "other_id")
    return near.join(fact_lists(facts).withColumnRenamed("entity_id", "other_id"), "other_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))


def ancestry(part_of: DataFrame, ids: DataFrame) -> DataFrame:
    """id, chain: the ids from the entity up its first parents to the root; a cycle ends the chain.

    Chains double in length each round, so the rounds are the logarithm of the longest one.
    """
    up = part_of.groupBy("child_id").agg(F.min("parent_id").alias("parent_id")).select(F.col("child_id").alias("node"), F.array("parent_id").alias("up"), F.lit(True).alias("open"))
    up = saved(up)
    while not up.where("open").isEmpty():
        further = up.select(F.col("node").alias("last"), F.col("up").alias("more"))
        step = up.join(further, F.when(F.col("open"), F.element_at("up", -1)) == further["last"], "left")
        longer = F.concat("up", F.coalesce("more", F.array().cast(up.schema["up"].dataType)))
        # A chain is closed at the root or where it meets a node of its own again; what comes before that is distinct.
        whole = F.array_distinct(F.concat(F.array("node"), longer))
        closed = F.col("more").isNull() | (F.size(whole) <= F.size(longer))
        up = saved(step.select("node", F.slice(whole, F.lit(2), F.size(whole)).alias("up"), (~closed).alias("open")))
    got = ids.select("id").join(up, ids["id"] == up["node"], "left")
    return got.select("id", F.concat(F.array("id"), F.coalesce("up", F.array().cast("array<bigint>"))).alias("chain"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 4) -> DataFrame:
    """a_id, b_id, path: for each pair the shortest path of at most max_depth edges, of equal ones the smallest.

    Searched from both ends.  Each round one side's frontiers grow by an edge,
    those that cost less by exact counts: edges to follow, and nodes to look up
    on the other side.  So few pairs, or such as end in hubs, meet half way,
    and many pairs of few sources (or few targets) are searched from there
    alone and looked up once at the end.  Ends shared by pairs grow once; each
    node of a frontier keeps its smallest path, so the smallest over the nodes
    met is the smallest of all.  A pair of equal ids has the path of that one
    id; null ids have none; repeated pairs have a row each.
    """
    hop = saved(undirected(edges).select("src", "dst").where("src is not null and dst is not null").distinct())
    degrees = saved(hop.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")))
    # Rounds see each pair once, with the times it is asked for, and only pairs with an edge at both ends; they are stored.
    linked = lambda c: degrees.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}"))
    some = pairs.select("a_id", "b_id").join(linked("a_id"), "a_id", "left").join(linked("b_id"), "b_id", "left").where("a_id = b_id or _a_id and _b_id")
    asked = saved(some.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("times")))
    found = [asked.where("a_id = b_id").withColumn("path", F.array("a_id"))]
    waiting = asked.where("a_id <> b_id")
    reach, last, size = {}, {}, {}
    for side in ("a", "b"):
        ends = waiting.select(F.col(f"{side}_id").alias("node")).distinct().join(degrees, "node")
        reach[side] = last[side] = saved(ends.select(F.col("node").alias("root"), F.lit(0).alias("level"), "node", F.array("node").alias("path"), "degree"))
        size[side] = _frontier_size(last[side])
    level, n_pairs, open_roots = {"a": 0, "b": 0}, waiting.count(), {}  # without open_roots all roots wait

    def without(got: DataFrame) -> DataFrame:
        left = saved(waiting.join(got, ["a_id", "b_id"], "left_anti"))
        open_roots.update({x: saved(left.select(F.col(f"{x}_id").alias("root")).distinct()) for x in ("a", "b")})
        return left

    for depth in range(1, max_depth + 1):
        if not size["a"]["nodes"] or not size["b"]["nodes"]:
            break
        grown, other = sorted(("a", "b"), key=lambda x: _growth_cost(x, "b" if x == "a" else "a", level, size, n_pairs))
        if level[other] and not level[grown]:  # from here on from both sides: what one side found alone leaves first
            found.append(saved(_looked_up(waiting, reach, other)))
            waiting = without(found[-1])
        level[grown] += 1
        if depth == max_depth and not level[other]:  # of the last level only the nodes asked for count
            ends = reach[other].select(F.col("node").alias("dst"))
            reach[grown] = reach[grown].unionByName(_next_level(last[grown], open_roots.get(grown), reach[grown], hop.join(ends, "dst", "left_semi"), degrees, grown))
            break
        last[grown] = saved(_next_level(last[grown], open_roots.get(grown), reach[grown], hop, degrees, grown))
        reach[grown], size[grown] = reach[grown].unionByName(last[grown]), _frontier_size(last[grown])
        if level[other]:
            found.append(saved(_met(waiting, last, min(("a", "b"), key=level.get))))
            waiting = without(found[-1])
            n_pairs = waiting.count()
    if not (level["a"] and level["b"]):
        found.append(_looked_up(waiting, reach, max(("a", "b"), key=level.get)))
    paths = found[0]
    for more in found[1:]:
        paths = paths.unionByName(more)
    return paths.select("a_id", "b_id", "path", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_i")).drop("_i")


def _frontier_size(front: DataFrame):
    return front.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"), F.count_distinct("root").alias("roots")).first()


def _growth_cost(grown: str, other: str, level: dict, size: dict, n_pairs: int) -> float:
    """Edges to follow, and nodes that the pairs then look up: those of the frontiers of fewer edges from their ends."""
    if not level[other]:
        return size[grown]["edges"]
    mine_tried = level[grown] + 1 <= level[other]
    width = size[grown]["edges"] / size[grown]["roots"] if mine_tried else size[other]["nodes"] / size[other]["roots"]
    return size[grown]["edges"] + n_pairs * width


def _next_level(front: DataFrame, roots: DataFrame | None, reach: DataFrame, hop: DataFrame, degrees: DataFrame, side: str) -> DataFrame:
    """Nodes one edge further, of the roots that still wait (None: all), that the root has not reached before, with their smallest paths: from the root (a) or to it (b)."""
    front = front if roots is None else front.join(roots, "root", "left_semi")
    step = front.withColumnRenamed("node", "src").join(hop, "src")
    step = step.groupBy("root", "level", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
    step = step.join(reach.select("root", "node"), ["root", "node"], "left_anti").join(degrees, "node")
    longer = F.concat("path", F.array("node")) if side == "a" else F.concat(F.array("node"), "path")
    return step.select("root", (F.col("level") + 1).alias("level"), "node", longer.alias("path"), "degree")


def _looked_up(waiting: DataFrame, reach: dict, side: str) -> DataFrame:
    """The pairs whose other end lies among all that side has reached."""
    root, node = ("a_id", "b_id") if side == "a" else ("b_id", "a_id")
    return waiting.join(reach[side].select(F.col("root").alias(root), F.col("node").alias(node), "path"), ["a_id", "b_id"]).select("a_id", "b_id", "times", "path")


def _met(waiting: DataFrame, last: dict, tried: str) -> DataFrame:
    """a_id, b_id, times, path of the pairs whose newest frontiers share a node; those of the tried side are looked up in the other."""
    of = {x: last[x].select(F.col("root").alias(f"{x}_id"), "node", F.col("path").alias(f"{x}_path")) for x in ("a", "b")}
    other = "b" if tried == "a" else "a"
    both = waiting.join(of[tried], f"{tried}_id").join(of[other], [f"{other}_id", "node"])
    return both.groupBy("a_id", "b_id", "times").agg(F.min(F.concat("a_path", F.slice("b_path", F.lit(2), F.size("b_path")))).alias("path"))


def on_topics(edges: DataFrame, entities: DataFrame, topics: list[str]) -> DataFrame:
    """The edges whose both ends are visible."""
    fine = entities.where(visible(F.col("topic"), topics)).select("id")
    keep = lambda e, c: e.join(fine.select(F.col("id").alias(c)), c, "left_semi")
    return keep(keep(edges, "a_id"), "b_id").select(*edges.columns)


def topic_paths(edges: DataFrame, entities: DataFrame, pairs: DataFrame, topics: list[str], max_depth: int = 4) -> DataFrame:
    """a_id, b_id, path, shortcut, hidden: the shortest path; where it touches a hidden entity, the shortest among visible ones.

    shortcut: the shortest path touches a hidden entity.  hidden: no visible path exists; path is the shortest one then.
    """
    shortest = saved(shortest_paths(edges, pairs, max_depth))
    unseen = entities.where(~visible(F.col("topic"), topics)).select("id")
    touched = shortest.select("a_id", "b_id", F.explode("path").alias("id")).join(unseen, "id").select("a_id", "b_id").distinct()
    around = shortest_paths(on_topics(edges, entities, topics), touched, max_depth).withColumnRenamed("path", "around")
    got = shortest.join(touched.withColumn("shortcut", F.lit(True)), ["a_id", "b_id"], "left").join(around, ["a_id", "b_id"], "left")
    got = got.withColumn("shortcut", F.coalesce("shortcut", F.lit(False)))
    return got.select("a_id", "b_id", F.coalesce("around", "path").alias("path"), "shortcut", (F.col("shortcut") & F.col("around").isNull()).alias("hidden"))


def path_steps(paths: DataFrame, entities: DataFrame, edges: DataFrame, evidence: int = 5) -> DataFrame:
    """One row a step: pair, step number, ends with names and topics, the first evidence ids of the edge."""
    ends = F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("a"), F.expr("slice(path, 2, size(path) - 1)").alias("b"))
    step = paths.select("a_id", "b_id", F.posexplode(ends).alias("step", "e")).select("a_id", "b_id", "step", F.col("e.a").alias("from_id"), F.col("e.b").alias("to_id"))
    named = entities.select("id", "canonical_name", F.coalesce("topic", F.lit("General")).alias("topic"))
    for side in ("from", "to"):
        step = step.join(named.select(F.col("id").alias(f"{side}_id"), F.col("canonical_name").alias(f"{side}_name"), F.col("topic").alias(f"{side}_topic")), f"{side}_id")
    proof = edges.select(*pair_key("a_id", "b_id"), F.slice("message_ids", 1, evidence).alias("evidence"))
    return step.withColumn("lo", F.least("from_id", "to_id")).withColumn("hi", F.greatest("from_id", "to_id")).join(proof, ["lo", "hi"], "left").drop("lo", "hi")


def redacted(steps: DataFrame, topics: list[str]) -> DataFrame:
    """steps with locked and locked_reason: a step that touches an inactive topic loses its evidence."""
    off = F.array_compact(F.array(*[F.when(~F.col(f"{s}_topic").isin(topics), F.col(f"{s}_topic")) for s in ("from", "to")]))
    got = steps.withColumn("locked", F.size(off) > 0).withColumn("locked_reason", F.when(F.size(off) > 0, F.concat(F.lit("Inactive topic(s): "), F.array_join(off, ", "))))
    return got.withColumn("evidence", F.when(~F.col("locked"), F.col("evidence")))


def alias_names(entities: DataFrame) -> DataFrame:
    """id, name: every lower-cased name and alias once."""
    return entities.select("id", F.explode(F.array_distinct(F.transform(F.array("canonical_name", "alias1"), F.lower))).alias("name")).where("name is not null")


def same_name_pairs(names: DataFrame, block: int = NAME_BLOCK, told: DataFrame | None = None) -> DataFrame:
    """lo < hi of names (id, name): every pair that shares a name, once; with told (id, of) also lo_of and hi_of.

    The ids of a name are dealt to blocks and two blocks meet in one task, so a
    name of any number of ids is many tasks.  A pair belongs to the smallest
    name it shares, so no pair is shuffled: what is shuffled are the ids, each
    as often as its name has blocks.
    """
    names = names.where("id is not null and name is not null").distinct()
    n = names.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = names.join(n, "name").select("id", "name", F.ceil(F.col("_n") / block).cast("int").alias("_m"))
    own = shared.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("name", "_m"))).alias("_all"))
    each = own.select("id", "_all", F.posexplode("_all").alias("_k", "_x")).select("id", F.col("_x.name").alias("name"), F.col("_x._m").alias("_m"), F.slice("_all", F.lit(1), F.col("_k"))["name"].alias("before"))
    # A bit for each name before: pairs without a bit in common share none of them.
    bits = F.aggregate("before", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    dealt = each.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int")).withColumn("bits", bits)
    if told is not None:
        dealt = dealt.join(told.select("id", "of"), "id")
    of = lambda c: [F.col("of").alias(f"{c}_of")] if told is not None else []
    a = dealt.select("name", F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_m") - 1)).alias("_j"), F.col("id").alias("x"), F.col("before").alias("x_before"), F.col("bits").alias("x_bits"), *of("x"))
    b = dealt.select("name", F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"), F.col("id").alias("y"), F.col("before").alias("y_before"), F.col("bits").alias("y_bits"), *of("y"))
    once = (F.col("_i") < F.col("_j")) | (F.col("x") < F.col("y"))
    new = (F.col("x_bits").bitwiseAND(F.col("y_bits")) == 0) | ~F.arrays_overlap("x_before", "y_before")
    both = [F.when((F.col("x") < F.col("y")) == low, F.col("x_of")).otherwise(F.col("y_of")).alias(c) for c, low in (("lo_of", True), ("hi_of", False))] if told is not None else []
    # Few bytes make many pairs, so by their bytes they would be few tasks.
    a, b = (x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name", "_i", "_j") for x in (a, b))
    return a.join(b, ["name", "_i", "_j"]).where(once & new).select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), *both)


def alias_collisions(entities: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Pairs lo < hi that share a name; with ids, only pairs that touch one.

    Entities with the same shared names are of one kind, dealt to blocks of ids. Blocks meet, not ids, each two once, and are spread
    out in the task in which they met.
    """
    names = alias_names(entities)
    if ids is None:
        each = names.where("id is not null").groupBy("id").agg(F.collect_set("name").alias("names")).select("id", F.explode("names").alias("name"))
        common = each.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("name")
        own = each.join(common, "name", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("names"))
        n = own.groupBy("names").agg(F.ceil(F.count(F.lit(1)) / KIND_BLOCK).cast("int").alias("_m"))
        dealt = own.join(n, "names").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_m")))
        kinds = saved(dealt.groupBy("names", "_b").agg(F.min("id").alias("id"), F.collect_list("id").alias("of")))
        two = same_name_pairs(kinds.select("id", F.explode("names").alias("name")), NAME_KINDS, kinds.select("id", "of"))
        met = two.select(F.explode("lo_of").alias("x"), "hi_of").select("x", F.explode("hi_of").alias("y"))
        within = kinds.where(F.size("of") > 1).select(F.explode("of").alias("x"), "of").select("x", F.explode("of").alias("y")).where("x < y")
        return met.unionByName(within).select(*pair_key("x", "y"))
    some = names.join(ids.select("id"), "id", "left_semi").withColumnRenamed("id", "x")
    return some.join(names.withColumnRenamed("id", "y"), "name").where("x <> y").select(*pair_key("x", "y")).distinct()


def hierarchy_candidates(edges: DataFrame, entities: DataFrame, part_of: DataFrame, rules: DataFrame, min_weight: int = 2) -> DataFrame:
    """Same-topic pairs whose types fit a rule, heavy enough, not yet part of one another."""
    e = undirected(edges.where(F.col("weight") >= min_weight)).select("src", "dst", "weight")
    side = lambda c: entities.select(F.col("id").alias(f"{c}_id"), F.col("type").alias(f"{c}_type"), F.col("topic").alias(f"{c}_topic"))
    got = e.withColumnsRenamed({"src": "parent_id", "dst": "child_id"}).join(side("parent"), "parent_id").join(side("child"), "child_id")
    got = got.where("parent_topic = child_topic").join(rules, ["parent_type", "child_type"])
    return got.join(part_of, ["parent_id", "child_id"], "left_anti").select("parent_id", "child_id", "parent_type", "child_type", "weight")


def shared_neighbors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with the number of common neighbours, the protected entity aside.

    Only neighbours that some first and some second end have count.  Through
    them, or from the neighbours of either end of the pairs: what makes the
    fewest rows, by exact counts.
    """
    asked = saved(pairs.select("a_id", "b_id").distinct())
    near = undirected(edges).select("src", "dst").distinct().where(F.col("dst") != PROTECTED)
    ends = {c: asked.select(F.col(c).alias("src")).distinct() for c in ("a_id", "b_id")}
    b = saved(near.join(ends["b_id"], "src", "left_semi"))
    a = saved(near.join(ends["a_id"], "src", "left_semi").join(b.select("dst").distinct(), "dst", "left_semi").select("src", "dst"))
    b = b.join(a.select("dst").distinct(), "dst", "left_semi").select("src", "dst")
    a, b = a.withColumnRenamed("src", "a_id"), saved(b).withColumnRenamed("src", "b_id")
    count = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = lambda df, n: df.agg(F.coalesce(F.sum(n), F.lit(0).cast("long"))).first()[0]
    cost = {c: rows(asked.join(count(of, c), c), F.col("n")) for c, of in (("a_id", a), ("b_id", b))}
    cost["dst"] = rows(count(a, "dst").join(count(b, "dst").withColumnRenamed("n", "m"), "dst"), F.col("n") * F.col("m"))
    way = min(cost, key=cost.get)
    if way == "dst":
        both = a.join(b, "dst").groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"))
    else:
        first, then, other = (a, b, "b_id") if way == "a_id" else (b, a, "a_id")
        both = asked.join(first, way).join(then, [other, "dst"]).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(both, ["a_id", "b_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def orphans(entities: DataFrame, facts: DataFrame, edges: DataFrame, part_of: DataFrame, now: Column, hours: int = 24, days: int = 30) -> DataFrame:
    """Entities without active facts that are unlinked and stale, or linked to the protected one only and very stale."""
    plain = entities.where(F.col("id") != PROTECTED).join(active(facts).select(F.col("source_entity_id").alias("id")), "id", "left_anti")
    degree = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("dst") != PROTECTED).alias("others"), F.count(F.lit(1)).alias("degree"))
    links = part_of.select(F.col("child_id").alias("id")).unionByName(part_of.select(F.col("parent_id").alias("id"))).distinct()
    got = plain.join(degree, "id", "left").join(links, "id", "left_anti")
    lone = F.coalesce("degree", F.lit(0)) == 0
    old = lambda n: F.unix_timestamp("last_mentioned") < F.unix_timestamp(now) - n
    return got.where(lone & old(hours * 3600) | ~lone & (F.col("others") == 0) & old(days * 86400)).select("id", "canonical_name")
