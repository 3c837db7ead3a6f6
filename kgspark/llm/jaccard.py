"""Exact n-gram Jaccard join by vertical partitioning, returned as linked groups.

1. Every text becomes its set of shingle hashes; equal sets are one class.
2. A first filter in hash order: two sets at the wanted similarity share several
   of their smallest hashes, so only classes with enough shared ones go on.
3. The global order of n-grams is by document frequency, rare ones first. A class
   goes on only if enough of its n-grams occur elsewhere.
4. The order is cut at quantiles into FRAGMENTS; each set falls into segments.
5. Each prefix n-gram links its classes to the smallest of them as candidates, so
   candidates are as many as postings, never all pairs. Overlaps are counted
   per fragment and summed per pair.
6. Candidates form clusters. Where a cluster is not one component yet, its classes
   meet in blocks of about BLOCK: a task counts the partial overlaps of two blocks
   in one fragment as a matrix, matrices are summed over fragments, and of the
   links only a spanning forest is returned. No link is lost.

Defined cases: null or wordless text has an empty set, linked with nothing;
equal sets are always linked; repeated rows belong to one class; rows that
share a doc_id but not a text are judged separately; an empty table gives no
rows; extra columns are kept by drop_copies and left out elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm import shingles
from kgspark.llm.common import fresh, join_checked, load, materialize, own
from kgspark.llm.components import components

FRAGMENTS, BLOCK = 6, 256


def at_least(n: Column, num: int, den: int) -> Column:
    """Overlap that a set of n needs with any partner."""
    return F.ceil(n * num / F.lit(float(den)) - 1e-9).cast("long")


def _at_least(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def _extra(n: int) -> int:
    return max(1, -(-n // 20))


def hash_sets(docs: DataFrame, n: int, keep) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(shingles.hasher(n, keep), shingles.DDL)


def count_shared(batches):
    """Over rows sorted by (h, cls): how many of each class's hashes another class has too, in parts."""
    held = None  # the last distinct row so far, and whether it was already counted
    for pdf in batches:
        h, c = pdf["h"].to_numpy(), pdf["cls"].to_numpy()
        done = np.zeros(len(h) + (held is not None), bool)
        if held is not None:
            h, c, done[0] = np.r_[held[0], h], np.r_[held[1], c], held[2]
        if not len(h):
            continue
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        h, c, done = h[new], c[new], done[new]
        same = h[1:] == h[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        count = shared & ~done
        held = (h[-1], c[-1], bool(done[-1] or shared[-1]))
        ids, k = np.unique(c[count], return_counts=True)
        yield pd.DataFrame({"cls": ids, "k": k})


def classes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Materialized rows: doc_id, text_key, n, cls, first (smallest doc_id of the class), hashes (smallest ones; first rows only)."""
    keep = lambda size: size - _at_least(size, num, den) + _extra(size)
    rows = materialize(hash_sets(docs, n, keep).withColumn("cls", F.when(F.col("n") > 0, F.xxhash64("sig"))))
    many = materialize(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    return join_checked(rows.drop("sig"), many, "cls", "left", row_bytes=32).withColumn("first", F.coalesce("first", "doc_id"))


def candidates_by_prefix(rows: DataFrame, num: int, den: int) -> DataFrame:
    """cls, first of the classes that share enough of their smallest hashes (materialized)."""
    firsts = rows.where("cls is not null and doc_id = first")
    posted = firsts.select("cls", F.explode("hashes").alias("h"))
    counted = posted.repartition("h").sortWithinPartitions("h", "cls").mapInPandas(count_shared, "cls long, k long")
    own = firsts.groupBy("cls").agg(F.first("n").alias("n"), F.first("first").alias("first"))
    need = F.greatest(F.lit(1), F.ceil(at_least(F.col("n"), num, den) / F.lit(20.0) - 1e-9))
    return materialize(counted.groupBy("cls").agg(F.sum("k").alias("k")).join(own, "cls").where(F.col("k") >= need).select("cls", "first"))


def ordered_sets(docs: DataFrame, some: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """cls, n, tokens (df and h of the n-grams that other classes have, rare first; materialized)."""
    ids = materialize(some.select(F.col("first").alias("doc_id")).distinct())
    texts = join_checked(docs.select("doc_id", "text"), ids, "doc_id", "left_semi", row_bytes=16)
    sets = hash_sets(texts, n, lambda size: size).withColumn("cls", F.xxhash64("sig")).dropDuplicates(["cls"])
    sets = materialize(sets.join(some.select("cls"), "cls", "left_semi").select("cls", "n", "hashes"))
    for _ in range(2):  # classes that fall out leave n-grams to fewer holders
        posted = sets.select("cls", "n", F.explode("hashes").alias("h"))
        shared = posted.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        held = posted.join(shared, "h").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("tokens"))
        kept = materialize(held.where(F.size("tokens") >= at_least(F.col("n"), num, den)))
        sets = kept.select("cls", "n", F.col("tokens.h").alias("hashes"))
    return kept


def segments(sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """cls, n, frag, hs: each set cut at quantiles of the global order (materialized)."""
    key = lambda t: t["df"].cast("double") + (t["h"].cast("double") / 2.0**64 + 0.5)  # noqa: E731  df, then hash, as one number
    parts = [(i + 1) / fragments for i in range(fragments - 1)]
    pivots = sets.select(F.explode("tokens").alias("t")).select(F.percentile_approx(key(F.col("t")), parts, 1000)).first()[0] or [0.0] * (fragments - 1)
    lows, highs = [float("-inf"), *pivots], [*pivots, float("inf")]

    def segment(a: float, b: float) -> Column:
        return F.transform(F.filter("tokens", lambda t: (key(t) >= a) & (key(t) < b)), lambda t: t["h"])

    cut = F.array(*map(segment, lows, highs))
    return materialize(sets.select("cls", "n", F.posexplode(cut).alias("frag", "hs")).where(F.size("hs") > 0))


def star_pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: each class with the smallest class of each of its prefix lists (materialized)."""
    size = F.col("n") - at_least(F.col("n"), num, den) + 1 - (F.col("n") - F.size("tokens"))
    posted = materialize(sets.select("cls", F.explode(F.slice(F.col("tokens.h"), F.lit(1), F.greatest(size, F.lit(1)).cast("int"))).alias("h")))
    leads = posted.groupBy("h").agg(F.min("cls").alias("lead"))
    return materialize(posted.join(leads, "h").where("lead <> cls").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct())


def linked(pairs: DataFrame, cut: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs at the wanted similarity: overlaps per fragment, summed per pair."""
    sizes = cut.select("cls", "n").distinct()
    fits = pairs.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
    fits = fits.where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    left = cut.select(F.col("cls").alias("a"), "frag", F.col("hs").alias("ha"))
    right = cut.select(F.col("cls").alias("b"), "frag", F.col("hs").alias("hb"))
    part = fits.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("k"))
    summed = part.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    return materialize(summed.where(den * F.col("k") >= num * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b"))


def block_links(nodes: DataFrame, cut: DataFrame, num: int, den: int) -> DataFrame:
    """Links between classes of one cluster (nodes: cls, n, cluster, comp) that join different components."""
    # Partners' sizes differ by the similarity at most, so they lie in the same size band or the next.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).cast("int")
    banded = nodes.withColumn("band", band)
    blocks = banded.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = banded.join(blocks, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).select("cluster", "band", "block", "cls", "n", "comp")
    member = F.struct("cls", "n", "comp", "hs")
    packed = materialize(dealt.join(cut.drop("n"), "cls").groupBy("cluster", "frag", "band", "block").agg(F.sort_array(F.collect_list(member)).alias("m")))
    side = lambda s: packed.select("cluster", "frag", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "block")], *[F.col(f"m.{c}").alias(f"{c}_{s}") for c in ("cls", "n", "comp", "hs")])
    a, b = side("a"), side("b")
    ahead = (F.col("band_a") < F.col("band_b")) | (F.col("band_a") == F.col("band_b")) & (F.col("block_a") <= F.col("block_b"))
    met = a.join(b, ["cluster", "frag"]).where(ahead & (F.col("band_b") - F.col("band_a") <= 1))
    ids = "cluster long, band_a int, block_a long, band_b int, block_b long, cls_a array<long>, n_a array<long>, comp_a array<long>, cls_b array<long>, n_b array<long>, comp_b array<long>"
    names = [x.split()[0] for x in ids.split(", ")]

    def partial(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                counts = overlaps(r.hs_a, r.hs_b)
                yield pd.DataFrame([[*(getattr(r, x) for x in names), counts.astype(np.int32).tobytes()]], columns=[*names, "counts"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        # A fragment holds only the members that have n-grams in it, so matrices are added by member.
        at = {}
        for s in "ab":
            at[s] = {}
            for cls, n, comp in zip(pdf[f"cls_{s}"], pdf[f"n_{s}"], pdf[f"comp_{s}"]):
                at[s].update(zip(cls, zip(n, comp)))
        ia, ib = ({c: i for i, c in enumerate(at[s])} for s in "ab")
        k = np.zeros((len(ia), len(ib)), np.int64)
        for ca, cb, raw in zip(pdf.cls_a, pdf.cls_b, pdf.counts):
            k[np.ix_([ia[c] for c in ca], [ib[c] for c in cb])] += np.frombuffer(raw, np.int32).reshape(len(ca), len(cb))
        na, nb = (np.array([v[0] for v in at[s].values()]) for s in "ab")
        hit = den * k >= num * (na[:, None] + nb[None, :] - k)
        ka, kb = list(at["a"].items()), list(at["b"].items())
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(hit)):
            x, y = root(ka[i][1][1]), root(kb[j][1][1])
            if x != y:
                parent[x] = y
                out.append((ka[i][0], kb[j][0]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    parts = met.mapInPandas(partial, f"{ids}, counts binary")
    return materialize(parts.groupBy("cluster", "band_a", "block_a", "band_b", "block_b").applyInPandas(total, "a long, b long"))


def overlaps(left, right) -> np.ndarray:
    """Sizes of the intersections of every set of left with every set of right."""
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    ta, tb = np.concatenate(list(left)), np.concatenate(list(right))
    both = np.intersect1d(ta, tb)
    out = np.zeros((len(la), len(lb)), np.float32)
    ra, rb = np.repeat(np.arange(len(la)), la), np.repeat(np.arange(len(lb)), lb)
    pa_, pb = np.searchsorted(both, ta), np.searchsorted(both, tb)
    step = 1 << 13  # columns at a time, to bound memory
    ina, inb = (pa_ < len(both)), (pb < len(both))
    ina[ina] = both[pa_[ina]] == ta[ina]
    inb[inb] = both[pb[inb]] == tb[inb]
    ra, pa_, rb, pb = ra[ina], pa_[ina], rb[inb], pb[inb]
    for c in range(0, len(both), step):
        width = min(step, len(both) - c)
        a, b = np.zeros((len(la), width), np.float32), np.zeros((len(lb), width), np.float32)
        s = (pa_ >= c) & (pa_ < c + width)
        a[ra[s], pa_[s] - c] = 1
        s = (pb >= c) & (pb < c + width)
        b[rb[s], pb[s] - c] = 1
        out += a @ b.T
    return out


def links(docs: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, label (classes): label is the smallest class of the component, for classes that are not it."""
    sets = ordered_sets(docs, candidates_by_prefix(rows, num, den), n, num, den)
    pairs, cut = star_pairs(sets, num, den), segments(sets)
    found = linked(pairs, cut, num, den)
    comp, cluster = components(found), components(pairs)
    members = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    members = members.join(cluster.select(F.col("node").alias("cls"), F.col("label").alias("cluster")), "cls", "left").join(comp.select(F.col("node").alias("cls"), F.col("label").alias("comp")), "cls", "left")
    members = materialize(members.select("cls", F.coalesce("cluster", "cls").alias("cluster"), F.coalesce("comp", "cls").alias("comp")))
    open_ = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("k > 2 and lo <> hi").select("cluster")
    nodes = materialize(members.join(open_, "cluster", "left_semi").join(cut.select("cls", "n").distinct(), "cls"))
    if nodes.isEmpty():
        return comp
    return components(found.unionByName(block_links(nodes, cut, num, den)))


def groups(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id of every row; linked at Jaccard similarity num/den or more."""
    rows = classes(docs, n, num, den)
    label = links(docs, rows, n, num, den)
    firsts = rows.where("cls is not null and doc_id = first").groupBy("cls").agg(F.min("first").alias("first"))
    named = label.unionByName(label.select(F.col("label").alias("node"), "label").distinct())
    with_first = named.join(firsts, named["node"] == firsts["cls"]).select("node", "label", "first")
    least = with_first.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = materialize(with_first.join(least, "label").select(F.col("node").alias("cls"), "component_id"))
    out = join_checked(rows, ids, "cls", "left", row_bytes=32)
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "first").alias("component_id"))


def drop_copies(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest doc_id stays."""
    found = materialize(groups(docs, n, num, den))
    gone = materialize(found.where("doc_id <> component_id").select("doc_id", "text_key").distinct())
    same = found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("text_key").alias("keep_key")).where("k > 1")
    key, keep, r = (fresh(docs, c) for c in ("text_key", "keep_key", "r"))
    gone = gone.withColumnRenamed("text_key", key)
    left = join_checked(docs.withColumn(key, F.xxhash64("text")), gone, ["doc_id", key], "left_anti", row_bytes=32)
    if not same.isEmpty():  # rows that repeat the doc_id of a group's first: one of them stays
        from pyspark.sql import Window as W

        twice = same.select("doc_id", F.col("keep_key").alias(keep))
        one = left.join(twice, "doc_id").where(F.col(key) == F.col(keep)).withColumn(r, F.row_number().over(W.partitionBy("doc_id").orderBy(key))).where(F.col(r) == 1).drop(r, keep)
        left = left.join(twice, "doc_id", "left_anti").unionByName(one)
    return left.select(*own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs, n=4, num=85, den=100).drop("text_key")
