"""Nearest neighbours by cosine: stated queries against a corpus, and all rows among themselves.

Vectors of each length are compared among themselves only.  Null and empty
vectors and those with null or non-finite components take no part; a zero
vector has cosine 0 to all.  Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import l2norm
from kgspark.operators.recovery import saved

#: Vectors of a query block and of a corpus block multiplied at once.
QUERY_BLOCK, CORPUS_BLOCK = 512, 4096
#: Queries and corpus rows of a cell; of these so many are multiplied at once.
CELL, QUERY_ROWS, CORPUS_ROWS = 16384, 1024, 4096
#: Components of the vectors packed into one row, vectors a task asks for, and vectors of a part of the corpus that they meet.
PACK, TASK_ROWS, PART_ROWS = 131_072, 4096, 262_144
#: Parts that rows of one vector are ranked in before they are ranked together.
SALTS = 64
FOUND = "qid long, id long, score double"


def usable(df: DataFrame) -> DataFrame:
    """The rows whose vec takes part."""
    return df.where((F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def blocks(df: DataFrame, key: list[str], id_col: str, size: int) -> DataFrame:
    """key, _n (blocks of the key), _s (number of the block), ids, vecs: blocks of about size rows."""
    n = df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_n"))
    dealt = df.join(n, key).withColumn("_s", F.pmod(F.xxhash64(id_col), F.col("_n")).cast("int"))
    return dealt.groupBy(*key, "_n", "_s").agg(F.collect_list(id_col).alias("ids"), F.collect_list("vec").alias("vecs"))


def _first(order: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k smallest values of each row, ties to the smaller id: only what is not beyond the k-th value is sorted."""
    if k < order.shape[1]:
        row, col = np.nonzero(order <= np.partition(order, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, col = (x.ravel() for x in np.indices(order.shape))
    sort = np.lexsort((ids[col], order[row, col], row))
    row, col = row[sort], col[sort]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def best_of(met: DataFrame, k: int) -> DataFrame:
    """met: qids, qvecs, ids, vecs of blocks that meet. The k best of each query in each, as FOUND rows."""

    def best(batches):
        for pdf in batches:
            for qids, qvecs, ids, vecs in zip(pdf.qids, pdf.qvecs, pdf.ids, pdf.vecs):
                q, c = np.stack(list(qvecs)).astype(np.float64), np.stack(list(vecs)).astype(np.float64)
                ids = np.asarray(ids)
                nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
                s = (q @ c.T) / np.where(nq == 0, 1, nq)[:, None] / np.where(nc == 0, 1, nc)[None, :]
                row, col = _first(-np.round(s, 12), ids, k)
                yield pd.DataFrame({"qid": np.asarray(qids)[row], "id": ids[col], "score": s[row, col]})

    return met.select("qids", "qvecs", "ids", "vecs").mapInPandas(best, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id"))
    return found.withColumn("rank", rn).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """qid, id, score, rank: the k nearest by cosine, the floor applied after the cut. queries: qid, vec; corpus: id, vec.

    Queries and corpus are dealt to chunks and each two chunks are a cell, a
    group of its own: a task holds one cell, multiplies matrices and keeps k a
    query; the window merges the cells.
    """
    asked, stored = (usable(df.select(i, "vec")).withColumn("_d", F.size("vec")) for df, i in ((queries, "qid"), (corpus, "id")))
    chunks = lambda df, n: df.groupBy("_d").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(n))
    n = chunks(asked, "_m").join(chunks(stored, "_n"), "_d")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda i, c: F.pmod(F.xxhash64(i), F.col(c)).cast("int")
    key = ["_d", "_q", "_s"]
    q = asked.join(n, "_d").select("_d", dealt("qid", "_m").alias("_q"), every("_n").alias("_s"), "qid", F.col("vec").alias("qvec")).groupBy(*key)
    c = stored.join(n, "_d").select("_d", every("_m").alias("_q"), dealt("id", "_n").alias("_s"), "id", F.col("vec").alias("vec")).groupBy(*key)
    got = ranked(q.cogroup(c).applyInPandas(_cell(k, floor), FOUND), k)
    return got if floor is None else got.where(F.col("score") >= floor)


def _cell(k: int, floor: float | None = None):
    """A function of the queries (qid, qvec) and corpus rows (id, vec) of a cell: the k best of each query.

    Once a query has k, only what comes near to its k-th is looked at: scores of normed vectors leave out the rest, and those
    of the vectors themselves decide.  So it is with what is under the floor, which leaves after the cut in any case.
    """

    def best(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or stored.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        q, c = (np.stack(list(x)).astype(np.float64) for x in (asked.qvec, stored.vec))
        qids, ids = asked.qid.to_numpy(), stored.id.to_numpy()
        nq, nc = (np.linalg.norm(x, axis=1) for x in (q, c))
        nq, nc = np.where(nq == 0, 1, nq), np.where(nc == 0, 1, nc)
        qn, cn = q / nq[:, None], c / nc[:, None]
        out = []
        for a in range(0, len(q), QUERY_ROWS):
            rows = qn[a : a + QUERY_ROWS]
            least, have = np.full(len(rows), -np.inf if floor is None else floor - 1e-9), (np.empty(0, int), np.empty(0, int), np.empty(0))
            for b in range(0, len(c), CORPUS_ROWS):
                s = rows @ cn[b : b + CORPUS_ROWS].T
                if b == 0 and k < s.shape[1] and floor is None:
                    least = np.partition(s, -k, axis=1)[:, -k]
                row, col = np.nonzero(s >= least[:, None] - 1e-9)
                score = np.einsum("ij,ij->i", q[a + row], c[b + col]) / nq[a + row] / nc[b + col]
                row, col, score = (np.concatenate(x) for x in zip(have, (row, b + col, score)))
                sort = np.lexsort((ids[col], -np.round(score, 12), row))
                row, col, score = row[sort], col[sort], score[sort]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                have = tuple(x[place < k] for x in (row, col, score))
                last = place == k - 1
                least[row[last]] = np.maximum(least[row[last]], score[last])
            out.append(pd.DataFrame({"qid": qids[a + have[0]], "id": ids[have[1]], "score": have[2]}))
        return pd.concat(out, ignore_index=True)

    return best


def near_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """k, l, r, score of left (k, l, vec) and right (k, r, vec) of one k whose cosine is at least so much (over 0).

    The rows of a k are dealt to blocks, and each pair of blocks is a key of its own, so a k with very many rows is many tasks.
    """
    if least <= 0:
        raise ValueError("vectors of unequal length have cosine 0")
    one = blocks(usable(left.select("k", "l", "vec")).withColumn("_d", F.size("vec")), ["k", "_d"], "l", QUERY_BLOCK)
    two = blocks(usable(right.select("k", "r", "vec")).withColumn("_d", F.size("vec")), ["k", "_d"], "r", QUERY_BLOCK)
    counts = two.groupBy("k", "_d").agg(F.max("_n").alias("_m"))
    asked = one.join(counts, ["k", "_d"]).select("k", "_d", F.col("ids").alias("ls"), F.col("vecs").alias("lvecs"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_s"))
    met = asked.join(two.select("k", "_d", "_s", F.col("ids").alias("rs"), F.col("vecs").alias("rvecs")), ["k", "_d", "_s"])

    def near(batches):
        for pdf in batches:
            for k, ls, lvecs, rs, rvecs in zip(pdf.k, pdf.ls, pdf.lvecs, pdf.rs, pdf.rvecs):
                q, c = np.stack(list(lvecs)).astype(np.float64), np.stack(list(rvecs)).astype(np.float64)
                nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
                s = (q @ c.T) / np.where(nq == 0, 1, nq)[:, None] / np.where(nc == 0, 1, nc)[None, :]
                i, j = np.nonzero(np.round(s, 12) >= least)
                yield pd.DataFrame({"k": pd.Series([k] * len(i), dtype=object), "l": np.asarray(ls)[i], "r": np.asarray(rs)[j], "score": s[i, j]})

    of = {c: df.schema[c].dataType.simpleString() for c, df in (("k", left), ("l", left), ("r", right))}
    return met.select("k", "ls", "lvecs", "rs", "rvecs").mapInPandas(near, f"k {of['k']}, l {of['l']}, r {of['r']}, score double")


@dataclass(frozen=True)
class Lsh:
    """Random projections of unit vectors cut into buckets of a length; rows meet where all projections of a table agree.

    The defaults find most neighbours even where nothing is near: of 2,000 vectors
    without structure (the 49th neighbour at cosine 0.25) 0.94 of the 49 nearest,
    comparing 0.79 of all pairs.  Where rows lie in clusters more projections will
    do: with 6 of them 0.99 of the 40 nearest, comparing 0.20.
    """

    tables: int = 12
    projections: int = 3
    length: float = 0.5
    seed: int = 7

    def keys(self, df: DataFrame) -> DataFrame:
        """df, all of one length, with _keys: for each table a hash of its buckets."""
        # Each step is stored: in one projection Spark would do the steps below it anew for every table and bucket.
        unit = saved(df.withColumn("_u", array_to_vector(l2norm(F.col("vec")))))
        model = BucketedRandomProjectionLSH(inputCol="_u", outputCol="_h", bucketLength=self.length, numHashTables=self.tables * self.projections, seed=self.seed).fit(unit)
        cells = F.transform("_h", lambda h: F.get(vector_to_array(h), F.lit(0)))
        table = lambda i: F.xxhash64(i, F.slice(F.col("_c"), i * self.projections + 1, F.lit(self.projections)))
        return saved(saved(model.transform(unit)).withColumn("_c", cells)).withColumn("_keys", F.transform(F.sequence(F.lit(0), F.lit(self.tables - 1)), table)).drop("_u", "_h", "_c")


def bucket_topk(queries: DataFrame, corpus: DataFrame, k: int, lsh: Lsh) -> DataFrame:
    """As vector_topk, of the corpus rows that share a bucket with the query; all of one length. A full bucket is many blocks."""
    key = lambda df: lsh.keys(df).withColumn("_key", F.explode("_keys")).drop("_keys")
    asked = blocks(key(usable(queries.select("qid", "vec"))), ["_key"], "qid", QUERY_BLOCK)
    stored = blocks(key(usable(corpus.select("id", "vec"))), ["_key"], "id", CORPUS_BLOCK)
    met = asked.select("_key", F.col("ids").alias("qids"), F.col("vecs").alias("qvecs")).join(stored.select("_key", "ids", "vecs"), "_key")
    # A row met in several buckets has one place.
    return ranked(best_of(met, k).groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def _packed(classes: DataFrame, parts: int) -> DataFrame:
    """d, qids, sizes, ids, vecs: rows (qid, ids, vec) of one length packed as bytes, up to PACK in one; dealt to so many partitions."""
    kind = np.float32 if classes.schema["vec"].dataType.elementType.typeName() == "float" else np.float64

    def pack(batches):
        for pdf in batches:
            for d, rows in pdf.groupby(pdf.vec.map(len)):
                n = max(1, PACK // int(d))
                for a in range(0, len(rows), n):
                    some = rows.iloc[a : a + n]
                    parts = some.qid.to_numpy(np.int64), some.ids.map(len).to_numpy(np.int64), np.concatenate(list(some.ids)).astype(np.int64), np.stack(list(some.vec)).astype(kind)
                    yield pd.DataFrame([(int(d), *(x.tobytes() for x in parts))], columns=["d", "qids", "sizes", "ids", "vecs"])

    return classes.select("qid", "ids", "vec").repartition(parts).mapInPandas(pack, "d int, qids binary, sizes binary, ids binary, vecs binary")


def _nearest(k: int, kind: type):
    """A function of packed queries (d, qids, qvecs) that each meet packed rows (sizes, ids, vecs): the k best ids of each query.

    Scores of normed single-precision vectors leave out what is not near a query's k-th, those of the vectors themselves decide.
    What comes near waits until it is as much as is kept, so it is sorted a few times only.
    """

    def best(batches):
        qids = None
        for pdf in batches:
            for d, asked, qvecs, sizes, ids, vecs in zip(pdf.d, pdf.qids, pdf.qvecs, pdf.sizes, pdf.ids, pdf.vecs):
                if asked != qids:
                    if qids is not None:
                        yield told()
                    qids, kept, late, n_late = asked, [np.empty(0, int), np.empty(0, int), np.empty(0)], [], 0
                    q = np.frombuffer(qvecs, kind).reshape(-1, d).astype(np.float64)
                    nq = np.linalg.norm(q, axis=1)
                    nq = np.where(nq == 0, 1, nq)
                    qn, least, slack = (q / nq[:, None]).astype(np.float32), np.full(len(q), -np.inf, np.float32), 1e-8 + 1.2e-7 * (d + 8)

                    def cut():
                        nonlocal kept, late, n_late, least
                        row, of, score = (np.concatenate(x) for x in zip(kept, *late))
                        sort = np.lexsort((of, -np.round(score, 9), row))
                        row, of, score = row[sort], of[sort], score[sort]
                        place = np.arange(len(row)) - np.searchsorted(row, row)
                        kept, late, n_late = [x[place < k] for x in (row, of, score)], [], 0
                        least[row[place == k - 1]] = score[place == k - 1]

                    def told():
                        cut()
                        return pd.DataFrame({"qid": np.frombuffer(qids, np.int64)[kept[0]], "id": kept[1], "score": kept[2]})

                c, sizes, ids = np.frombuffer(vecs, kind).reshape(-1, d).astype(np.float64), np.frombuffer(sizes, np.int64), np.frombuffer(ids, np.int64)
                nc = np.linalg.norm(c, axis=1)
                nc = np.where(nc == 0, 1, nc)
                s = qn @ (c / nc[:, None]).astype(np.float32).T
                if k <= s.shape[1] and not np.isfinite(least).all():
                    least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - np.float32(slack))
                row, col = np.divmod(np.flatnonzero(s >= (least - np.float32(slack))[:, None]), s.shape[1])
                score = np.concatenate([np.einsum("ij,ij->i", q[x], c[y]) / nq[x] / nc[y] for x, y in zip(*(np.array_split(z, 1 + len(row) * d // PACK) for z in (row, col)))])
                start = np.cumsum(sizes) - sizes
                if len(row) > 4 * len(q) * k:  # so many are equally near: of vectors too, k with the smallest first ids will do
                    sort = np.lexsort((np.minimum.reduceat(ids, start)[col], -np.round(score, 9), row))
                    row, col, score = row[sort], col[sort], score[sort]
                    few = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, col, score = row[few], col[few], score[few]
                n = sizes[col]
                late.append((np.repeat(row, n), ids[np.repeat(start[col] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(score, n)))
                n_late += len(late[-1][0])
                if n_late >= len(q) * k:
                    cut()
        if qids is not None:
            yield told()

    return best


def self_topk(classes: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank of rows (qid, ids, vec): of each vector the k nearest ids, its own counted.

    Packed rows are stored once and all meet: a task takes some queries through a part of the corpus row by row and keeps k a query,
    so vectors are not shuffled for it, and what is are k rows a query and part.
    """
    n = classes.count()
    packed = saved(_packed(classes, max(1, -(-n // TASK_ROWS))))
    kind = np.float32 if classes.schema["vec"].dataType.elementType.typeName() == "float" else np.float64
    stored = packed.coalesce(max(1, -(-n // PART_ROWS))).select("d", "sizes", "ids", "vecs").hint("shuffle_replicate_nl")
    met = packed.select("d", "qids", F.col("vecs").alias("qvecs")).join(stored, "d")
    return ranked(met.mapInPandas(_nearest(k, kind), FOUND), k)


def knn_self(vectors: DataFrame, k: int = 50, lsh: Lsh | None = None) -> DataFrame:
    """id, other, score: the k nearest of each row (id, vec), itself counted and then dropped.

    Without lsh exact, pack by pack, which is work with the square of the
    distinct vectors; with it only rows that share a bucket are compared, those
    of each length by buckets of their own.  Rows of equal vectors are one
    query, and of such rows only the k with the smallest ids can be neighbours,
    so a vector that very many rows have costs no more than one.
    """
    v = usable(vectors.select("id", "vec"))
    one = saved(v.groupBy("vec").agg(F.min("id").alias("qid")))
    members = saved(v.join(one, "vec").select("id", "qid"))
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("id"))
    few = members.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("_r", place("qid", "_p")).where(F.col("_r") <= k).withColumn("_r", place("qid")).where(F.col("_r") <= k)
    classes = saved(few.groupBy("qid").agg(F.collect_list("id").alias("ids")).join(one, "qid"))
    if lsh is None:
        found = self_topk(classes, k)
    else:
        of = [classes.where(F.size("vec") == r.d) for r in classes.select(F.size("vec").alias("d")).distinct().orderBy("d").collect()]
        each = [bucket_topk(c.select("qid", "vec"), c.select(F.explode("ids").alias("id"), "vec"), k, lsh) for c in of]
        found = reduce(DataFrame.unionByName, each) if each else self_topk(classes, k)
    return members.join(found.select("qid", F.col("id").alias("other"), "score"), "qid").where("id <> other").select("id", "other", "score")


def recall(vectors: DataFrame, k: int, lsh: Lsh, queries: DataFrame) -> tuple[float, float]:
    """(share of the k nearest that the buckets hold, share of all pairs that meet) over stated queries (qid, vec)."""
    exact = vector_topk(queries, vectors, k).select("qid", "id")
    hit = exact.join(bucket_topk(queries, vectors, k, lsh).select("qid", "id"), ["qid", "id"], "left_semi").count() / max(1, exact.count())
    keys = lambda df, i: lsh.keys(df).select(F.col(i).alias(i), F.explode("_keys").alias("_key"))
    met = keys(usable(queries.select("qid", "vec")), "qid").join(keys(usable(vectors.select("id", "vec")), "id"), "_key").select("qid", "id").distinct().count()
    return hit, met / max(1, queries.count() * vectors.count())
