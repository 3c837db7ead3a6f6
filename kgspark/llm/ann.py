"""Nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length, padded to a power of two and turned by
pseudo-rotations (three rounds of random signs and a fast Hadamard transform);
a table's bucket is the signed axis nearest to the turned vector.  A query
probes, in each table, the PROBES buckets of its largest signed coordinates.
Rows of a bucket are packed into blocks of about BLOCK vectors, so a full
bucket is many rows; queries meet blocks bucket by bucket, a task multiplies
the two matrices and keeps each query's k best, and the exact scores (double
precision, original vectors) of all blocks are merged per query.

For inner products of vectors of unequal length an extra coordinate
sqrt(M^2 - |x|^2) is added before scaling (M the largest length), which makes
the largest inner product the smallest angle.

Defined cases: null, zero or wrong-length vectors and those with null or
non-finite components take no part (nor do null ids); equal vectors are all
candidates and ties go to the smaller id; with fewer than k candidates all
are returned; rows that repeat an id and its vector have one place; queries skip all rows
with their own id; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.common import load, materialize

TABLES, PROBES, BLOCK, QUERY_BLOCK, SEED, K = 10, 16, 2048, 256, 20240501, 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), scaled to keep lengths."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        h *= 2
    return x.reshape(rows, n) / np.sqrt(n)


def signs(dim: int, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, dim))


def turned(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    for r in s:
        x = hadamard(x * r)
    return x


def padded(x: np.ndarray, extra: np.ndarray | None) -> np.ndarray:
    """Unit rows, with the extra coordinate if given, filled up to a power of two."""
    if extra is not None:
        x = np.concatenate([x, extra[:, None]], axis=1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, n - x.shape[1])))


def bucket(x: np.ndarray) -> np.ndarray:
    """Nearest signed axis: 2 * axis, plus 1 for the negative side."""
    axis = np.argmax(np.abs(x), axis=1)
    return 2 * axis + (x[np.arange(len(x)), axis] < 0)


def probes(x: np.ndarray, n: int) -> np.ndarray:
    both = np.stack([x, -x], axis=2).reshape(len(x), -1)
    n = min(n, both.shape[1])
    return np.argpartition(-both, n - 1, axis=1)[:, :n]


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id and _v of the vectors that take part, each pair once."""
    v = F.col(vec_col)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(F.col("_id").isNotNull() & fine).dropDuplicates(["_id", "_v"])


def posted(rows: DataFrame, hashed, block: int) -> DataFrame:
    """Packed rows: _code (table and bucket), _salt, rows (array of id and vector), at most about block of them.

    The blocks of a bucket follow from its count; there are as many counts as buckets, a fixed number.
    """
    each = rows.select(F.explode(hashed(F.col("_v"))).alias("_code"), "_id", "_v")
    blocks = each.groupBy("_code").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    dealt = each.join(F.broadcast(blocks), "_code").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
    return dealt.groupBy("_code", "_salt").agg(F.collect_list("_id").alias("ids"), F.flatten(F.collect_list("_v")).alias("vs"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, *, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probe: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows with another id.

    Queries for which the probed buckets hold fewer than k candidates are asked again in every bucket of one table.
    """
    names = {"id_col": id_col, "vec_col": vec_col}
    found = materialize(probed(vectors, queries, k, tables=tables, probe=probe, seed=seed, **names))
    full = found.where(F.col("rank") == k).select("query_id").distinct()
    short = queries.join(full, F.col(id_col) == F.col("query_id"), "left_anti")
    if short.isEmpty():
        return found
    again = probed(vectors, short, k, tables=1, probe=1 << 30, seed=seed, **names)
    return found.join(full, "query_id", "left_semi").unionByName(again)


def probed(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probe: int = PROBES, seed: int = SEED) -> DataFrame:
    """As nearest(), from the probed buckets alone."""
    data = materialize(clean(vectors, id_col, vec_col))
    squares = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = data.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("m"), F.min(squares).alias("l")).orderBy(F.desc("n"), "d").first()
    if stats is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, largest = stats["d"], stats["m"]
    flat = largest - stats["l"] <= 1e-4 * largest
    width = 1 << max(1, (dim + (not flat) - 1).bit_length())
    data = data.where(F.size("_v") == dim)
    asked = clean(queries, id_col, vec_col).where(F.size("_v") == dim)

    def hashing(of_query: bool):
        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def codes(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.stack(v.to_numpy()).astype(np.float64)
            extra = None if flat else np.zeros(len(x)) if of_query else np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
            u, out = padded(x, extra), []
            for t, s in enumerate(signs(width, tables, seed)):
                y = turned(u, s)
                out.append(2 * width * t + (probes(y, probe) if of_query else bucket(y)[:, None]))
            return pd.Series(list(np.concatenate(out, axis=1).astype(np.int32)))

        return codes

    blocks = posted(data, hashing(False), BLOCK).select("_code", F.col("ids").alias("c_ids"), F.col("vs").alias("c_vs"))
    met = posted(asked, hashing(True), QUERY_BLOCK).join(blocks, "_code")

    def score(batches):
        for pdf in batches:
            for q_ids, q_vs, c_ids, c_vs in zip(pdf.ids, pdf.vs, pdf.c_ids, pdf.c_vs):
                q, c = np.asarray(q_vs, np.float64).reshape(-1, dim), np.asarray(c_vs, np.float64).reshape(-1, dim)
                q_ids, c_ids = np.asarray(q_ids), np.asarray(c_ids)
                s = q @ c.T
                s[q_ids[:, None] == c_ids[None, :]] = -np.inf
                n = min(k, s.shape[1])
                floor = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                r, j = np.nonzero((s >= floor[:, None] - 1e-9) & (s > -np.inf))
                exact = (q[r] * c[j]).sum(axis=1)  # the same for a pair in whichever block it is met
                order = np.lexsort((c_ids[j], -exact, r))
                r, j, exact = r[order], j[order], exact[order]
                new = np.r_[True, (r[1:] != r[:-1]) | (c_ids[j[1:]] != c_ids[j[:-1]]) | (exact[1:] != exact[:-1])] if len(r) else np.zeros(0, bool)
                r, j, exact = r[new], j[new], exact[new]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                yield pd.DataFrame({"query_id": q_ids[r[keep]], "vec_id": c_ids[j[keep]], "score": exact[keep]})

    found = met.mapInPandas(score, "query_id long, vec_id long, score double")
    # A pair met in several tables has one place; the limit by dense_rank runs before the shuffle too.
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score").distinct()


def query(spark, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
