"""Whitening against exact rationals and numpy."""

import math
import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from kgspark.llm import whitening

rnd = random.Random(13)
DDL = "vec_id long, embedding array<float>"


def plain(rows, k=8):
    """Expected vec_id -> deviation, and n, explained, components; plain Python."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    dev = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    cov = [[float(sum(Fraction(n * r[i] - s[i], n) * Fraction(n * r[j] - s[j], n) for r in x) / n) for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array(cov))
    centred = np.array([[float(Fraction(n * r[i] - s[i], n)) for i in range(d)] for r in x])
    return n, dev, np.array(cov), values[::-1][:k], vectors[:, ::-1][:, :k], centred


def check(got, rows, k=8):
    n, dev, cov, values, vectors, centred = plain(rows, k)
    d = cov.shape[0]
    w = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == n * min(k, d) == len(w)
    for a in range(min(k, d)):
        mine = np.array([w[i, a + 1]["whitened"] for i, _ in rows], dtype=float)
        theirs = centred @ vectors[:, a] / math.sqrt(values[a])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7
        for (i, _), x in zip(rows, dev):
            r = w[i, a + 1]
            assert r["deviation"] == x and r["n"] == n and abs(r["explained"] - values[a] / np.trace(cov)) < 1e-12
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def vectors(n, d, ids=None):
    return [(ids(i) if ids else i, [float(np.float32(rnd.gauss(0, 1) + (j > 2) * 0.3 * i / n)) for j in range(d)]) for i in range(n)]


def test_equals_plain(spark):
    rows = vectors(150, 12, lambda i: (1 << 60) + i)
    odd = [(9000, None), (9001, []), (9002, [1.0] * 11 + [float("nan")]), (9003, [float("inf")] + [1.0] * 11), (9004, [1.0] * 11 + [None]), (9005, [1.0] * 5), (9006, [3e20] * 12)]
    df = spark.createDataFrame(rows + odd, DDL).withColumn("component", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    got = whitening.whiten(df).collect()
    check(got, rows)


def test_few_dimensions_null_ids_and_repeats(spark):
    rows = vectors(40, 3)
    again = rows + [(None, rows[0][1]), (rows[1][0], rows[1][1])]
    got = whitening.whiten(spark.createDataFrame(again, DDL)).collect()
    assert len(got) == 3 * 42 and sum(r["vec_id"] is None for r in got) == 3 and {r["n"] for r in got} == {42}
    n, dev, *_ = plain(again)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(map(Decimal, dev))


def test_without_variance(spark):
    got = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], DDL)).collect()
    assert len(got) == 10 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(flat, DDL)).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1} and got[0]["identity_error"] < 1e-9


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(rnd.randrange(-(2**29), 2**29)) for _ in range(4)]) for i in range(60)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, dev, *_ = plain(rows)
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == {i: x for (i, _), x in zip(rows, dev)}
    check(got, rows)


def test_empty(spark):
    assert whitening.whiten(spark.createDataFrame([], DDL)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], DDL)).collect() == []


def test_polarised_equals_products():
    x = np.array([[rnd.randrange(-50, 50) for _ in range(5)] for _ in range(33)])
    n, sums = len(x), x.sum(axis=0).tolist()
    y = x - np.array([s // n for s in sums])
    squares = {(i, j): int(((y[:, i] + y[:, j]) ** 2).sum() if i < j else (y[:, i] ** 2).sum()) for i in range(5) for j in range(i, 5)}
    assert np.allclose(whitening.covariance(n, sums, squares), np.cov(x.T, bias=True), rtol=1e-13, atol=1e-12)
