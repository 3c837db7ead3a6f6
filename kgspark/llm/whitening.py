"""Whitening of embeddings by polarised covariance.

Entries become integers, so all sums are exact.  Every dimension and every sum
of two dimensions is centred by an integer near its mean, squared and
aggregated; the exact centring follows from what the integer leaves over:

    sum((n x - S)^2) = n^2 sum(y^2) - n r^2,  y = x - c,  S = n c + r.

A covariance is half of what the variance of the two dimensions' sum exceeds
their own variances by (polarisation), taken of exact integers and rounded once.
The matrix, of the size of the dimensions squared whatever the number of rows,
goes to the driver for eigh; rows are then projected and scaled where they lie.

Defined cases: vectors that are null, empty, or hold null, non-finite or huge
entries (beyond LARGEST, which integers could not hold) are dropped, as are
those of another length than the commonest one (ties: the shorter); rows that
repeat count each; a null id stays; with fewer dimensions than components there
are as many components; a component without variance (beside rounding) has null
for whitened values and stays out of identity_error; without any variance
explained is null; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.common import load, materialize

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
LARGEST = 2.0**30
#: Rows that are squared at once.
ROWS = 1024


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id, _v (array of double) of the vectors that take part, of whatever length."""
    v = F.col(vec_col)
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    return vectors.select(F.col(id_col).cast("long").alias("_id"), v.cast("array<double>").alias("_v")).where(F.coalesce(fine, F.lit(False)))


def integers(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(c * SCALE) + OFFSET)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("_x").flatten().to_numpy().reshape(-1, d)


def pair_squares(rows: DataFrame, centres: list[int]) -> DataFrame:
    """i, j (i <= j), squares: the sums of (y_i + y_j)^2, for i = j of y_i^2, with y = x - centre. rows: _x.

    A task adds up what it has; partial sums per pair are shuffled, as many rows as pairs and tasks.
    """
    d = len(centres)

    def run(batches):
        c, total, some = np.array(centres, np.int64), np.zeros((d, d), dtype=object), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _matrix(batch.slice(at, ROWS), d) - c
                exact = 4 * int(np.abs(y).max()) ** 2 * len(y) < 1 << 63
                y, some = y if exact else y.astype(object), True
                for i in range(d):
                    both = y[:, i:] + y[:, i : i + 1]
                    both[:, 0] = y[:, i]
                    total[i, i:] += (both * both).sum(axis=0)
        if some:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "squares": _decimals(total[i, j])})

    return rows.select("_x").mapInArrow(run, "i int, j int, squares decimal(38,0)").groupBy("i", "j").agg(F.sum("squares").alias("squares"))


def covariance(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance, from differences of exact variances; squares as of pair_squares with centres S // n."""
    d = len(sums)
    left = [s % n for s in sums]
    of = lambda i, j: n * squares[i, j] - (left[i] + left[j] if i < j else left[i]) ** 2  # noqa: E731  n^2 times the variance
    own, out = [of(i, i) for i in range(d)], np.zeros((d, d))
    for i in range(d):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (of(i, j) - own[i] - own[j]) / (2 * n * n)
    return out


class Fit:
    """n, sums per dimension, covariance, trace, falling eigenvalues and their unit vectors (columns) for the first components."""

    def __init__(self, rows: DataFrame, components: int = COMPONENTS):
        """rows: _x, all of one length, not empty."""
        found = rows.select(F.posexplode("_x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
        self.n, self.sums = found[0]["n"], [int(r["s"]) for r in found]
        self.centres = [s // self.n for s in self.sums]
        squares = {(r["i"], r["j"]): int(r["squares"]) for r in pair_squares(rows, self.centres).collect()}
        self.covariance = covariance(self.n, self.sums, squares)
        values, vectors = np.linalg.eigh(self.covariance)
        self.trace = float(np.trace(self.covariance))
        self.values, self.vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        self.telling = self.values > len(self.sums) * np.finfo(float).eps * max(values[-1], 0.0)

    def apply(self, rows: DataFrame) -> DataFrame:
        """_id, _deviation (exact), _w (whitened values, null where the component has no variance) of rows (_id, _x)."""
        n, c, r = self.n, np.array(self.centres, np.int64), [s % self.n for s in self.sums]
        scale = np.where(self.telling, 1 / np.sqrt(np.where(self.telling, self.values, 1.0)), np.nan)
        turn, rest = self.vectors * scale, sum(x * x for x in r)

        def run(batches):
            left, over = np.array(r, dtype=object), np.array([x / n for x in r])
            for batch in batches:
                y = _matrix(batch, len(c)) - c
                exact = y.astype(object)
                deviation = n * n * (exact * exact).sum(axis=1) - 2 * n * (exact @ left) + rest
                w = (y - over) @ turn
                flat = pa.array(w.ravel(), from_pandas=True)  # NaN, of a component without variance, becomes null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), _decimals(deviation), lists], names=["_id", "_deviation", "_w"])

        return rows.select("_id", "_x").mapInArrow(run, "_id long, _deviation decimal(38,0), _w array<double>")

    def identity_error(self, whitened: DataFrame) -> float | None:
        """The largest entry, by size, of the covariance of _w less the identity, measured over the rows."""
        use = [int(k) for k in np.flatnonzero(self.telling)]
        if not use:
            return None
        means = whitened.agg(*[F.avg(F.get("_w", F.lit(k))).alias(f"m{k}") for k in use]).first()
        at = lambda k: F.get("_w", F.lit(k)) - F.lit(means[f"m{k}"])
        pairs = [(a, b) for a in use for b in use if a <= b]
        got = whitened.agg(*[F.avg(at(a) * at(b)).alias(f"v{a}_{b}") for a, b in pairs]).first()
        return max(abs(got[f"v{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error of every row that takes part."""
    fine = usable(vectors, id_col, vec_col)
    length = fine.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = materialize(fine.where(F.size("_v") == length["d"]).select("_id", integers(F.col("_v")).alias("_x")))
    fit = Fit(rows, components)
    out = materialize(fit.apply(rows))
    explained = F.array(*[F.lit(float(v) / fit.trace if fit.trace > 0 else None).cast("double") for v in fit.values])
    each = out.select("_id", "_deviation", F.posexplode("_w").alias("_k", "_y"))
    return each.select(
        F.col("_id").alias("vec_id"), (F.col("_k") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"), F.col("_y").alias("whitened"),
        F.get(explained, F.col("_k")).alias("explained"), F.lit(fit.identity_error(out)).cast("double").alias("identity_error"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = whiten(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").try_cast(T.LongType()))
