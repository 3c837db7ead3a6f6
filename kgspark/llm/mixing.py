"""Mixing by soft membership. DataFrame functions only.

A classifier fitted on a bounded sample of the labels table gives every
document posteriors over DOMAINS (clean, low quality, toxic).  Then nonnegative
rates are fitted so that the expected tokens of each domain, sum of rate *
tokens * posterior, match targets: of the least squares solutions the one
nearest to rates of 1, which is 1 - posterior . e cut to the bounds, for one
vector e over DOMAINS.  e is found by Newton steps (a system of one row per
domain over the documents within the bounds), each a distributed aggregation.
Documents are first added up by rounded posteriors, with their mean posteriors,
so that this table has a fixed number of rows at most; the last steps then run
on the documents' own posteriors, until every target that rates can reach is met.

Defined cases: null or blank text has no tokens and still gets a rate; null
labels count as good and not toxic; with labels of one class only, or none,
every document is clean; repeated rows are mixed each, with the same rate;
extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import fresh, load, materialize

DOMAINS = ("clean", "low", "toxic")
#: Share of all tokens that each domain is to have.
TARGETS = {"clean": 0.90, "low": 0.09, "toxic": 0.01}
#: Labelled documents the classifier is fitted on at most, and words of its lexicon.
SAMPLE_ROWS, LEXICON = 4000, 64
#: Posteriors are rounded to this many parts for the fit.
PARTS = 50
#: Aggregations of a fit at most (beyond them it fails), and how far a domain's tokens may be from the reachable target, relative to it.
STEPS, TOLERANCE = 400, 1e-3
#: Weights of the distance to rates of 1 beside the squared residuals, one fit after the other.
NEARNESS = tuple(10.0**-i for i in range(1, 9))
FEATURES = ("symbols", "repeated", "lines", "length", "short", "lexicon")


def features(text: Column, lexicon: list[str]) -> Column:
    """A struct of FEATURES and n_tokens (words between white space). Words and lines are split once, as variables of a lambda."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")
    lines = F.array_remove(F.split(text, "\n"), "")

    def of(w: Column) -> Column:
        some = F.greatest(F.size(w), F.lit(1))
        hits = F.size(F.array_intersect(w, F.array(*map(F.lit, lexicon)))) if lexicon else F.lit(0)
        return F.struct(
            F.least(F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / F.greatest(F.length(text), F.lit(1)) * 5, F.lit(1.0)).alias("symbols"),
            (1 - F.size(F.array_distinct(w)) / some).alias("repeated"),
            F.transform(F.array(lines), lambda x: 1 - F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)))[0].alias("lines"),
            (F.length(text) / some / 10).alias("length"),
            (1.0 / F.sqrt(some)).alias("short"),
            F.least(hits / 3.0, F.lit(1.0)).alias("lexicon"),
            F.size(w).cast("long").alias("n_tokens"),
        )

    return F.transform(F.array(words), of)[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, domain (0, 1, 2) of the labelled documents whose ids hash lowest, rows at most (materialized)."""
    domain = F.when(F.coalesce("toxic", F.lit(0)) == 1, 2).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(0)
    few = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(domain).alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    few = materialize(few)
    return materialize(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "domain").select("text", "domain").limit(rows))  # ids may repeat


def lexicon_of(sample: DataFrame, size: int = LEXICON) -> list[str]:
    """Words that mark the toxic domain: the largest excess of document shares, held by enough documents."""
    words = sample.select("domain", F.explode(F.array_distinct(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"))).alias("w")).where("w <> ''")
    total = {r["t"]: r["n"] for r in sample.groupBy((F.col("domain") == 2).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total.get(True) or not total.get(False):
        return []
    share = words.groupBy("w").agg(F.count_if(F.col("domain") == 2).alias("a"), F.count_if(F.col("domain") != 2).alias("b"))
    odds = F.log((F.col("a") + 0.5) / total[True]) - F.log((F.col("b") + 0.5) / total[False])
    return [r["w"] for r in share.where(F.col("a") >= max(2, 0.02 * total[True])).where(odds > math.log(8)).orderBy(F.desc("a"), "w").limit(size).collect()]


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """A function from a text column to the struct of features with an array p of posteriors over DOMAINS."""
    sample = labelled_sample(docs, labels, rows)
    lexicon = lexicon_of(sample)
    data = materialize(sample.select("domain", features(F.col("text"), lexicon).alias("f")).select("domain", "f.*"))
    seen = sorted(r["domain"] for r in data.select("domain").distinct().collect())
    if len(seen) < 2:
        sure = F.array(*[F.lit(1.0 if i == (seen or [0])[0] else 0.0) for i in range(len(DOMAINS))])
        return lambda text: features(text, lexicon).withField("p", sure)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(data.select(F.col("domain").cast("double").alias("label"), *FEATURES))
    model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=1e-4, maxIter=100).fit(vectors)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def with_posteriors(s: Column) -> Column:
        # A class without rows has intercept -inf; labels beyond the largest seen have no weights.
        z = [sum((s[c] * float(w) for c, w in zip(FEATURES, weights[k])), F.lit(float(bias[k]))) if k < len(bias) and math.isfinite(bias[k]) else None for k in range(len(DOMAINS))]
        e = F.array(*[F.lit(0.0) if x is None else F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))) for x in z])
        p = F.transform(F.array(e), lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda x, y: x + y)))[0]
        return F.struct(*[s[c].alias(c) for c in (*FEATURES, "n_tokens")], p.alias("p"))

    return lambda text: F.transform(F.array(features(text, lexicon)), with_posteriors)[0]


def profiles(scored: DataFrame) -> DataFrame:
    """p, tokens: documents added up by rounded posteriors, p their mean by tokens; at most (PARTS+1)(PARTS+2)/2 rows (materialized)."""
    p, n = F.col("m.p"), F.col("m.n_tokens")
    a, b = F.round(p[0] * PARTS).cast("int"), F.round(p[1] * PARTS).cast("int")
    grouped = scored.where(n > 0).groupBy(a.alias("a"), F.least(b, PARTS - a).alias("b")).agg(F.sum(n).cast("double").alias("tokens"), *[F.sum(p[d] * n).alias(f"p{d}") for d in range(len(DOMAINS))])
    return materialize(grouped.select(F.array(*[F.col(f"p{d}") / F.col("tokens") for d in range(len(DOMAINS))]).alias("p"), "tokens").coalesce(1))


def rate(p: Column, steps: Column, max_rate: float | None = None) -> Column:
    """Rate of a document with posteriors p after these steps (an array of vectors over DOMAINS), from 1."""

    def move(r: Column, e: Column) -> Column:
        r = F.greatest(F.lit(0.0), r - sum((p[d] * e[d] for d in range(1, len(DOMAINS))), p[0] * e[0]))
        return r if max_rate is None else F.least(r, F.lit(max_rate))

    return F.aggregate(steps, F.lit(1.0), move)


def as_column(steps: list[list[float]]) -> Column:
    return F.array(*[F.array(*map(F.lit, s)) for s in steps])


def fit_rates(table: DataFrame, targets: dict[str, float], max_rate: float | None = None, steps: int = STEPS, start: list[list[float]] | None = None) -> list[list[float]]:
    """The step vector e of the rates 1 - p . e within the bounds, as a list of one; start: that of a table much like this one.

    e is least where the convex function of value() is: its gradient is want - expected tokens + nearness * have * e, so e is
    the scaled residual, and 0 in the limit wherever the target can be reached. Newton steps with halving.
    """
    n, spent = len(DOMAINS), 0

    def at(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected tokens by domain, minus their derivative by e, and the documents' part of the convex function."""
        nonlocal spent
        spent += 1
        p, t = F.col("p"), F.col("tokens")
        u = sum((p[d] * float(e[d]) for d in range(1, n)), p[0] * float(e[0]))
        rows = table.select("p", "tokens", rate(p, as_column([e.tolist()]), max_rate).alias("r"), u.alias("u"))
        r, free = F.col("r"), F.when((F.col("u") < 1) & (F.lit(True) if max_rate is None else 1 - F.col("u") < max_rate), t).otherwise(0.0)
        got = rows.agg(
            *[F.sum(r * t * p[d]) for d in range(n)], *[F.sum(free * p[c] * p[d]) for c in range(n) for d in range(n)],
            F.sum(t * (-(r - 1) * (r - 1) / 2 - F.col("u") * r)),
        ).first()
        got = np.array([x or 0.0 for x in got])
        return got[:n], got[n:-1].reshape(n, n), float(got[-1])

    have = np.array([x or 0.0 for x in table.agg(*[F.sum(F.col("tokens") * F.col("p")[d]) for d in range(n)]).first()])
    total = have.sum()
    some = have > 0
    if not some.any():
        return [[0.0] * n]
    want, scale = np.array([targets[d] for d in DOMAINS]) * total, np.where(some, have, 1.0)
    e = np.zeros(n) if start is None else np.array(start[0])
    now = at(e)
    # A target of 0 is met by the tolerance's share of what there was.
    close = TOLERANCE * np.where(want > 0, np.minimum(want, scale), scale)
    for near in NEARNESS if start is None else NEARNESS[3::2]:
        if (np.abs(now[0] - want) <= close)[some].all():
            break
        while True:
            slope = lambda x, got: np.where(some, near * scale * x + want - got[0], 0.0)  # noqa: B023, E731
            value = lambda x, got: near / 2 * (scale * x * x).sum() + (want * x)[some].sum() + got[2]  # noqa: B023, E731
            g = slope(e, now)
            if (np.abs(g) <= close / 2).all():
                break
            move, length = np.linalg.solve(np.diag(near * scale) + now[1], g), 1.0
            while True:
                if spent >= steps:
                    raise ArithmeticError(f"rates not found in {steps} steps")
                to = e - length * move
                then = at(to)
                # Where the values differ by no more than they are exact, the gradients decide.
                less, exact = value(e, now) - value(to, then), 1e-10 * abs(value(e, now))
                if less >= 1e-4 * length * (g @ move) or abs(less) <= exact and (slope(to, then) ** 2 / scale).sum() < (1 - 1e-4 * length) * (g**2 / scale).sum():
                    break
                length /= 2
            e, now = to, then
    return [e.tolist()]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float | None = None, keep_text: bool = True) -> DataFrame:
    """docs with m (features, n_tokens, p), rate and copies: the whole part of the rate plus a draw for the rest by hashed id."""
    score = fit_classifier(docs, labels)
    scored = docs.withColumn("m", score(F.col("text")))
    scored = materialize(scored if keep_text else scored.drop("text"))
    rough = fit_rates(profiles(scored), targets or TARGETS, max_rate)
    own = scored.select(F.col("m.p").alias("p"), F.col("m.n_tokens").cast("double").alias("tokens"))
    found = rate(F.col("m.p"), as_column(fit_rates(own, targets or TARGETS, max_rate, start=rough)), max_rate)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    return scored.withColumn("rate", found).withColumn("copies", F.floor(F.col("rate") + draw))


def expected_shares(mixed: DataFrame) -> dict[str, float]:
    """Of mix(): each domain's expected tokens, by the documents' own posteriors, as shares of the tokens before mixing."""
    tokens = F.col("m.n_tokens")
    got = mixed.agg(F.sum(tokens), *[F.sum(F.col("rate") * tokens * F.col("m.p")[d]) for d in range(len(DOMAINS))]).first()
    return {d: (x or 0.0) / max(got[0] or 0, 1) for d, x in zip(DOMAINS, got[1:])}


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float | None = None) -> DataFrame:
    """docs as often as their copies say, with their own columns only."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias(fresh(docs, "none"))).alias("own"))
    mixed = mix(packed, labels, targets, max_rate).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*[c if c in ("doc_id", "text") else F.col("own")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix(docs, load(spark, sf_dir, "labels"), keep_text=False)
    p = [F.col("m.p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return mixed.select("doc_id", F.col("m.n_tokens").alias("n_tokens"), *p, "rate", "copies")
