"""Quality rules whose limits come from the corpus itself.

Per document a handful of text measures; per (lang, source), per lang and over
all, a mergeable quantile sketch of each measure (logarithmic buckets with
counts, so sketches add up and every quantile is within a fixed relative
error).  A measure is out of bounds beyond its group's quartiles by more than
FENCE times their distance, all on the logarithmic scale of the buckets.
A group of fewer than MIN_GROUP texts takes the limits of its language, and a
language of fewer those of all documents.  No fixed cutoff decides anything
but the base rule.

Copies of a text within a group count once in the sketches, and the distance of
a group's quartiles counts as half of the median one of all groups at least, so
that a group full of near copies does not reject everything else.

Defined cases: null or blank text has zero words and fails the base rule;
null lang or source form a group of their own (null-safe join); repeated rows
are judged one by one; extra columns are kept with their values, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.common import fresh, load, materialize, own

WINDOW = 8
MEASURES = T.StructType([T.StructField(c, T.LongType(), False) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")])
#: name -> (numerator, denominator, bounded below, bounded above). The added constants keep short texts from looking extreme and zero counts measurable.
RATIOS = {
    "symbols": ("n_symbols + 1", "word_chars + 100", False, True),
    "dup_lines": ("n_dup_lines + 1", "n_lines + 10", False, True),
    "word_length": ("word_chars", "n_words", True, True),
    "distinct_words": ("n_distinct", "n_words", True, False),
}
#: Relative error of a sketch bucket.
ALPHA = 0.002
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Quartile distances beyond the quartiles that are still in bounds, and texts that a group needs for limits of its own.
FENCE, MIN_GROUP = 3, 100


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of that many words found twice or more in the list."""
    n = len(words)
    if n <= window:
        return 0
    key = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + key[j : n - window + 1 + j]
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Equal windows have equal keys, so only now is an exact count needed: ranks of 1, 2, 4, 8 words.
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    step = 1
    while step < window:
        rank = np.unique(rank[:-step] * np.int64(n + 1) + rank[step:], return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeat_words(words), len(lines), len(set(words))


@F.pandas_udf(MEASURES)
def _measures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(measure_text, text)), columns=MEASURES.names, dtype="int64")


def measures(text: Column | str) -> Column:
    """A struct of MEASURES of the whole text."""
    return _measures(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def sketch_bucket(value: Column) -> Column:
    """Bucket of a positive value; every value of a bucket is within ALPHA of its middle."""
    return F.ceil(F.log(value) / math.log(GAMMA)).cast("long")


def buckets(m: Column) -> dict[str, Column]:
    """Bucket of each measure, from a struct of MEASURES."""

    def sum_of(text: str) -> Column:
        name, _, more = text.partition(" + ")
        return m[name] + int(more or 0)

    return {k: sketch_bucket(sum_of(a) / F.greatest(sum_of(b), F.lit(1))) for k, (a, b, _, _) in RATIOS.items()}


def sketches(scored: DataFrame, m: str, key: Column) -> DataFrame:
    """Mergeable sketches: n texts per (lang, source, measure, bucket), copies (equal key) within a group once. Sum n to merge two."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), b.alias("bucket")) for k, b in buckets(F.col(m)).items()])
    texts = scored.where(~base_failed(F.col(m))).select("lang", "source", key.alias("_key"), each.alias("_each")).dropDuplicates(["lang", "source", "_key"])
    return materialize(texts.select("lang", "source", F.explode("_each").alias("_e")).groupBy("lang", "source", "_e.measure", "_e.bucket").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, *group: str) -> DataFrame:
    """group, measure, q1, q3 (buckets) and n texts, of the sketches merged by group."""
    by = [*group, "measure"]
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("_cum", F.sum("n").over(W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(W.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("_cum") >= F.col("_all") * q, F.col("bucket")))
    return ranked.groupBy(*by).agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("_all").alias("n"))


def limits(sketch: DataFrame, fence: int = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and a struct low, high (buckets) per measure: lim_<measure>. Materialized."""

    def level(name: str, *group: str) -> DataFrame:
        return quartiles(sketch, *group).select(*[F.col(c).alias(f"{name}_{c}") for c in group], F.col("measure").alias(f"{name}_m"), F.struct("q1", "q3", "n").alias(name))

    own = level("own", "lang", "source")
    lang, every = level("lang", "lang"), level("every")
    both = own.join(lang, own["own_lang"].eqNullSafe(lang["lang_lang"]) & (F.col("own_m") == F.col("lang_m"))).join(every, F.col("own_m") == F.col("every_m"))
    used = F.when(F.col("own.n") >= min_group, F.col("own")).when(F.col("lang.n") >= min_group, F.col("lang")).otherwise(F.col("every"))
    chosen = materialize(both.select(F.col("own_lang").alias("lang"), F.col("own_source").alias("source"), F.col("own_m").alias("measure"), used["q1"].alias("q1"), used["q3"].alias("q3")))
    typical = chosen.groupBy("measure").agg(F.percentile_approx(F.col("q3") - F.col("q1"), 0.5, 100_000).alias("typical"))
    wide = F.greatest(F.col("q3") - F.col("q1"), F.ceil(F.col("typical") / 2))
    bound = F.struct((F.col("q1") - fence * wide).alias("low"), (F.col("q3") + fence * wide).alias("high"))
    each = chosen.join(typical, "measure").select("lang", "source", "measure", bound.alias("b"))
    return materialize(each.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, F.col("b"))).alias(f"lim_{k}") for k in RATIOS]))


def judge(scored: DataFrame, bounds: DataFrame, m: str, into: str) -> DataFrame:
    """scored with a struct into: base_failed and kept. (A group without limits has no document that passes the base rule.)"""
    names = [fresh(scored, c) for c in ("lim_lang", "lim_source", "lim")]
    side = bounds.select(F.col("lang").alias(names[0]), F.col("source").alias(names[1]), F.struct(*[f"lim_{k}" for k in RATIOS]).alias(names[2]))
    fine = F.lit(True)
    for k, b in buckets(F.col(m)).items():
        limit = F.col(names[2])[f"lim_{k}"]
        fine = fine & (b >= limit["low"] if RATIOS[k][2] else F.lit(True)) & (b <= limit["high"] if RATIOS[k][3] else F.lit(True))
    failed = base_failed(F.col(m))
    verdict = F.struct(failed.alias("base_failed"), (~failed & F.coalesce(fine, F.lit(True))).alias("kept"))
    joined = scored.join(side, scored["lang"].eqNullSafe(side[names[0]]) & scored["source"].eqNullSafe(side[names[1]]), "left")
    return joined.withColumn(into, verdict).drop(*names)


def apply_rules(docs: DataFrame, keep_text: bool = True) -> tuple[DataFrame, str, str]:
    """docs with two struct columns, whose names are returned too: the measures, and the verdict (base_failed, kept).

    The measures are computed once and written to the shared folder.
    """
    m, key, verdict = (fresh(docs, c) for c in ("measures", "text_key", "verdict"))
    scored = docs.withColumn(m, measures("text")).withColumn(key, F.xxhash64("text"))
    scored = materialize(scored if keep_text else scored.drop("text"))
    bounds = limits(sketches(scored, m, F.col(key)))
    return judge(scored, bounds, m, verdict).drop(key), m, verdict


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    out, _, verdict = apply_rules(docs)
    return out.where(F.col(verdict)["kept"]).select(*own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    out, m, verdict = apply_rules(docs, keep_text=False)
    return out.select("doc_id", *[F.col(m)[c].alias(c) for c in MEASURES.names], F.col(verdict)["base_failed"].alias("base_failed"), F.col(verdict)["kept"].alias("kept"))


_WORD = r"[^\x20\x09-\x0D]+"
_LEADS = " || ' ' || ".join(f"lead(w, {i}) OVER (PARTITION BY r ORDER BY i)" for i in range(1, WINDOW))
_BUCKETS = " UNION ALL ".join(f"SELECT r, lang, source, text, '{k}' AS measure, CAST(ceil(ln(({a}) / greatest({b}, 1)) / ln({GAMMA!r})) AS BIGINT) AS b FROM m WHERE NOT base_failed" for k, (a, b, _, _) in RATIOS.items())
_OUT = " OR ".join(f"(e.measure = '{k}' AND ({' OR '.join(c for c, on in (('e.b < l.low', low), ('e.b > l.high', high)) if on)}))" for k, (_, _, low, high) in RATIOS.items())


def _level(*group: str) -> str:
    by = ", ".join((*group, "measure"))
    ranked = f"SELECT {by}, b, row_number() OVER (PARTITION BY {by} ORDER BY b) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM one"
    return f"SELECT {by}, min(b) FILTER (k >= n * 0.25) AS q1, min(b) FILTER (k >= n * 0.75) AS q3, max(n) AS n FROM ({ranked}) GROUP BY {by}"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
win AS (SELECT r, i, w || ' ' || {_LEADS} AS k FROM w),
twice AS (SELECT r, i FROM win WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range({WINDOW}) AS g(j) GROUP BY r),
m0 AS (SELECT t.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct FROM t LEFT JOIN rep USING (r)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m0),
e AS ({_BUCKETS}),
one AS (SELECT DISTINCT ON (lang, source, text, measure) lang, source, measure, b FROM e),
own AS ({_level("lang", "source")}),
lang_ AS ({_level("lang")}),
every AS ({_level()}),
used AS (SELECT own.lang, own.source, own.measure, CASE WHEN own.n >= {MIN_GROUP} THEN own.q1 WHEN l.n >= {MIN_GROUP} THEN l.q1 ELSE v.q1 END AS q1,
 CASE WHEN own.n >= {MIN_GROUP} THEN own.q3 WHEN l.n >= {MIN_GROUP} THEN l.q3 ELSE v.q3 END AS q3
 FROM own JOIN lang_ l ON own.lang IS NOT DISTINCT FROM l.lang AND own.measure = l.measure JOIN every v ON own.measure = v.measure),
half AS (SELECT measure, CAST(ceil(min(x) / 2.0) AS BIGINT) AS half FROM (SELECT measure, q3 - q1 AS x, row_number() OVER (PARTITION BY measure ORDER BY q3 - q1) AS k, count(*) OVER (PARTITION BY measure) AS n FROM used) WHERE k >= n * 0.5 GROUP BY measure),
l AS (SELECT lang, source, measure, q1 - {FENCE} * greatest(q3 - q1, half) AS low, q3 + {FENCE} * greatest(q3 - q1, half) AS high FROM used JOIN half USING (measure)),
bad AS (SELECT DISTINCT e.r FROM e JOIN l ON e.lang IS NOT DISTINCT FROM l.lang AND e.source IS NOT DISTINCT FROM l.source AND e.measure = l.measure WHERE {_OUT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM m LEFT JOIN bad USING (r)
"""
