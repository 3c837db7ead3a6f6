"""URL filters: stated host and path rules first, then association rules mined from labelled URLs.

Labels come to URLs by content: a page's passages (text between tags, 40
characters or more) are looked up among those of labelled documents, and the
page is blocked if most of what is found lies in low or toxic documents.

A URL's tokens are its host labels with their depth, path segments with their
depth and query names.  FP-growth over labelled URLs (tokens plus the item
=block or =allow) gives rules "tokens -> =block".  Pruned are those under the
support, those under the confidence, those that chance explains (EVIDENCE; the
number of URLs that a rule must cover follows from it), and those that contain
a smaller rule of at least the same confidence.  Rules
are matched by an inverted index: each rule is posted under its rarest token,
URLs meet it there, and the rest of its tokens are checked.  A URL that no
stated rule fits is blocked if any mined rule fits.

Defined cases: a null url or one without :// has empty host and path and is
allowed; a host rule fits whole labels only; repeated urls are judged once and
joined back; a url labelled both ways counts as blocked; without labels nothing
is mined; an empty table gives no rows; extra columns are kept with their
values, whatever their names, but for host, path, rule and verdict.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import fresh, join_checked, load, materialize

#: (host, path prefix, verdict)
STATED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Share of labelled URLs that a rule covers at least; share of those it covers that are blocked, at least.
MIN_SUPPORT, MIN_CONFIDENCE = 0.001, 0.6
#: A rule's share of blocked URLs is to have a chance of exp(-EVIDENCE) at most if its URLs were drawn from all labelled ones (Chernoff's bound).
EVIDENCE = 16.0
#: Characters of a passage that carries a label from a document to a page.
PASSAGE = 40
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules=STATED) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # longer ones override
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: h<depth>:label counted from the right, p<depth>:segment, q:name."""
    labels = F.reverse(F.split(host_of(url), r"\."))
    segments = F.split(F.regexp_replace(path_of(url), "^/", ""), "/")
    names = F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0])
    placed = lambda kind: lambda x, i: F.concat(F.lit(kind), i.cast("string"), F.lit(":"), x)
    real = lambda x: F.filter(x, lambda t: ~F.endswith(t, F.lit(":")))
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(F.concat(real(F.transform(labels, placed("h"))), real(F.transform(segments, placed("p"))), real(F.transform(names, lambda x: F.concat(F.lit("q:"), x)))))).otherwise(F.array().cast("array<string>"))


def least_count(base: float, evidence: float = EVIDENCE) -> int:
    """Blocked URLs that a rule needs at least: chance explains fewer, even if all its URLs are blocked."""
    return math.ceil(evidence / -math.log(base))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, evidence: float = EVIDENCE) -> DataFrame:
    """labelled: url, blocked (boolean). Returns rule_id, tokens, index_token, confidence, support (materialized)."""
    one = labelled.where("url is not null").groupBy("url").agg(F.max("blocked").alias("blocked"))
    label = F.when(F.col("blocked"), "=block").otherwise("=allow")
    items = materialize(one.select(F.monotonically_increasing_id().alias("u"), F.concat(tokens_of(F.col("url")), F.array(label)).alias("items"), "blocked"))
    # A rule "tokens -> =block" needs its tokens and =block together, so only tokens frequent among blocked URLs matter.
    n, n_block = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0))).first()
    none = labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, index_token string, confidence double, support double")
    if not n_block or n_block == n:  # labels of one kind only
        return none
    base = n_block / n
    floor = max(least_count(base, evidence), min_support * n)
    counts = materialize(items.select(F.explode("items").alias("token"), "blocked").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("long")).alias("n_block")))
    frequent = counts.where((F.col("n_block") >= floor) & ~F.startswith("token", F.lit("=")))
    kept = join_checked(items.select("u", F.explode("items").alias("token")), frequent.select("token"), "token", row_bytes=80).groupBy("u").agg(F.collect_list("token").alias("kept"))
    baskets = materialize(items.join(kept, "u").select(F.concat("kept", F.array(F.element_at("items", -1))).alias("items")))
    m = baskets.count()
    if m < floor:
        return none
    model = FPGrowth(itemsCol="items", minSupport=floor / m, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == "=block").where(~F.exists("antecedent", lambda t: F.startswith(t, F.lit("="))))
    covers, c = F.col("support") * m / F.col("confidence"), F.col("confidence")
    apart = c * F.log(c / base) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - base))).otherwise(0.0)
    rules = rules.where((c > base) & (covers * apart >= evidence - 1e-9))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * m / n).alias("support")))
    # Pruned: a rule with a proper part that is a rule of at least its confidence.
    tall = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("t"))
    part = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"), F.element_at("tokens", 1).alias("t"))
    covered = tall.join(part, "t").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("part_confidence") >= F.col("confidence"))).select("tokens").distinct()
    best = rules.join(covered, "tokens", "left_anti").withColumn("rule_id", F.xxhash64("tokens"))
    rarest = best.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("index_token"))
    return materialize(best.join(rarest, "rule_id").select("rule_id", "tokens", "index_token", "confidence", "support"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, confidence, matched (tokens of the best rule) for the distinct urls that some rule fits."""
    each = urls.where("url is not null").select("url").distinct().withColumn("_tokens", tokens_of(F.col("url")))
    posted = each.select("url", "_tokens", F.explode("_tokens").alias("index_token"))
    met = join_checked(posted, rules, "index_token", row_bytes=400).where(F.size(F.array_except("tokens", "_tokens")) == 0)
    return met.groupBy("url").agg(F.max(F.struct("confidence", F.col("tokens").alias("matched"))).alias("_b")).select("url", "_b.confidence", "_b.matched")


def judge_urls(pages: DataFrame, rules: DataFrame, stated=STATED, match: str = "match") -> DataFrame:
    """pages with host, path, rule, verdict, and a struct named match: confidence and matched (tokens of the best mined rule)."""
    own, host, path = pages.columns, host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = stated_rule(host, path, stated)
    side, key = fresh(pages, "best"), fresh(pages, "rule_url")
    if rules.isEmpty():
        out = pages.withColumn(side, F.lit(None).cast("struct<confidence:double,matched:array<string>>"))
    else:
        found = match_rules(pages.select("url"), rules).select(F.col("url").alias(key), F.struct("confidence", "matched").alias(side))
        out = pages.join(found, pages["url"] == found[key], "left")
    made = {"host": host, "path": path, "rule": rule, "verdict": F.coalesce(verdict, F.when(F.col(side).isNotNull(), "block").otherwise("allow")), match: F.col(side)}
    return out.select(*[F.col(f"`{c}`") for c in own if c not in made], *[v.alias(k) for k, v in made.items()])


def passages(text: Column) -> Column:
    """Hashes of the distinct passages in marked-up or plain text: between tags and line ends, PASSAGE characters or more."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "\n")
    parts = F.transform(F.split(bare, r"<[^<>]*>|\n"), F.trim)
    real = F.filter(parts, lambda x: F.length(x) >= PASSAGE)
    entity = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.array_distinct(F.transform(real, lambda x: F.xxhash64(entity(x))))


def labelled_urls(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """url, blocked: of a page's passages in labelled documents, do more lie in low or toxic ones than in others?"""
    bad = labels.groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long")).alias("bad"))
    # Hashes, not texts, meet the labels; both grow with the documents, so the join shuffles at every size.
    held = docs.select("doc_id", passages(F.col("text")).alias("hs")).where(F.size("hs") > 0)
    known = held.join(bad.hint("merge"), "doc_id").select(F.explode("hs").alias("h"), "bad").groupBy("h").agg(F.avg("bad").alias("bad"))
    read = pages.where("url is not null").select("page_id", "url", F.explode(passages(F.col("html"))).alias("h"))
    return read.join(known.hint("merge"), "h").groupBy("page_id", "url").agg((F.avg("bad") > 0.5).alias("blocked")).select("url", "blocked")


def query(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    rules = mine_rules(labelled_urls(pages, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))
    out = judge_urls(pages.select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict", "match.confidence", F.array_join("match.matched", " ").alias("matched"))
