"""Fingerprints of documents by a homomorphic multiset hash.

A text is the multiset of its paragraphs (what stands between newlines, empty
ones too).  Each paragraph is hashed to a wide vector, and a fingerprint is the
sum of the vectors, lane by lane, modulo 2^32: it does not depend on the order
of paragraphs, and paragraphs are inserted and deleted by adding and
subtracting their vectors, without the rest of the text.

Of the lanes of a paragraph's vector, EXACT are the words of its SHA-512, so
fingerprints are equal if, and in practice only if, the multisets are.  The
LIKE others hold, for every run of SHINGLE words of the paragraph (one with
fewer words is one run), whether a bit of the run's hash is set; one more
counts the runs.  Twice a lane less the count is a sum of random signs, so
scalar products of two fingerprints estimate those of their counts of runs
(a tug-of-war sketch), and with a and b for the counts

    likeness = 2 a.b / (a.a + b.b), cut to 0..1.

Two lanes share a long: a sum of them is two sums, as a text has fewer than
2^31 runs.  Its standard error is about 1 / sqrt(LIKE) for unlike texts, less
for like ones; equal fingerprints have likeness 1.

Defined cases: null text is empty, and an empty text is one empty paragraph;
texts without a word have likeness 1 to equal ones and 0 to others; rows that
repeat have their own rows of results; of rows that share an id, the one whose
text hashes lowest stands for it as the next document; a null id comes after
all others and the first document is next to it (none, with likeness 0, where all
ids are null); an empty table gives no rows;
extra columns are left out.  Ids and texts tell rows apart; two texts of one id
with the same 64-bit hash would be taken for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import load, materialize

EXACT, LIKE, SHINGLE = 16, 128, 5
LANE = (1 << 32) - 1
PAIRS = LIKE // 2
WIDTH = EXACT + PAIRS + 1
BLANKS = r"[ \t\x0B\f\r]+"


def vectors(rows: DataFrame, keys: list[str], text: str, kept: list[str] = ()) -> DataFrame:
    """keys, vector (the sum of the vectors of the paragraphs of all rows with these keys, not yet reduced modulo 2^32), texts (their number) and the
    largest values of the kept columns (numbers).

    One pass over the texts; only one row of sums a key leaves a task.
    """
    paragraphs = rows.select(*keys, *kept, F.posexplode(F.split(F.col(text), "\n")).alias("_at", "_p"))
    words = F.filter(F.split("_p", BLANKS), lambda w: w != "")
    hashed = paragraphs.select(*keys, *kept, "_at", F.sha2("_p", 512).alias("_h"), words.alias("_w"))
    runs = hashed.select(*keys, *kept, "_at", "_h", "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - SHINGLE, F.lit(0)))).alias("_i"))
    run = F.xxhash64(*[F.get("_w", F.col("_i") + k) for k in range(SHINGLE)])
    signed = runs.select(*keys, *kept, "_at", "_h", "_i", F.when(F.size("_w") > 0, run).alias("_a")).select("*", F.xxhash64("_a", F.lit(1)).alias("_b"))
    first, pair = F.col("_i") == 0, (1 << 32) + 1
    exact = [F.sum(F.when(first, F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long"))) for k in range(EXACT)]
    like = [F.sum(F.when(F.col("_a").isNotNull(), F.shiftrightunsigned(c, k).bitwiseAND(pair))) for c in ("_a", "_b") for k in range(PAIRS // 2)]
    sums = [s.alias(f"_s{i}") for i, s in enumerate([*exact, *like, F.count("_a")])]
    found = signed.groupBy(*keys).agg(*sums, F.count_if(first & (F.col("_at") == 0)).alias("texts"), *[F.max(c).alias(c) for c in kept])
    return found.select(*keys, F.array(*[F.coalesce(f"_s{i}", F.lit(0).cast("long")) for i in range(WIDTH)]).alias("vector"), "texts", *kept)


def _lanes(v: Column, exact, pair) -> Column:
    return F.transform(v, lambda x, i: F.when((i >= EXACT) & (i < EXACT + PAIRS), pair(x)).otherwise(exact(x)))


def reduced(v: Column) -> Column:
    """A fingerprint from sums of vectors."""
    return _lanes(v, lambda x: x.bitwiseAND(LANE), lambda x: x)


def inserted(fingerprint: Column, vector: Column) -> Column:
    """The fingerprint with the paragraphs of the vector added."""
    return reduced(F.zip_with(fingerprint, vector, lambda a, b: a + b))


def deleted(fingerprint: Column, vector: Column) -> Column:
    """The fingerprint with the paragraphs of the vector, which it has, taken out."""
    return reduced(F.zip_with(fingerprint, vector, lambda a, b: a - b))


def digest(fingerprint: Column) -> Column:
    """All lanes as hex digits, eight for an exact one and four (modulo 2^16) for one of the others."""
    short = lambda x: F.shiftleft(F.shiftrightunsigned(x, 32).bitwiseAND(0xFFFF), 16) + x.bitwiseAND(0xFFFF)
    return F.concat_ws("", F.transform(_lanes(fingerprint, lambda x: x, short), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def signs(fingerprint: Column) -> Column:
    """Sums of random signs, one for each of the LIKE lanes."""
    n = F.get(fingerprint, F.lit(WIDTH - 1))
    mid = F.slice(fingerprint, EXACT + 1, PAIRS)
    low, high = F.transform(mid, lambda x: 2 * x.bitwiseAND(LANE) - n), F.transform(mid, lambda x: 2 * F.shiftrightunsigned(x, 32) - n)
    return F.concat(low, high).cast("array<double>")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two results of signs(); null if both are of texts without words or one is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    of = F.try_divide(2 * dot(a, b), dot(a, a) + dot(b, b))
    return F.when(of.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), of)))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, fingerprint of all paragraphs of the rows with these keys."""
    whole = docs.select(*keys, F.coalesce(text, F.lit("")).alias("_t"))
    return vectors(whole, keys, "_t").select(*keys, reduced(F.col("vector")).alias("fingerprint"))


def following(ids: DataFrame) -> DataFrame:
    """id, next_id of distinct ids (no null): the next larger one, after the last the first. Sorted in ranges; only each range's first goes to one task."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(ids.select("id").repartitionByRange(n, "id").select("id", F.spark_partition_id().alias("_r")))
    heads = ranged.groupBy("_r").agg(F.min("id").alias("_head"))
    order = W.orderBy("_r")  # one row a range
    nexts = heads.select("_r", F.coalesce(F.lead("_head").over(order), F.first("_head").over(order)).alias("_after"))
    ahead = ranged.withColumn("_next", F.lead("id").over(W.partitionBy("_r").orderBy("id")))
    return ahead.join(nexts, "_r").select("id", F.coalesce("_next", "_after").alias("next_id"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, key, text, next_id, ahead of docs (doc_id, text): the next document and its first characters, at least a quarter as many as the text has."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    needs = materialize(docs.groupBy(F.col("doc_id").alias("id")).agg(F.max(quarter).alias("need")))
    links = materialize(needs.where("id is not null").join(following(needs.where("id is not null")), "id"))
    before = links.select(F.col("next_id").alias("doc_id"), F.col("id").alias("_for"), "need")
    known = docs.where("doc_id is not null")
    head = F.substring(F.col("text"), F.lit(1), F.col("need"))
    heads = known.join(before.hint("merge"), "doc_id").groupBy(F.col("_for").alias("doc_id")).agg(F.max("doc_id").alias("next_id"), F.min(F.struct("key", head.alias("ahead"))).alias("_h"))
    out = known.join(heads.select("doc_id", "next_id", F.col("_h.ahead").alias("ahead")).hint("merge"), "doc_id", "left")
    lost = needs.where("id is null").first()
    if lost is not None:  # rows without an id all have the first document next, which is one row
        first = links.agg(F.min("id").alias("doc_id"))
        one = known.join(F.broadcast(first), "doc_id").agg(F.max("doc_id").alias("next_id"), F.min(F.struct("key", F.substring("text", 1, lost["need"]).alias("ahead"))).alias("_h"))
        one = materialize(one.select("next_id", F.col("_h.ahead").alias("ahead")))
        out = out.unionByName(docs.where("doc_id is null").join(F.broadcast(one), how="left"))
    return out.withColumn("ahead", F.coalesce("ahead", F.lit("")))


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, key, next_id, texts (rows alike), n_chars, edited_sha256, fingerprint, edited_fingerprint of the distinct documents: the edited text is
    the text with its last quarter replaced by the next one's first characters.

    The edited text is not hashed anew: the paragraphs from the cut on are deleted, and the new ones inserted.
    """
    m = F.floor(F.length("text") / 4).cast("int")
    rows = with_next(docs).withColumn("_kept", F.substring(F.col("text"), F.lit(1), F.length("text") - m))
    rows = rows.withColumn("_new", F.concat("_kept", F.substring(F.col("ahead"), F.lit(1), m))).withColumn("_sha", F.sha2("_new", 256))
    same = F.length("_kept") - F.length(F.substring_index("_kept", "\n", -1))  # characters before the paragraph that the cut is in
    sides = F.array(
        F.struct(F.lit("stays").alias("side"), F.when(same > 0, F.substring(F.col("text"), F.lit(1), same - 1)).alias("part")),
        F.struct(F.lit("goes").alias("side"), F.substring(F.col("text"), same + 1, F.length("text")).alias("part")),
        F.struct(F.lit("comes").alias("side"), F.substring(F.col("_new"), same + 1, F.length("_new")).alias("part")),
    )
    sha = [F.conv(F.substring("_sha", 8 * k + 1, 8), 16, 10).cast("long").alias(f"_e{k}") for k in range(8)]
    kept = ["next_id", "n_chars", *[f"_e{k}" for k in range(8)]]
    cut = rows.select("doc_id", "key", "next_id", F.length("text").cast("long").alias("n_chars"), *sha, F.explode(sides).alias("_x")).select("doc_id", "key", *kept, "_x.side", "_x.part")
    summed = vectors(cut, ["doc_id", "key", "side"], "part", kept)
    # Rows alike were summed together, exactly so many times.
    one = summed.withColumn("vector", F.expr("transform(vector, x -> x div texts)"))
    both = one.groupBy("doc_id", "key").agg(F.collect_list(F.struct("side", "vector")).alias("_v"), F.max("texts").alias("texts"), *[F.max(c).alias(c) for c in kept])
    of = lambda side: F.coalesce(F.get(F.filter("_v", lambda x: x["side"] == side), F.lit(0))["vector"], F.array_repeat(F.lit(0).cast("long"), WIDTH))
    both = both.select("*", of("stays").alias("_stays"), of("goes").alias("_goes"), of("comes").alias("_comes")).withColumn("fingerprint", inserted(F.col("_stays"), F.col("_goes")))
    both = both.withColumn("edited_fingerprint", inserted(deleted(F.col("fingerprint"), F.col("_goes")), F.col("_comes")))
    sha = F.concat_ws("", *[F.lpad(F.lower(F.hex(f"_e{k}")), 8, "0") for k in range(8)])
    return both.select("doc_id", "key", "next_id", "texts", "n_chars", sha.alias("edited_sha256"), "fingerprint", "edited_fingerprint")


def compared(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (arrays of lanes), near_edited, near_next."""
    found = materialize(edits(docs))
    found = found.select("*", signs(F.col("fingerprint")).alias("_a"), signs(F.col("edited_fingerprint")).alias("_b"))
    stands = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min(F.struct("key", "fingerprint")).alias("_n")).select("next_id", F.col("_n.fingerprint").alias("_next"))
    near = found.where("doc_id is not null").join(stands.hint("merge"), "next_id", "left")
    lost = found.where("doc_id is null")
    if not lost.isEmpty():  # they all have the first document next, which is one row
        first = found.where("doc_id is not null").agg(F.min("doc_id").alias("next_id"))
        near = near.unionByName(lost.join(F.broadcast(materialize(stands.join(F.broadcast(first), "next_id"))), "next_id", "left"))
    same = lambda a, b: F.when(a == b, 1.0)
    edited = same(F.col("fingerprint"), F.col("edited_fingerprint")).otherwise(F.coalesce(likeness(F.col("_a"), F.col("_b")), F.lit(0.0)))
    ahead = same(F.col("fingerprint"), F.col("_next")).otherwise(F.coalesce(likeness(F.col("_a"), signs(F.col("_next"))), F.lit(0.0)))
    near = near.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", edited.alias("near_edited"), ahead.alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), "texts")).alias("_k"))
    return near.drop("_k")


def query(spark, sf_dir: str) -> DataFrame:
    out = compared(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("fingerprint", digest(F.col("fingerprint"))).withColumn("edited_fingerprint", digest(F.col("edited_fingerprint")))
