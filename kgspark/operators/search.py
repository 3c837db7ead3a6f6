"""Vector, text and hybrid search, and ranked listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import cosine, sigmoid
from kgspark.functions.udfs import ratio, weighted_ratio
from kgspark.operators.graph import alias_names, undirected, visible
from kgspark.operators.recovery import saved
from kgspark.operators.vectors import knn_self, vector_topk  # noqa: F401

def relevant_facts(facts: DataFrame, query: DataFrame, k: int = 5) -> DataFrame:
    """query (entity_id, qvec) -> its active facts nearest by cosine."""
    got = facts.where("invalid_at is null and vec is not null").join(query, facts["source_entity_id"] == query["entity_id"])
    got = got.withColumn("score", cosine(F.col("vec"), F.col("qvec")))
    rn = F.row_number().over(W.partitionBy("entity_id").orderBy(F.round("score", 9).desc(), "id"))
    return got.withColumn("rank", rn).where(F.col("rank") <= k).select("entity_id", "id", "content", "score", "rank")


def terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(text_col), " ")).alias("term")).where("term <> ''")


def bm25(corpus: DataFrame, queries: DataFrame, k: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """qid, id, score (> 0), rank. corpus: id, text; queries: qid, text. Okapi weights; postings are cut to query terms early."""
    words = terms(corpus, "id", "text")
    length = words.groupBy("id").agg(F.count(F.lit(1)).alias("dl"))
    stats = length.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    asked = terms(queries.withColumnRenamed("qid", "id"), "id", "text").withColumnRenamed("id", "qid").groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))
    tf = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    got = tf.join(df, "term").join(length, "id").crossJoin(F.broadcast(stats)).select("id", "term", weight.alias("w"))
    scored = asked.join(got, "term").groupBy("qid", "id").agg(F.sum(F.col("w") * F.col("qf")).alias("score")).where("score > 0")
    rn = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id"))
    scored = scored.withColumn("rank", rn)
    return scored if k is None else scored.where(F.col("rank") <= k)


def hybrid(vector: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """Sum of the vector score and the text score over the query's best text score."""
    top = F.max("score").over(W.partitionBy("qid"))
    t = text.select("qid", "id", (F.col("score") / top).alias("t_score"))
    both = vector.select("qid", "id", F.col("score").alias("v_score")).join(t, ["qid", "id"], "full_outer")
    got = both.withColumn("score", F.coalesce("v_score", F.lit(0.0)) + F.coalesce("t_score", F.lit(0.0)))
    rn = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id"))
    return got.withColumn("rank", rn).where(F.col("rank") <= k)


def rerank(cands: DataFrame, texts: DataFrame, queries: DataFrame, scorer=None, fetch: int = 45, k: int = 8) -> DataFrame:
    """The first `fetch` candidates rescored by scorer(query text, text) -> column; without a scorer the raw score stands."""
    cut = cands.where(F.col("rank") <= fetch).select("qid", "id", "score")
    if scorer is not None:
        cut = cut.join(texts.select("id", "text"), "id").join(queries.select("qid", F.col("text").alias("q_text")), "qid").withColumn("score", scorer(F.col("q_text"), F.col("text")))
    rn = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id"))
    return cut.withColumn("rank", rn).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def overlap_score(q: Column, t: Column) -> Column:
    """A simple pair scorer: common words over the query's words."""
    a, b = F.array_distinct(F.split(F.lower(q), " ")), F.array_distinct(F.split(F.lower(t), " "))
    return F.size(F.array_intersect(a, b)) / F.size(a)


def parent_retrieval(hits: DataFrame, children: DataFrame, n: int, parents: DataFrame | None = None, queries: DataFrame | None = None, scorer=None) -> DataFrame:
    """hits (qid, id, score) on children (id, parent_id) -> best parents with a sigmoid score to four places.

    A parent's raw score is its best child's; with scorer(query text, parent text) it is that of parents (parent_id, text).
    """
    got = hits.join(children.select("id", "parent_id"), "id").groupBy("qid", "parent_id").agg(F.max("score").alias("raw"))
    if scorer is not None:
        got = got.join(parents.select("parent_id", "text"), "parent_id").join(queries.select("qid", F.col("text").alias("q_text")), "qid").withColumn("raw", scorer(F.col("q_text"), F.col("text")))
    rn = F.row_number().over(W.partitionBy("qid").orderBy(F.round("raw", 9).desc(), "parent_id"))
    return got.withColumn("rank", rn).where(F.col("rank") <= n).select("qid", "parent_id", F.round(sigmoid(F.col("raw")), 4).alias("score"), "rank")


def search_entity(entities: DataFrame, queries: DataFrame, topics: list[str] | None, limit: int) -> DataFrame:
    """BM25 over names and aliases, one row per entity."""
    corpus = entities.where(visible(F.col("topic"), topics)).select("id", F.concat_ws(" ", "canonical_name", "alias1").alias("text"))
    hits = bm25(corpus, queries, limit)
    return hits.join(entities.select("id", "canonical_name", "type", "topic"), "id")


def entity_cards(hits: DataFrame, facts: DataFrame, part_of: DataFrame, edges: DataFrame, n_facts: int = 5, k: int = 5) -> DataFrame:
    """hits (with id) and what is known of each: facts (newest active contents), parent_id, n_children, connections (ids, heaviest first)."""
    ids = hits.select("id").distinct()
    near = top_connections(edges, ids, k).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id")))["other_id"].alias("connections"))
    mine = facts.where("invalid_at is null").join(ids.select(F.col("id").alias("source_entity_id")), "source_entity_id", "left_semi")
    rn = F.row_number().over(W.partitionBy("source_entity_id").orderBy(F.desc("created_at"), F.desc("id")))
    known = mine.withColumn("rn", rn).where(F.col("rn") <= n_facts).groupBy(F.col("source_entity_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rn", "content")))["content"].alias("facts"))
    up = part_of.groupBy(F.col("child_id").alias("id")).agg(F.min("parent_id").alias("parent_id"))
    down = part_of.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    got = hits.join(known, "id", "left").join(up, "id", "left").join(down, "id", "left").join(near, "id", "left")
    return got.withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def top_connections(edges: DataFrame, ids: DataFrame, k: int = 5, evidence: int = 5) -> DataFrame:
    """The k heaviest edges of each id with the first evidence ids."""
    near = undirected(edges).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    rn = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return near.withColumn("rank", rn).where(F.col("rank") <= k).select(F.col("src").alias("id"), "rank", F.col("dst").alias("other_id"), "weight", F.slice("message_ids", 1, evidence).alias("evidence"))


def recent_activity(edges: DataFrame, entities: DataFrame, names: DataFrame, now: Column, hours: int, topics: list[str] | None = None) -> DataFrame:
    src = alias_names(entities).join(names.select(F.lower("name").alias("name")), "name").select(F.col("id").alias("src")).distinct()
    near = undirected(edges).join(src, "src").where(F.unix_timestamp("last_seen") > F.unix_timestamp(now) - hours * 3600)
    return near.join(entities.where(visible(F.col("topic"), topics)).select(F.col("id").alias("dst"), F.col("canonical_name").alias("other")), "dst").select(F.col("src").alias("id"), F.col("dst").alias("other_id"), "other", "last_seen", "weight")


def _pairs_of_letters(texts: DataFrame) -> DataFrame:
    """f, n, g: of each text f its pairs of adjacent letters, each with its number of occurrence, and how many there are; shorter texts are one."""
    at = F.sequence(F.lit(1), F.greatest(F.length("f") - 1, F.lit(1)))
    pairs = F.array_sort(F.transform(at, lambda i: F.substring(F.col("f"), i, F.lit(2))))
    # Equal pairs stand together once sorted; the number of occurrence is the distance to the first of them.
    counted = texts.select("f", pairs.alias("p")).select("f", F.transform("p", lambda x, i: F.concat(x, F.lit(":"), (i + 1 - F.array_position("p", x)).cast("string"))).alias("grams"))
    return counted.select("f", F.size("grams").alias("n"), F.explode("grams").alias("g"))


#: Rows for each given one that texts may make where they meet for all k at once.
WHOLE = 16


def alike_texts(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """k, l, r of left (k, l, text) and right (k, r, text) of one k whose texts' plain ratio is over the cutoff (85 or more).

    No pair is lost: see fuzzy_candidates. Postings are by k and letters, so a k of any size is many keys.
    """
    c = cutoff / 100
    texts = saved(left.select("text").unionByName(right.select("text")).where("text is not null").distinct().withColumnRenamed("text", "f"))
    posted = _pairs_of_letters(texts)
    ordered = posted.join(posted.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "g").groupBy("f", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
    least = F.ceil((1.5 * c - 1) * F.length("f") * (1 + c / (2 - c)) - 1 - 1e-9)
    rare = saved(ordered.select(F.col("f").alias("text"), F.explode(F.slice("o", F.lit(1), F.greatest(F.lit(1), F.col("n") - F.greatest(F.lit(1), least) + 1).cast("int"))).alias("x")).select("text", "x.g"))
    near = F.abs(F.length("lt") - F.length("rt")) <= (1 - c) * (F.length("lt") + F.length("rt")) + 1e-9
    rows = lambda df, n: df.agg(F.coalesce(F.sum(n), F.lit(0).cast("long"))).first()[0]
    count = lambda df, by, n: df.groupBy(by).agg(F.count(F.lit(1)).alias(n))

    def rated(two: DataFrame) -> DataFrame:
        """Two texts are rated once, whoever says them; they are stored first, as the filter would be moved before the distinct."""
        return saved(saved(two.select("lt", "rt").where("lt <> rt").distinct()).where(ratio("lt", "rt") > cutoff))

    # Where few texts are said often, texts meet once for all k; else within each k. By exact counts of the rows made.
    said = {s: saved(count(df.where("text is not null"), "text", "n")) for s, df in (("l", left), ("r", right))}
    most = WHOLE * sum(rows(df, "n") for df in said.values())
    of = {s: rare.join(df, "text").select("g", F.col("text").alias(f"{s}t")) for s, df in said.items()}
    if rows(count(of["l"], "g", "n").join(count(of["r"], "g", "m"), "g"), F.col("n") * F.col("m")) <= most:
        alike = rated(of["l"].join(of["r"], "g").where(near))
        both = said["l"].join(said["r"].select("text"), "text", "left_semi").select(F.col("text").alias("lt"), F.col("text").alias("rt")) if cutoff < 100 else alike.where("false")
        alike = saved(alike.unionByName(both))
        if rows(alike.join(said["l"].withColumnRenamed("text", "lt"), "lt"), "n") <= most:
            return left.withColumnRenamed("text", "lt").join(alike, "lt").join(right.withColumnRenamed("text", "rt"), ["k", "rt"]).select("k", "l", "r").distinct()
    a = left.join(rare, "text").select("k", "l", "g", F.col("text").alias("lt"))
    b = right.join(rare, "text").select("k", "r", "g", F.col("text").alias("rt"))
    met = saved(a.join(b, ["k", "g"]).where(near).select("k", "l", "r", "lt", "rt").distinct())
    same = met.where("lt = rt") if cutoff < 100 else met.where("false")
    return same.select("k", "l", "r").unionByName(met.join(rated(met), ["lt", "rt"], "left_semi").select("k", "l", "r"))


#: Longest texts of which all forms with up to two letters left out are made, and letters left out and put in that these find.
SHORT, EDITS = 32, 3


def _left_out(texts: DataFrame, text: str) -> DataFrame:
    """texts (text, of at most SHORT letters) with cut, gone: the text without any gone (0 to 2) of its letters."""
    without = lambda x, i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))
    at = lambda x: F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x)))
    one = texts.withColumn("_i", F.explode(at(F.col(text)))).withColumn("cut", without(F.col(text), F.col("_i")))
    # The second letter is after the first, so two letters are left out once.
    two = one.where(F.col("_i") <= F.length("cut")).withColumn("_j", F.explode(F.sequence(F.col("_i"), F.length("cut")))).withColumn("cut", without(F.col("cut"), F.col("_j"))).drop("_j")
    each = [df.drop("_i").withColumn("gone", F.lit(n)) for n, df in enumerate((texts.withColumn("cut", F.col(text)), one, two))]
    return each[0].unionByName(each[1]).unionByName(each[2]).distinct()


def _close_words(sides: DataFrame) -> DataFrame:
    """mention, name, edits of sides (s, is_m, is_n, short): short words that differ by at most EDITS letters left out and put in; every such pair, and how many."""
    m, n = sides.where("is_m and short").select(F.col("s").alias("mention")), sides.where("is_n and short").select(F.col("s").alias("name"))

    def cut(df, c, other, o):
        """Two letters are left out only of words one or two letters longer than one of the other side, which loses one letter at most."""
        longer = other.select(F.explode(F.array(F.length(o) + 1, F.length(o) + 2)).alias("_l")).distinct()
        return _left_out(df, c).where("gone < 2").unionByName(_left_out(df.join(longer, F.length(c) == F.col("_l"), "left_semi"), c).where("gone = 2"))

    met = cut(m, "mention", n, "name").withColumnRenamed("gone", "_g").join(cut(n, "name", m, "mention").withColumnRenamed("gone", "_h"), "cut")
    return met.withColumn("edits", F.col("_g") + F.col("_h")).where(F.col("edits") <= EDITS).groupBy("mention", "name").agg(F.min("edits").alias("edits"))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to as many partitions as a shuffle has: few bytes that are much work would else be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _marks(items: Column) -> list[Column]:
    """Two numbers with a bit for each item of an array, by its hash."""
    at = lambda x: F.pmod(F.xxhash64(x), F.lit(128)).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), at(x) % 64)
    half = lambda of: F.aggregate(F.filter(items, of), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x)))
    return [half(lambda x: at(x) < 64), half(lambda x: at(x) >= 64)]


def _lacks(a: str, b: str, what: str) -> Column:
    """How many of a's letters or pairs (what) b has not, at least: bits of a's that are none of b's."""
    return F.bit_count(F.col(f"{a}{what}0").bitwiseAND(F.bitwise_not(f"{b}{what}0"))) + F.bit_count(F.col(f"{a}{what}1").bitwiseAND(F.bitwise_not(f"{b}{what}1")))


def _numbered(items: Column) -> Column:
    """The items sorted, each with its number of occurrence; that is the distance to the first of the equal ones."""
    return F.transform(F.array_sort(items), lambda x, i: F.concat(x, F.lit(":"), (i + 1 - F.array_position(F.array_sort(items), x)).cast("string")))


def fuzzy_candidates(mentions: DataFrame, names: DataFrame, cutoff: float = 85, k: int = 50) -> DataFrame:
    """mention, id, score (0..1): the weighted ratio over names (id, name in lower case), of the cutoff (85 or more); below four letters the plain ratio.

    Candidates lose no pair; c = cutoff / 100.  A text counts as it is, with its words sorted, and with its distinct words sorted.
      - Plain ratios, of any of these: texts of a and b letters have c (a + b) / 2 in common order at least, hence 3 c (a + b) / 2 - (a + b) - 1 pairs
        of adjacent letters.  Of so many shared pairs one is among the rarest of each text, once that many less one are left out.
      - Sets of words, where one word is shared, and parts that share one: the word.
      - Parts, weighted 0.9: with p = c / 0.9 a part and the shorter text of a letters differ by 2 (1 - p) a edits at most, each of which takes
        away two of the a - 1 pairs at most; one of the others is among the rarest that many and one of the shorter text, and anywhere in the longer.
          - One letter alone: the letter.

    What meets is looked at for more than the one pair or letter it meets by, before it is rated: bits of all letters and pairs, each with its
    number of occurrence, tell how many of them the other text lacks at least, and by the same figures it may lack so many at most.

    Of short words (one ASCII word each) those a few letters apart are found first, by the letters left out.  All other short words
    have at most 1 - (EDITS + 1) / (2 a + EDITS + 1), or 0.9 as parts; a mention of a letters with k ids over that needs none of them.
    If all mentions have, short names are not posted at all.  Of a name's ids, all as good, the k smallest will do.
    """
    if cutoff < 85:
        raise ValueError("below 85 short names need not share adjacent letters")
    c = cutoff / 100
    asked = mentions.select(F.lower("mention").alias("s")).where("s <> ''").distinct()
    known = names.select(F.col("name").alias("s")).where("s is not null").distinct()
    texts = asked.withColumn("m", F.lit(1)).unionByName(known.withColumn("m", F.lit(0))).groupBy("s").agg(F.max("m").alias("m"), F.min("m").alias("n_side"))
    words = F.filter(F.split("s", r"\s+"), lambda w: w != "")
    forms = F.array_distinct(F.array(F.col("s"), F.array_join(F.array_sort(words), " "), F.array_join(F.array_sort(F.array_distinct(words)), " ")))
    sides = saved(texts.select("s", (F.col("m") == 1).alias("is_m"), (F.col("n_side") == 0).alias("is_n"), forms.alias("forms"), F.array_distinct(words).alias("words"), F.col("s").rlike(f"^[!-~]{{1,{SHORT}}}$").alias("short")))
    smallest = F.dense_rank().over(W.partitionBy("name").orderBy("id"))
    of = saved(names.where("name is not null").select("id", "name").withColumn("_r", smallest).where(F.col("_r") <= k).select("id", "name").distinct())
    lm, ln, fm, fn = F.length("mention"), F.length("name"), F.length("mf"), F.length("nf")
    r = F.when(F.col("mention") == F.col("name"), 100.0).otherwise(F.when(lm < 4, ratio("mention", "name")).otherwise(weighted_ratio("mention", "name")))
    close = saved(_close_words(sides))
    # Of one word each and of near lengths, so the weighted ratio is the plain one: that of the letters left out and put in.
    own = (lm < 4) | (2 * F.greatest(lm, ln) < 3 * F.least(lm, ln))
    told, rest = close.where(own).withColumn("score", 200.0 * ((lm + ln - F.col("edits")) / 2) / (lm + ln)), _spread(close.where(~own), "mention", "name").withColumn("score", r)
    close = saved(told.unionByName(rest).where(F.col("score") >= cutoff).select("mention", "name", "score"))
    beyond = F.greatest(F.lit(90.0), 100 - 100 * (EDITS + 1) / (2 * lm + EDITS + 1)) + 1e-6
    full = close.where((lm >= 4) & (F.col("score") > beyond)).join(of, "name")
    full = full.groupBy("mention").agg(F.count_distinct("id").alias("_n")).where(F.col("_n") >= k).select(F.col("mention").alias("s"), F.lit(True).alias("full"))
    sides = saved(sides.join(full, "s", "left").withColumn("full", F.coalesce("full", F.lit(False)) & F.col("is_m")))
    if sides.where("is_m and not full").isEmpty():
        sides = sides.where("is_m or not short")
    form = sides.select("s", "is_m", "is_n", "short", "full", F.explode("forms").alias("f"))
    posted = saved(_pairs_of_letters(_spread(form.select("f").distinct(), "f")))
    df = posted.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ordered = _spread(posted.join(df, "g"), "f", "n").groupBy("f", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
    a, gone = F.length("f"), F.floor(4 * (1 - c / 0.9) * F.length("f") + 1e-9)
    least = F.ceil((1.5 * c - 1) * a * (1 + c / (2 - c)) - 1 - 1e-9)
    plain = F.greatest(F.lit(1), F.col("n") - F.greatest(F.lit(1), least) + 1)
    bits = [b.alias(f"{what}{i}") for what, items in (("l", _numbered(F.split("f", ""))), ("p", F.col("o")["g"])) for i, b in enumerate(_marks(items))]
    known_bits = ("n", *(f"{what}{i}" for what in "lp" for i in (0, 1)))
    ordered = ordered.withColumn("bits", F.struct("n", *bits))
    rare = ordered.select("f", "n", "bits", F.posexplode(F.col("o")).alias("r", "x")).select("f", "x.g", (F.col("r") < plain).alias("plain"), (F.col("r") <= gone).alias("part"), "bits")
    rare = saved(rare.join(form, "f").select("s", "f", "g", "is_m", "is_n", "short", "full", "plain", "part", *[F.col(f"bits.{b}").alias(b) for b in known_bits]))
    near = F.abs(fm - fn) * 100 <= (100 - cutoff) * (fm + fn)
    apart = (F.greatest(lm, ln) >= 1.5 * F.least(lm, ln)) & (F.greatest(lm, ln) <= 8 * F.least(lm, ln)) & (lm >= 4)
    part = F.col("m_part") & (fm <= fn) | F.col("n_part") & (fn <= fm)
    # By their letters and pairs, of which each text may lack so many: the plain ratio, and the shorter one as a part.
    shared = (3 * c / 2 - 1) * (fm + fn) - 1 - 1e-9
    enough = (2 * (fm - _lacks("m_", "n_", "l")) >= c * (fm + fn) - 1e-9) & (2 * (fn - _lacks("n_", "m_", "l")) >= c * (fm + fn) - 1e-9)
    enough = enough & (F.col("m_n") - _lacks("m_", "n_", "p") >= shared) & (F.col("n_n") - _lacks("n_", "m_", "p") >= shared)
    within = lambda x, y, long: (_lacks(x, y, "p") <= F.floor(4 * (1 - c / 0.9) * long + 1e-9)) & (long - _lacks(x, y, "l") >= c / 0.9 / (2 - c / 0.9) * long - 1e-9)
    inside = (fm <= fn) & within("m_", "n_", fm) | (fn <= fm) & within("n_", "m_", fn)

    def alike(is_m: str, is_n: str) -> DataFrame:
        side = lambda df, to, x: df.select(F.col("s").alias(to), F.col("f").alias(f"{x}f"), "g", *[F.col(col).alias(f"{x}_{col}") for col in ("plain", "part", *known_bits)])
        m, n = side(rare.where(is_m), "mention", "m"), side(rare.where(is_n), "name", "n")
        met = m.where("m_plain").join(n.where("n_plain"), "g").where(near & enough).select("mention", "name")
        met = met.unionByName(m.where("m_part").join(n, "g").where(apart & part & inside).select("mention", "name")).unionByName(m.join(n.where("n_part"), "g").where(apart & part & inside).select("mention", "name"))
        word = lambda side, to: sides.where(side).select(F.col("s").alias(to), F.explode("words").alias("w"))
        met = met.unionByName(word(is_m, "mention").where(lm >= 4).join(word(is_n, "name"), "w").where(F.greatest(lm, ln) <= 8 * F.least(lm, ln)).select("mention", "name"))
        letter = sides.where(is_m).select(F.col("s").alias("mention"), F.explode(F.array_distinct(F.split("s", ""))).alias("f"))
        alone = form.where(is_n).where(F.length("f") == 1).select("f", F.col("s").alias("name"))
        return met.unionByName(letter.join(alone, "f").where(apart).select("mention", "name"))

    met = saved(_spread(alike("is_m and not full", "is_n").unionByName(alike("full", "is_n and not short")).distinct(), "mention", "name"))
    scored = close.unionByName(met.withColumn("score", r).where(F.col("score") >= cutoff))
    best = scored.join(of, "name").groupBy("mention", "id").agg((F.max("score") / 100).alias("score"))
    rn = F.row_number().over(W.partitionBy("mention").orderBy(F.round("score", 9).desc(), "id"))
    return best.withColumn("rank", rn).where(F.col("rank") <= k)


def fuse(*candidates: DataFrame) -> DataFrame:
    """mention, id, score: the best score of all candidate tables."""
    union = candidates[0].select("mention", "id", "score")
    for c in candidates[1:]:
        union = union.unionByName(c.select("mention", "id", "score"))
    return union.groupBy("mention", "id").agg(F.max("score").alias("score"))


def resolve_best(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """mention, id, canonical_name of the best live candidate."""
    live = candidates.join(entities.select("id", "canonical_name"), "id")
    return live.groupBy("mention").agg(F.max_by(F.struct("id", "canonical_name"), F.struct("score", -F.col("id"))).alias("_b")).select("mention", "_b.id", "_b.canonical_name")
