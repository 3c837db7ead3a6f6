"""Personal data: format rules, and candidates scored by boosted trees. DataFrame functions only.

Base kinds (email, ip, card, phone) are exact formats with validators, leftmost
and without overlap per kind.  High-recall generators propose further spans,
which may overlap: values after a name and = or :, runs of letters and digits,
numbers with separators, addresses, plain or spelled out.  Boosted trees score
a candidate by its format and the text before it.

Their labels come from evidence that is no feature: a candidate that covers a
validated base span is personal; a number that fails its validator is not; a
run of letters and digits is a secret if its characters are spread like random
ones (ENTROPY) and no more than CONTEXTS different contexts in the corpus hold
it; of base spans, masked copies (spelled-out address, other separators, no
plus) are personal too.  The trees are fitted on six tenths of all values, for
each format (key, number, address) a threshold is calibrated to PRECISION on two
tenths, and precision and recall are measured on the rest.  Candidates over
their threshold that touch no base span are added, as kind "secret".

The patterns are written so that no text makes them slow or deep: runs are
matched by single character classes after separators inside a run have been
replaced by a mark of the same length.

Defined cases: null text is empty and has no spans; offsets are code points;
the mark itself in a text counts as another character; repeated rows are each
reported; rows without doc_id are handled like others; where all have one
label only nothing is added; an empty table gives no rows; extra columns are
kept by redact, with their values, and left out elsewhere.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import fresh, join_checked, load, materialize, own

MARK, OTHER = "\x01", "\x02"
KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int>>"
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Precision that a threshold must reach on the calibration part.
PRECISION = 0.98
#: Bits a character of a random run has at least, and different contexts a secret has at most.
ENTROPY, CONTEXTS = 3.0, 2
FORMATS = ("key", "number", "address")
FEATURES = ("digits", "letters", "upper", "seps", "size", "groups", "quoted", "assigned", "key_word", "number_word", "licence_word", "plus", "at", "dots", "colon_before")


def found(text: Column, pattern: str, kind: str, fine=lambda m: F.lit(True)) -> Column:
    """Array of (kind, start, end) of the leftmost non-overlapping matches for which fine holds."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(fine(x["m"]), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), matches.alias("m"))
    return F.when(F.size(matches) == 0, F.array().cast(SPAN)).otherwise(F.aggregate(pairs, zero, step)["spans"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def part(x: Column, i: Column) -> Column:
        v = x.cast("int")
        return F.when(i % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(d), ""), part), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def working(text: Column) -> Column:
    """The text with the mark character replaced, of equal length."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)


def base_spans(text: Column) -> Column:
    """A struct of KINDS, each an array of spans; text as from working()."""
    none, has_digit = F.array().cast(SPAN), F.rlike(text, F.lit("[0-9]"))
    label = "A-Za-z0-9-"
    joined = F.regexp_replace(text, rf"(?<=[{label}])\.(?=[{label}])", MARK)
    local = rf"A-Za-z0-9._%+{MARK}-"
    email = found(joined, rf"(?:(?<![{local}])|\G)[{local}]++@[{label}]++{MARK}[{label}{MARK}]++", "email")
    ip = found(text, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "ip", lambda m: F.rlike(m, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$")))
    run = F.regexp_replace(text, r"(?<=[0-9])[ -](?=[0-9])", MARK)

    def is_card(m: Column) -> Column:
        d = digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))

    card = found(run, rf"(?<![0-9{MARK}])[0-9][0-9{MARK}]{{15,}}+", "card", is_card)
    phone = found(text, r"\+[0-9][ ().0-9-]+[0-9]", "phone", lambda m: F.length(digits(m)).between(8, 15))
    return F.struct(
        F.when(F.contains(text, F.lit("@")), email).otherwise(none).alias("email"), F.when(has_digit, ip).otherwise(none).alias("ip"),
        F.when(has_digit, card).otherwise(none).alias("card"), F.when(F.contains(text, F.lit("+")), phone).otherwise(none).alias("phone"),
    )


def candidates(text: Column) -> Column:
    """Overlapping spans of all generators, with value and the text before."""
    none, has_digit = F.array().cast(SPAN), F.rlike(text, F.lit("[0-9]"))
    run, mixed = "A-Za-z0-9+/_=-", lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]"))
    number = F.regexp_replace(text, "(?<=[0-9])[ .-](?=[0-9])", MARK)
    at = F.contains(text, F.lit("at"))
    generators = [
        (text, rf"(?i)(?<![a-z0-9_-])[a-z][a-z0-9_-]*+[ ]?[=:][ ]?\"?[{run}]{{8,}}+\"?", has_digit, mixed),
        (text, rf"(?<![{run}])[{run}]{{12,}}+", has_digit, mixed),
        (number, rf"(?<![0-9{MARK}])[0-9][0-9{MARK}]{{6,}}+", has_digit, lambda m: F.lit(True)),
        (text, r"\+[0-9][ ().0-9-]++", F.contains(text, F.lit("+")), lambda m: F.length(m) > 6),
        (text, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++", F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        (text, r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++[ ]?[(\[]at[)\]][ ]?[a-z0-9.-]++(?:[ ]?[(\[]dot[)\]][ ]?[a-z]++)?", at, lambda m: F.lit(True)),
        (text, r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++ at [a-z0-9-]++ dot [a-z]++", at & F.contains(text, F.lit(" dot ")), lambda m: F.lit(True)),
    ]
    every = F.concat(*[F.when(when, found(t, p, "secret", fine)).otherwise(none) for t, p, when, fine in generators])

    def with_context(s: Column) -> Column:
        before = F.greatest(s["start"] - 24, F.lit(0))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"),
            F.lower(F.substring(text, before + 1, s["start"] - before)).alias("before"),
        )

    return F.transform(F.array_distinct(every), with_context)


def format_of(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit("^[+0-9 ().-]+$")), "number").when(F.rlike(value, F.lit(r"(?i)@|[(\[]at[)\]]| at ")), "address").otherwise("key")


def candidate_features(c: DataFrame) -> DataFrame:
    v, b = F.col("value"), F.col("before")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    word = lambda p, x=b: F.rlike(x, F.lit(p)).cast("double")
    made = {
        "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "upper": count("[A-Z]"), "seps": count("[ ().-]"), "size": F.length(v).cast("double"), "groups": count("[0-9]+"),
        "quoted": word("\"$", v), "assigned": word("[=:]", v), "key_word": word("(?i)token|secret|key|pass", F.concat(b, v)),
        "number_word": word("(tel|phone|call|fax|card|iban|account|mail)[^a-z]{0,3}$"), "licence_word": word("(version|licen[sc]e|by-nc|by)[ ,]*$"), "plus": word(r"^\+", v),
        "at": word(r"(?i)[(\[]at[)\]]| at |@", v), "dots": count(r"\."), "colon_before": word("[=:][ \"]*$"),
    }
    return c.withColumns({k: made[k] for k in FEATURES}).withColumn("format", format_of(v))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row's doc_id and text), base (struct of spans), cand; materialized."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), working(F.col("text")).alias("_t"))
    return materialize(rows.select("doc_id", "key", base_spans(F.col("_t")).alias("base"), candidates(F.col("_t")).alias("cand")))


def each_candidate(scanned: DataFrame) -> DataFrame:
    """key, covers (touches a base span), start, end, value, before."""
    spans = F.concat(*[F.col(f"base.{k}") for k in KINDS])
    each = scanned.select("key", spans.alias("spans"), F.explode("cand").alias("c"))
    return each.select("key", F.exists("spans", lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"])).alias("covers"), "c.*")


def entropy(value: Column) -> Column:
    """Bits a character, from the value's own character counts."""
    letters = F.split(value, "")
    share = lambda d: F.size(F.filter(letters, lambda x: x == d)) / F.size(letters)
    return -F.aggregate(F.transform(F.array_distinct(letters), lambda d: share(d) * F.log2(share(d))), F.lit(0.0), lambda a, x: a + x)


def masked(value: Column) -> Column:
    """Other spellings of a base span's value."""
    spelled = F.replace(F.replace(value, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) "))
    dotted = F.regexp_replace(F.regexp_replace(value, r"^\+", ""), r"[ ()-]+", ".")
    return F.when(F.contains(value, F.lit("@")), F.array(spelled, F.replace(value, F.lit("@"), F.lit(" [at] ")))).otherwise(F.array(dotted))


def labelled(scanned: DataFrame) -> DataFrame:
    """label, part (0-9, by value), format, FEATURES of all candidates with a label and of masked copies, and n, how many are so (materialized)."""
    each = materialize(each_candidate(scanned).withColumn("format", format_of(F.col("value"))))
    # In how many contexts all documents have each run.
    seen = materialize(each.where("format = 'key'").groupBy("value").agg(F.count_distinct("before").alias("contexts")))
    secret = (entropy(F.col("value")) >= ENTROPY) & (F.coalesce("contexts", F.lit(1)) <= CONTEXTS)
    label = F.when(F.col("covers"), 1.0).when(F.col("format") == "number", 0.0).when(F.col("format") == "key", F.when(secret, 1.0).otherwise(0.0))
    own = join_checked(each, seen, "value", "left", row_bytes=100).select(label.alias("label"), "value", "before", F.pmod(F.xxhash64("value"), F.lit(10)).alias("part")).where("label is not null")
    # A masked copy stands for the whole value, so only candidates that are one base span are masked.
    whole = each.where("covers").where((F.col("format") != "key") & ~F.contains("value", F.lit("\n")))
    copies = whole.select(F.col("value").alias("of"), F.explode(masked(F.col("value"))).alias("value"), "before").where("value <> of")
    copies = copies.select(F.lit(1.0).alias("label"), "value", "before", F.pmod(F.xxhash64("of"), F.lit(10)).alias("part"))
    # Candidates alike in all that the trees see are one row of their number as weight.
    return materialize(candidate_features(own.unionByName(copies)).groupBy("label", "part", "format", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")))


def fit(scanned: DataFrame):
    """(model, threshold by format, held-out precision and recall by format); None where the candidates have one label only."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(labelled(scanned))
    train, rest = data.where("part < 6"), data.where("part >= 6")
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="n", maxIter=8, maxDepth=3, seed=1).fit(train)
    bins = score(rest, model).groupBy("format", (F.col("part") >= 8).alias("held"), F.floor(F.col("p") * 50).alias("bin")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    thresholds, report = {}, {}
    for f in FORMATS:
        good = n = 0
        thresholds[f] = 1.01
        for r in sorted((r for r in bins if r["format"] == f and not r["held"]), key=lambda r: -r["bin"]):
            good, n = good + r["good"], n + r["n"]
            if good >= PRECISION * n and r["bin"] >= 25:
                thresholds[f] = r["bin"] / 50
        held = [r for r in bins if r["format"] == f and r["held"]]
        hits, picked = (sum(r[c] for r in held if r["bin"] / 50 >= thresholds[f]) for c in ("good", "n"))
        report[f] = {"precision": hits / picked if picked else None, "recall": hits / max(1, sum(r["good"] for r in held)), "n": sum(r["n"] for r in held)}
    return model, thresholds, report


def score(data: DataFrame, model) -> DataFrame:
    return model.transform(data).withColumn("p", vector_to_array("probability")[1])


def added(scanned: DataFrame, fitted) -> DataFrame:
    """key, extra (spans of kind secret that touch no base span; materialized)."""
    free = each_candidate(scanned).where("not covers")
    if fitted is None:
        picked = free.where("false")
    else:
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(candidate_features(free))
        limit = F.element_at(F.create_map(*[F.lit(x) for kv in fitted[1].items() for x in kv]), F.col("format"))
        picked = score(data, fitted[0]).where(F.col("p") >= limit)
    span = F.struct(F.lit("secret").alias("kind"), "start", "end")
    got = picked.groupBy("key").agg(F.sort_array(F.collect_set(span)).alias("all"))
    # Of overlapping additions the first stays, and of those that start together the longest.
    longest = F.array_sort("all", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    step = lambda s, x: F.when((F.size(s) > 0) & (x["start"] < F.element_at(s, -1)["end"]), s).otherwise(F.concat(s, F.array(x)))
    return materialize(got.select("key", F.aggregate(longest, F.array().cast(SPAN), lambda s, x: F.when(F.size(s) == 0, F.array(x)).otherwise(step(s, x))).alias("extra")))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, key, base and extra of every row."""
    scanned = scan(docs)
    extra = added(scanned, fit(scanned))
    out = join_checked(scanned.drop("cand"), extra, "key", "left", row_bytes=100)
    return out.withColumn("extra", F.coalesce("extra", F.array().cast(SPAN)))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; n_chars, if there, follows the text."""
    key, mine = fresh(docs, "key"), fresh(docs, "spans")
    spans = F.concat(*[F.col(f"base.{k}") for k in KINDS], "extra")
    hits = materialize(detect(docs).where(F.size(spans) > 0).select(F.col("key").alias(key), spans.alias(mine)).dropDuplicates([key]))
    by_place = F.array_sort(mine, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(s: Column, x: Column) -> Column:
        start = F.greatest(x["start"], s["at"])
        shown = F.when(x["start"] >= s["at"], F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit(""))
        piece = F.concat(F.substring(F.col("text"), s["at"] + 1, start - s["at"]), shown)
        return F.struct(F.greatest(x["end"], s["at"]).alias("at"), F.concat(s["parts"], F.array(piece)).alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    end = F.aggregate(by_place, zero, step)
    text = F.transform(F.array(end), lambda e: F.concat(F.array_join(e["parts"], ""), F.substring(F.col("text"), e["at"] + 1, F.length("text"))))[0]
    out = join_checked(docs.withColumn(key, F.xxhash64("doc_id", "text")), hits, key, "left", row_bytes=120)
    out = out.withColumn("text", F.when(F.col(mine).isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(mine).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*own(docs))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    out = detect(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[F.col(f"base.{k}") for k in KINDS])
    n = [F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *n, F.size("extra").cast("long").alias("n_secret"), F.size(F.concat(base, "extra")).cast("long").alias("n_spans"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, "extra")).alias("spans"))
