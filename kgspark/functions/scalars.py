"""Column functions: vectors, strings, ids and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0.0 for missing, empty or zero vectors, unequal lengths and null components."""
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | F.exists(a, lambda x: x.isNull()) | F.exists(b, lambda x: x.isNull())
    length = norm(a) * norm(b)
    return F.when(bad | (length == 0), 0.0).otherwise(F.coalesce(dot(a, b) / length, F.lit(0.0)))


def l2norm(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def substring_match(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return F.contains(a, b) | F.contains(b, a)


#: Letters in a word of the row of indel_ratio: a sum of two rows and a carry fits a long.
WORD = 62


def bound(value: Column, use) -> Column:
    """use(value), with value computed once: within a function Spark would compute it at each place."""
    return F.transform(F.array(value), use)[0]


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (len a + len b), 100 for two empty strings: the LCS by one fold over b, a row of the table as the bits of words of WORD letters of a."""
    xs, ys = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    total, none = F.size(xs) + F.size(ys), F.lit(0).cast("long")
    shift = lambda way, x, n: F.call_function(way, x, n)
    bits = F.transform(xs, lambda x, i: F.struct(x.alias("c"), shift("shiftleft", F.lit(1).cast("long"), i % WORD).alias("bit")))
    words = bound(bits, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / WORD).cast("int")), lambda w: F.slice(all_, w * WORD + 1, F.lit(WORD))))

    def next_row(s: Column, y: Column) -> Column:
        def word(t: Column, w: Column) -> Column:
            """t: words done, carry. w: letters with their bits, row of the word."""
            hit = F.aggregate(w["letters"], none, lambda m, x: F.when(x["c"] == y, m.bitwiseOR(x["bit"])).otherwise(m)).bitwiseAND(w["row"])

            def added(z: Column) -> Column:
                row = z["sum"].bitwiseOR(w["row"] - z["hit"]).bitwiseAND(F.element_at(w["letters"], -1)["bit"] * 2 - 1)
                return F.struct(F.concat(t["done"], F.array(row)).alias("done"), shift("shiftright", z["sum"], F.lit(WORD)).alias("carry"))

            return bound(hit, lambda h: bound(F.struct(h.alias("hit"), (w["row"] + h + t["carry"]).alias("sum")), added))

        pairs = F.zip_with(s["words"], s["rows"], lambda letters, row: F.struct(letters.alias("letters"), row.alias("row")))
        rows = F.aggregate(pairs, F.struct(F.array().cast("array<bigint>").alias("done"), none.alias("carry")), word)["done"]
        return F.struct(s["words"].alias("words"), rows.alias("rows"))

    first = bound(words, lambda ws: F.struct(ws.alias("words"), F.transform(ws, lambda w: F.element_at(w, -1)["bit"] * 2 - 1).alias("rows")))
    open_ = F.aggregate(F.aggregate(ys, first, next_row)["rows"], F.lit(0), lambda n, r: n + F.bit_count(r))
    lcs = F.when((F.size(xs) == 0) | (F.size(ys) == 0), 0).otherwise(F.size(xs) - open_)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs / total)


def msg_hash(session: Column, content: Column, ts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", session.cast("string"), content, ts.cast("string")), 256), 1, 12)


def date_label(text: Column) -> Column:
    """yyyy-MM-dd of an ISO time, else the first ten characters, else unknown."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"), F.when(F.length(text) > 0, F.substring(text, 1, 10)), F.lit("unknown"))


def sigmoid(s: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), s))))


def sanitize(q: Column) -> Column:
    """Search operators become blanks, blanks collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(q, r'[+\-&|!(){}\[\]^"~*?:\\/]', " "), r"\s+", " "))


ASSISTANT_IDS = 1_000_000_000


def format_msg_id(i: Column) -> Column:
    return F.when(i < ASSISTANT_IDS, F.concat(F.lit("msg_"), i.cast("string"))).otherwise(F.concat(F.lit("turn_"), (i - ASSISTANT_IDS).cast("string")))


def parse_msg_id(s: Column) -> Column:
    """Null for anything but msg_<n> and turn_<n>."""
    number = F.regexp_extract(s, r"^(?:msg|turn)_([0-9]{1,18})$", 1)
    value = F.when(number != "", number.cast("long"))
    return F.when(F.startswith(s, F.lit("turn_")), value + ASSISTANT_IDS).otherwise(value)


def normalize_ts(text: Column) -> Column:
    """Epoch seconds of a number in s, ms, us or ns (whichever falls in 2000..2100) or of an ISO time; else null."""
    low, high = 946684800, 4102444800
    v = F.try_to_number(text, F.lit("9" * 19)).cast("decimal(19,0)").cast("long")
    scaled = F.coalesce(*[F.when((v / d).between(low, high), F.floor(v / d)) for d in (1, 1_000, 1_000_000, 1_000_000_000)])
    return F.coalesce(scaled, F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))))


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def token_estimate(s: Column) -> Column:
    return F.floor(F.length(s) / 4).cast("long")
