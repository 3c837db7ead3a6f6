"""Fingerprints: the contract against plain Python, multiset laws, and likeness against counts of runs."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kgspark.llm import fingerprints as fp

rnd = random.Random(12)
WORDS = ["".join(rnd.choice("abcdefghéß") for _ in range(rnd.randrange(1, 7))) for _ in range(300)]
DDL = "doc_id long, text string"


def prose(paragraphs, low=6, high=30):
    return "\n".join(" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(low, high))) for _ in range(paragraphs))


def exact(text):
    """The exact lanes in plain Python."""
    lanes = [0] * fp.EXACT
    for p in text.split("\n"):
        h = hashlib.sha512(p.encode()).hexdigest()
        lanes = [(a + int(h[8 * k : 8 * k + 8], 16)) % (1 << 32) for k, a in enumerate(lanes)]
    return lanes


def runs(text):
    out = Counter()
    for p in text.split("\n"):
        w = [x for x in re.split(r"[ \t\x0b\f\r]+", p) if x]
        if w:
            out.update(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    return out


def alike(a, b):
    a, b = runs(a), runs(b)
    return 2 * sum(a[k] * b[k] for k in a) / max(1, sum(v * v for v in a.values()) + sum(v * v for v in b.values()))


def prints(spark, texts):
    got = fp.fingerprints(spark.createDataFrame(list(enumerate(texts)), DDL), ["doc_id"]).collect()
    return [r["fingerprint"] for r in sorted(got)]


def test_multiset_laws(spark):
    p = [prose(1) for _ in range(6)] + ["", " ", "one"]
    texts = ["\n".join(p), "\n".join(reversed(p)), "\n".join(p[:-1]), "\n".join(p[1:] + p[:1]), "\n".join(p + p[:1]), "", None, "\n", "one", "one\n"]
    a, b, c, d, e, empty, null, two, one, one_more = prints(spark, texts)
    assert a == b == d and len({tuple(x) for x in (a, c, e, empty, two, one, one_more)}) == 7 and empty == null
    for text, got in zip(texts, (a, b, c, d, e, empty, null, two, one, one_more)):
        assert got[: fp.EXACT] == exact(text or "") and got[-1] == sum(runs(text or "").values())


def test_insert_and_delete(spark):
    whole, part = prose(7), prose(3)
    a, b, both = prints(spark, [whole, part, whole + "\n" + part])
    row = spark.createDataFrame([(a, b, both)], "a array<long>, b array<long>, c array<long>")
    got = row.select(fp.inserted(F.col("a"), F.col("b")).alias("x"), fp.deleted(F.col("c"), F.col("b")).alias("y"), fp.digest(F.col("a")).alias("da"), fp.digest(F.col("c")).alias("dc")).first()
    assert got["x"] == both and got["y"] == a and got["da"] != got["dc"] and len(got["da"]) == 8 * fp.WIDTH


def table():
    rows = [(i * 7 + 3, prose(rnd.randrange(1, 9))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "abc"), (1003, "a\n\nb\n"), (1004, "\n\n\n\n"), (1005, "é" * 50), (1006, "\U0001f600 x " * 30), (1007, "w " * 30000), (1008, prose(400))]
    rows += [(1009, rows[0][1]), (1010, "\n".join(reversed(rows[0][1].split("\n")))), ((1 << 60) + 1, prose(2))]
    return rows


def expected(rows):
    """doc_id -> (n_chars, edited text, next text) for distinct ids."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        m, ahead = len(t) // 4, rows[(k + 1) % len(rows)][1]
        out[i] = (len(t), t[: len(t) - m] + ahead[:m], ahead)
    return out


def test_edited_texts(spark):
    rows = table()
    df = spark.createDataFrame(rows, DDL).withColumn("key", F.lit("clash")).withColumn("side", F.lit(1)).repartition(6)
    got = {r["doc_id"]: r for r in fp.compared(df).collect()}
    want = expected(rows)
    assert set(got) == set(want) and len(got) == len(rows)
    texts = dict(rows)
    edited = prints(spark, [want[i][1] for i, _ in rows])
    far = []
    for (i, _), e in zip(rows, edited):
        n, new, ahead = want[i]
        r, t = got[i], texts[i] or ""
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["edited_fingerprint"] == e, i  # the same as of the edited text hashed anew
        assert r["fingerprint"][: fp.EXACT] == exact(t)
        for near, other in ((r["near_edited"], new), (r["near_next"], ahead)):
            assert 0 <= near <= 1
            far.append(abs(near - (1 if sorted(t.split("\n")) == sorted(other.split("\n")) else alike(t, other))))
    assert max(far) < 0.45 and sum(far) / len(far) < 0.08
    assert got[3]["fingerprint"] == got[1009]["fingerprint"] == got[1010]["fingerprint"] and got[1000]["fingerprint"] == got[1001]["fingerprint"]


def test_query_columns(spark):
    out = fp.query(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    rows = out.collect()
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.6 and sum(r["near_next"] for r in rows) / len(rows) < 0.1


def test_repeated_ids_and_nulls(spark):
    rows = [(1, "a b c d e f\ng h i j k l"), (1, "a b c d e f\ng h i j k l"), (1, "other text here"), (None, "x y z w"), (None, "x y z w"), (None, None), (2, "second one of these texts")]
    got = fp.compared(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    first = spark.createDataFrame(rows, DDL).where("doc_id = 1").selectExpr("min_by(text, xxhash64(text)) t").first()["t"]
    for i, t, ahead in ((1, rows[0][1], rows[-1][1]), (1, rows[2][1], rows[-1][1]), (2, rows[-1][1], first), (None, "x y z w", first)):
        m = len(t) // 4
        assert by[i, len(t)]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + ahead[:m]).encode()).hexdigest()
        assert by[i, len(t)]["fingerprint"][: fp.EXACT] == exact(t)
    alone = fp.compared(spark.createDataFrame([(None, "x y z w")], DDL)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 0 and alone[0]["edited_sha256"] == hashlib.sha256(b"x y z ").hexdigest()
    assert fp.compared(spark.createDataFrame([], DDL)).collect() == []
    one = fp.compared(spark.createDataFrame([(5, "a b c d e f g h")], DDL)).collect()
    assert one[0]["near_next"] == 1.0
