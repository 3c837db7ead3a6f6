"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from kgspark.llm import spelling

rnd = random.Random(11)


def counted(rows, least=5, times=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= times}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n, rise=2):
    out, form = {}, {}
    for w, k in n.items():
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= rise * k else None
        out[w] = [len(close), form[w], n[form[w]] if form[w] else None]
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out[w].append(r)
    return {w: (n[w], *v) for w, v in out.items()}


def texts():
    base = ["".join(rnd.choice("abcÄéß×") for _ in range(rnd.randrange(4, 9))) for _ in range(40)]

    def typo(w):
        i = rnd.randrange(len(w))
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abÄXY") + w[i:], w[:i] + rnd.choice("abcé") + w[i + 1 :]])

    words = base * 4 + [typo(w) for w in base for _ in range(12)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(120)) + rnd.choice(["", "\n", ".,;", "日本", "\U0001f600"])) for i in range(40)]
    return rows + [(90, None), (91, ""), (92, " -- "), (None, "ccccc aaaaa " * 4), (93, "aaaaa " * 5000), (93, "aaaaa " * 5000), (94, "abcab Abcab ABCAB")]


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    got = spelling.variants(spelling.vocabulary(docs)).collect()
    assert len(got) == len({r["word"] for r in got})
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got}


def test_equals_brute_force(spark):
    rows = texts()
    want = expected(counted(rows))
    assert sum(v[1] > 0 for v in want.values()) > 50 and sum(v[2] is not None for v in want.values()) > 10
    assert run(spark, rows) == want


def test_slips_follow_the_checksum(spark):
    rows = [(i, "letters") for i in range(4000)]
    assert len(counted(rows)) > 2
    assert run(spark, rows) == expected(counted(rows))


def test_no_words(spark):
    assert run(spark, [(1, None), (2, "abc")]) == {}
    assert run(spark, []) == {}


def test_scan_joins_groups_that_batches_cut(spark):
    words = spark.createDataFrame([("aXb", 1), ("aYb", 5), ("aZb", 5), ("ab", 9), ("aab", 2), ("b", 1), ("c", 1), ("x\0y", 3), ("", 2)], "word string, n long")
    rows = spelling.rotations(words).toPandas().sort_values("prefix", kind="stable")
    for size in (1, 2, 3, 7, 1000):
        batches = [pa.RecordBatch.from_pandas(rows.iloc[i : i + size], preserve_index=False) for i in range(0, len(rows), size)]
        out = pa.Table.from_batches(list(spelling._scan(iter(batches)))).to_pylist()
        n, best = Counter(), {}
        for r in out:
            n[r["word"]] += r["k"]
            best[r["word"]] = min(best.get(r["word"], (1, "")), (-r["best_n"], r["best"]))
        have = {w: k for w, k in [("aXb", 1), ("aYb", 5), ("aZb", 5), ("ab", 9), ("aab", 2), ("b", 1), ("c", 1), ("", 2)]}
        want = {w: v for w, v in expected(have).items() if v[1]}
        assert n == {w: v[1] for w, v in want.items()}
        assert {w: b[1] for w, b in best.items()} == {w: min((v for v in have if near(w, v)), key=lambda v: (-have[v], v)) for w in want}


def test_forms_over_a_long_chain(spark):
    chain = ["a" * (5 + i) for i in range(14)]
    words = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(chain)], "word string, n long")
    got = {r["word"]: r["root"] for r in spelling.variants(words).collect()}
    assert got == {w: chain[-1] for w in chain}
