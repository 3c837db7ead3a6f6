"""Quality rules, near copies, repeated strings and personal data against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgspark.llm import components, jaccard, pii, quality, shingles, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(7)
WORDS = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]


def prose(n, r=rnd):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, k, r=rnd):
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(WORDS) + "x"
    return " ".join(w)


def corpus():
    base = [prose(rnd.randrange(30, 90)) for _ in range(12)]
    texts = list(base)
    texts += [edited(b, rnd.randrange(1, 6)) for b in base for _ in range(4)]
    hot = prose(60)
    texts += [edited(hot, 2) for _ in range(40)] + [hot] * 5
    passage = prose(15)
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(10)]
    texts += ["", None, "one", "one", "Two Words", "two\twords", " \n ", prose(4000), "a" * 5000, "ÄÖ ß " * 20]
    rnd.shuffle(texts)
    return list(enumerate(texts))


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], DOCS).repartition(5).cache()


def test_measures_equal_brute_force():
    cases = [t or "" for _, t in ROWS] + ["a b c d e f g h " * 3, "x\ny\nx\n\n \nx", "#*$%&|<> a", "w " * 9, "é\x85b\x1cc"]
    for t in cases:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        in_repeat = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        n_lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        assert quality.measure_text(t) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(in_repeat), n_lines, len(set(w)))


def measured(spark, rows):
    """rows: lang, source, n_words, word_chars, n_symbols; no repeated line or word."""
    kind = f"lang string, source string, key long, m struct<{', '.join(f'{c}:long' for c in quality.MEASURES.names)}>"
    return spark.createDataFrame([(g, s, i, (n, c, k, 0, 0, 10, int(n * 0.8))) for i, (g, s, n, c, k) in enumerate(rows)], kind)


def test_sketches_merge_and_are_near(spark):
    data = measured(spark, [(f"l{i % 2}", None if i % 3 else "s", 100 + i, 500 + 3 * i, i % 50) for i in range(600)])
    sketch = lambda d: quality.sketches(d, "m", F.col("key"))
    whole = quality.quartiles(sketch(data), "lang", "source").orderBy("lang", "source", "measure").collect()
    parts = sketch(data.where("key % 2 = 0")).unionByName(sketch(data.where("key % 2 = 1")))
    assert whole == quality.quartiles(parts, "lang", "source").orderBy("lang", "source", "measure").collect() and len(whole) == 4 * len(quality.RATIOS)
    exact = sorted((500 + 3 * i) / (100 + i) for i in range(600) if i % 2 == 0 and i % 3 == 0)
    got = next(r for r in whole if r["measure"] == "word_length" and r["lang"] == "l0" and r["source"] == "s")
    for q, b in ((0.25, got["q1"]), (0.75, got["q3"])):
        at = exact[-(-len(exact) * int(4 * q) // 4) - 1]
        assert quality.GAMMA ** (b - 1) < at * (1 + 1e-9) and at <= quality.GAMMA**b * (1 + 1e-9)


def verdicts(spark, data, **k):
    bounds = quality.limits(quality.sketches(data, "m", F.col("key")), **k)
    return {r.key: r.v.kept for r in quality.judge(data, bounds, "m", "v").collect()}


def test_groups_have_their_own_limits(spark):
    """The same measures pass in a group where they are common and fail in one where they are not; without the sketches nothing fails."""
    r = random.Random(4)
    rows = [("plain", "a", n := r.randrange(100, 600), 5 * n + r.randrange(-n // 9, n // 9), 0) for _ in range(300)] + [("tables", "b", n := r.randrange(100, 600), 5 * n + r.randrange(-n // 9, n // 9), n // 2 + r.randrange(40)) for _ in range(300)]
    rows += [("plain", "a", 300, 1500, 160), ("tables", "b", 300, 1500, 160), ("plain", "a", 300, 3000, 0), ("plain", "new", 300, 1500, 160), ("plain", "new", 300, 1500, 0), (None, None, 300, 1500, 0)]
    got = verdicts(spark, measured(spark, rows))
    assert [got[i] for i in range(600, 606)] == [False, True, False, False, True, True]
    assert sum(got[i] for i in range(600)) >= 594
    assert all(verdicts(spark, measured(spark, rows), fence=10_000).values())


def test_near_copies_do_not_reject_the_rest(spark):
    r = random.Random(6)
    rows = [("en", "a", 200, 1000, i % 2) for i in range(500)] + [("en", "a", n := r.randrange(100, 600), 5 * n + r.randrange(-n // 9, n // 9), 0) for _ in range(300)] + [("en", "bc"[i % 2], n := r.randrange(100, 600), 5 * n + r.randrange(-n // 9, n // 9), 0) for i in range(600)]
    got = verdicts(spark, measured(spark, rows))
    assert sum(got[i] for i in range(500, 800)) >= 297


def test_the_querys_sql_gives_its_rows(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = quality.query(spark, sf)
    names = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {names} FROM ({quality.ORACLE})").fetchall())


def test_rules_keep_extra_columns_rows_and_null_groups(spark):
    clean = [(i, prose(40), None if i % 2 else "en", None, 1) for i in range(40)]
    junk = [(100, prose(40).replace(" ", "$$$ "), "en", None, 1), (101, None, None, None, 0), (102, "short", "en", "z", 5), (0, clean[0][1], "en", None, 1)]
    mine = {"measures": F.lit("m"), "kept": F.lit("k"), "base_failed": F.lit("b"), "verdict": F.lit("v"), "lim": F.lit("l"), "text_key": F.lit("t")}
    got = quality.keep_good(spark.createDataFrame(clean + junk, DOCS).withColumns(mine))
    assert got.columns[5:] == list(mine) and {tuple(r)[5:] for r in got.collect()} == {tuple("mkbvlt")}
    assert sorted(r.doc_id for r in got.collect()) == sorted([0, *range(40)])
    assert quality.keep_good(spark.createDataFrame([], DOCS)).count() == 0


def linked(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = bytes(t or "", "utf8").lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("n", "num", "den", "block"), [(4, 85, 100, 256), (5, 8, 10, 6)])
def test_jaccard_groups_equal_brute_force(docs, monkeypatch, n, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs, n, num, den).collect()}
    assert got == linked(ROWS, n, num, den)


@pytest.mark.parametrize("n", [4, 5])
def test_shingles_of_chunks_with_few_words(monkeypatch, n):
    words = [f"w{i}" for i in range(7)]
    for k in range(7):
        (got,) = shingles.shingle_sets(pa.array([" ".join(words[:k])]), n)
        assert len(got) == (k - n + 1 if k >= n else min(k, 1))
    monkeypatch.setattr(shingles, "CHUNK", 1 << 12)
    long, alone = shingles.shingle_sets(pa.array(["a b c d " * 600, "x y"]), n)
    assert len(long) == 4 and alone.tolist() == next(shingles.shingle_sets(pa.array(["X  y"]), n)).tolist()


def test_block_links_find_what_stars_miss(spark, monkeypatch):
    """A chain of texts: neighbours are alike, ends are not; blocks of two."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    r = random.Random(3)
    w = [prose(1, r) + str(i) for i in range(400)]
    rows = [(100 - i, " ".join(w[4 * i : 4 * i + 60])) for i in range(40)]
    df = spark.createDataFrame([(i, t, "e", "s", 1) for i, t in rows], DOCS)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.groups(df, 4, 80, 100).collect()} == linked(rows, 4, 80, 100)


def test_drop_copies_keeps_one_of_each_group(docs, spark):
    twice = docs.unionByName(docs.where("doc_id < 6")).withColumn("cls", F.lit("extra"))
    kept = jaccard.drop_copies(twice)
    want = sorted({c for n, c in linked(ROWS, 5, 8, 10).values() if n} | {i for i, (n, _) in linked(ROWS, 5, 8, 10).items() if not n})
    assert kept.columns == twice.columns and sorted({r.doc_id for r in kept.collect()}) == want
    assert jaccard.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (12, 11), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 11: 10, 12: 10, **{101 + i: 100 for i in range(40)}}


def repeats(rows):
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for q in range(len(gone)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def digest(df):
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", removed, F.size("starts"), F.sha2("kept", 256)).collect())


@pytest.mark.parametrize(("batches", "at_once"), [(1, 50_000), (5, 50_000), (2, 3)])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, batches, at_once):
    monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
    r = random.Random(batches)
    rows = [(i, t) for i, t in ROWS if t is None or len(t) < 2000] + [(900, "abcabc" * 30), (901, "xx" + "abcabc" * 30), (902, "é" * 60), (903, "é" * 40), (904, "q" * 49), (905, "q" * 49), (906, "q" * 50), (907, "q" * 51)]
    rows += [(1000 + i, prose(30, r)[: r.randrange(200)] + ROWS[i % 40][1][:80] + prose(5, r)) for i in range(30) if ROWS[i % 40][1]]
    got = digest(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), batches))
    assert got == repeats(rows)


def test_repeated_strings_of_odd_rows(spark):
    p = prose(30)
    rows = [(5, p), (5, p), (5, "z" + p), (None, p), (6, "start " + p)]
    got = digest(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).fillna(-1, ["doc_id"]))
    assert [(x[0], x[2]) for x in got] == [(-1, 0), (5, 0), (5, 0), (5, 0), (6, len(p))]
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_merge_geometrically(spark):
    index = suffixes.SuffixLevels()
    for i in range(7):
        index.add(spark.createDataFrame([(i, 0, prose(30))], "doc_id long, key long, text string"))
        index.scan(i - 1)
    assert [n for n, _, _ in index.levels] == [4, 2, 1]  # equal ones merge before the next batch
    index.drop()
    assert not index.levels


def base_spans(t):
    def ok(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            s += v - 9 * (v > 9)
        return s % 10 == 0

    only = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(only(m)) <= 19 and ok(only(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(only(m)) <= 15]


def test_base_spans_equal_brute_force(spark):
    r = random.Random(2)
    rows = [None, "", "a@b.c..d@e.f", "x@y.z-foo@q.r a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1111-1", "+1 (017) 555-7713 +1-+49 30 123456 7", "é😀 a.b+c@d-e.f.g. \x01 9.9.9.9", "1" * 5000, "a" * 20000 + "@", "1." * 3000 + "1", "a@" + "b." * 3000 + "c"]
    rows += ["".join(r.choice("aA1.@+- %0(9)41x\n") for _ in range(60)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = F.concat(*[F.col(f"base.{k}") for k in pii.KINDS])
    for i, got in pii.detect(df).select("doc_id", pii.listed(spans)).collect():
        assert got == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(rows[i] or "")), rows[i][:80]


def secrets_corpus():
    r = random.Random(9)
    key = lambda n, a="0123456789abcdef": "".join(r.choice(a) for _ in range(n))
    rows = []
    for i in range(400):
        bare = "AKIA" + key(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        some = [f'token = "{key(40)}"', f"password={key(18)}", bare, f"mail {prose(1, r)}.{i}@host{i % 7}.example.org", f"call +1 (017) 555-{1000 + i}", f"10.{i % 200}.3.{i % 251}", "build2024release7final9", str(r.randrange(10**15, 10**16))]
        rows.append((i, f"{prose(8, r)} {some[i % 8]} {prose(6, r)}"))
    return rows


def test_labels_come_from_evidence_that_is_no_feature(spark):
    rows = secrets_corpus()
    df = spark.createDataFrame(rows + [(None, None), (7, "a" * 5000), (8, "1 " * 4000)], "doc_id long, text string")
    scanned = pii.scan(df)
    model, thresholds, report = pii.fit(scanned)
    assert all(x["recall"] >= 0.8 and (x["precision"] or 0) >= 0.9 for f, x in report.items() if f != "number"), report
    got = {r.doc_id: r.spans for r in pii.detect(df.where("doc_id < 400 and length(text) < 3000")).select("doc_id", pii.listed(F.col("extra")).alias("spans")).collect()}
    share = lambda k: sum(bool(got[i]) for i, _ in rows if i % 8 == k) / 50
    assert min(share(0), share(1), share(2)) >= 0.9
    assert share(6) == 0  # a run of letters and digits that many contexts hold
    assert share(3) == share(4) == share(5) == 0  # base spans are not added again
    # Without evidence for one label nothing is added.
    assert pii.fit(pii.scan(df.where("doc_id = 6"))) is None


def test_labels_of_all_candidates_count(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("number "), (F.col("id") + 10**8).cast("string")).alias("text"))
    got = pii.labelled(pii.scan(df))
    assert got.where("format = 'number'").agg(F.sum("n")).first()[0] == 9000 and got.count() < 100


def test_spelled_out_addresses_are_found(spark):
    rows = secrets_corpus() + [(1000 + i, f"{prose(5)} anna{i}.smith (at) mail{i % 3} (dot) org {prose(4)}") for i in range(5)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("<SECRET>" in got[1000 + i] and "(at)" not in got[1000 + i] for i in range(5))


def test_trees_add_credentials_and_leave_plain_text(spark):
    r = random.Random(9)
    rows = [(i, f'{prose(10)} token = "{r.getrandbits(160):040x}" {prose(3)} 10.{i % 200}.3.4 version 2.{i % 9}.1 and {r.getrandbits(30)}') for i in range(120)] + [(500 + i, prose(30)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit("clash"), "key": F.lit("k"), "spans": F.lit("s")})
    got = pii.redact(df)
    assert got.columns == df.columns
    texts = {x.doc_id: x.text for x in got.collect()}
    held = [texts[i] for i in range(120)]
    assert sum("<SECRET>" in t for t in held) >= 110 and all("<IP>" in t for t in held) and all(re.search(r"version 2\.\d\.1", t) for t in held)
    assert all(texts[i] == t for i, t in rows[120:])
    assert pii.redact(spark.createDataFrame([], "doc_id long, text string")).count() == 0
