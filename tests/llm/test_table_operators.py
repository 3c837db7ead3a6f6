"""Mixing, URL filters, chat, packing, archives, neighbours and the pipeline."""

import io
import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from kgspark.llm import ann, chat, mixing, packing, quality, urls, warc
from tests.llm.test_text_operators import DOCS, prose


# chat -------------------------------------------------------------------------------------------

EVENT = "conv_id long, turn long, seq long, kind string, role string, text string"


def replay(events):
    """Folds events in order, one by one."""
    done = defaultdict(list)  # conv -> [(turn, seq, role, text)], streamed: (conv, turn) -> index
    streamed = {}
    for conv, turn, seq, kind, role, text in sorted(events, key=lambda e: e[2]):
        now = done[conv]
        if kind in ("edit", "regenerate"):
            gone = [m for m in now if m[0] == turn or kind == "regenerate" and m[0] > turn]
            for m in gone:
                now.remove(m)
                if streamed.get((conv, m[0])) is m:
                    del streamed[conv, m[0]]
        if kind == "message":
            now.append([turn, seq, role, text])
        elif kind in ("delta", "edit"):
            if (conv, turn) in streamed:
                m = streamed[conv, turn]
                m[2], m[3] = m[2] or role, m[3] + text
            else:
                streamed[conv, turn] = m = [turn, seq, role, text]
                now.append(m)
    return {c: sorted(map(tuple, m)) for c, m in done.items() if m}


def test_fold_equals_replay(spark):
    r = random.Random(5)
    events = [(c, r.randrange(4), 100 * c + i, r.choice(["message", "delta", "delta", "edit", "regenerate"]), r.choice(["user", "assistant"]), r.choice("abc")) for c in range(25) for i in range(12)]
    got = defaultdict(list)
    for x in chat.fold(spark.createDataFrame(events, EVENT).repartition(3)).collect():
        got[x.conv_id].append((x.turn, x.seq, x.role, x.text))
    assert {c: sorted(m) for c, m in got.items()} == replay(events)


def test_the_log_of_a_table_folds_to_the_table(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice([None, "", prose(r.randrange(1, 9), r)])) for c in range(20) for t in range(r.randrange(1, 12))] + [(99, t, "user", f"turn {t}") for t in range(300)]
    rows += [rows[3], rows[3], (None, None, "user", "x"), (5, None, "user", "y"), (None, 2, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    log = chat.events_of(df)
    kinds = Counter(r.kind for r in log.collect())
    assert min(kinds[k] for k in ("message", "delta", "edit", "regenerate")) > 20
    key = lambda x: tuple((v is None, v) for v in x)
    got = [(x.conv_id, x.turn, x.role, x.text) for x in chat.fold(log.repartition(5)).collect()]
    assert sorted(got, key=key) == sorted([(c, t, role or "", text or "") for c, t, role, text in rows], key=key)
    # Without the fold the drafts would be there.
    assert log.where("kind in ('message', 'delta')").count() > len(rows)


def test_chat_reads_back_every_text(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    r = random.Random(6)
    parts = ["<|start|>", "<|end|>", "<|text|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "\n", "é😀", "<", "|", ">", "a"]
    rows = [(c, t, r.choice(["user", "assistant", None, "<s>"]), None if t == 5 else "".join(r.choice(parts) for _ in range(8))) for c in range(12) for t in range(r.randrange(1, 9))]
    rows += [rows[0], (None, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    blocks = chat.render(chat.fold(chat.events_of(df)))
    for f in blocks.collect():
        body = f.formatted.replace("<|start|>", "").replace("<|text|>", "").replace("<|end|>", "")
        assert not any(x in body for x in parts[:8])
    back = chat.join_blocks(chat.read_back(blocks), "plain", "loss_text").collect()
    for x in back:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == x.conv_id))
        assert x.n_turns == len(own) and x.plain == "".join(f"{role}\n{text}\n" for _, role, text in own)
        assert x.loss_text == "".join(text for _, role, text in own if role == "assistant")
    assert chat.format_conversations(spark.createDataFrame([], EVENT)).count() == 0


# URLs -------------------------------------------------------------------------------------------


def test_stated_rules(spark):
    cases = {
        "http://www.Example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "https://blog.example.com/en/": ("blog.example.com", "/en/", "example.com/en/", "block"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"), "a://x.net/fr/?q": ("x.net", "/fr/", "net/fr/", "block"), "http://x.net/de/": ("x.net", "/de/", None, "allow"),
        "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "x://com": ("com", "", None, "allow"), "x://a?b://c/": ("a", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("extra", F.lit(1))
    rules = urls.mine_rules(spark.createDataFrame([], "url string, blocked boolean"))
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()}
    assert got == cases


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        spam = r.random() < 0.3
        host = r.choice(["spam", "casino"]) if spam and r.random() < 0.8 else r.choice(["news", "blog", "wiki"])
        rows.append((f"http://{host}.example.{r.choice(['org', 'io'])}/{r.choice(['a', 'b'])}/{i % 40}", spam))
    got = {tuple(x.tokens): x.confidence for x in urls.mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"), 0.03, 0.9, 6.0).collect()}
    one = defaultdict(bool)
    for u, b in rows:
        one[u] |= b
    toks = {u: frozenset(x for x in t) for u, t in spark.createDataFrame([(u,) for u in one], "url string").select("url", urls.tokens_of(F.col("url"))).collect()}
    from itertools import combinations

    base = sum(one.values()) / len(one)
    floor, count, block = max(urls.least_count(base, 6.0), 0.03 * len(one)), Counter(), Counter()
    for u, b in one.items():
        for k in range(1, len(toks[u]) + 1):
            for c in combinations(sorted(toks[u]), k):
                count[c] += 1
                block[c] += b
    apart = lambda p: p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
    rules = {c: block[c] / count[c] for c in count if block[c] >= floor and block[c] / count[c] >= 0.9 and count[c] * apart(block[c] / count[c]) >= 6.0}
    want = {c: p for c, p in rules.items() if not any(set(d) < set(c) and q >= p for d, q in rules.items())}
    assert got.keys() == want.keys() and want and all(got[c] == pytest.approx(want[c]) for c in want)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(one)], "page_id long, url string")
    verdict = {r.url: r.verdict for r in urls.judge_urls(pages, urls.mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"), 0.03, 0.9, 6.0)).collect()}
    assert all((verdict[u] == "block") == any(set(c) <= toks[u] for c in want) for u in one)


def crawl(spark, tied):
    """Pages of labelled documents. tied: those of two hosts hold bad documents."""
    r = random.Random(12)
    docs, labels, pages = [], [], []
    for i in range(400):
        bad = i % 5 == 0
        line = prose(20, r)
        docs.append((i, f"{line}\n{prose(3, r)} & <b>", "en", "s", 1))
        labels.append((i, int(not bad), 0))
        host = ("pills" if i % 10 else "bets") if (bad if tied else r.random() < 0.2) else r.choice(["news", "wiki", "blog"])
        pages.append((1000 + i, f"http://{host}.example.org/en/{i}", f"<html><style>p {{margin: 0}}</style><script>var x = '</p>';</script><p>{line}</p><p>{prose(15, r)}</p></html>"))
    pages += [(1, None, None), (2, "http://pills.example.org/x", None), (3, "http://pills.example.com/x", "<p>"), (4, "http://new.example.org/", "a" * 200_000), (5, "http://a.example.org/" + "x/" * 5000, "")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame(pages, "page_id long, url string, html string")


@pytest.mark.parametrize("tied", [True, False])
def test_rules_come_from_content_and_not_from_chance(spark, tied):
    docs, labels, pages = crawl(spark, tied)
    known = urls.labelled_urls(pages, docs, labels)
    assert {r.url: r.blocked for r in known.collect()} == {r.url: (r.page_id - 1000) % 5 == 0 for r in pages.where("page_id >= 1000").collect()}
    rules = urls.mine_rules(known)
    assert {tuple(r.tokens) for r in rules.collect()} == ({("h2:pills",), ("h2:bets",)} if tied else set())
    clash = {c: F.lit(c) for c in ("matched", "confidence", "best", "rule_url", "tokens")}
    got = urls.judge_urls(pages.drop("html").withColumns(clash), rules)
    assert {tuple(r[c] for c in clash) for r in got.collect()} == {tuple(clash)} and got.count() == pages.count()
    verdict = {r.page_id: r.verdict for r in got.collect()}
    assert [verdict[i] for i in (1, 2, 3, 4, 5)] == ["allow", "block" if tied else "allow", "allow", "allow", "allow"]
    assert urls.mine_rules(known.where("false")).count() == 0 and urls.mine_rules(known.where("blocked")).count() == 0


# packing ----------------------------------------------------------------------------------------


def test_plans_are_gapless_and_near_the_bound():
    r = random.Random(3)
    for _ in range(400):
        cap = r.choice([10, 30, 100])
        lengths = Counter(r.randint(1, cap) for _ in range(r.randrange(80)))
        bins = defaultdict(list)
        for length, runs in packing.plan(dict(lengths), cap).items():
            assert sum(n for _, n, *_ in runs) == lengths[length]
            assert sorted(f for f, *_ in runs) == [sum(n for _, n, *_ in runs[:i]) for i in range(len(runs))]
            for _, n, first, per, offset in runs:
                for k in range(n):
                    bins[first + k // per].append((offset + k % per * length, length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= cap
        total = sum(k * v for k, v in lengths.items())
        assert len(bins) <= max(-(-total // cap), sum(v for k, v in lengths.items() if 2 * k > cap)) * 1.25 + 1


def test_packed_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    rows = [(1, None), (2, ""), (3, prose(3000)), (4, "It's <|endoftext|> Ünïcode\u0301 ΑΣ don't. 12 a\x1cb Å \u00a0x,%%% ..."), (5, "Hello, World."), (5, "Hello, World."), (6, "x" * 3000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")), capacity=256).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, p // 256, p, len(ids[p : p + 256]), zlib.crc32(np.array(ids[p : p + 256], "<u4").tobytes())) for p in range(0, len(ids), 256)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for b in places.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 256
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# archives ---------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    from kgspark.llm.common import shared_root

    r = random.Random(8)
    html = ["", None, "same", "é" * 50, *[prose(200, r) for _ in range(60)]]
    rows = [(i, f"http://x/{i}\r\n", html[i % len(html)]) for i in range(150)] + [(149, "http://x/tie", html[149 % len(html)]), (None, None, "nobody")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = warc.read_archives(warc.write_archives(pages), warc.uri_of(shared_root(spark))).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    by_payload = defaultdict(list)
    texts = {warc.base32_sha1((h or "").encode()): h or "" for h in html + ["nobody"]}
    for x in got:
        payload = texts[x.payload_digest]
        assert x.payload_bytes == len(payload.encode())
        by_payload[payload].append(x)
        assert x.refers_to == (top[payload] if x.record_type == "revisit" else None)
    for payload, records in by_payload.items():
        first = [x for x in records if x.record_type == "response"]
        assert len(first) == 1 and (first[0].page_id if first[0].page_id is not None else -1) == top[payload]
    ids, kinds = [], Counter()
    for x in warc.write_archives(pages).collect():
        with open(x.path, "rb") as f:
            assert warc.struct.unpack("<I", f.read(4)) == (warc.DICTIONARY_MAGIC,)
            f.seek(0)
            found = list(warc.read_archive(f))
        ids += [r["warc-record-id"] for r in found]
        kinds.update(r["warc-type"] for r in found)
        assert found[0]["warc-type"] == "warcinfo"
    assert len(ids) == len(set(ids)) and kinds["warcinfo"] >= 1
    assert warc.read_archives(warc.write_archives(pages.where("false")), warc.uri_of(shared_root(spark))).count() == 0


def archive(*records, dictionary=b""):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(dict_data=d).compress
    head = warc.struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    return head + b"".join(map(pack, records))


def test_damaged_archives_are_refused():
    good = warc.write_record(1, "http://x", b"body", warc.base32_sha1(b"body"))
    words = [prose(50).encode() for _ in range(300)]
    trained = zstandard.train_dictionary(4096, words).as_bytes()
    assert [r["block"] for r in warc.read_archive(io.BytesIO(archive(good, good, dictionary=trained)))] == [b"body"] * 2
    packed = zstandard.ZstdCompressor().compress(trained)
    raw = warc.struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + archive(good, dictionary=trained)[8 + len(trained) :]
    assert len(list(warc.read_archive(io.BytesIO(raw)))) == 1
    bad = [archive(good)[:-3], archive(good.replace(b"body", b"bodi")), archive(good.replace(b"WARC/1.1", b"HTTP/1.1")), archive(good.replace(b"Content-Length: 4", b"Content-Length: 5")), archive(good[:-2]), archive(good) + b"junk", archive(good.replace(b"WARC-Type", b"WARC-Kind")), archive(good.replace(b"WARC-Date", b"WARC-When")), archive(good.replace(b"1970-01-01T", b"1970-01-01 "))]
    for b in bad:
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(b)))


# neighbours -------------------------------------------------------------------------------------


@pytest.mark.parametrize("scaled", [False, True])
def test_neighbours(spark, monkeypatch, scaled):
    monkeypatch.setattr(ann, "BLOCK", 64)
    g = np.random.default_rng(4)
    x = g.normal(size=(900, 20)).astype(np.float32)
    x[300:600] = x[299]  # a third of the rows are one vector
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= g.uniform(0.5, 2, (900, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 20), (2002, [float("nan")] * 20), (2003, [None] * 20), (2020, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    d, hits = x.astype(np.float64), 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -np.round(s, 9)))[:20]
        hits += len(set(want) & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(sc == pytest.approx(s[v], abs=1e-12) for _, v, sc in found)
        assert [(-sc, v) for _, v, sc in found] == sorted((-sc, v) for _, v, sc in found)
    assert hits >= 0.9 * 20 * len(got)
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 4
    assert ann.nearest(df.where("false"), df).count() == 0


def test_copies_of_a_row_have_one_place(spark):
    g = np.random.default_rng(3)
    x = np.eye(16)[0] + 0.01 * g.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    near = int(np.argsort(-(x @ x[0]))[0]) or int(np.argsort(-(x @ x[0]))[1])
    vectors = spark.createDataFrame(rows + [rows[near]] * 29, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(vectors, vectors.where("vec_id = 0"), 20, tables=1, probe=1 << 30).orderBy("rank").collect()
    want = sorted(range(1, 60), key=lambda i: -(x[0] * x[i]).sum())[:20]
    assert [r.vec_id for r in got] == want


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(ann.hadamard(ann.hadamard(x)), x)


# mixing -----------------------------------------------------------------------------------------


def labelled(spark, n=600):
    r = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        kind = i % 6
        text = prose(40, r)
        if kind == 0:
            text = text.replace(" ", "$$$ ")
        if kind == 1:
            text = text.replace(" ", " stupid idiot ", 2)
        docs.append((i, text, "en", "s", len(text)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(kind != 0), int(kind == 1)))
    docs += [(n, None, None, None, 0), (n + 1, "", "en", "s", 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_rates_meet_the_targets(spark):
    docs, labels = labelled(spark)
    got = mixing.mix(docs, labels).toPandas()
    p = np.stack(got.m.map(lambda m: m["p"]))
    n = got.m.map(lambda m: m["n_tokens"]).to_numpy()
    kind = got.doc_id.to_numpy() % 6
    want = np.where(kind == 0, 1, np.where(kind == 1, 2, 0))
    body = got.doc_id < 600
    assert (p.argmax(axis=1) == want)[body].mean() > 0.97
    share = (got.rate.to_numpy()[:, None] * n[:, None] * p).sum(axis=0) / n.sum()
    assert np.allclose(share, [mixing.TARGETS[d] for d in mixing.DOMAINS], rtol=0.02, atol=0)
    assert (got.rate >= 0).all() and np.isfinite(got.rate).all()
    assert abs(got.copies.sum() / got.rate.sum() - 1) < 0.1


def test_steps_reach_the_least_squares_solution(spark):
    """Against a plain projected gradient on the same profiles, run long."""
    g = np.random.default_rng(1)
    p = g.dirichlet([0.3, 0.3, 0.3], 30)
    tokens = g.integers(1, 100, 30).astype(float)
    table = spark.createDataFrame([(a.tolist(), float(t)) for a, t in zip(p, tokens)], "p array<double>, tokens double")
    want = np.array([0.7, 0.25, 0.05]) * tokens.sum()
    steps = mixing.fit_rates(table, {"clean": 0.7, "low": 0.25, "toxic": 0.05}, steps=40)
    rate = np.array([r[0] for r in table.select(mixing.rate(F.col("p"), mixing.as_column(steps))).collect()])
    r, have = np.ones(30), (tokens[:, None] * p).sum(axis=0)
    for _ in range(20000):
        r = np.maximum(0, r - p @ ((((r * tokens)[:, None] * p).sum(axis=0) - want) / have))
    loss = lambda x: ((((x * tokens)[:, None] * p).sum(axis=0) - want) ** 2 / have).sum()
    assert loss(rate) <= loss(r) + 0.02 * loss(np.ones(30)) and (rate >= 0).all()


@pytest.mark.parametrize("apart", [2.0, 1.5])
def test_shares_of_soft_posteriors_are_within_two_percent_of_each_target(spark, apart):
    g = np.random.default_rng(5)
    kind, z = g.choice(3, 4000, p=[0.6, 0.3, 0.1]), g.normal(size=(4000, 3))
    z[np.arange(4000), kind] += apart
    p = np.exp(apart * z)
    p /= p.sum(axis=1, keepdims=True)
    n = g.integers(1, 400, 4000)
    scored = spark.createDataFrame([((a.tolist(), int(t)),) for a, t in zip(p, n)], "m struct<p: array<double>, n_tokens: long>").repartition(4)
    own = scored.select(F.col("m.p").alias("p"), F.col("m.n_tokens").cast("double").alias("tokens"))
    steps = mixing.fit_rates(own, mixing.TARGETS, start=mixing.fit_rates(mixing.profiles(scored), mixing.TARGETS))
    shares = mixing.expected_shares(scored.withColumn("rate", mixing.rate(F.col("m.p"), mixing.as_column(steps))))
    assert shares == pytest.approx(mixing.TARGETS, rel=0.02)


def test_resampling_keeps_clean_documents_and_columns(spark):
    docs, labels = labelled(spark)
    clash = {c: F.lit(c) for c in ("rate", "copies", "m", "copy", "own", "none")}
    kept = mixing.resample(docs.withColumns(clash), labels, {"clean": 1.0, "low": 0.0, "toxic": 0.0}, max_rate=1.0)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == [*docs.columns, *clash] and {tuple(r[c] for c in clash) for r in kept.collect()} == {tuple(clash)} and len(ids) == len(set(ids))
    assert {i for i in range(600) if i % 6 > 1} <= set(ids) and not {i for i in range(600) if i % 6 == 1} & set(ids)
    assert mixing.resample(docs.where("false"), labels).count() == 0
    assert mixing.resample(docs, labels.where("false"), {"clean": 1.0, "low": 0.0, "toxic": 0.0}, max_rate=1.0).count() == 602


# pipeline and entry -------------------------------------------------------------------------------


def docs_of(df):
    return df.select("doc_id", "text").collect()


def good_by_hand(rows):
    """doc_ids that pass the quality rules, by plain loops over all rows."""
    step = lambda v: math.ceil(math.log(v) / math.log(quality.GAMMA))
    measured, kept = {}, set()
    for r in rows:
        m = dict(zip(quality.MEASURES.names, quality.measure_text(r.text)))
        if m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"]:
            at = (step((m["n_symbols"] + 1) / (m["word_chars"] + 100)), step((m["n_dup_lines"] + 1) / (m["n_lines"] + 10)), step(m["word_chars"] / m["n_words"]), step(m["n_distinct"] / m["n_words"]))
            measured[r.doc_id] = (r.lang, r.source, r.text, at)
    q = lambda v, p: v[max(0, math.ceil(len(v) * p) - 1)]

    def bounds(k):
        def quartiles(keep):
            v = sorted(m[3][k] for m in {m[:3]: m for m in measured.values() if keep(m)}.values())
            return len(v), q(v, 0.25), q(v, 0.75)

        used = {}
        for group in {m[:2] for m in measured.values()}:
            own, same, every = quartiles(lambda m: m[:2] == group), quartiles(lambda m: m[0] == group[0]), quartiles(lambda m: True)  # noqa: B023
            used[group] = (own if own[0] >= 100 else same if same[0] >= 100 else every)[1:]
        half = math.ceil(q(sorted(b - a for a, b in used.values()), 0.5) / 2)
        return {g: (a - 3 * max(b - a, half), b + 3 * max(b - a, half)) for g, (a, b) in used.items()}

    limits = [bounds(k) for k in range(4)]
    for i, (lang, source, _, at) in measured.items():
        fine = True
        for k, (low, high) in enumerate([(False, True), (False, True), (True, True), (True, False)]):
            fine &= not (low and at[k] < limits[k][lang, source][0]) and not (high and at[k] > limits[k][lang, source][1])
        kept |= {i} if fine else set()
    return kept


def test_pipeline_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline
    from tests.llm.test_text_operators import base_spans, linked

    docs, labels = labelled(spark, 240)
    near = docs.where("doc_id % 40 = 2").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" tail")).alias("text"), "lang", "source", "n_chars")
    docs.unionByName(near).withColumn("text", F.when(F.col("doc_id") % 50 == 4, F.concat("text", F.lit(" mail me at ab@cd.ef"))).otherwise(F.col("text"))).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in pipeline.STAGES:
        before = now
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append((before, now))
    for before, after in seen[:-1]:
        assert after.columns == before.columns
    ids = [{r.doc_id for r in after.select("doc_id").collect()} for _, after in seen]
    assert ids[0] == good_by_hand(seen[0][0].collect())
    groups = linked([(r.doc_id, r.text) for r in seen[1][0].collect()], 5, 8, 10)
    assert ids[1] == {c for _, c in groups.values()} and ids[2] == ids[1]
    spans = {r.doc_id: base_spans(r.text or "") for r in seen[2][0].collect()}
    for r in seen[2][1].collect():
        before = next(x.text for x in docs_of(seen[2][0]) if x.doc_id == r.doc_id)
        for kind, a, b in sorted(spans[r.doc_id], key=lambda s: -s[1]):
            before = before[:a] + f"<{kind.upper()}>" + before[b:]
        assert r.text == before
    rows = {r.doc_id: r.text for r in seen[4][0].collect()}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((i, p // 2048) for i, text in rows.items() for p in range(0, len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1, 2048))
    assert Counter((r.doc_id, r.piece) for r in seen[4][1].collect()) == want
    assert not any("ab@cd.ef" in r.text for r in seen[2][1].collect()) and any("<EMAIL>" in r.text for r in seen[2][1].collect())
    assert {i for i in ids[2] if i < 240 and i % 6 > 1} <= ids[3] and ids[4] == ids[3]
    ran = pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, ran.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, now.select("doc_id", "piece", "ids_crc32").collect()))
    assert pipeline.ORACLE_SQL is None


def test_entry_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['kgspark.llm'] = None\nimport __spark_entry__ as e; assert e.llm is None and e.queries() and not any(k.startswith(('op', 'pipeline')) for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
