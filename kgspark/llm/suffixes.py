"""Removal of byte strings that repeat across documents, with a logarithmic family of sparse suffix arrays.

A suffix array here holds the suffixes that start at anchors: in every window
of MATCH bytes the positions whose GRAM bytes hash lowest.  Equal windows have
equal anchors, so two documents that share MATCH bytes share the first GRAM
bytes of an anchored suffix.  Suffixes are sorted by the hash of those bytes.

Batches of documents come in ascending doc_id.  Each gets its suffix array,
which is merge-scanned against the existing levels for long matches; two levels
of equal size merge into one of double size before the next batch.

A suffix carries a hash of its whole context (all bytes that a window with the
anchor can reach).  A document whose context occurs in an earlier one is covered
there; of each distinct context only the earliest document goes on, and only
where an anchor has several contexts.  Its windows around the anchor are
compared with those of the other contexts by 64-bit hashes.

Defined cases: null text is empty; texts are UTF-8; shorter ones than MATCH are
kept; matches never cross documents and never come from the document itself;
of equal texts all but the one with the smallest doc_id are removed whole;
rows that share a doc_id are never each other's source; rows with a null doc_id
are kept whole and are no source; an empty table gives no rows; extra columns
are left out.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.common import join_checked, load, materialize, release, worker_cache
from kgspark.llm.shingles import mix

MATCH, GRAM = 50, 16
#: Bytes on either side of an anchor's gram that a window containing it can reach.
REACH = MATCH - GRAM
#: Contexts of one anchor that a task compares at once; where there are more, Spark compares their windows by key.
AT_ONCE = 50_000
CHUNK = 1 << 21
BATCHES = 4


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of every width consecutive values."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of GRAM bytes (a power of two)."""
    h, done, power = mix(np.arange(1, 257, dtype=np.uint64))[raw], 1, 0x9E3779B97F4A7C15
    while done < GRAM:
        h = h[:-done] * np.uint64(power) + h[done:]
        power, done = power * power % (1 << 64), 2 * done
    return mix(h)


def anchors(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of the texts that end at edges."""
    if len(raw) < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(raw)
    low = sliding(h, REACH + 1, np.minimum)  # of the window that starts here
    whole = np.ones(len(low), bool)
    for e in edges:  # windows that would cross the end of a text
        whole[max(0, e - MATCH + 1) : min(e, len(low))] = False
    low = np.where(whole, low, 0)
    padded = np.concatenate([np.zeros(REACH, np.uint64), low, np.zeros(REACH, np.uint64)])
    at = np.flatnonzero((sliding(padded, REACH + 1, np.maximum) == h) & (h > 0))
    return at, h[at]


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    held = worker_cache("powers")
    if len(held.get(base, ())) < n:
        p = np.full(1 << max(1, n - 1).bit_length(), base, np.uint64)
        p[0] = 1
        held[base] = np.cumprod(p, dtype=np.uint64)
    return held[base][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the strings raw[start:end], equal for equal strings."""
    n = len(raw) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[raw] * powers(BASE, n - 1), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


ROWS = pa.schema([("fp", pa.int64()), ("ch", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("shape", pa.int32())])
ARRAY = "fp long, ch long, doc long, key long, start int, shape int"


def _later_copies(ch: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which places have a context that a smaller document among them has too."""
    order = np.argsort(ch, kind="stable")
    starts = np.flatnonzero(np.r_[True, ch[order][1:] != ch[order][:-1]])
    least = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.r_[starts, len(order)]))
    out = np.zeros(len(ch), bool)
    out[order] = doc[order] > least
    return out


def _array_rows(batches):
    for batch in batches:
        texts, ids, keys = batch.column("text").cast(pa.large_string()), batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = min(len(texts), max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1))
            edges, raw = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            at, fp = anchors(raw, edges[1:])
            if len(at):
                row = np.searchsorted(edges, at, side="right") - 1
                start, end = np.maximum(edges[row], at - REACH), np.minimum(edges[row + 1], at + GRAM + REACH)
                ch, doc, begin, shape = span_hashes(raw, start, end), ids[i:j][row], start - edges[row], (end - start) * 64 + at - start
                # Copies within a task's slice need no source from elsewhere: they go on under a key of their own, so no common passage makes a large group.
                own = _later_copies(ch, doc)
                fp = np.where(own, mix(doc.astype(np.uint64) * np.uint64(BASE) + begin.astype(np.uint64)), fp)
                shape = np.where(own, start - end, shape)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(doc), pa.array(keys[i:j][row]), pa.array(begin.astype(np.int32)), pa.array(shape.astype(np.int32))], schema=ROWS)
            i = j


def suffix_array(docs: DataFrame) -> DataFrame:
    """ARRAY rows of the anchored suffixes: hashes of the anchor's gram and of its context, where that starts, and its length * 64 + the anchor's offset;
    with minus the length for a context that a smaller document of the same slice of docs has."""
    return docs.select("doc_id", "key", "text").mapInArrow(_array_rows, ARRAY)


class SuffixLevels:
    """Levels of suffix arrays: add() stores a batch's array, scan() matches what is new with all levels, drop() deletes them."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame, bool]] = []  # batches, array, scanned already
        self.stored: list[DataFrame] = []

    def _store(self, array: DataFrame) -> DataFrame:
        self.stored.append(materialize(array, sort_within=["fp"]))
        return self.stored[-1]

    def drop(self) -> None:
        release(*self.stored)
        self.levels, self.stored = [], []

    def add(self, docs: DataFrame, stored: bool = True) -> None:
        """docs: doc_id, key, text, with ids above all earlier ones. An array that is not stored is made anew when scanned."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, x, x_done), (_, y, y_done) = self.levels.pop(), self.levels.pop()
            if not (x_done and y_done):
                raise ValueError("scan() before adding to two levels of equal size")
            merged = self._store(x.where("shape > 0").unionByName(y.where("shape > 0")))
            release(x, y)
            self.stored = [t for t in self.stored if t is not x and t is not y]
            self.levels.append((2 * n, merged, True))
        array = suffix_array(docs)
        self.levels.append((1, self._store(array) if stored else array, False))

    def scan(self, above: int | None = None) -> DataFrame:
        """COVERED rows (materialized) of the arrays not scanned before, whose documents have ids above the given one (None: all are new):
        strings (s, e) whose whole context an earlier document has; where an anchor gets several contexts, the places (s, with fp) of each
        context's first document."""
        run, context = W.partitionBy("fp"), W.partitionBy("fp", "ch")
        new = F.lit(True) if above is None else F.col("doc") > above
        differ = lambda c: F.coalesce(F.min(c).over(run) < F.max(c).over(run), F.lit(False))
        old = lambda c: F.when(~F.col("new"), F.col(c))
        rows = None
        for _, level, done in self.levels:
            part = level.where("shape > 0") if done else level
            rows = part if rows is None else rows.unionByName(part)
        self.levels = [(n, level, True) for n, level, _ in self.levels]
        rows = rows.repartition("fp").withColumns({"least": F.min("doc").over(run), "most": F.max("doc").over(run)})
        met = rows.where((F.col("shape") < 0) | (F.col("least") < F.col("most")) & (F.lit(True) if above is None else F.col("most") > above)).withColumn("new", new)
        # given: an earlier scan returned the places of the old documents
        met = met.select("*", differ("ch").alias("several"), (differ(old("ch")) & differ(old("doc"))).alias("given")).withColumn("least", F.min("doc").over(context))
        found = met.where("new and (shape < 0 or doc > least) or shape > 0 and doc = least and several and (new or not given)")
        covered = (F.col("shape") < 0) | (F.col("doc") > F.col("least"))
        length, offset = F.when(F.col("shape") < 0, -F.col("shape")).otherwise(F.shiftright("shape", 6)), F.col("shape").bitwiseAND(63)
        out = found.select("doc", "key", F.when(covered, F.col("start")).otherwise(F.col("start") + offset).alias("s"), F.when(covered, F.col("start") + length).otherwise(-1).alias("e"), F.when(~covered, F.col("fp")).alias("fp"))
        return materialize(out)


WIDTH = GRAM + 2 * REACH
WINDOWS = "fp long, doc long, key long, pos int, low int, n int, ctx binary"


def _context_bytes(batches):
    for pdf in batches:
        out = []
        for doc, key, text, places in zip(pdf.doc_id, pdf.key, pdf.text, pdf.places):
            raw = text.encode("utf-8", "surrogatepass")
            for x in places:
                p = x["s"]
                if p + GRAM <= len(raw):
                    part = raw[max(0, p - REACH) : p + GRAM + REACH]
                    out.append((x["fp"], doc, key, p, max(0, REACH - p), len(part), part))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])


def window_hashes(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows at offsets 0..REACH of every context, and which of them are whole."""
    m = len(pdf)
    grid = np.zeros((m, WIDTH), np.uint8)
    low, n = pdf["low"].to_numpy(), pdf["n"].to_numpy()
    flat = np.frombuffer(b"".join(pdf["ctx"]), np.uint8)
    row = np.repeat(np.arange(m), n)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + low[row]] = flat
    total = np.zeros((m, WIDTH + 1), np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[grid] * powers(BASE, WIDTH), axis=1, out=total[:, 1:])
    o = np.arange(REACH + 1)
    hashes = mix((total[:, MATCH:] - total[:, : REACH + 1]) * powers(INVERSE, REACH + 1))
    return hashes, (o >= low[:, None]) & (o + MATCH <= (low + n)[:, None])


def _reached(pdf: pd.DataFrame, hit: np.ndarray) -> pd.DataFrame:
    some = hit.any(axis=1)
    first, last = np.argmax(hit, axis=1)[some], REACH - np.argmax(hit[:, ::-1], axis=1)[some]
    at = pdf["pos"].to_numpy()[some] - REACH
    return pd.DataFrame({"doc": pdf["doc"].to_numpy()[some], "key": pdf["key"].to_numpy()[some], "s": at + first, "e": at + last + MATCH})


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole runs sorted by (fp, doc): windows that an earlier document of the run has at the same offset."""
    hashes, whole = window_hashes(pdf)
    fp, doc = pdf["fp"].to_numpy(), pdf["doc"].to_numpy()
    keys = mix(hashes ^ mix(fp.view(np.uint64)[:, None] * np.uint64(BASE) + np.arange(REACH + 1, dtype=np.uint64)))
    at = np.flatnonzero(whole.ravel())
    order = at[np.argsort(keys.ravel()[at], kind="stable")]  # equal windows stay in order of doc
    k, d = keys.ravel()[order], doc[order // (REACH + 1)]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    hit = np.zeros(whole.size, bool)
    hit[order] = d > np.repeat(d[start], np.diff(np.r_[start, len(k)]))
    return _reached(pdf, hit.reshape(whole.shape))


def _compared(batches):
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        fp = pdf["fp"].to_numpy()
        cut = len(fp) - int(np.searchsorted((fp == fp[-1])[::-1] == False, True))  # noqa: E712  where the last run starts
        if cut:
            yield _compare(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
            held = []
        held.append(pdf.iloc[cut:])
        if held[0]["fp"].iloc[0] != fp[-1]:
            yield _compare(pd.concat(held[:-1], ignore_index=True))
            held = held[-1:]
    if held:
        yield _compare(pd.concat(held, ignore_index=True))


def _window_rows(batches):
    for pdf in batches:
        hashes, whole = window_hashes(pdf)
        row, o = np.nonzero(whole)
        yield pd.DataFrame({"fp": pdf["fp"].to_numpy()[row], "window": hashes[row, o].view(np.int64), "doc": pdf["doc"].to_numpy()[row], "key": pdf["key"].to_numpy()[row], "s": pdf["pos"].to_numpy()[row] - REACH + o})


def compared(contexts: DataFrame) -> DataFrame:
    """doc, key, s, e of what agrees with an earlier document's context of the same anchor. contexts: WINDOWS, materialized."""
    crowded = materialize(contexts.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > AT_ONCE).select("fp"))
    few = contexts if crowded.isEmpty() else join_checked(contexts, crowded, "fp", "left_anti", row_bytes=16)
    out = few.repartition("fp").sortWithinPartitions("fp", "doc").mapInPandas(_compared, "doc long, key long, s int, e int")
    if crowded.isEmpty():
        return out
    rows = materialize(join_checked(contexts, crowded, "fp", "left_semi", row_bytes=16).mapInPandas(_window_rows, "fp long, window long, doc long, key long, s int"))
    least = rows.groupBy("fp", "window").agg(F.min("doc").alias("least"))
    return out.unionByName(rows.join(least, ["fp", "window"]).where("least < doc").select("doc", "key", "s", (F.col("s") + MATCH).cast("int").alias("e")))


def _merged(batches):
    for pdf in batches:
        out = []
        for doc, key, spans in zip(pdf.doc, pdf.key, pdf.spans):
            ab = np.array([(s["s"], s["e"]) for s in spans], np.int64)
            ab = ab[np.argsort(ab[:, 0], kind="stable")]
            top = np.maximum.accumulate(ab[:, 1])
            new = np.r_[True, ab[1:, 0] > top[:-1]]
            out.append((doc, key, ab[new, 0], top[np.r_[np.flatnonzero(new)[1:] - 1, len(ab) - 1]]))
        yield pd.DataFrame(out, columns=["doc", "key", "starts", "ends"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key: 0, but a hash of the text where rows share a doc_id."""
    shared = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id", F.lit(True).alias("_shared")))
    if shared.isEmpty():
        return docs.withColumn("key", F.lit(0).cast("long"))
    return join_checked(docs, shared, "doc_id", "left", row_bytes=24).withColumn("key", F.when(F.col("_shared"), F.xxhash64("text")).otherwise(0)).drop("_shared")


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc, key, starts, ends: the maximal byte runs to remove (materialized). docs: doc_id, text (distinct texts only), key."""
    docs = docs.where("doc_id is not null").select("doc_id", "text", "key")
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("q")).first()["q"] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    index, scans = SuffixLevels(), []
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = docs
        part = part if low is None else part.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        last = i == len(bounds) - 2
        index.add(part, stored=not last)
        if i > 0 or last:  # the first batch is scanned with the second
            scans.append(index.scan(bounds[i] if i > 1 else None))
    index.drop()
    found = functools.reduce(DataFrame.unionByName, scans)
    # Nearly every document has places, so these tables grow with the texts: the joins with texts always shuffle.
    firsts = materialize(found.where("fp is not null").groupBy(F.col("doc").alias("doc_id"), "key").agg(F.collect_list(F.struct("s", "fp")).alias("places")))
    bytes_ = materialize(docs.join(firsts.hint("merge"), ["doc_id", "key"]).select("doc_id", "key", "text", "places").mapInPandas(_context_bytes, WINDOWS))
    spans = found.where("fp is null").select("doc", "key", "s", "e").unionByName(compared(bytes_))
    merged = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("s", "e")).alias("spans")).mapInPandas(_merged, "doc long, key long, starts array<long>, ends array<long>")
    return materialize(merged)


@F.pandas_udf(T.BinaryType())
def kept_bytes(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """The bytes outside the runs."""

    def one(t, s, e):
        raw, at, out = t.encode("utf-8", "surrogatepass"), 0, []
        for a, b in zip(s, e):
            out.append(raw[at:a])
            at = b
        out.append(raw[at:])
        return b"".join(out)

    return pd.Series([one(*x) for x in zip(text, starts, ends)], dtype=object)


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, starts, ends (removed byte runs) and kept (remaining bytes) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    same = docs.withColumn("_same", F.unhex(F.md5("text")))
    many = materialize(same.where("doc_id is not null").groupBy("_same").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k"))
    marked = join_checked(same, many, "_same", "left", row_bytes=48).withColumn("_copy", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)))
    marked = keyed(marked.drop("_same", "_first"))
    spans = repeated_spans(marked.where("not _copy"), batches)
    spans = spans.withColumnRenamed("doc", "doc_id").hint("merge")
    n, none = F.octet_length("text").cast("long"), F.array().cast("array<long>")
    out = marked.join(spans, ["doc_id", "key"], "left")
    gone = F.col("_copy") & (n >= MATCH)
    whole = out.where(gone).select("doc_id", n.alias("n_bytes"), F.array(F.lit(0).cast("long")).alias("starts"), F.array(n).alias("ends"), F.lit("").cast("binary").alias("kept"))
    same = out.where(~gone & F.col("starts").isNull()).select("doc_id", n.alias("n_bytes"), none.alias("starts"), none.alias("ends"), F.col("text").cast("binary").alias("kept"))
    part = out.where(~gone & F.col("starts").isNotNull()).select("doc_id", n.alias("n_bytes"), "starts", "ends", kept_bytes("text", "starts", "ends").alias("kept"))
    return whole.unionByName(same).unionByName(part)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
