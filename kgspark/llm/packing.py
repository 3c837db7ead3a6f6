"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Only the histogram of piece lengths (at most `capacity` counts, whatever the
corpus) decides the packing, so the plan is made on the driver from counts and
the pieces find their places by rank: rank r of length l lies in one of that
length's runs, and the run gives sequence and offset.

Plan: pieces above a third of the capacity pair at most twice per bin by
greedy matching, the longest first with the longest that fits; smaller ones,
longest first, go to the bin with the tightest gap that takes them, whole
groups of equal bins at a time.

Tokens are those of the tokenizers library.  Distinct white-space chunks repeat
so often that each worker keeps a bounded cache of their ids; chunks that could
interact with normalisation are encoded by the library one by one, and texts
with control characters that only some of the splitters call white space are
encoded whole.

Defined cases: null text is empty (one piece, the end token); repeated rows are
packed each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import load, materialize, worker_cache

CAPACITY, END = 2048, 0
VOCABULARY = "word_bpe_49k.json"
#: Chunks kept by a worker; the cache starts anew beyond that.
CACHE_CHUNKS = 800_000
#: Characters of text split and looked up at once.
SLICE_CHARS = 2 << 20
#: Marks that the splitter keeps apart from the letters before them (the apostrophe is not one).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkCache:
    """White-space chunk -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.ids: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_words(self, words: list[str]) -> None:
        """Adds words of letters only, in lower case; each is one word for the splitter, so one call takes them all."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            raw, cuts = ids.tobytes(), (4 * np.r_[0, ends]).tolist()
            self.ids.update(zip(words, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        else:
            self.ids.update((w, self.whole(w)) for w in words)

    def learn(self, chunks: list[str]) -> None:
        """Adds the ids of chunks not seen yet: letters and the marks after them apart, all else by the library as it is."""
        ids, tails = self.ids, {"": b""}
        words = [c.rstrip(MARKS) for c in chunks]
        lower = [w.lower() if w.isalpha() and "Σ" not in w else None for w in words]  # the library lower-cases first; a final sigma apart
        if new := list({w for w in lower if w and w not in ids}):
            self.learn_words(new)
        odd = []
        for c, w, low in zip(chunks, words, lower):
            if low is None:
                odd.append(c)
            else:
                tail = c[len(w) :]
                if tail not in tails:  # a run of marks is one word for the splitter
                    tails[tail] = self.whole(tail)
                ids[c] = ids[low] + tails[tail]
        for c, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else ()):
            ids[c] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) > CACHE_CHUNKS:
            self.ids.clear()
        split = [None if any(map(t.count, "\x1c\x1d\x1e\x1f")) else t.split() for t in texts]
        missing = set().union(*(s for s in split if s)).difference(self.ids)
        if missing:
            self.learn(list(missing))
        get = self.ids.__getitem__
        return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every document: its ids and END, cut only where longer than the capacity."""
    path = path or tokenizer_path()

    def run(batches):
        caches = worker_cache("chunks")
        if path not in caches:
            caches[path] = ChunkCache(path)
        cache = caches[path]
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            texts, ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
            sizes = np.cumsum([len(t) for t in texts]) // SLICE_CHARS
            for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                out = []
                for doc_id, raw in zip((ids[i] for i in at), cache.encode([texts[i] for i in at])):
                    raw += end
                    for i, start in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[start : start + 4 * capacity]
                        out.append((doc_id, i, start // 4, len(part) // 4, zlib.crc32(part)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """length -> runs (first rank, number, first sequence, pieces per sequence, offset).

    Rank r of a run lies in sequence first + (r - first rank) // per, at offset + (r - first rank) % per * length.
    """
    left, used, runs = dict(counts), defaultdict(int), defaultdict(list)
    sequences = 0
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> groups [first sequence, number of bins]

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs[length].append((used[length], n, first, per, offset))
        used[length] += n
        left[length] -= n

    def close(gap: int, first: int, n: int) -> None:
        if n and gap:
            gaps[gap].append([first, n])

    large = sorted(x for x in left if 3 * x > capacity and left[x])
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - a) - 1
        while at >= 0 and not left[large[at]]:
            at -= 1
        b = large[at] if at >= 0 else None
        if b is None or b == a and left[a] == 1:
            n = left[a] if b is None else 1
            place(a, n, sequences, 1, 0)
            close(capacity - a, sequences, n)
        elif b == a:
            n = left[a] // 2
            place(a, 2 * n, sequences, 2, 0)
            close(capacity - 2 * a, sequences, n)
        else:
            n = min(left[a], left[b])
            place(a, n, sequences, 1, 0)
            place(b, n, sequences, 1, a)
            close(capacity - a - b, sequences, n)
        sequences += n
    open_gaps = sorted(gaps)
    for s in sorted((x for x in left if left[x]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(open_gaps, s)
            if at == len(open_gaps):  # a new bin
                gap, first, n = capacity, sequences, -(-left[s] // (capacity // s))
                sequences += n
            else:
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            per = gap // s
            full = min(n, left[s] // per)
            for bins, each in ((full, per), (int(full < n and left[s] > full * per), left[s] - full * per)):
                if bins:
                    place(s, bins * each, first, each, capacity - gap)
                    rest = gap - each * s
                    if rest:
                        if rest not in gaps:
                            bisect.insort(open_gaps, rest)
                        gaps[rest].append([first, bins])
                    first, n = first + bins, n - bins
            if n:
                if gap not in gaps:
                    bisect.insort(open_gaps, gap)
                gaps[gap].append([first, n])
    return {k: v for k, v in runs.items() if v}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to materialized PIECES."""
    spark = cut.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(64, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)))
    salted = cut.withColumn("_salt", salt)
    # A length may hold any share of the rows: they are counted and ranked by (length, salt), never by length alone.
    counts = materialize(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")))
    before = counts.withColumn("_before", F.sum("n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    made = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    rows = [(k, [list(map(int, r)) for r in v]) for k, v in made.items()]
    runs = spark.createDataFrame(rows, "length long, runs array<array<long>>")
    rank = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # At most `capacity` lengths, and together no more runs than steps of the plan: bounded whatever the corpus.
    placed = ranked.join(F.broadcast(runs), "length").withColumn("_run", F.filter("runs", lambda r: (F.col("_rank") >= r[0]) & (F.col("_rank") < r[0] + r[1]))[0])
    at = F.col("_rank") - F.col("_run")[0]
    per = F.col("_run")[3]
    return placed.select(*cut.columns, (F.col("_run")[2] + F.floor(at / per)).alias("sequence_id"), (F.col("_run")[4] + at % per * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces(docs, path, capacity)), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
