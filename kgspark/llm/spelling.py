"""Groups of spelling variants, by permuterm rotations.

A word marked with a terminator has a rotation for each place in it.  Turned so
that the place of an edit comes last, two words that differ by a replaced
character agree in all but that last character, and the shorter of two words
that differ by an inserted one is, turned to the same place, the whole of what
comes before it.  So every word gives its rotations without their last letter
(each with the letter skipped) and its rotations as they are; sorted, words one
edit apart stand side by side under one prefix.  A scan of the sorted prefixes
gives each member the number of its partners there and the best of them.  A
pair is met once: replacements have one place, and of a run of equal letters
only the first counts as the inserted one.  The members of a prefix differ in
one character, so a prefix has no more of them than there are characters.

A word's form is its most frequent neighbour if that is at least RISE times as
frequent; forms lead strictly upwards, so roots follow by pointer doubling in a
number of rounds that grows with the logarithm of the logarithm of the counts.

Defined cases: null and empty texts have no words; a null doc_id counts as an
empty one; rows that repeat are counted each; words that hold the terminator
U+0000 (none of the letters here) have no neighbours; an empty table gives no
rows; extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import load, materialize

LEAST_LENGTH, LEAST_COUNT, RISE = 5, 3, 2
#: One in SLIP runs of a document loses a letter, by its checksum.
SLIP = 97
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
END = "\x00"


def _counts(least: int, slip: int):
    def run(batches):
        found, held = re.compile(rb"[a-z\xc0-\xff]{%d,}" % max(1, least)).findall, Counter()

        def passed_on():
            out = pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
                # One byte a character: letters of the alphabet keep theirs, and lower() changes A-Z alone.
                for word, k in Counter(found(text.encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += k
                if len(held) > HELD:
                    yield passed_on()
        yield passed_on()

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n of the letter runs of all texts, A-Z in lower case."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counts(least_length, slip), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """prefix, skipped, n: of each word its rotations whole (nothing skipped) and without the last character (skipped; marked where the one before it is the same)."""
    w, size, i = F.col("word"), F.length("word"), F.col("_i")
    turned = words.where(~F.contains(w, F.lit(END))).select("word", "n", F.explode(F.sequence(F.lit(0), 2 * size)).alias("_i"))
    at = F.when(i < size, i).otherwise(i - size)
    skips = (i < size).cast("int")
    prefix = F.concat(F.substring(w, at + 1 + skips, size), F.lit(END), F.substring(w, F.lit(1), at))
    letter = F.substring(w, at + 1, F.lit(1))
    again = (at > 0) & (F.substring(w, at, F.lit(1)) == letter)
    return turned.select(prefix.alias("prefix"), F.when(i >= size, "").when(again, F.concat(letter, F.lit(END))).otherwise(letter).alias("skipped"), "n")


NEAR = pa.schema([("word", pa.string()), ("k", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _group(prefix: str, members: list[tuple[str, int]], out: list) -> None:
    tail, head = prefix.split(END)
    own, others, first = None, [], []
    for skipped, n in members:
        if not skipped:
            own = (-n, head + tail)
            continue
        item = (-n, head + skipped[0] + tail)
        others.append(item)
        if len(skipped) == 1:
            first.append(item)
    if len(others) > 1:
        best, second = sorted(others)[:2]
        for x in others:
            y = second if x is best else best
            out.append((x[1], len(others) - 1, -y[0], y[1]))
    if own and first:
        y = min(first)
        out.append((own[1], len(first), -y[0], y[1]))
        out.extend((x[1], 1, -own[0], own[1]) for x in first)


def _scan(batches):
    """Over rows sorted by prefix: each member's partners under the prefix, as their number and the best."""
    held, members = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        prefixes, out = batch.column("prefix"), []
        starts = np.flatnonzero(np.r_[True, pc.not_equal(prefixes[1:], prefixes[:-1]).to_numpy(zero_copy_only=False)])
        sizes = np.diff(np.r_[starts, batch.num_rows])
        # Prefixes of one member have no partners; the first and the last may go on in other batches.
        some = np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) % (max(1, len(sizes) - 1)) == 0))
        rows = batch.filter(pa.array(np.repeat(np.isin(np.arange(len(sizes)), some), sizes)))
        values, at = list(zip(rows.column("skipped").to_pylist(), rows.column("n").to_pylist())), 0
        for start, size in zip(starts[some].tolist(), sizes[some].tolist()):
            prefix = prefixes[start].as_py()
            if prefix != held:
                if len(members) > 1:
                    _group(held, members, out)
                held, members = prefix, []
            members = members + values[at : at + size]
            at += size
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((), (), (), ()), NEAR.types)], schema=NEAR)
    out = []
    if len(members) > 1:
        _group(held, members, out)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((), (), (), ()), NEAR.types)], schema=NEAR)


def neighbours(words: DataFrame) -> DataFrame:
    """words (word, n; each word once) that have others one edit apart: word, n_near, best (the most frequent; ties: the smallest), best_n."""
    met = rotations(words).repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_scan, "word string, k long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("_m"), "best")).alias("_b")
    return met.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", F.col("_b.best").alias("best"), (-F.col("_b._m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form), which hold no cycle: where following the forms ends."""
    now, moved = materialize(forms.select("word", F.col("form").alias("root"))), True
    while moved:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = materialize(now.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = not further.where("_moved").isEmpty()
        now = further.select("word", "root")
    return now


def variants(words: DataFrame, rise: int = RISE) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of words (word, n)."""
    near = words.join(neighbours(words), "word", "left")
    lifts = F.col("best_n") >= rise * F.col("n")
    known = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(lifts, F.col("best")).alias("form"), F.when(lifts, F.col("best_n")).alias("form_n")))
    top = roots(known.where("form is not null"))
    return known.join(top, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark, sf_dir: str) -> DataFrame:
    words = materialize(vocabulary(load(spark, sf_dir, "documents").select("doc_id", "text")))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
