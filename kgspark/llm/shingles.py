"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed with numpy from Arrow buffers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
CHUNK = 1 << 21
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("hashes", pa.list_(pa.int64()))])
DDL = "doc_id long, text_key long, n long, sig binary, hashes array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table() -> np.ndarray:
    """A 64-bit value per byte, the same for both cases of A-Z, 0 for white space."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    table[65:91] = table[97:123]
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def word_hashes(raw: np.ndarray, edges: np.ndarray, table: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in raw and the index of each word's start. Words end at white space and at edges."""
    blank = space[raw]
    start = ~blank
    start[1:] &= blank[:-1]
    inner = edges[(edges > 0) & (edges < len(raw))]
    start[inner] = ~blank[inner]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))[: len(raw)] if starts[0] == 0 else None
    if place is None:
        lead = starts[0]
        raw, starts0 = raw[lead:], starts - lead
        place = np.arange(len(raw)) - np.repeat(starts0, np.diff(np.append(starts0, len(raw))))
    else:
        starts0 = starts
    power = np.full(int(place.max()) + 1, 0x100000001B3, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    return mix(np.add.reduceat(table[raw] * power[place], starts0)), starts


def shingle_sets(texts: pa.Array, n: int):
    """Per text its sorted distinct shingle hashes as int64 in unsigned order; with fewer than n words the whole sequence is one."""
    table = byte_table()
    space = table == 0
    space[:] = False
    space[[9, 10, 11, 12, 13, 32]] = True
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    big = texts.cast(pa.large_string())
    offsets = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1]
    data = np.frombuffer(big.buffers()[2], np.uint8) if big.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(big):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, len(big))
        at = offsets[i : j + 1] - offsets[i]
        words, starts = word_hashes(data[offsets[i] : offsets[j]], at, table, space)
        cut = np.searchsorted(starts, at)
        run = words.copy()
        for k in range(1, n):
            m = max(0, len(run) - k)  # a chunk may have fewer words than a shingle
            run[:m] = run[:m] * np.uint64(0x9E3779B97F4A7C15) + words[k:]
        run = mix(run)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= n:
                yield np.unique(run[a : b - n + 1])
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = np.uint64((int(h) * 0x9E3779B97F4A7C15 + int(w)) & 0xFFFFFFFFFFFFFFFF)
                yield mix(np.array([h], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        i = j


def hasher(n: int, keep):
    """A function for mapInArrow over (doc_id, text_key, text); keep(size) says how many of the smallest hashes to return."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), n))
            sizes = [len(s) for s in sets]
            parts = [s[: keep(len(s))] for s in sets]
            offsets = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)].astype(np.int32)
            values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_key").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                schema=SCHEMA,
            )

    return run
