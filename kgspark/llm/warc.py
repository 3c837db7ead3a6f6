"""WARC archives compressed with Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing: pages are dealt to shards of bounded size; each task writes one
archive file at a time into a folder that all executors see (any store that
pyarrow's filesystems open), under a temporary name and renamed when whole, so
a repeated task leaves the same files.  Of records with equal payloads of at
least min_bytes bytes the one with the largest page_id is a response; the
others are revisits without a payload that refer to it.

Reading: the file list is a Spark table; each task streams its files frame by
frame, loads the dictionary from the skippable frame, and checks version line,
required headers, date, block length, payload digest and the record's end.

Defined cases: a null html has an empty payload; a null url an empty target;
rows with equal page_id and payload are separate records, all but one of them
revisits (of that page_id); a null page_id counts as smaller than any other;
an empty table writes no archive; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import time

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import join_checked, load, materialize, shared_dir, shared_root

#: Skippable frame that holds the dictionary (format of WARC files with Zstandard), and plain frames.
DICTIONARY_MAGIC, FRAME_MAGIC, DICT_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: The dictionary is trained on at most this many pages and characters of each.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 64 << 10
#: Target of payload bytes in an archive.
SHARD_BYTES = 32 << 20
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str, place: str = "") -> str:
    """Of the one response of a digest without a place, which revisits name; of any other record with its place in the archives."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{place and ':' + place}>"


def page_of(record: str):
    page = record[len("<urn:page:") :].split(":")[0]
    return int(page) if page else None


def write_info(date: str, place: str) -> bytes:
    block = b"software: kgspark\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info:{place}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_record(page_id, url: str, payload: bytes, digest: str, refers_to=None, revisit: bool = False, *, date: str = "1970-01-01T00:00:00Z", place: str = "") -> bytes:
    kind, block = ("revisit", b"") if revisit else ("response", payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, place)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
        *([] if not revisit else [f"WARC-Refers-To: {record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcError(ValueError):
    pass


def parse_record(raw: bytes) -> dict:
    """Headers (lower-cased names) and block of one record; raises WarcError unless it is whole and consistent."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise WarcError(f"not a WARC record: {raw[:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "surrogatepass")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if headers.get("warc-type") != "warcinfo":
        missing |= {"warc-payload-digest"} - headers.keys()
    if missing:
        raise WarcError(f"headers missing: {sorted(missing)}")
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", headers["warc-date"]):
        raise WarcError(f"not a date: {headers['warc-date'][:40]}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes where the header says {length}")
    block = rest[:length]
    if headers["warc-type"] == "response" and f"sha1:{base32_sha1(block)}" != headers["warc-payload-digest"]:
        raise WarcError("payload digest differs")
    if headers["warc-type"] == "revisit" and (length or "warc-refers-to" not in headers):
        raise WarcError("a revisit has no block and names its response")
    return headers | {"block": block}


def read_archive(stream):
    """Records of one archive, one frame each."""
    buffer, dictionary, done = b"", None, False

    def more(n: int) -> bool:
        nonlocal buffer, done
        parts, have = [buffer], len(buffer)
        while have < n and not done:
            part = stream.read(1 << 20)
            done = not part
            parts.append(part)
            have += len(part)
        buffer = b"".join(parts)
        return len(buffer) >= n

    first = True
    while more(4):
        (magic,) = struct.unpack_from("<I", buffer)
        if magic == DICTIONARY_MAGIC and first:
            if not more(8) or not more(8 + (size := struct.unpack_from("<I", buffer, 4)[0])):
                raise WarcError("dictionary frame is cut short")
            body, buffer = buffer[8 : 8 + size], buffer[8 + size :]
            if body[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                body = zstd.ZstdDecompressor().decompressobj().decompress(body)
            dictionary = zstd.ZstdCompressionDict(body)
        elif magic == FRAME_MAGIC:
            one = zstd.ZstdDecompressor(dict_data=dictionary).decompressobj()
            parts = [one.decompress(buffer)]
            while not one.eof:
                buffer = stream.read(1 << 20)
                if not buffer:
                    raise WarcError("frame is cut short")
                parts.append(one.decompress(buffer))
            buffer = one.unused_data
            yield parse_record(b"".join(parts))
        elif 0x184D2A50 <= magic <= 0x184D2A5F:
            if not more(8) or not more(8 + (size := struct.unpack_from("<I", buffer, 4)[0])):
                raise WarcError("skippable frame is cut short")
            buffer = buffer[8 + size :]
        else:
            raise WarcError(f"unknown frame {magic:#x}")
        first = False
    if buffer:
        raise WarcError("bytes after the last frame")


def train_dictionary(pages: DataFrame) -> bytes:
    """From a bounded sample of pages. Of too few to train on, the text itself is the dictionary; b'' without any text."""
    sample = [r[0].encode("utf-8", "surrogatepass") for r in pages.where("html is not null").select(F.substring("html", 1, SAMPLE_CHARS)).limit(SAMPLE_PAGES).collect()]
    if sum(map(len, sample)) < 20 * DICTIONARY_BYTES // 10 or len(sample) < 20:
        text = b"".join(sample)[:DICTIONARY_BYTES]
        return text if len(text) >= 8 and text[:4] != struct.pack("<I", DICT_MAGIC) else b""
    return zstd.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Digests with several records -> response_id, the largest page_id, and top_n, the records that have it (materialized)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keys = pages.select(F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"), "page_id").where(F.col("size") >= min_bytes)
    each = keys.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    top = each.groupBy("digest").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "n")).alias("top")).where("n > 1")
    return materialize(top.select("digest", F.col("top.page_id").alias("response_id"), F.col("top.n").alias("top_n")))


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, response_id, is_response (true once for each digest that counts, and for all others)."""
    from pyspark.sql import Window as W

    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    role = roles(pages, min_bytes)
    rows = join_checked(rows, role, "digest", "left", row_bytes=100)
    largest = F.col("top_n").isNull() | F.col("page_id").eqNullSafe(F.col("response_id"))
    if role.where("top_n > 1").isEmpty():
        return rows.withColumn("is_response", largest)
    # The largest page_id itself repeats: among those rows the first by url is the response.
    order = W.partitionBy("digest").orderBy("url")
    tied = rows.where(largest & (F.col("top_n") > 1)).withColumn("is_response", F.row_number().over(order) == 1)
    return rows.where(~(largest & (F.coalesce("top_n", F.lit(1)) > 1))).withColumn("is_response", largest).unionByName(tied)


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns their manifest: path, n_records."""
    where, dictionary = shared_dir(pages.sparkSession), train_dictionary(pages)
    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    return materialize(with_roles(pages, min_bytes).mapInArrow(_writer(where, dictionary, date, min_bytes), "path string, n_records long"))


def _writer(where: str, dictionary: bytes, date: str, min_bytes: int):
    def write(batches):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(where)
        store.create_dir(base, recursive=True)
        dict_data = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstd.ZstdCompressor(level=3, dict_data=dict_data, write_content_size=True)
        part, shard, attempt = TaskContext.get().partitionId(), 0, TaskContext.get().taskAttemptId()  # attempts never write to one name
        out, temporary, size, n = None, "", 0, 0
        names = "path", "n_records"
        for batch in batches:
            for page_id, url, payload, digest, refers, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "response_id", "is_response"))):
                if out is None:
                    temporary, size, n = f"{base}/_{uuid.uuid4().hex}", 0, 0
                    out = store.open_output_stream(temporary, compression=None)
                    if dictionary:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                    out.write(packer.compress(write_info(date, f"{part}.{shard}")))
                place = "" if first and len(payload) >= min_bytes else f"{part}.{shard}.{n}"
                out.write(packer.compress(write_record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers, not first, date=date, place=place)))
                size, n = size + len(payload), n + 1
                if size >= SHARD_BYTES:
                    out.close()
                    store.move(temporary, name := f"{base}/part-{part:05d}-{shard:05d}-{attempt}.warc.zst")
                    out, shard = None, shard + 1
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=names)
        if out is not None:
            out.close()
            store.move(temporary, name := f"{base}/part-{part:05d}-{shard:05d}-{attempt}.warc.zst")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=names)

    where = uri_of(where)
    return write


def uri_of(path: str) -> str:
    """A folder as a URI that pyarrow's filesystems read."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def read_archives(manifest: DataFrame, uri: str = "file:///") -> DataFrame:
    """RECORDS of every archive in the manifest; fails on a damaged record or a wrong record count."""

    def read(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, n_records in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                rows, n = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream):
                        if r["warc-type"] == "warcinfo":
                            continue
                        refers = r.get("warc-refers-to")
                        rows.append((page_of(r["warc-record-id"]), r.get("warc-target-uri"), int(r["warc-payload-length"]), r["warc-payload-digest"][5:], r["warc-type"], refers and page_of(refers)))
                        n += 1
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                if n != n_records:
                    raise WarcError(f"{path} has {n} records, {n_records} were written")
                yield _frame(rows)

    files = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4))
    return files.mapInArrow(read, RECORDS)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def query(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(write_archives(pages), uri_of(shared_root(spark))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda b:
   (((instr('0123456789abcdef', substr(hex, 1 + CAST((i * 5 + b) // 4 AS BIGINT), 1)) - 1) // CAST(2 ** (3 - (i * 5 + b) % 4) AS BIGINT)) % 2) * CAST(2 ** (4 - b) AS BIGINT))) AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM s
"""
