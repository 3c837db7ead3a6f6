"""Sessions, turns and files as tables: import, export, listings, appends and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import ASSISTANT_IDS

TURN = "turn_id long, role string, content string, timestamp string, user_msg_id long, metadata map<string,string>, _corrupt string"


def parse_turns(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON turns; malformed rows and rows without a role or content are left out."""
    got = lines.select(*[c for c in lines.columns if c != col], F.from_json(col, TURN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("t"))
    return got.select(*[c for c in lines.columns if c != col], "t.*").where("_corrupt is null and role is not null and content is not null").drop("_corrupt")


def export_sessions(turns: DataFrame, cap: int = 1000) -> DataFrame:
    """session_id, n, messages (newest cap turns in time order)."""
    rn = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn_id")))
    kept = turns.withColumn("rn", rn).where(F.col("rn") <= cap)
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("ts", "turn_id", "role", "content"))).alias("messages"))


def import_sessions(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """JSON files of messages (session_id, role, content, timestamp); a missing or bad time becomes now."""
    rows = spark.read.schema("session_id string, role string, content string, timestamp string").json(path)
    return clean_import(rows, now)


def clean_import(rows: DataFrame, now: Column) -> DataFrame:
    got = rows.where("role is not null and content is not null and content <> ''")
    return got.withColumn("ts", F.coalesce(F.try_to_timestamp("timestamp"), now)).withColumn("store", F.when(F.col("role") == "user", "user").otherwise("assistant")).drop("timestamp")


def list_sessions(turns: DataFrame, now: Column, limit: int, offset: int = 0, active_s: int = 86400) -> DataFrame:
    last = turns.groupBy("session_id").agg(F.max("ts").alias("last_active"), F.count(F.lit(1)).alias("n_turns"))
    got = last.withColumn("is_active", F.unix_timestamp(now) - F.unix_timestamp("last_active") <= active_s)
    return got.orderBy(F.desc("last_active"), "session_id").offset(offset).limit(limit)


def upsert_sessions(store: DataFrame, new: DataFrame) -> DataFrame:
    """store and new: session_id, title, last_active; given fields overwrite."""
    n = new.select("session_id", F.col("title").alias("_title"), F.col("last_active").alias("_last"))
    return store.join(n, "session_id", "full_outer").select("session_id", F.coalesce("_title", "title").alias("title"), F.coalesce("_last", "last_active").alias("last_active"))


def delete_sessions(ids: DataFrame, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without these sessions, rows removed per table)."""
    left = {k: t.join(ids.select("session_id"), "session_id", "left_anti") for k, t in tables.items()}
    counts = None
    for k, t in tables.items():
        one = t.join(ids.select("session_id"), "session_id", "left_semi").agg(F.count(F.lit(1)).alias("removed")).select(F.lit(k).alias("table"), "removed")
        counts = one if counts is None else counts.unionByName(one)
    return left, counts


def append_turns(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new (session_id, seq, role, content) numbered after the session's existing turns; message ids as in the store."""
    base = existing.groupBy("session_id").agg((F.max("turn_id") + 1).alias("base"))
    rn = F.row_number().over(W.partitionBy("session_id").orderBy("seq")) - 1
    got = new.withColumn("_rn", rn).join(base, "session_id", "left").withColumn("turn_id", F.coalesce("base", F.lit(0)) + F.col("_rn"))
    return got.withColumn("msg_id", F.when(F.col("role") == "user", F.col("turn_id")).otherwise(F.col("turn_id") + ASSISTANT_IDS)).drop("_rn", "base")


EXTENSIONS = ("txt", "md", "csv", "json", "py", "log")


def read_text_files(spark: SparkSession, path: str, largest: int = 50 << 20) -> DataFrame:
    """path, name, extension, size, text of acceptable files; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length").between(1, largest))
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("extension", F.lower(F.element_at(F.split("name", r"\."), -1)))
    return accept_files(named.select("path", "name", "extension", F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")))


def accept_files(files: DataFrame, per_session: int = 100) -> DataFrame:
    """Known extensions, non-empty texts and at most so many files per session (by name)."""
    got = files.where(F.col("extension").isin(*EXTENSIONS) & (F.length(F.trim("text")) > 0))
    if "session_id" not in files.columns:
        return got
    return got.withColumn("_rn", F.row_number().over(W.partitionBy("session_id").orderBy("name"))).where(F.col("_rn") <= per_session).drop("_rn")


def delete_files(ids: DataFrame, files: DataFrame, parents: DataFrame, children: DataFrame) -> dict[str, DataFrame]:
    """The manifest and chunk tables without these files; parent chunks are found by their prefix."""
    off = lambda df: df.join(ids.select("file_id"), "file_id", "left_anti")
    owner = parents.withColumn("file_id", F.split("parent_id", "_parent_")[0])
    return {"files": off(files), "parents": off(owner), "children": off(children)}
