"""A corpus in five stages: quality rules, near-copies, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet to the shared folder and reads it as the next one's docs.
All but the last return the columns of docs.  SQL cannot express the stages with
fitted models, so tests hold quality rules, near copies, base spans and pieces
against plain loops, stage by stage, and the mixing against documents whose
domain is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import jaccard, mixing, packing, pii, quality
from kgspark.llm.common import load, materialize

#: Token shares after mixing: low and toxic documents give way, and no document is repeated (rates stay at 1 or below).
TARGETS = {"clean": 1.0, "low": 0.0, "toxic": 0.0}

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 5-word shingles and Jaccard 0.8 stays."""
    return jaccard.drop_copies(docs, n=5, num=8, den=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in angle brackets."""
    return pii.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay by their fitted rate."""
    return mixing.resample(docs, load(spark, sf_dir, "labels"), TARGETS, max_rate=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("PII", personal_data), ("mixing", mix_domains), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
