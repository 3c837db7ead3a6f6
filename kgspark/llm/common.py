"""Loading, recovery points and size-checked broadcasts shared by the operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast while its rows, as counted, stay below this many bytes.
BROADCAST_BYTES = 32 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder every executor can see. Where it is unset, a local session gets a temporary one; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kgspark-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder; all of one application lie in one folder, which clean() deletes."""
    return f"{shared_root(spark)}/kgspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application's operators wrote to the shared folder. For the owner of the session, once results are stored."""
    _delete(spark, f"{shared_root(spark)}/kgspark-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, *, sort_within: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, where = df.sparkSession, shared_dir(df.sparkSession)
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    df.write.option("compression", "zstd").parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._kgspark_folder = where
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the folders of materialized tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._kgspark_folder)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def own(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", *, small_bytes: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Join that broadcasts small only if its counted size is under BROADCAST_BYTES; else both sides shuffle.

    small should be materialized already, as its rows are counted here.
    """
    if small_bytes is None:
        small_bytes = small.count() * row_bytes
    return big.join(F.broadcast(small) if small_bytes <= BROADCAST_BYTES else small.hint("merge"), on, how)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process."""
    module = sys.modules.setdefault("_kgspark_worker_cache", types.ModuleType("_kgspark_worker_cache"))
    return module.__dict__.setdefault(name, {})
