"""Tables as versions of hash partitions, with a manifest for each version.

A version lists, for each partition, the folder that holds it; partitions that
a write does not touch are listed as they were.  So a batch rewrites what its
keys hash to, and earlier versions stay readable, by number or by label, until
vacuum() drops them.  A manifest is created only if its number is still free:
of two writers one fails to create it, and merges again on the other's version.
A manifest also holds the last epoch of each stream, so a repeated epoch is
skipped, whatever other streams wrote in between.

Files of a write that did not end are listed by no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS, TRIES = 64, 20
#: Columns of the number of a row's partition, and of its share of it, while it is written.
PART, SHARE = "_part", "_share"
#: Tasks that write a partition at most.
SHARES = 32


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _path(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        """Numbers of the versions, ascending."""
        folder, fs = self._path(f"{self.root}/{table}/_versions")
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def manifest(self, table: str, version: int) -> dict:
        path, fs = self._path(f"{self.root}/{table}/_versions/{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, table: str, manifest: dict) -> bool:
        """Whether the manifest's number was still free."""
        path, fs = self._path(f"{self.root}/{table}/_versions/{manifest['version']}.json")
        try:
            stream = fs.create(path, False)
        except Py4JJavaError as e:
            if fs.exists(path):
                return False
            raise e
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return True

    def latest(self, table: str) -> dict | None:
        have = self.versions(table)
        return self.manifest(table, have[-1]) if have else None

    def _read(self, manifest: dict, parts: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = sorted(f for p, f in manifest["parts"].items() if parts is None or p in parts)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)

    def read(self, table: str, back: int = 0, *, version: int | None = None, label: str | None = None) -> DataFrame | None:
        """The current rows, those of so many versions earlier, of a numbered version, or of the one before the labelled write; None if there is none."""
        have = self.versions(table)
        if label is not None:
            named = [v for v in have if self.manifest(table, v)["label"] == label]
            version = have[have.index(named[-1]) - 1] if named and have.index(named[-1]) else None
        elif version is None:
            version = have[-1 - back] if len(have) > back else None
        return self._read(self.manifest(table, version)) if version in have else None

    def labelled(self, table: str, label: str) -> DataFrame | None:
        """The rows as the labelled write left them."""
        named = [m for m in (self.manifest(table, v) for v in self.versions(table)) if m["label"] == label]
        return self._read(named[-1]) if named else None

    def _store(self, table: str, df: DataFrame, key: list[str]) -> dict[str, str]:
        """Writes df by partition, each in shares, so a task does not sort a whole partition; the folders by number of partition."""
        where = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
        at = F.xxhash64(*map(F.expr, key))
        placed = df.withColumns({PART: F.pmod(at, F.lit(self.parts)), SHARE: F.pmod(F.xxhash64(at), F.lit(SHARES))})
        placed.repartition(PART, SHARE).drop(SHARE).write.partitionBy(PART).parquet(where)
        folder, fs = self._path(where)
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return {n.removeprefix(f"{PART}="): f"{where}/{n}" for n in names if n.startswith(f"{PART}=")}

    def merge(self, table: str, batch: DataFrame, key: list[str], merged: Callable[[DataFrame, DataFrame], DataFrame], *, schema: T.StructType, stream: str | None = None, epoch: int | None = None, label: str | None = None) -> bool:
        """A version in which the partitions that the batch's keys fall into are merged(their rows, batch); whether it was written.

        key: SQL expressions of what rows are placed by, the same for stored rows and the batch's.
        With stream and epoch an epoch not above the stream's last one is skipped.
        """
        for _ in range(TRIES):
            now = self.latest(table) or {"version": -1, "parts": {}, "epochs": {}, "schema": schema.jsonValue()}
            if stream is not None and now["epochs"].get(stream, -1) >= epoch:
                return False
            hit = {str(r[0]) for r in batch.select(F.pmod(F.xxhash64(*map(F.expr, key)), F.lit(self.parts))).distinct().collect()}  # as many as partitions at most
            made = self._store(table, merged(self._read(now, hit), batch), key)
            if made.keys() - hit:
                raise ValueError("a merge may not move rows to other keys")
            kept = {p: f for p, f in now["parts"].items() if p not in hit}
            epochs = now["epochs"] | ({stream: epoch} if stream is not None else {})
            if self._create(table, {"version": now["version"] + 1, "parts": kept | made, "epochs": epochs, "label": label, "schema": now["schema"]}):
                return True
        raise RuntimeError(f"{table}: other writers were faster {TRIES} times")

    def write(self, table: str, df: DataFrame, key: list[str] | None = None, *, label: str | None = None) -> None:
        """A version that holds df alone."""
        made = self._store(table, df, key or [f"`{df.columns[0]}`"])
        for _ in range(TRIES):
            now = self.latest(table) or {"version": -1, "epochs": {}}
            if self._create(table, {"version": now["version"] + 1, "parts": made, "epochs": now["epochs"], "label": label, "schema": df.schema.jsonValue()}):
                return
        raise RuntimeError(f"{table}: other writers were faster {TRIES} times")

    def touched(self, table: str, version: int) -> set[str]:
        """Partitions in which a version differs from the one before."""
        now, have = self.manifest(table, version)["parts"], self.versions(table)
        before = self.manifest(table, version - 1)["parts"] if version - 1 in have else {}
        return {p for p in now.keys() | before.keys() if now.get(p) != before.get(p)}

    def vacuum(self, table: str, keep: int = 10) -> None:
        """Drops all but the newest versions, and the folders that only the dropped ones list."""
        have = self.versions(table)
        old, new = have[:-keep], have[-keep:]
        used = {f for v in new for f in self.manifest(table, v)["parts"].values()}
        gone = {f for v in old for f in self.manifest(table, v)["parts"].values()} - used
        for where in [f"{self.root}/{table}/_versions/{v}.json" for v in old] + sorted(gone):
            path, fs = self._path(where)
            fs.delete(path, True)
