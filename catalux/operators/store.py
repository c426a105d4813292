"""Keyed tables in buckets, changed together by one commit.

A table is cut into buckets by a hash of its key.  A change names the rows of
the buckets that it touches; only these are written, each commit into folders
of its own (copy on write), and one manifest file names, for every table, the
folder that each bucket is read from.  Creating the manifest is the commit:

* a ten-row batch rewrites at most ten buckets of a table, whatever the
  table's size;
* several tables (points and state) change in the same instant or not at
  all: a job that dies before the manifest exists leaves folders that no
  manifest names;
* a manifest carries the last epoch of each stream, so a replayed
  micro-batch is known and skipped;
* a second writer on the same number fails instead of overwriting.

Buckets replaced ``retain`` commits ago are deleted.  ``buckets`` is fixed when
the store is made (it stands in the manifest): 64 suits a small table, some
thousands a table of terabytes; a bucket should be a few files' worth.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
RETAIN = 3


class Conflict(RuntimeError):
    """Another writer has made this commit."""


class Store:
    def __init__(self, spark: SparkSession, root: str, keys: Mapping[str, Iterable[str]], buckets: int = BUCKETS, retain: int = RETAIN):
        self.spark, self.root, self.retain = spark, root.rstrip("/"), max(retain, 1)
        self.keys = {name: tuple(cols) for name, cols in keys.items()}
        self.buckets = self.manifest().get("buckets", buckets)

    # --- files -------------------------------------------------------------

    def _path(self, path: str):
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hpath, hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commit_file(self, n: int) -> str:
        return f"{self.root}/_commits/{n:012d}.json"

    def _commits(self) -> list[int]:
        folder, fs = self._path(f"{self.root}/_commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, n: int | None = None) -> dict:
        """The manifest of commit ``n`` (default: the newest; before the first: an empty one)."""
        n = max(self._commits(), default=0) if n is None else n
        if not n:
            return {"commit": 0, "tables": {}, "epochs": {}}
        file, fs = self._path(self._commit_file(n))
        stream = fs.open(file)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The commit: the finished file is renamed into place, which fails where the place is taken."""
        final, fs = self._path(self._commit_file(manifest["commit"]))
        draft, _ = self._path(f"{self.root}/_commits/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"commit {manifest['commit']} of {self.root} exists")

    # --- reading -----------------------------------------------------------

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.keys[name]]), F.lit(self.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """Buckets of table ``name`` that the keys of ``rows`` fall into (at most as many as the store has)."""
        return sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect())

    def epoch(self, stream: str) -> int:
        """The last epoch of ``stream`` that is committed; -1 before the first."""
        return self.manifest()["epochs"].get(stream, -1)

    def read(self, name: str, buckets: Iterable[int] | None = None, empty: DataFrame | None = None) -> DataFrame | None:
        """The table, or only some buckets of it; ``empty`` while nothing is committed."""
        table = self.manifest()["tables"].get(name)
        if table is None:
            return empty
        schema = T.StructType.fromJson(table["schema"])
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/{name}/{folder}/bucket={b}" for folder, own in table["folders"].items() for b in own
                 if wanted is None or b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # --- writing -----------------------------------------------------------

    def commit(self, changes: Mapping[str, tuple[DataFrame, Iterable[int]]], stream: str | None = None, epoch: int | None = None) -> int:
        """Replace, for each table, the named buckets by the rows of the frame; all tables in one commit.

        A frame holds every row that its buckets have from now on.  Returns the commit's number.
        """
        old = self.manifest()
        new = {"commit": old["commit"] + 1, "buckets": self.buckets, "tables": dict(old["tables"]), "epochs": dict(old["epochs"]), "replaced": []}
        for name, (rows, buckets) in changes.items():
            buckets = sorted(set(buckets))
            folder = f"c{new['commit']:012d}-{uuid.uuid4().hex[:8]}"
            have = self._write(name, folder, rows, buckets)
            before = new["tables"].get(name, {"folders": {}})["folders"]
            gone = {f: [b for b in own if b in set(buckets)] for f, own in before.items()}
            new["replaced"] += [f"{name}/{f}/bucket={b}" for f, own in gone.items() for b in own]
            folders = {f: [b for b in own if b not in set(buckets)] for f, own in before.items()}
            folders[folder] = have
            new["tables"][name] = {"schema": rows.schema.jsonValue(), "folders": {f: own for f, own in folders.items() if own}}
        if stream is not None:
            new["epochs"][stream] = epoch
        self._publish(new)
        self._clean(new["commit"])
        return new["commit"]

    def _write(self, name: str, folder: str, rows: DataFrame, buckets: list[int]) -> list[int]:
        """Write the rows of ``buckets``; returns those that have any."""
        path = f"{self.root}/{name}/{folder}"
        (rows.withColumn("bucket", self.bucket(name)).where(F.col("bucket").isin(buckets)).repartition("bucket")
         .write.partitionBy("bucket").parquet(path))
        hpath, fs = self._path(path)
        names = [s.getPath().getName() for s in fs.listStatus(hpath)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))

    def _clean(self, n: int) -> None:
        """Forget manifests older than the last ``retain`` and the buckets that only they named."""
        first = n - self.retain + 1
        for k in self._commits():
            if k > first:
                break
            for path in self.manifest(k).get("replaced", []):
                hpath, fs = self._path(f"{self.root}/{path}")
                fs.delete(hpath, True)
            if k < first:
                hpath, fs = self._path(self._commit_file(k))
                fs.delete(hpath, False)
