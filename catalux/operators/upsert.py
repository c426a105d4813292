"""Keyed upserts on snapshot tables.

Plain parquet has no MERGE, so an upsert is: rows of the old snapshot whose
key is not in the batch (anti join) UNION the batch (deduplicated on the
key, latest wins).  The result is written to a NEW immutable version folder
under the shared checkpoint folder, which becomes current once its commit
marker exists, so the snapshot being read is never overwritten and a lost
executor only re-runs tasks of an idempotent write.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalux.session import ensure_checkpoint_dir

STATE_KEY = ("source", "pg_id")
FILM_KEY = ("content_type", "tmdb_id")
SCENE_KEY = ("content_type", "content_source", "content_id")


def latest_per_key(batch: DataFrame, keys, order: list[Column] | None = None) -> DataFrame:
    """One row per key: the last one by ``order`` (batch order column), else any deterministic pick."""
    keys = list(keys)
    if order is None:
        from pyspark.sql import types as T
        scalar = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        order = ([F.desc_nulls_last("updated_at")] if "updated_at" in batch.columns else []) + \
            [F.asc(f.name) for f in batch.schema.fields
             if f.name not in keys and f.name != "updated_at" and isinstance(f.dataType, scalar)]
    w = Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)]))
    return batch.withColumn("_u", F.row_number().over(w)).where(F.col("_u") == 1).drop("_u")


def upsert(old: DataFrame, batch: DataFrame, keys, order: list[Column] | None = None) -> DataFrame:
    """Insert or replace by key: old rows not in the batch, plus the batch (one row per key)."""
    keys = list(keys)
    b = latest_per_key(batch, keys, order)
    kept = old.join(b.select(*keys), keys, "left_anti")
    return kept.unionByName(b.select(*old.columns), allowMissingColumns=False)


def state_rows(rows: DataFrame, source: str, now, embedding_version: str) -> DataFrame:
    """S3 batch: (source, pg_id, text_hash, embedding_version, vector_id, nsfw_score, updated_at=now, last_error=NULL)."""
    return rows.select(F.lit(source).alias("source"), F.col("pg_id").cast("string").alias("pg_id"), "text_hash",
                       F.lit(embedding_version).alias("embedding_version"), F.col("vector_id").cast("string").alias("vector_id"),
                       F.coalesce(F.col("nsfw_score").cast("double"), F.lit(0.0)).alias("nsfw_score"),
                       F.to_timestamp(F.lit(now)).alias("updated_at"), F.lit(None).cast("string").alias("last_error"))


def sync_state_upsert(state: DataFrame, rows: DataFrame, source: str, now, embedding_version: str) -> DataFrame:
    """S3: upsert state rows by (source, pg_id); sets hash, version, vector id, score, time, clears the error."""
    return upsert(state, state_rows(rows, source, now, embedding_version), STATE_KEY)


def failure_upsert(state: DataFrame, failures: DataFrame, now, max_len: int = 512) -> DataFrame:
    """Record last_error (first 512 characters) and time by key; other columns kept (NULL for new keys)."""
    f = latest_per_key(failures.select("source", "pg_id", F.substring("error", 1, max_len).alias("_err")),
                       STATE_KEY, [F.asc("_err")])
    j = state.join(f, list(STATE_KEY), "full_outer")
    now_c = F.to_timestamp(F.lit(now))
    hit = F.col("_err").isNotNull()
    out = [F.col(c) for c in STATE_KEY]
    for c in state.columns:
        if c in STATE_KEY:
            continue
        if c == "last_error":
            out.append(F.when(hit, F.col("_err")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, now_c).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def points_upsert(points: DataFrame, batch: DataFrame) -> DataFrame:
    """Add or replace vectors by (source, pg_id)."""
    return upsert(points, batch, STATE_KEY)


def film_enrich_upsert(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert normalised film rows by (content_type, tmdb_id)."""
    return upsert(table, batch, FILM_KEY)


def scene_enrich_upsert(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert scene rows (match method, score, status, error) by the 3-part key."""
    return upsert(table, batch, SCENE_KEY)


# --- versioned snapshots -----------------------------------------------------
#
# A snapshot root holds immutable version folders ``v<zero-padded millis>``.
# The current version is the newest folder whose ``_SUCCESS`` marker exists;
# Spark's commit protocol writes that marker last, so a job that dies while
# writing leaves an incomplete folder that readers never pick.  No pointer
# file has to be swapped, which makes the switch atomic on any filesystem.

def snapshot_root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    hpath, fs = _fs(spark, root)
    if not fs.exists(hpath):
        return None
    jvm = spark.sparkContext._jvm
    done = []
    for st in fs.listStatus(hpath):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            done.append(st.getPath().toString())
    return max(done) if done else None


def mark_done(spark: SparkSession, version: str) -> None:
    """Put the commit marker into a version folder that is written in several steps."""
    hpath, fs = _fs(spark, f"{version}/_SUCCESS")
    fs.create(hpath, True).close()


def next_version(spark: SparkSession, root: str) -> str:
    """A version folder newer than any committed one."""
    last = current_snapshot(spark, root)
    stamp = int(time.time() * 1000)
    if last is not None:
        stamp = max(stamp, int(last.rstrip("/").rsplit("/v", 1)[1]) + 1)
    return f"{root}/v{stamp:015d}"


def read_snapshot(spark: SparkSession, root: str, empty: DataFrame | None = None) -> DataFrame | None:
    path = current_snapshot(spark, root)
    if path is None:
        return empty
    return spark.read.parquet(path)


def write_snapshot(df: DataFrame, root: str, keys=None, partition_by=None, partitions: int | None = None,
                   retain: int | None = None) -> str:
    """Write ``df`` as a new immutable version under ``root`` (it becomes current when committed).

    Rows are hash-partitioned on the key so each key's rows land in one file
    set (later joins on the key read co-located files).  With ``retain``,
    only that many of the newest versions stay.
    """
    version = next_version(df.sparkSession, root)
    out = df
    if keys:
        out = out.repartition(partitions, *keys) if partitions else out.repartition(*keys)
    writer = out.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(version)
    if retain is not None:
        _drop_old_versions(df.sparkSession, root, retain)
    return version


def _drop_old_versions(spark: SparkSession, root: str, retain: int) -> None:
    """Delete version folders older than the newest ``retain`` committed ones (unfinished folders in between too)."""
    hpath, fs = _fs(spark, root)
    jvm = spark.sparkContext._jvm
    found = sorted(st.getPath().toString() for st in fs.listStatus(hpath)
                   if st.isDirectory() and st.getPath().getName().startswith("v"))
    done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    for path in found:
        if len(done) > max(retain, 1) and path < done[-max(retain, 1)]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
