"""Incremental indexing as Structured Streaming.

The reference polls a database in a loop.  Here new source rows arrive as a
stream (landed files, or a table that is polled by key: ``sources.poll``), and
``foreachBatch`` runs the batch sync plan (E11) on each micro-batch.  Points and
state are bucketed tables of one ``Store``: a micro-batch reads and rewrites
only the buckets of its own keys, and both tables change in one commit that
also records the micro-batch's epoch.  So a crash at any point leaves the
tables as they were before the batch, the replayed batch is applied once, and
re-running on unchanged input changes nothing.

Triggers: ``availableNow`` for batch-style runs, ``processingTime`` for a
resident service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from catalux.operators import upsert as U
from catalux.operators.store import BUCKETS, RETAIN, Store
from catalux.plans.sync import SyncParams, apply_batch, embed_pending
from catalux.session import ensure_checkpoint_dir
from catalux.spec import SourceSpec

STATE_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("pg_id", T.StringType()),
    T.StructField("text_hash", T.StringType()), T.StructField("embedding_version", T.StringType()),
    T.StructField("vector_id", T.StringType()), T.StructField("nsfw_score", T.DoubleType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("last_error", T.StringType()),
])


def _trigger(writer, trigger: str | None):
    if trigger in (None, "availableNow"):
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


def _start(frame: DataFrame, process, checkpoint: str, trigger: str | None, mode: str = "append"):
    q = _trigger(frame.writeStream.outputMode(mode).foreachBatch(process).option("checkpointLocation", checkpoint), trigger).start()
    if trigger in (None, "availableNow"):
        q.awaitTermination()
    return q


def _files(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _query_id(spark: SparkSession, otherwise: str) -> str:
    """The running stream's id (it lives in the checkpoint, so a restarted stream keeps it)."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or otherwise


def sync_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
    """Points and state of a sync, both in the buckets of (source, pg_id)."""
    return Store(spark, f"{root}/tables", {"points": U.STATE_KEY, "state": U.STATE_KEY}, buckets, RETAIN)


def sync_batch(store: Store, rows: DataFrame, spec: SourceSpec, params: SyncParams, scene: DataFrame | None = None,
               make_embedder=None, stream: str | None = None, epoch: int | None = None) -> dict:
    """One pass of R1 over ``rows``: pending rows are embedded once, points and state change in one commit.

    Nothing pending: nothing is written.  Returns the figures of the pass.
    """
    keys = rows.select(F.lit(spec.name).alias("source"), F.col(spec.id_field).cast("string").alias("pg_id"))
    near = store.touched("state", keys)
    no_state = store.spark.createDataFrame([], STATE_SCHEMA)
    vec, gated = embed_pending(rows, spec, store.read("state", near, no_state), params, scene=scene, make_embedder=make_embedder)
    # points and state both derive from one embedding pass: compute it once (reliable checkpoint)
    vec = vec.checkpoint(eager=True)
    own = store.touched("state", vec)
    if own:
        points, state = apply_batch(vec, store.read("state", own, no_state), store.read("points", own), spec, params)
        store.commit({"points": (points, own), "state": (state, own)}, stream, epoch)
    return {"source": spec.name, "embedded": vec.count(), "gated_rows": gated.first()["gated_rows"], "buckets": len(own)}


def incremental_sync(spark: SparkSession, source: str | DataFrame, source_schema: T.StructType | None,
                     to_rows: Callable[[DataFrame], DataFrame], spec: SourceSpec, params: SyncParams,
                     root: str, trigger: str | None = "availableNow", scene: DataFrame | None = None,
                     make_embedder=None, max_files_per_trigger: int | None = None, stream: str = "_stream",
                     buckets: int = BUCKETS) -> dict:
    """Stream new source rows through the sync job; returns the store and the place of the run figures.

    ``source``: a path of landed files, or a streaming frame (``sources.poll``).  ``stream`` names the folder under
    ``root`` that remembers what was read; another name reads all again.  ``to_rows`` shapes a micro-batch of raw records
    into source rows (joins with static tables are fine there).
    """
    ensure_checkpoint_dir(spark)
    store, stats_root = sync_store(spark, root, buckets), f"{root}/runs"

    def process(batch: DataFrame, epoch_id: int) -> None:
        me = _query_id(spark, stream)
        if store.epoch(me) >= epoch_id:
            return       # committed before the stream could note it
        figures = sync_batch(store, to_rows(batch), spec, params, scene, make_embedder, me, epoch_id)
        spark.createDataFrame([(epoch_id, figures["embedded"], figures["gated_rows"], figures["buckets"])],
                              "epoch long, embedded long, gated_rows long, buckets long").withColumn(
            "at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(stats_root)

    frame = _files(spark, source, source_schema, max_files_per_trigger) if isinstance(source, str) else source
    q = _start(frame, process, f"{root}/{stream}", trigger)
    return {"store": store, "runs": stats_root, "query": q}


ATTEMPTED = T.StructType([T.StructField("run", T.StringType())])


def first_in_run(refs: DataFrame, key_cols: list[str], run: str, force: bool = False) -> DataFrame:
    """The refs of a stream that ``run`` has not attempted yet: keyed streaming state holds the last run of each ref.

    The state lives in the stream's checkpoint, so it survives a restart within the run; another run starts afresh.
    """
    schema = T.StructType([refs.schema[c] for c in key_cols])

    def attempt(key: tuple, rows: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if force or not state.exists or state.get[0] != run:
            state.update((run,))
            yield pd.DataFrame([key], columns=key_cols)

    return refs.select(*key_cols).groupBy(*key_cols).applyInPandasWithState(
        attempt, schema, ATTEMPTED, "append", GroupStateTimeout.NoTimeout)


def enrichment_loop(spark: SparkSession, refs_path: str, refs_schema: T.StructType,
                    job: Callable[[DataFrame, DataFrame], DataFrame], key_cols: list[str], root: str,
                    empty_table: DataFrame, run: str, force: bool = False, trigger: str | None = "availableNow",
                    max_files_per_trigger: int | None = 1, buckets: int = BUCKETS) -> dict:
    """Each micro-batch of refs is enriched; a ref is attempted once in a run (so one that failed is not tried again
    before the next run) unless forced.

    ``job(refs, table)`` gets the rows of the touched buckets and returns them after the upsert.  ``run`` names the run: a
    restart within it goes on with the same name.
    """
    ensure_checkpoint_dir(spark)
    store = Store(spark, f"{root}/tables", {"table": key_cols}, buckets, RETAIN)

    def process(batch: DataFrame, epoch_id: int) -> None:
        me = _query_id(spark, "refs")
        if store.epoch(me) >= epoch_id:
            return
        refs = batch.checkpoint(eager=True)
        own = store.touched("table", refs)
        if own:
            store.commit({"table": (job(refs, store.read("table", own, empty_table)), own)}, me, epoch_id)

    frame = first_in_run(_files(spark, refs_path, refs_schema, max_files_per_trigger), key_cols, run, force)
    q = _start(frame, process, f"{root}/_stream", trigger)
    return {"store": store, "query": q}


def status_snapshot(spark: SparkSession, state_path: str, state_schema: T.StructType, report: Callable[[DataFrame], DataFrame],
                    root: str, trigger: str | None = "60 seconds", max_files_per_trigger: int | None = None) -> dict:
    """A status report kept fresh by a streaming aggregation over landed state rows.

    The stream keeps, for each source, the rows with a state, the newest of their times and the errors (update mode: only
    sources with new rows leave a micro-batch).  ``report(counts)`` shapes the counts of all sources into the report, which
    is published as a new snapshot.  A key lands once; the files of a key that changes hold its difference (-1 for the row
    that no longer holds) in column ``weight`` where the schema has it.
    """
    ensure_checkpoint_dir(spark)
    store = Store(spark, f"{root}/tables", {"counts": ("source",)}, 1, RETAIN)
    out_root = f"{root}/status"
    one = F.col("weight") if "weight" in state_schema.names else F.lit(1)
    counts = (_files(spark, state_path, state_schema, max_files_per_trigger).groupBy("source")
              .agg(F.sum(one).alias("synced_rows"), F.max("updated_at").alias("last_sync_updated_at"),
                   F.sum(F.when(F.col("last_error").isNotNull(), one).otherwise(F.lit(0))).alias("errors")))

    def process(batch: DataFrame, epoch_id: int) -> None:
        now = batch.checkpoint(eager=True)       # a row a source
        merged = U.upsert(store.read("counts", None, now.limit(0)), now, ["source"])
        me = _query_id(spark, "status")
        if store.epoch(me) < epoch_id:
            store.commit({"counts": (merged, [0])}, me, epoch_id)
        U.write_snapshot(report(store.read("counts")).withColumn("epoch", F.lit(epoch_id)), out_root, retain=RETAIN)

    q = _start(counts, process, f"{root}/_stream", trigger, "update")
    return {"status": out_root, "query": q}
