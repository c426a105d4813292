"""Registered queries: streaming and incremental operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalux.operators import upsert as U
from catalux.operators.embed import hash_vectors
from catalux.plans.sync import SyncParams
from catalux.registry import duck as D
from catalux.registry import register
from catalux.registry.common import FILM_SOURCE, ITEMS_SYNC, NOW, film_enrich, items_content
from catalux.session import shared_path, stored
from catalux.spec import SourceSpec
from catalux.streaming import incremental as INC

SYNC_SPEC = SourceSpec(name="items", id_field="id", text_field="text", updated_at_field="updated_at",
                       extra_fields=("lang", "size", "title"), size_field="size")
DIM = 64


def _to_items(events):
    """Micro-batch of documents -> item rows (the items shape, with their times from the static events)."""
    def to_rows(batch):
        title = F.concat(F.substring(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 1, 40),
                         F.element_at(F.array(F.lit(".1080p.x264-GRP"), F.lit(" ABC-123"), F.lit(" HD 720"),
                                              F.lit(" 标题 中文字幕"), F.lit(" [web-dl]"), F.lit("")),
                                      (F.col("doc_id") % 6 + 1).cast("int")))
        j = batch.join(events.select("event_id", "ts"), F.col("event_id") == F.col("doc_id"))
        return j.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("pg_id"), "text", "lang",
                        "source", F.col("n_chars").alias("size"), F.col("ts").alias("updated_at"), title.alias("title"))
    return to_rows


def _run_sync(fx, make_embedder=None):
    events = fx.table("events")
    docs = fx.table("documents")
    root = shared_path(fx.spark, "stream-sync")
    out = INC.incremental_sync(fx.spark, f"{fx.root.rstrip('/')}/documents*.parquet", docs.schema, _to_items(events),
                               SYNC_SPEC, SyncParams(now=NOW, dim=DIM), root, make_embedder=make_embedder, buckets=8)
    return out["store"].read("state"), out


def _embed_sql() -> str:
    n = D.normalize_title("i.text")
    return f"(CASE WHEN {n} <> '' THEN {n} ELSE coalesce(i.text, '') END)"


@register("incremental_sync", f"""
SELECT 'items' AS source, i.pg_id, md5(i.text) AS text_hash, 'v1' AS embedding_version,
       {D.point_id("'items'", 'i.pg_id')} AS vector_id, round({D.safety_score(_embed_sql())}, 6) AS nsfw_score,
       CAST(NULL AS VARCHAR) AS last_error
FROM items i""", ("items",))
def incremental_sync(fx):
    """Documents stream (new files only) -> sync job per micro-batch -> one commit of points and state."""
    state, _ = _run_sync(fx)
    return state.select("source", "pg_id", "text_hash", "embedding_version", "vector_id",
                        F.round("nsfw_score", 6).alias("nsfw_score"), "last_error")


def flaky_embedder():
    """A model stand-in that fails on texts containing 'qu' (for the failure-isolation check)."""
    def embed(texts):
        if any("qu" in t for t in texts):
            raise ValueError("model failure")
        sha = [__import__("hashlib").sha1(t.encode("utf-8")).hexdigest() for t in texts]
        return hash_vectors(sha, DIM).astype(np.float32)
    return embed


@register("failure_isolation", f"""
SELECT i.pg_id, strpos(substring({_embed_sql()}, 1, 256), 'qu') > 0 AS failed FROM items i""", ("items",))
def failure_isolation(fx):
    """R2: rows whose embedding fails are recorded (last_error) while the others are indexed."""
    state, _ = _run_sync(fx, make_embedder=flaky_embedder)
    return state.select("pg_id", F.col("last_error").isNotNull().alias("failed"))


@register("enrichment_loop", """
SELECT 'doc' AS content_type, source AS content_source, pg_id AS content_id, 'success' AS status FROM items""", ("items",))
def enrichment_loop(fx):
    """Refs landed in two files, enriched one micro-batch at a time; each ref attempted once in the run."""
    from catalux.plans.enrichment import scene_enrichment_job
    spark = fx.spark
    refs = fx["items"].select(F.lit("doc").alias("content_type"), F.col("source").alias("content_source"),
                              F.col("pg_id").alias("content_id"), "title")
    land = shared_path(spark, "refs")
    refs.repartition(2, "content_id").write.parquet(land)
    landed = spark.read.schema(refs.schema).parquet(land)    # narrow: the texts that the titles come from are not read again
    pay = fx["payload"].select(F.col("id").cast("string").alias("content_id"), "scene_json")
    cols = ["tpdb_id", "title", "aka", "actors", "tags", "studio", "site", "release_date", "plot", "poster_url",
            "match_method"]
    empty = spark.createDataFrame([], "content_type STRING, content_source STRING, content_id STRING, " +
                                  ", ".join(f"{c} STRING" for c in cols) +
                                  ", match_score DOUBLE, status STRING, updated_at TIMESTAMP")

    def job(batch_refs, table):
        # the plan of the job reads either several times
        r = stored(batch_refs.join(landed, ["content_type", "content_source", "content_id"]), "batch-refs")
        p = stored(r.select("content_type", "content_source", "content_id").join(pay, "content_id"), "batch-payloads")
        return scene_enrichment_job(r, table, p, NOW, 240.0, 48.0, "data.searchScene", 0)

    out = INC.enrichment_loop(spark, land, refs.schema, job, ["content_type", "content_source", "content_id"],
                              shared_path(spark, "enrich-loop"), empty, run="1", buckets=8)
    return out["store"].read("table").select("content_type", "content_source", "content_id", "status")


def status_snapshot(fx):
    """Sync state landed in four files, counted by a streaming aggregation one file at a time; each micro-batch
    publishes the status report (E7) as a snapshot."""
    from catalux.plans import catalogue as C
    spark = fx.spark
    state = fx["sync_state"]
    land = shared_path(spark, "landed-state")
    state.repartition(4, "pg_id").write.parquet(land)

    def report(counts):
        return C.sync_status({"items": fx["items"]}, state, items_content(fx), film_enrich(fx), {"items": ITEMS_SYNC}, FILM_SOURCE, counts)

    out = INC.status_snapshot(spark, land, spark.read.parquet(land).schema, report, shared_path(spark, "status"), trigger="availableNow",
                              max_files_per_trigger=2)
    return U.read_snapshot(spark, out["status"]).drop("epoch")


def _register_status_snapshot():
    from catalux.registry import ORACLE, register as reg
    import catalux.registry.endtoend  # noqa: F401 - defines the sync_status oracle
    sql = ORACLE["sync_status"]
    reg("status_snapshot")(status_snapshot)
    ORACLE["status_snapshot"] = sql


_register_status_snapshot()
