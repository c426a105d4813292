"""Registered queries: aggregations (A1-A8, A10-A13; A9 lives with the set operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalux.operators import aggregates as A
from catalux.operators.vector import knn
from catalux.registry import register
from catalux.registry.common import self_queries
from catalux.registry.common import FILM_ENRICH_SQL, FILM_SOURCE, ITEMS_CONTENT_SQL, ITEMS_SYNC, film_enrich, items_content


@register("array_agg_join", """
SELECT parent_id, list(size ORDER BY idx) AS sizes FROM files GROUP BY parent_id""", ("files",))
def array_agg_join(fx):
    """A1: array_agg of a joined column with NULLs kept (ordered by file index)."""
    return fx["files"].groupBy("parent_id").agg(A.array_agg_keep_nulls("size", order="idx").alias("sizes"))


@register("array_agg_distinct_join", """
SELECT parent_id, list_sort(list(DISTINCT size), 'ASC', 'NULLS LAST') AS sizes FROM files GROUP BY parent_id""",
          ("files",))
def array_agg_distinct_join(fx):
    """A2: distinct values, sorted, NULL last."""
    return fx["files"].groupBy("parent_id").agg(A.array_agg_distinct("size").alias("sizes"))


@register("json_agg_join", """
SELECT parent_id, CAST(to_json(list(role ORDER BY idx)) AS VARCHAR) AS roles_json,
       CAST(to_json(list_sort(list(DISTINCT role), 'ASC', 'NULLS LAST')) AS VARCHAR) AS distinct_roles_json
FROM files GROUP BY parent_id""", ("files",))
def json_agg_join(fx):
    """A3: json_agg, plain and DISTINCT."""
    return fx["files"].groupBy("parent_id").agg(
        F.to_json(A.array_agg_keep_nulls("role", order="idx")).alias("roles_json"),
        F.to_json(A.array_agg_distinct("role")).alias("distinct_roles_json"))


@register("string_agg_distinct", """
SELECT l.content_id, string_agg(DISTINCT s.name, ' ' ORDER BY s.name) AS names
FROM links l JOIN collections s ON s.collection_id = l.collection_id WHERE s.name IS NOT NULL
GROUP BY l.content_id""", ("links", "collections"))
def string_agg_distinct(fx):
    """A4: distinct collection names per content, sorted, space-joined."""
    j = fx["links"].join(fx["collections"], "collection_id").where(F.col("name").isNotNull())
    return j.groupBy("content_id").agg(A.string_agg_distinct("name").alias("names"))


@register("source_status", """
SELECT 'items' AS name, (SELECT count(*) FROM items) AS total_rows,
       (SELECT count(*) FROM sync_state WHERE source = 'items') AS synced_rows,
       (SELECT max(updated_at) FROM items) AS max_updated_at,
       (SELECT max(updated_at) FROM sync_state WHERE source = 'items') AS last_sync_updated_at,
       (SELECT max(i.updated_at) FROM items i JOIN sync_state s ON s.source = 'items' AND s.pg_id = CAST(i.id AS VARCHAR)) AS max_synced_updated_at,
       (SELECT count(*) FROM sync_state WHERE source = 'items' AND last_error IS NOT NULL) AS errors""",
          ("items", "sync_state"))
def source_status(fx):
    """A5: the per-source status row in one pass over source and state."""
    return A.source_status(fx["items"], fx["sync_state"], ITEMS_SYNC)


@register("enrichment_status", f"""
SELECT (SELECT count(*) FROM ({ITEMS_CONTENT_SQL}) c WHERE c.source = '{FILM_SOURCE}') AS content_total,
       (SELECT max(updated_at) FROM ({ITEMS_CONTENT_SQL}) c WHERE c.source = '{FILM_SOURCE}') AS content_latest,
       (SELECT count(*) FROM ({FILM_ENRICH_SQL}) e) AS enrichment_total,
       (SELECT max(updated_at) FROM ({FILM_ENRICH_SQL}) e) AS enrichment_latest,
       (SELECT count(*) FROM ({FILM_ENRICH_SQL}) e WHERE coalesce(aka, '') = '' AND coalesce(keywords, '') = '') AS enrichment_missing""",
          ("items", "enrich"))
def enrichment_status(fx):
    """Film content and enrichment totals, latest times, missing lists."""
    return A.enrichment_status(items_content(fx), film_enrich(fx), FILM_SOURCE)


@register("status_histogram", "SELECT status, count(*) AS n FROM enrich GROUP BY status", ("enrich",))
def status_histogram(fx):
    """Scene enrichment rows by status."""
    return fx["enrich"].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("scene_status_by_source", """
SELECT content_type, content_source, count(*) AS n, max(updated_at) AS latest FROM enrich
GROUP BY content_type, content_source""", ("enrich",))
def scene_status_by_source(fx):
    """Count and newest time per (type, source)."""
    return fx["enrich"].groupBy("content_type", "content_source").agg(
        F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("latest"))


@register("file_list_total", """
SELECT parent_id, count(*) AS file_count,
       coalesce(sum(CASE WHEN TRY_CAST(size AS DOUBLE) > 0 THEN TRY_CAST(size AS DOUBLE) END), 0.0) AS total_size
FROM files GROUP BY parent_id""", ("files",))
def file_list_total(fx):
    """A10: per item file count and sum of positive sizes."""
    return A.file_list_total(fx["files"])


@register("hits_by_source", """
WITH hits AS (
  SELECT * FROM (SELECT q.vec_id AS query_id, p.source, p.pg_id,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) DESC, p.source, p.pg_id) AS rank
     FROM (SELECT * FROM points WHERE vec_id % 50 = 0) q, points p) t WHERE rank <= 10)
SELECT query_id, source, count(*) AS hits FROM hits GROUP BY query_id, source""", ("points",))
def hits_by_source(fx):
    """Hit count per source per query."""
    p = fx["points"]
    hits = knn(p, self_queries(p), 10)
    return hits.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("hits"))


@register("latency_summary", """
SELECT event_type, min(value) AS min_v, quantile_cont(value, 0.5) AS p50_v, round(avg(value), 6) AS mean_v, max(value) AS max_v
FROM events GROUP BY event_type""")
def latency_summary(fx):
    """Min / exact median / mean / max per event type."""
    out = A.latency_summary(fx.table("events"), "event_type", "value")
    return out.select("event_type", "min_v", "p50_v", F.round("mean_v", 6).alias("mean_v"), "max_v")


@register("sync_summary", """
SELECT event_type AS source, count(*) AS batches, round(sum(value), 6) AS rows,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds,
       round(sum(value) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS rows_per_sec
FROM events GROUP BY event_type""")
def sync_summary(fx):
    """Per source batches, rows, elapsed seconds, rows/s over a run log (events as the log)."""
    log = fx.table("events").select(F.col("event_type").alias("source"), "value", "ts")
    out = A.sync_summary(log, "source", "value", "ts")
    return out.select("source", "batches", F.round("rows", 6).alias("rows"), "seconds",
                      F.round("rows_per_sec", 6).alias("rows_per_sec"))
