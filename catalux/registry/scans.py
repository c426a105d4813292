"""Registered queries: source scans and keyed upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalux.functions.match import normalize_film_payload
from catalux.functions.text import point_id, safety_score
from catalux.operators import joins as J
from catalux.operators import upsert as U
from catalux.registry import duck as D
from catalux.registry import register
from catalux.registry.common import ITEMS_SYNC, NOW
from catalux.registry.joins import PENDING_SQL
from catalux.session import stored
from catalux.sources.tables import table


@register("source_scan", "SELECT pg_id, text, md5(text) AS text_hash, updated_at, lang, size FROM items", ("items",))
def source_scan(fx):
    """(pg_id text, text, md5 hash, update time, configured extras)."""
    return J.source_scan(fx["items"], ITEMS_SYNC)


@register("table_source", "SELECT * FROM customer")
def table_source(fx):
    """A whole table behind a location (parquet here; JDBC partitioned reads in production)."""
    return table(fx.spark, fx.root, "customer")


_NEW_STATE = f"""
new_rows AS (
  SELECT 'items' AS source, p.pg_id, p.text_hash, 'v2' AS embedding_version,
         {D.point_id("'items'", 'p.pg_id')} AS vector_id, round({D.safety_score('p.text')}, 6) AS nsfw_score,
         TIMESTAMP '{NOW}' AS updated_at, CAST(NULL AS VARCHAR) AS last_error
  FROM ({PENDING_SQL}) p)"""


@register("sync_state_upsert", f"""
WITH {_NEW_STATE}
SELECT s.* FROM sync_state s WHERE NOT EXISTS (SELECT 1 FROM new_rows n WHERE n.source = s.source AND n.pg_id = s.pg_id)
UNION ALL SELECT * FROM new_rows""", ("items", "sync_state"))
def sync_state_upsert(fx):
    """S3: every pending row gets a fresh state (hash, version, vector id, score, time; error cleared)."""
    # both are narrow, are read twice and stand on whole texts
    state = stored(fx["sync_state"], "state")
    pend = J.pending_rows(fx["items"], ITEMS_SYNC, state)
    rows = stored(pend.select("pg_id", "text_hash", point_id(F.lit("items"), "pg_id").alias("vector_id"),
                              F.round(safety_score("text"), 6).alias("nsfw_score")), "new-state")
    return U.sync_state_upsert(state, rows, "items", NOW, "v2")


@register("failure_upsert", f"""
WITH f AS (SELECT 'items' AS source, p.pg_id,
                  substring('text too long to embed (' || CAST(p.size AS VARCHAR) || ' chars): ' || repeat('x', 600), 1, 512) AS err
           FROM ({PENDING_SQL}) p WHERE p.size > 20000)
SELECT coalesce(s.source, f.source) AS source, coalesce(s.pg_id, f.pg_id) AS pg_id, s.text_hash, s.embedding_version,
       s.vector_id, s.nsfw_score, CASE WHEN f.err IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE s.updated_at END AS updated_at,
       CASE WHEN f.err IS NOT NULL THEN f.err ELSE s.last_error END AS last_error
FROM sync_state s FULL OUTER JOIN f ON f.source = s.source AND f.pg_id = s.pg_id""", ("items", "sync_state"))
def failure_upsert(fx):
    """Failures (texts too long to embed) recorded by key, error cut to 512 characters, other columns kept."""
    pend = J.pending_rows(fx["items"], ITEMS_SYNC, fx["sync_state"])
    fails = pend.where(F.col("size") > 20000).select(
        F.lit("items").alias("source"), "pg_id",
        F.concat(F.lit("text too long to embed ("), F.col("size").cast("string"), F.lit(" chars): "),
                 F.repeat(F.lit("x"), 600)).alias("error"))
    return U.failure_upsert(fx["sync_state"], fails, NOW)


@register("points_upsert", """
WITH batch AS (
  SELECT source, pg_id, vec_id, list_reverse(embedding) AS embedding FROM points WHERE label % 2 = 1
  UNION ALL SELECT 'items' AS source, CAST(vec_id + 100000 AS VARCHAR) AS pg_id, vec_id, embedding FROM points WHERE label % 2 = 0),
merged AS (SELECT source, pg_id, vec_id, embedding FROM points p
           WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.source = p.source AND b.pg_id = p.pg_id)
           UNION ALL SELECT * FROM batch)
SELECT source, pg_id, vec_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 4) AS checksum
FROM merged""", ("points",))
def points_upsert(fx):
    """Every point of an odd label is replaced, one is added for every other, by (source, pg_id)."""
    p = fx["points"].select("source", "pg_id", "vec_id", "embedding")
    batch = (p.where(F.col("label") % 2 == 1).select("source", "pg_id", "vec_id", F.reverse("embedding").alias("embedding"))
             .unionByName(fx["points"].where(F.col("label") % 2 == 0).select(
                 F.lit("items").alias("source"), (F.col("vec_id") + 100000).cast("string").alias("pg_id"), "vec_id",
                 "embedding")))
    merged = U.points_upsert(p, batch)
    checksum = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0),
                           lambda a, b: a + b)
    return merged.select("source", "pg_id", "vec_id", F.round(checksum, 4).alias("checksum"))


@register("points_snapshot", "SELECT source, label, count(*) AS n FROM points GROUP BY source, label", ("points",))
def points_snapshot(fx):
    """The points written as a versioned snapshot by IVF cell, reloaded with their metadata, counted."""
    from catalux.registry.vectors import points_index
    back = points_index(fx).points
    return back.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


_FILM_OLD = """SELECT CASE p_partkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv' ELSE 'tv_show' END AS content_type,
       CAST(p_partkey AS VARCHAR) AS tmdb_id, 'old' AS genre, CAST(NULL AS VARCHAR) AS plot FROM part WHERE p_size > 25"""


def _film_old(fx):
    p = fx.table("part").where(F.col("p_size") > 25)
    t = F.when(F.col("p_partkey") % 3 == 0, "movie").when(F.col("p_partkey") % 3 == 1, "tv").otherwise("tv_show")
    return p.select(t.alias("content_type"), F.col("p_partkey").cast("string").alias("tmdb_id"),
                    F.lit("old").alias("genre"), F.lit(None).cast("string").alias("plot"))


@register("film_enrich_upsert", f"""
WITH old AS ({_FILM_OLD}),
batch AS (SELECT CASE p.p_partkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv' ELSE 'tv_show' END AS content_type,
                 CAST(p.p_partkey AS VARCHAR) AS tmdb_id,
                 array_to_string(list_filter(coalesce(json_extract_string(y.film_json, '$.genres[*].name'), []::VARCHAR[]), lambda x: coalesce(x, '') <> ''), ', ') AS genre,
                 coalesce(nullif(json_extract_string(y.film_json, '$.overview'), ''), '') AS plot
          FROM part p JOIN payload y ON y.id = p.p_partkey)
SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.content_type = o.content_type AND b.tmdb_id = o.tmdb_id)
UNION ALL SELECT * FROM batch""", ("payload",))
def film_enrich_upsert(fx):
    """Normalised film rows upserted by (content_type, tmdb_id)."""
    p = fx.table("part")
    y = fx["payload"].select(F.col("id").alias("p_partkey"), "film_json")
    cols = normalize_film_payload(F.col("film_json"))
    t = F.when(F.col("p_partkey") % 3 == 0, "movie").when(F.col("p_partkey") % 3 == 1, "tv").otherwise("tv_show")
    batch = p.join(y, "p_partkey").select(t.alias("content_type"), F.col("p_partkey").cast("string").alias("tmdb_id"),
                                          cols["genre"].alias("genre"), cols["plot"].alias("plot"))
    return U.film_enrich_upsert(_film_old(fx), batch)


@register("scene_enrich_upsert", f"""
WITH old AS (SELECT content_type, content_source, content_id, status, CAST(NULL AS VARCHAR) AS match_method,
                    CAST(NULL AS DOUBLE) AS match_score, updated_at FROM enrich),
batch AS (
  SELECT content_type, content_source, content_id, 'success' AS status, 'code' AS match_method, 1.0 AS match_score,
         TIMESTAMP '{NOW}' AS updated_at FROM enrich WHERE status = 'error'
  UNION ALL
  SELECT 'doc', i.source, i.pg_id, 'not_found', 'not_found', CAST(NULL AS DOUBLE), TIMESTAMP '{NOW}' FROM items i
  WHERE NOT EXISTS (SELECT 1 FROM enrich e WHERE e.content_type = 'doc' AND e.content_source = i.source AND e.content_id = i.pg_id))
SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.content_type = o.content_type
                                       AND b.content_source = o.content_source AND b.content_id = o.content_id)
UNION ALL SELECT * FROM batch""", ("items", "enrich"))
def scene_enrich_upsert(fx):
    """Retried errors become matches, unenriched items become not_found; upsert on the 3-part key."""
    e = fx["enrich"]
    old = e.select("content_type", "content_source", "content_id", "status",
                   F.lit(None).cast("string").alias("match_method"), F.lit(None).cast("double").alias("match_score"),
                   "updated_at")
    now = F.to_timestamp(F.lit(NOW))
    retried = e.where(F.col("status") == "error").select(
        "content_type", "content_source", "content_id", F.lit("success").alias("status"),
        F.lit("code").alias("match_method"), F.lit(1.0).alias("match_score"), now.alias("updated_at"))
    refs = fx["items"].select(F.lit("doc").alias("content_type"), F.col("source").alias("content_source"),
                              F.col("pg_id").alias("content_id"))
    missing = J.anti_refs(refs, e, [("content_type", "content_type"), ("content_source", "content_source"),
                                    ("content_id", "content_id")])
    nf = missing.select("content_type", "content_source", "content_id", F.lit("not_found").alias("status"),
                        F.lit("not_found").alias("match_method"), F.lit(None).cast("double").alias("match_score"),
                        now.alias("updated_at"))
    return U.scene_enrich_upsert(old.withColumn("updated_at", F.col("updated_at").cast("timestamp")),
                                 retried.unionByName(nf))
