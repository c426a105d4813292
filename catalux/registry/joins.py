"""Registered queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalux.operators import joins as J
from catalux.operators.vector import knn
from catalux.registry import register
from catalux.registry.common import self_queries
from catalux.registry.common import (FILES_JOIN, FILM_ENRICH_SQL, FILM_SOURCE, ITEMS_CONTENT_SQL, ITEMS_SYNC, NOW,
                                     film_enrich, items_content)

PENDING_SQL = """
SELECT i.pg_id, i.text, md5(i.text) AS text_hash, i.updated_at, i.lang, i.size
FROM items i LEFT JOIN sync_state s ON s.source = 'items' AND s.pg_id = CAST(i.id AS VARCHAR)
WHERE s.pg_id IS NULL OR i.updated_at > coalesce(s.updated_at, TIMESTAMP '1970-01-01 00:00:00')
   OR s.text_hash IS DISTINCT FROM md5(i.text) OR s.last_error IS NOT NULL"""


@register("pending_rows", PENDING_SQL, ("items", "sync_state"))
def pending_rows(fx):
    """Rows with no state, newer than their state, a changed hash, or a recorded error."""
    return J.pending_rows(fx["items"], ITEMS_SYNC, fx["sync_state"])


@register("configured_join", """
SELECT i.id, e.aka, f.paths FROM items i
LEFT JOIN enrich e ON e.content_id = CAST(i.id AS VARCHAR)
LEFT JOIN (SELECT CAST(parent_id AS VARCHAR) AS pid, list(path ORDER BY idx) AS paths FROM files GROUP BY parent_id) f
  ON f.pid = CAST(i.id AS VARCHAR)""", ("items", "enrich", "files"))
def configured_join(fx):
    """A plain left join and an aggregated (array_agg, pre-grouped) left join."""
    from catalux.spec import JoinSpec
    plain = JoinSpec(table="enrich", on_left=("id",), on_right=("content_id",), fields={"aka": "aka"})
    out = J.configured_join(fx["items"], [plain, FILES_JOIN], {"enrich": fx["enrich"], "files": fx["files"]})
    return out.select("id", "aka", "paths")


FILM_TABLE_SQL = """SELECT CASE p_partkey % 5 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv_show' WHEN 2 THEN 'tv' END AS content_type,
       CAST(p_partkey AS VARCHAR) AS tmdb_id FROM part WHERE p_size > 25"""


def _film_table(fx):
    p = fx.table("part").where(F.col("p_size") > 25)
    t = (F.when(F.col("p_partkey") % 5 == 0, "movie").when(F.col("p_partkey") % 5 == 1, "tv_show")
         .when(F.col("p_partkey") % 5 == 2, "tv"))
    return p.select(t.alias("content_type"), F.col("p_partkey").cast("string").alias("tmdb_id"))


@register("unenriched_film_refs", f"""
SELECT r.content_type, r.content_id FROM refs r
WHERE r.content_source = 'tmdb'
  AND NOT EXISTS (SELECT 1 FROM ({FILM_TABLE_SQL}) e WHERE e.content_type = r.content_type AND e.tmdb_id = r.content_id)""",
          ("refs",))
def unenriched_film_refs(fx):
    """Film refs without an enrichment row (enriched: parts larger than 25)."""
    r = fx["refs"].where(F.col("content_source") == "tmdb")
    return J.anti_refs(r, _film_table(fx), [("content_type", "content_type"), ("content_id", "tmdb_id")]).select(
        "content_type", "content_id")


SCENE_KEYS = [("content_type", "content_type"), ("content_source", "content_source"), ("content_id", "content_id")]
ITEM_REFS_SQL = "SELECT 'doc' AS content_type, source AS content_source, pg_id AS content_id FROM items"


def _item_refs(fx):
    return fx["items"].select(F.lit("doc").alias("content_type"), F.col("source").alias("content_source"),
                              F.col("pg_id").alias("content_id"))


@register("unenriched_scene_refs", f"""
SELECT r.* FROM ({ITEM_REFS_SQL}) r
WHERE NOT EXISTS (SELECT 1 FROM enrich e WHERE e.content_type = r.content_type
                  AND e.content_source = r.content_source AND e.content_id = r.content_id)""", ("items", "enrich"))
def unenriched_scene_refs(fx):
    """Item refs without a scene enrichment row (3-part key anti join)."""
    return J.anti_refs(_item_refs(fx), fx["enrich"], SCENE_KEYS)


@register("missing_refs", f"""
SELECT DISTINCT r.* FROM (SELECT 'doc' AS content_type, source AS content_source, CAST(id % 500 AS VARCHAR) AS content_id FROM items) r
WHERE NOT EXISTS (SELECT 1 FROM enrich e WHERE e.content_type = r.content_type
                  AND e.content_source = r.content_source AND e.content_id = r.content_id)""", ("items", "enrich"))
def missing_refs(fx):
    """Distinct given refs (with repeats) minus existing ones."""
    refs = fx["items"].select(F.lit("doc").alias("content_type"), F.col("source").alias("content_source"),
                              (F.col("id") % 500).cast("string").alias("content_id"))
    return J.missing_refs(refs, fx["enrich"], SCENE_KEYS)


@register("stale_refs", f"""
SELECT r.* FROM ({ITEM_REFS_SQL}) r
LEFT JOIN enrich e ON e.content_type = r.content_type AND e.content_source = r.content_source AND e.content_id = r.content_id
WHERE e.content_id IS NULL OR e.updated_at IS NULL
   OR (epoch_us(TIMESTAMP '{NOW}') - epoch_us(e.updated_at)) / 3.6e9
      >= CASE WHEN e.status = 'not_found' THEN 48.0 ELSE 240.0 END""", ("items", "enrich"))
def stale_refs(fx):
    """Absent refs, or older than their TTL (10 days; 2 days for not_found)."""
    return J.stale_refs(_item_refs(fx), fx["enrich"], SCENE_KEYS, NOW, 240.0, 48.0)


@register("collection_join", """
SELECT c.id, l.collection_id, s.name AS collection_name FROM catalog c
LEFT JOIN links l ON l.content_id = c.id LEFT JOIN collections s ON s.collection_id = l.collection_id""",
          ("catalog", "links", "collections"))
def collection_join(fx):
    """Content -> link table -> collection."""
    out = J.collection_join(fx["catalog"], fx["links"], fx["collections"])
    return out.select("id", "collection_id", "collection_name")


@register("enrichment_join", f"""
SELECT c.id, fe.aka AS film_aka, e.status AS scene_status FROM ({ITEMS_CONTENT_SQL}) c
LEFT JOIN ({FILM_ENRICH_SQL}) fe ON fe.content_type = c.type AND fe.tmdb_id = c.id AND c.source = '{FILM_SOURCE}'
LEFT JOIN enrich e ON e.content_type = c.type AND e.content_source = c.source AND e.content_id = c.id""",
          ("items", "enrich"))
def enrichment_join(fx):
    """Film enrichment only for the film source, scene enrichment on the 3-part key."""
    c = items_content(fx)
    fe = film_enrich(fx).select(F.col("content_type").alias("_ft"), F.col("tmdb_id").alias("_fid"),
                                F.col("aka").alias("film_aka"))
    se = fx["enrich"].select(F.col("content_type").alias("_st"), F.col("content_source").alias("_ss"),
                             F.col("content_id").alias("_sid"), F.col("status").alias("scene_status"))
    j = c.join(fe, (fe["_ft"] == c["type"]) & (fe["_fid"] == c["id"]) & (c["source"] == FILM_SOURCE), "left")
    j = j.join(se, (se["_st"] == j["type"]) & (se["_ss"] == j["source"]) & (se["_sid"] == j["id"]), "left")
    return j.select("id", "film_aka", "scene_status")


@register("latest_enriched", f"""
SELECT c.type || ':' || c.source || ':' || c.id AS content_uid, c.id AS tmdb_id, c.title, c.updated_at, fe.genre, fe.keywords
FROM ({ITEMS_CONTENT_SQL}) c JOIN ({FILM_ENRICH_SQL}) fe ON fe.content_type = c.type AND fe.tmdb_id = c.id
WHERE c.source = '{FILM_SOURCE}'
ORDER BY c.updated_at DESC NULLS LAST, c.id LIMIT 15""", ("items", "enrich"))
def latest_enriched(fx):
    """Newest 15 film items with their enrichment (the limit is the feature)."""
    out = J.latest_enriched(items_content(fx), film_enrich(fx), 15, FILM_SOURCE)
    return out.select(F.concat_ws(":", "type", "source", "id").alias("content_uid"), F.col("id").alias("tmdb_id"),
                      "title", "updated_at", "genre", "keywords")


@register("hit_lookup_join", """
WITH hits AS (
  SELECT * FROM (SELECT q.vec_id AS query_id, p.source, p.pg_id,
       round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) DESC, p.source, p.pg_id) AS rank
     FROM (SELECT * FROM points WHERE vec_id % 50 = 0) q, points p) t WHERE rank <= 10)
SELECT h.query_id, h.source, h.pg_id, h.score, i.title, i.lang AS meta_lang, i.size AS meta_size
FROM hits h JOIN items i ON h.source = 'items' AND i.pg_id = h.pg_id""", ("points", "items"))
def hit_lookup_join(fx):
    """Vector hits joined to their source rows; hits of unknown sources or without a row drop out."""
    p = fx["points"]
    hits = knn(p, self_queries(p), 10)
    rows = fx["items"].select(F.lit("items").alias("_src"), F.col("pg_id").alias("_pid"), "title",
                              F.col("lang").alias("meta_lang"), F.col("size").alias("meta_size"))
    j = hits.join(rows, (hits["source"] == rows["_src"]) & (hits["pg_id"] == rows["_pid"]))
    return j.select("query_id", "source", "pg_id", F.round("score", 6).alias("score"), "title", "meta_lang", "meta_size")


@register("state_score_lookup", """
SELECT i.pg_id, coalesce(CAST(s.nsfw_score AS DOUBLE), 0.0) AS nsfw_score
FROM items i LEFT JOIN sync_state s ON s.source = 'items' AND s.pg_id = i.pg_id""", ("items", "sync_state"))
def state_score_lookup(fx):
    """Safety score per row from the state table, missing -> 0.0."""
    hits = fx["items"].select(F.lit("items").alias("source"), "pg_id")
    return J.state_score_lookup(hits, fx["sync_state"]).select("pg_id", "nsfw_score")


@register("scene_fields_attach", """
SELECT i.pg_id, e.match_id AS tpdb_id, e.status AS tpdb_status FROM items i
LEFT JOIN enrich e ON e.content_type = 'doc' AND e.content_source = i.source AND e.content_id = i.pg_id""",
          ("items", "enrich"))
def scene_fields_attach(fx):
    """Match columns attached by content id within (type, source), renamed tpdb_*."""
    scene = fx["enrich"].withColumn("tpdb_id", F.col("match_id"))
    out = J.scene_fields_attach(fx["items"].select("pg_id", "source"), scene, "doc", F.col("source"), fields=["tpdb_id", "status"])
    return out.select("pg_id", "tpdb_id", "tpdb_status")


@register("synced_rows_join", """
SELECT max(i.updated_at) AS max_synced_updated_at, count(*) AS synced_rows
FROM items i JOIN sync_state s ON s.source = 'items' AND s.pg_id = CAST(i.id AS VARCHAR)""", ("items", "sync_state"))
def synced_rows_join(fx):
    """Newest source time among rows that have a state row."""
    st = fx["sync_state"].where(F.col("source") == "items")
    return J.synced_rows(fx["items"], st, "id").agg(F.max("updated_at").alias("max_synced_updated_at"),
                                                    F.count(F.lit(1)).alias("synced_rows"))
