"""Registered queries: catalogue views."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalux.functions.match import first_item_frame, normalize_film_payload, scene_frame
from catalux.functions.text import parse_source_rating
from catalux.operators import joins as J
from catalux.operators import views as VW
from catalux.registry import duck as D
from catalux.registry import register
from catalux.registry.common import CATALOG_FILM_SOURCE, ITEMS_SYNC
from catalux.registry.joins import PENDING_SQL
from catalux.registry.payloads import SCENE_PATH, _film_sql, _scene_sql


@register("file_view", """
SELECT lower(hex(unhex(info_hash))) || ':' || CAST(idx AS VARCHAR) AS file_id, idx, path FROM files""", ("files",))
def file_view(fx):
    """File id from the binary hash and the index."""
    f = fx["files"].select(F.unhex("info_hash").alias("info_hash_bin"), "idx", "path")
    return f.select(VW.file_id("info_hash_bin", "idx").alias("file_id"), "idx", "path")


@register("content_uid", """
SELECT id, type || ':' || source || ':' || CAST(id AS VARCHAR) AS content_uid,
       type || ':' || overview || ':' || CAST(id AS VARCHAR) AS overview_uid FROM catalog""", ("catalog",))
def content_uid(fx):
    """P2: 'type:source:id', NULL when a part is NULL."""
    c = fx["catalog"]
    return c.select("id", VW.content_uid("type", "source", "id").alias("content_uid"),
                    VW.content_uid("type", "overview", "id").alias("overview_uid"))


_NAMES_SQL = """names AS (SELECT l.content_id, string_agg(DISTINCT s.name, ' ' ORDER BY s.name) AS collection_names
       FROM links l JOIN collections s ON s.collection_id = l.collection_id WHERE s.name IS NOT NULL GROUP BY l.content_id)"""


@register("search_text", f"""
WITH {_NAMES_SQL}
SELECT c.id, trim(concat_ws(' ', c.title, CAST(NULL AS VARCHAR), c.overview, CAST(c.release_year AS VARCHAR), n.collection_names,
                    CASE WHEN c.source = '{CATALOG_FILM_SOURCE}' THEN CAST(c.id AS VARCHAR) END)) AS search_text
FROM catalog c LEFT JOIN names n ON n.content_id = c.id""", ("catalog", "links", "collections"))
def search_text(fx):
    """Trimmed space-join of the content fields, NULLs skipped."""
    c = fx["catalog"]
    names = VW.collection_names(fx["links"], fx["collections"])
    j = c.join(names, c["id"] == names["content_id"], "left")
    st = F.trim(F.concat_ws(" ", "title", F.lit(None).cast("string"), "overview", F.col("release_year").cast("string"),
                            "collection_names", VW.conditional_id("source", "id", CATALOG_FILM_SOURCE)))
    return j.select("id", st.alias("search_text"))


@register("conditional_id", f"""
SELECT id, CASE WHEN source = '{CATALOG_FILM_SOURCE}' THEN CAST(id AS VARCHAR) END AS tmdb_id FROM catalog""",
          ("catalog",))
def conditional_id(fx):
    """Id only where the source is the film catalogue."""
    return fx["catalog"].select("id", VW.conditional_id("source", "id", CATALOG_FILM_SOURCE).alias("tmdb_id"))


@register("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(fx):
    """P5: raw->>'key'."""
    return fx.table("events").select("event_id", VW.json_field("props", "k").alias("k"))


def _film_table(fx):
    """Film enrichment for catalogue items: normalised payloads; parts above size 30 stand under another type."""
    c = fx["catalog"].withColumn("type", F.when(F.col("release_year") <= 30, F.col("type")).otherwise("OLD"))
    y = fx["payload"].select(F.col("id").alias("_pid"), "film_json")
    cols = normalize_film_payload(F.col("film_json"))
    j = c.join(y.hint("merge"), c["id"] == y["_pid"])       # payloads are far larger than the file that they are made from
    return j.select(F.col("type").alias("content_type"), F.col("id").cast("string").alias("tmdb_id"),
                    *[cols[k].alias(k) for k in ("aka", "keywords", "actors", "directors", "plot", "genre", "imdb_id")],
                    parse_source_rating(cols["imdb_rating_text"]).alias("imdb_rating"),
                    F.lit(None).cast("double").alias("douban_rating"), F.col("film_json").alias("raw"))


def _scene_table(fx):
    """Scene enrichment for catalogue items: first result item; parts up to size 10 stand under another type."""
    c = fx["catalog"].withColumn("type", F.when(F.col("release_year") > 10, F.col("type")).otherwise("NEW"))
    y = fx["payload"].select(F.col("id").alias("_pid"), "scene_json")
    j = c.join(y.hint("merge"), c["id"] == y["_pid"]).select(F.col("type").alias("content_type"),
                                                F.col("source").alias("content_source"),
                                                F.col("id").cast("string").alias("content_id"), "scene_json")
    keys = ["content_type", "content_source", "content_id"]
    items = first_item_frame(j, "scene_json", SCENE_PATH, keys)
    return scene_frame(items, "it", keys).select(*keys, *VW.SCENE_COLS)


_FILM_TABLE_SQL = f"""film AS (SELECT CASE WHEN c.release_year <= 30 THEN c.type ELSE 'OLD' END AS content_type, CAST(c.id AS VARCHAR) AS tmdb_id, f.*
   FROM catalog c JOIN (SELECT id AS pid, film_json, {_film_sql()} FROM payload) f ON f.pid = c.id)"""
_SCENE_TABLE_SQL = f"""scene AS (SELECT CASE WHEN c.release_year > 10 THEN c.type ELSE 'NEW' END AS content_type, c.source AS content_source, CAST(c.id AS VARCHAR) AS content_id, s.*
   FROM catalog c JOIN (SELECT id AS pid, {_scene_sql()} FROM (SELECT id, {D.result_items('scene_json', SCENE_PATH)}[1] AS it FROM payload) t) s
     ON s.pid = c.id)"""


@register("content_view", f"""
WITH {_NAMES_SQL}, {_FILM_TABLE_SQL}, {_SCENE_TABLE_SQL}
SELECT c.type || ':' || c.source || ':' || CAST(c.id AS VARCHAR) AS content_uid, c.id,
       CASE WHEN c.source = '{CATALOG_FILM_SOURCE}' THEN CAST(c.id AS VARCHAR) END AS tmdb_id,
       te.genre, te.keywords,
       trim(concat_ws(' ', c.title, CAST(NULL AS VARCHAR), c.overview, CAST(c.release_year AS VARCHAR), n.collection_names,
            CASE WHEN c.source = '{CATALOG_FILM_SOURCE}' THEN CAST(c.id AS VARCHAR) END,
            te.aka, te.keywords, te.actors, te.directors, te.plot, te.genre,
            je.title, je.original_title, je.aka, je.actors, je.tags, je.studio, je.series, je.site, je.release_date, je.plot)) AS search_text,
       te.aka, te.actors, te.imdb_rating, json_extract_string(te.film_json, '$.poster_path') AS poster_path,
       je.title AS tpdb_title, je.studio AS tpdb_studio, je.site AS tpdb_site, je.poster_url AS tpdb_poster_url
FROM catalog c
LEFT JOIN names n ON n.content_id = c.id
LEFT JOIN film te ON te.content_type = c.type AND te.tmdb_id = CAST(c.id AS VARCHAR) AND c.source = '{CATALOG_FILM_SOURCE}'
LEFT JOIN scene je ON je.content_type = c.type AND je.content_source = c.source AND je.content_id = CAST(c.id AS VARCHAR)""",
          ("catalog", "links", "collections", "payload"))
def content_view(fx):
    """One row per content item: collections pre-aggregated, film and scene enrichment joined."""
    c = fx["catalog"].withColumn("original_title", F.lit(None).cast("string")).withColumn(
        "updated_at", F.lit(None).cast("timestamp"))
    v = VW.content_view(c, fx["links"], fx["collections"], _film_table(fx), _scene_table(fx), CATALOG_FILM_SOURCE)
    return v.select("content_uid", "id", "tmdb_id", "genre", "keywords", "search_text", "aka", "actors", "imdb_rating",
                    "poster_path", "tpdb_title", "tpdb_studio", "tpdb_site", "tpdb_poster_url")


@register("metadata_struct", """
SELECT id, title, pg_id AS meta_pg_id, text AS meta_text, lang AS meta_lang, source AS meta_source, size AS meta_size,
       updated_at AS meta_updated_at, '\\x' || md5(text) AS meta_digest FROM items""", ("items",))
def metadata_struct(fx):
    """Every column except id and title as metadata, binary values rendered '\\x' + hex."""
    it = fx["items"].withColumn("digest", F.unhex(F.md5("text")))
    return VW.metadata_columns(it, "id", "title")


@register("refresh_rows", f"""
SELECT p.pg_id, md5(p.text) AS text_hash, p.lang, p.size, e.match_id AS tpdb_id, e.status AS tpdb_status
FROM ({PENDING_SQL}) p JOIN items i ON i.pg_id = p.pg_id
LEFT JOIN enrich e ON e.content_type = 'doc' AND e.content_source = i.source AND e.content_id = p.pg_id""",
          ("items", "sync_state", "enrich"))
def refresh_rows(fx):
    """Pending rows after enrichment in one join: hash recomputed, configured extras only."""
    spec = replace(ITEMS_SYNC, extra_fields=(*ITEMS_SYNC.extra_fields, "source"))
    pend = J.pending_rows(fx["items"], spec, fx["sync_state"])
    scene = fx["enrich"].withColumn("tpdb_id", F.col("match_id"))
    out = J.refresh_rows(pend, scene, "doc", F.col("source"), fields=["tpdb_id", "status"])
    return out.select("pg_id", "text_hash", "lang", "size", "tpdb_id", "tpdb_status")
