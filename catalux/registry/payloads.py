"""Registered queries: landed payloads and their normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalux.functions import match as M
from catalux.functions.text import parse_source_rating
from catalux.operators.views import json_field
from catalux.registry import duck as D
from catalux.registry import register
from catalux.session import shared_path
from catalux.sources import payload as P

SCENE_PATH = "data.searchScene"
IMAGE_BASE = "https://images.example/w185"

# --- S9 ----------------------------------------------------------------------


@register("payload_ingest", """
SELECT id, json_extract_string(film_json, '$.overview') AS overview, json_extract_string(film_json, '$.poster_path') AS poster_path,
       CAST(json_array_length(film_json, '$.genres') AS BIGINT) AS n_genres
FROM payload""", ("payload",))
def payload_ingest(fx):
    """Landed JSON lines read with a declared schema (written from the payload table, then read back)."""
    spark = fx.spark
    path = shared_path(spark, "landed", "film")
    lines = fx["payload"].select(F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"film":'),
                                          F.col("film_json"), F.lit("}")).alias("value"))
    lines.write.mode("overwrite").text(path)
    df = P.read_payload_files(spark, path, f"id BIGINT, film {M.FILM_SCHEMA}")
    return df.select("id", F.col("film.overview").alias("overview"), F.col("film.poster_path").alias("poster_path"),
                     F.size("film.genres").cast("bigint").alias("n_genres"))


# --- S10 / S11 / X16 ---------------------------------------------------------

_NODES = (f"CASE WHEN {D.jtype('search_json', '$.data.torrentContent')} = 'OBJECT' "
          f"THEN {D.jget('search_json', '$.data.torrentContent.search.items[*]')} "
          f"ELSE {D.jget('search_json', '$.data.torrents.edges[*].node')} END")
NODES_SQL = f"""nodes AS (SELECT id, node FROM (SELECT id, unnest({_NODES}) AS node FROM payload) t
                        WHERE {D.jtype('node')} = 'OBJECT')"""


@register("search_payload_nodes", f"""
WITH {NODES_SQL}
SELECT id, coalesce(nullif({D.jstr('node', '$.infoHash')}, ''), {D.jstr('node', '$.torrent.infoHash')}, '') AS info_hash,
       coalesce(nullif({D.jstr('node', '$.torrent.name')}, ''), nullif({D.jstr('node', '$.name')}, ''),
                nullif({D.jstr('node', '$.title')}, ''), '') AS title,
       coalesce(TRY_CAST({D.jstr('node', '$.torrent.size')} AS DOUBLE), TRY_CAST({D.jstr('node', '$.size')} AS DOUBLE)) AS size
FROM nodes""", ("payload",))
def search_payload_nodes(fx):
    """Hit nodes of both payload shapes, null / non-object entries dropped."""
    n = P.each_node(fx["payload"].select("id", P.search_nodes(F.col("search_json")).alias("_nodes")), "_nodes")
    c = P.node_columns(F.col("node"))
    return n.select("id", c["info_hash_raw"].alias("info_hash"), c["title"].alias("title"), c["size_raw"].alias("size"))


@register("search_payload_meta", f"""
SELECT id,
  CASE WHEN {D.jtype('search_json', '$.data.torrentContent')} = 'OBJECT'
       THEN TRY_CAST({D.jstr('search_json', '$.data.torrentContent.search.totalCount')} AS BIGINT)
       ELSE TRY_CAST({D.jstr('search_json', '$.data.torrents.totalCount')} AS BIGINT) END AS total_count,
  CASE WHEN {D.jtype('search_json', '$.data.torrentContent')} = 'OBJECT'
       THEN TRY_CAST({D.jstr('search_json', '$.data.torrentContent.search.hasNextPage')} AS BOOLEAN) END AS has_next_page
FROM payload""", ("payload",))
def search_payload_meta(fx):
    """totalCount and hasNextPage per payload."""
    m = P.search_meta(F.col("search_json"))
    return fx["payload"].select("id", m["total_count"].alias("total_count"), m["has_next_page"].alias("has_next_page"))


_ATTR_HIT = (f"len(list_filter(coalesce({D.jget('node', '$.content.attributes[*]')}, []::JSON[]), lambda a: "
             f"{D.jtype('a')} = 'OBJECT' AND {D.strip_ws(D.jstr('a', '$.value'))} <> '' "
             f"AND strpos(lower(coalesce({D.jstr('a', '$.key')}, '')), 'tmdb') > 0)) > 0")


@register("node_has_external_id", f"""
WITH {NODES_SQL}
SELECT id, lower(coalesce(nullif({D.jstr('node', '$.contentSource')}, ''), nullif({D.jstr('node', '$.content_source')}, ''), '')) = 'tmdb'
       OR ({D.jtype('node', '$.content')} = 'OBJECT' AND coalesce({_ATTR_HIT}, false)) AS has_ext
FROM nodes""", ("payload",))
def node_has_external_id(fx):
    """Film source, or an attribute key mentioning it with a value."""
    n = P.each_node(fx["payload"].select("id", P.search_nodes(F.col("search_json")).alias("_nodes")), "_nodes")
    return n.select("id", M.node_has_external_id(F.col("node")).alias("has_ext"))


# --- S12 ---------------------------------------------------------------------

@register("file_payload_rows", f"""
SELECT id, TRY_CAST({D.jstr('it', '$.index')} AS BIGINT) AS "index", {D.jstr('it', '$.path')} AS path,
       {D.jstr('it', '$.extension')} AS extension, TRY_CAST({D.jstr('it', '$.size')} AS BIGINT) AS size,
       {D.jstr('it', '$.updatedAt')} AS updated_at
FROM (SELECT id, unnest({D.jget('file_json', '$.data.torrent.files.items[*]')}) AS it FROM payload) t
WHERE {D.jtype('it')} = 'OBJECT'""", ("payload",))
def file_payload_rows(fx):
    """One row per file entry; updatedAt renamed."""
    return P.file_rows(fx["payload"], "file_json", keep=["id"]).drop("pos")


# --- X20-X24 -----------------------------------------------------------------

_ITEMS = D.result_items("scene_json", SCENE_PATH)
SCENE_ITEM_SQL = f"first_items AS (SELECT id, len({_ITEMS}) AS n_items, {_ITEMS}[1] AS it FROM payload)"


def _first_item(fx):
    return M.first_item_frame(fx["payload"], "scene_json", SCENE_PATH, ["id"])


@register("result_items", f"""
WITH {SCENE_ITEM_SQL}
SELECT id, n_items, {D.jstr('it', '$.id')} AS first_id FROM first_items""", ("payload",))
def result_items(fx):
    """Items under the result path (list as is, wrapped lists unwrapped)."""
    f = _first_item(fx)
    return f.select("id", "n_items", M.vstr(F.col("it"), "$.id").alias("first_id"))


@register("join_names", f"""
WITH {SCENE_ITEM_SQL}
SELECT id, {D.join_names(D.jget('it', '$.studio'))} AS studio, {D.join_names(D.jget('it', '$.tags'))} AS tags,
       {D.join_names(D.jget('it', '$.performers'))} AS performers, {D.join_names(D.jget('it', '$.missing'))} AS missing
FROM first_items""", ("payload",))
def join_names(fx):
    """Names from strings, objects and mixed lists."""
    f = _first_item(fx)
    it = F.col("it")
    return f.select("id", M.join_names(M.vget(it, "$.studio")).alias("studio"), M.join_names(M.vget(it, "$.tags")).alias("tags"),
                    M.join_names(M.vget(it, "$.performers")).alias("performers"),
                    M.join_names(M.vget(it, "$.missing")).alias("missing"))


@register("first_image_url", f"""
WITH {SCENE_ITEM_SQL}
SELECT id, {D.first_image_url(D.jget('it', '$.images'))} AS from_list, {D.first_image_url(D.jget('it', '$.studio'))} AS from_object,
       {D.first_image_url(D.jget('it', '$.date'))} AS from_string
FROM first_items""", ("payload",))
def first_image_url(fx):
    """First usable image url from a list, an object, or a string."""
    f = _first_item(fx)
    it = F.col("it")
    return f.select("id", M.first_image_url(M.vget(it, "$.images")).alias("from_list"),
                    M.first_image_url(M.vget(it, "$.studio")).alias("from_object"),
                    M.first_image_url(M.vget(it, "$.date")).alias("from_string"))


def _scene_sql() -> str:
    g = lambda k: D.jget("it", f"$.{k}")
    url_sites = (f"list_filter(list_transform(coalesce({D.jget('it', '$.urls[*]')}, []::JSON[]), lambda u: "
                 f"CASE WHEN {D.jtype('u')} = 'OBJECT' AND {D.jtype('u', '$.site')} = 'OBJECT' THEN nullif({D.jstr('u', '$.site.name')}, '') "
                 f"WHEN {D.jtype('u')} = 'OBJECT' AND {D.jtype('u', '$.site')} = 'VARCHAR' THEN {D.jstr('u', '$.site')} END), "
                 f"lambda s: s IS NOT NULL AND s <> '')")
    site = f"(CASE WHEN {D.truthy(g('site'))} THEN {D.join_names(g('site'))} ELSE array_to_string({url_sites}, ', ') END)"
    aka_v = D.first_truthy(g("aka"), g("alternateTitles"))
    aka = (f"(CASE WHEN {aka_v} IS NULL THEN (CASE WHEN {D.truthy(g('code'))} THEN {D.any_str(g('code'))} ELSE '' END) "
           f"WHEN {D.jtype(aka_v)} = 'VARCHAR' THEN {D.jstr(aka_v)} ELSE {D.join_names(aka_v)} END)")
    cols = {
        "tpdb_id": f"nullif({D.any_str(D.first_truthy(g('id'), g('uuid')))}, '')",
        "external_type": f"nullif({D.any_str(D.first_truthy(g('type'), g('__typename')))}, '')",
        "title": D.any_str(D.first_truthy(g("title"), g("name"))),
        "original_title": D.any_str(D.first_truthy(g("original_title"), g("originalTitle"))),
        "aka": aka,
        "actors": D.join_names(D.first_truthy(g("performers"), g("actors"))),
        "tags": D.join_names(g("tags")),
        "studio": D.join_names(g("studio")),
        "series": D.join_names(g("series")),
        "site": site,
        "release_date": f"coalesce({D.any_str(D.first_truthy(g('release_date'), g('releaseDate'), g('date'), g('production_date')))}, '')",
        "plot": f"coalesce({D.any_str(D.first_truthy(g('description'), g('overview'), g('plot'), g('details')))}, '')",
        "poster_url": D.first_image_url(D.first_truthy(g("image"), g("images"), g("poster"))),
    }
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


@register("normalize_scene_item", f"WITH {SCENE_ITEM_SQL} SELECT id, {_scene_sql()} FROM first_items", ("payload",))
def normalize_scene_item(fx):
    """The 13 scene columns with their fallbacks (first result item of each payload)."""
    return M.scene_frame(_first_item(fx), "it", ["id"])


def _film_sql() -> str:
    j = "film_json"
    names = lambda arr: f"array_to_string(list_filter({arr}, lambda x: coalesce(x, '') <> ''), ', ')"
    kw = (f"(CASE WHEN coalesce(json_array_length({j}, '$.keywords.keywords'), 0) > 0 THEN {D.jstr(j, '$.keywords.keywords[*].name')} "
          f"WHEN coalesce(json_array_length({j}, '$.keywords.results'), 0) > 0 THEN {D.jstr(j, '$.keywords.results[*].name')} "
          f"ELSE []::VARCHAR[] END)")
    alt = (f"(CASE WHEN coalesce(json_array_length({j}, '$.alternative_titles.titles'), 0) > 0 THEN {D.jstr(j, '$.alternative_titles.titles[*].title')} "
           f"WHEN coalesce(json_array_length({j}, '$.alternative_titles.results'), 0) > 0 THEN {D.jstr(j, '$.alternative_titles.results[*].title')} "
           f"ELSE []::VARCHAR[] END)")
    crew = D.jget(j, "$.credits.crew[*]")
    directors = (f"list_filter(list_transform(coalesce({crew}, []::JSON[]), lambda c: CASE WHEN {D.jstr('c', '$.job')} = 'Director' "
                 f"THEN {D.jstr('c', '$.name')} END), lambda x: coalesce(x, '') <> '')")
    rating = D.strip_ws(f"coalesce({D.jstr(j, '$.imdbRating')}, '')")
    cols = {
        "aka": names(f"list_slice({alt}, 1, 10)"),
        "keywords": names(kw),
        "actors": names(f"list_slice(coalesce({D.jstr(j, '$.credits.cast[*].name')}, []::VARCHAR[]), 1, 10)"),
        "directors": f"array_to_string(list_slice({directors}, 1, 5), ', ')",
        "plot": f"coalesce(nullif({D.jstr(j, '$.overview')}, ''), '')",
        "genre": names(f"coalesce({D.jstr(j, '$.genres[*].name')}, []::VARCHAR[])"),
        "poster_path": D.jstr(j, "$.poster_path"),
        "backdrop_path": D.jstr(j, "$.backdrop_path"),
        "imdb_id": f"coalesce(nullif({D.jstr(j, '$.external_ids.imdb_id')}, ''), nullif({D.jstr(j, '$.imdb_id')}, ''))",
        "imdb_rating": f"(CASE WHEN {rating} = '' OR upper({rating}) = 'N/A' THEN NULL ELSE TRY_CAST({rating} AS DOUBLE) END)",
        "poster_url": f"(CASE WHEN coalesce({D.jstr(j, '$.poster_path')}, '') <> '' THEN '{IMAGE_BASE}' || {D.jstr(j, '$.poster_path')} END)",
    }
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


@register("normalize_film_payload", f"SELECT id, {_film_sql()} FROM payload", ("payload",))
def normalize_film_payload(fx):
    """X23 (+X37 asset URL, X38 rating): normalised film columns."""
    cols = M.normalize_film_payload(F.col("film_json"))
    p = fx["payload"]
    poster = F.when(F.coalesce(cols["poster_path"], F.lit("")) != "", F.concat(F.lit(IMAGE_BASE), cols["poster_path"]))
    return p.select("id", *[cols[k].alias(k) for k in ("aka", "keywords", "actors", "directors", "plot", "genre",
                                                       "poster_path", "backdrop_path", "imdb_id")],
                    parse_source_rating(cols["imdb_rating_text"]).alias("imdb_rating"), poster.alias("poster_url"))


@register("asset_url", f"""
SELECT id, CASE WHEN coalesce({D.jstr('film_json', '$.poster_path')}, '') <> '' THEN '{IMAGE_BASE}' || {D.jstr('film_json', '$.poster_path')} END AS poster_url,
       CASE WHEN coalesce({D.jstr('film_json', '$.backdrop_path')}, '') <> '' THEN '{IMAGE_BASE}' || {D.jstr('film_json', '$.backdrop_path')} END AS backdrop_url
FROM payload""", ("payload",))
def asset_url(fx):
    """Base URL + path, else NULL (the backdrop is absent in every payload)."""
    from catalux.functions.text import asset_url as au
    p = fx["payload"]
    return p.select("id", au(IMAGE_BASE, json_field("film_json", "poster_path")).alias("poster_url"),
                    au(IMAGE_BASE, json_field("film_json", "backdrop_path")).alias("backdrop_url"))


_R = D.strip_ws(f"coalesce({D.jstr('film_json', '$.imdbRating')}, '')")


@register("parse_source_rating", f"""
SELECT id, CASE WHEN {_R} = '' OR upper({_R}) = 'N/A' THEN NULL ELSE TRY_CAST({_R} AS DOUBLE) END AS imdb_rating FROM payload""",
          ("payload",))
def parse_source_rating_q(fx):
    """Rating text to double; 'N/A' / empty / bad -> NULL."""
    return fx["payload"].select("id", parse_source_rating(json_field("film_json", "imdbRating")).alias("imdb_rating"))


def _norm_or_raw(e: str) -> str:
    n = D.normalize_title(e)
    return f"(CASE WHEN {n} <> '' THEN {n} ELSE coalesce({e}, '') END)"


@register("search_variables", f"""
SELECT content_id, coalesce({D.extract_code('raw_title')}, nullif({_norm_or_raw('raw_title')}, ''), coalesce(raw_title, '')) AS term,
       CASE WHEN coalesce(raw_title, '') <> '' THEN {_norm_or_raw('raw_title')} ELSE '' END AS title,
       coalesce(raw_title, '') AS raw_title, {D.extract_code('raw_title')} AS code
FROM refs""", ("refs",))
def search_variables(fx):
    """Search term = code, else cleaned title, else raw title."""
    v = M.search_variables("raw_title")
    return fx["refs"].select("content_id", *[v[k].alias(k) for k in ("term", "title", "raw_title", "code")])


@register("embed_text", f"""
SELECT i.id, CASE WHEN e.match_id IS NOT NULL AND e.match_id <> ''
                   AND concat_ws(chr(10), nullif(e.aka, ''), nullif(e.keywords, ''), nullif(e.genre, '')) <> ''
             THEN (CASE WHEN {D.normalize_title('i.title')} <> '' THEN {D.normalize_title('i.title')} ELSE coalesce(i.title, '') END)
                  || chr(10) || concat_ws(chr(10), nullif(e.aka, ''), nullif(e.keywords, ''), nullif(e.genre, ''))
             ELSE (CASE WHEN {D.normalize_title('i.title')} <> '' THEN {D.normalize_title('i.title')} ELSE coalesce(i.title, '') END) END
       AS embed_text
FROM items i LEFT JOIN enrich e ON e.content_id = i.pg_id""", ("items", "enrich"))
def embed_text(fx):
    """Normalised title plus the match fields on new lines when matched."""
    it, en = fx["items"], fx["enrich"].select(F.col("content_id").alias("_cid"), "match_id", "aka", "keywords", "genre")
    j = it.join(en, it["pg_id"] == en["_cid"], "left")
    return j.select("id", M.embed_text("title", ["aka", "keywords", "genre"], "match_id").alias("embed_text"))
