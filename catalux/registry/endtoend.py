"""Registered queries: end-to-end compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalux.functions import fixed
from catalux.plans import catalogue as C
from catalux.plans import enrichment as EN
from catalux.plans import search as S
from catalux.plans import sync as SY
from catalux.registry import duck as D
from catalux.registry import register
from catalux.registry.common import FILM_ENRICH_SQL, FILM_SOURCE, ITEMS, ITEMS_CONTENT_SQL, ITEMS_SYNC, NOW, film_enrich, items_content
from catalux.registry.scalars import SEARCH_TEXTS_SQL, search_texts
from catalux.registry.sets import ENGLISH_SQL, TERMS_SQL
from catalux.registry.views import _film_table
from catalux.spec import SourceSpec

FILM_TABLE = ("content_type string, tmdb_id string, aka string, keywords string, actors string, directors string, plot string, "
              "genre string, imdb_id string, imdb_rating double, douban_rating double, raw string, updated_at timestamp")
STRIP = D.lit(__import__("catalux.functions.fixed", fromlist=["x"]).KEYWORD_STRIP_CHARS)
COS = "list_cosine_similarity(f.qvec::DOUBLE[], p.embedding::DOUBLE[])"


def _title_key(e: str, src: str, pid: str) -> str:
    n = D.normalize_title(e)
    return f"(CASE WHEN {n} <> '' THEN 'title:' || {n} ELSE 'id:' || {src} || ':' || {pid} END)"


_FT, _RAW = D.query_file_type("b.q")
_QA, _QS = D.detect_languages(_RAW)

HITS_SQL = f"""cnt AS (SELECT query_id, count(*) AS raw_count FROM HITS_OF GROUP BY query_id),
d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id,
         CASE WHEN {D.strip_ws("coalesce(text_hash, '')")} <> '' THEN {D.strip_ws("coalesce(text_hash, '')")} ELSE source || ':' || pg_id END
         ORDER BY rank) AS k FROM HITS_OF) t WHERE k = 1 AND NOT nsfw),
res AS (SELECT d1.*, i.title, {_title_key('i.title', 'd1.source', 'd1.pg_id')} AS tkey
        FROM d1 JOIN items i ON d1.source = 'items' AND i.pg_id = d1.pg_id),
d2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tkey ORDER BY score DESC, source, pg_id) AS k2
       FROM res) t WHERE k2 = 1)
SELECT d2.query_id, row_number() OVER (PARTITION BY d2.query_id ORDER BY score DESC, source, pg_id) AS position,
       source, pg_id, title, score, nsfw, 0.0 AS nsfw_score, CASE WHEN c.raw_count = 20 THEN c.raw_count END AS next_cursor
FROM d2 JOIN cnt c ON c.query_id = d2.query_id"""

SEMANTIC_SQL = f"""
WITH b AS (SELECT p.vec_id AS query_id, i.title AS q, p.embedding AS qvec FROM points p JOIN items i ON i.id = p.vec_id WHERE p.vec_id % 50 = 0),
f AS (SELECT b.query_id, b.qvec, {_FT} AS file_type, {_QA} AS audio, {_QS} AS subs, {D.query_genres(_RAW)} AS genres FROM b),
s AS (SELECT f.query_id, p.source, p.pg_id, p.text_hash, coalesce(p.nsfw, false) AS nsfw, round({COS}, 6) AS score
      FROM f, points p
      WHERE (f.file_type IS NULL OR p.file_type = f.file_type)
        AND (len(f.audio) = 0 OR list_has_any(p.audio_langs, f.audio))
        AND (len(f.subs) = 0 OR list_has_any(p.subtitle_langs, f.subs))
        AND (len(f.genres) = 0 OR list_has_any(p.genre_tags, f.genres))),
prim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS rank FROM s) t
         WHERE rank <= 20),
""" + HITS_SQL.replace("HITS_OF", "prim")


def _semantic_queries(fx):
    p = fx["points"].where(F.col("vec_id") % 50 == 0)
    it = fx["items"].select(F.col("id").alias("_iid"), F.col("title").alias("q"))
    return p.join(it, p["vec_id"] == it["_iid"]).select(F.col("vec_id").alias("query_id"), "q",
                                                         F.col("embedding").alias("qvec"))


def _rows(fx):
    return fx["items"].select(F.lit("items").alias("source"), "pg_id", "title", "size")


@register("semantic_search", SEMANTIC_SQL, ("points", "items"))
def semantic_search(fx):
    """E1 with given query vectors: filters from the query text, filtered top-k, dedupes, look-up, ranking."""
    p = S.SearchParams(expand=False)
    return S.semantic_search(_semantic_queries(fx), fx["points"], _rows(fx), p, qvec="qvec", cross_language=False)


_CLEAN_Q = D.strip_ws(D.query_file_type("qt.q")[1])
KEYWORD_SQL = f"""
WITH qt AS ({SEARCH_TEXTS_SQL}),
qc AS (SELECT query_id, q AS raw_q, CASE WHEN {_CLEAN_Q} <> '' THEN {_CLEAN_Q} ELSE coalesce(q, '') END AS q FROM qt),
m1 AS (SELECT qc.query_id, i.pg_id FROM qc JOIN items i ON i.title ILIKE '%' || qc.q || '%' WHERE qc.q <> ''),
m2 AS (SELECT qc.query_id, i.pg_id FROM qc JOIN items i
         ON translate(lower(i.title), {STRIP}, '') LIKE '%' || lower(translate(qc.q, {STRIP}, '')) || '%'
       WHERE qc.q <> '' AND regexp_matches(qc.q, '[\\x{{4e00}}-\\x{{9fff}}]') AND lower(translate(qc.q, {STRIP}, '')) <> ''),
m AS (SELECT DISTINCT * FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) u),
lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pg_id) AS r FROM m) t WHERE r <= 60),
j AS (SELECT lim.query_id, i.pg_id, i.title, i.size, coalesce(CAST(s.nsfw_score AS DOUBLE), 0.0) AS nsfw_score, qc.q
      FROM lim JOIN items i ON i.pg_id = lim.pg_id JOIN qc ON qc.query_id = lim.query_id
      LEFT JOIN sync_state s ON s.source = 'items' AND s.pg_id = i.pg_id),
c AS (SELECT query_id, 'items' AS source, pg_id, title, nsfw_score >= 0.7 AS nsfw, nsfw_score,
             {D.keyword_score('q', 'title')} AS score, {_title_key('title', "'items'", 'pg_id')} AS tkey FROM j),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tkey ORDER BY score DESC, source, pg_id) AS k
      FROM c WHERE NOT nsfw) t WHERE k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS position,
             count(*) OVER (PARTITION BY query_id) AS n FROM d)
SELECT query_id, position, source, pg_id, title, score, nsfw, nsfw_score, CASE WHEN n > 20 THEN 20 END AS next_cursor
FROM r WHERE position <= 20"""


@register("keyword_search", KEYWORD_SQL, ("queries", "items", "sync_state"))
def keyword_search(fx):
    """Every query text against the items titles (plain and normalised substring match)."""
    p = S.SearchParams()
    return S.keyword_search(search_texts(fx), fx["items"], ITEMS, fx["sync_state"], p)


PAYLOAD_SQL = f"""
WITH n AS (SELECT id AS query_id, split_part(p_name, ' ', 1) AS q, node,
                  CASE WHEN {D.jtype('search_json', '$.data.torrentContent')} = 'OBJECT'
                       THEN TRY_CAST({D.jstr('search_json', '$.data.torrentContent.search.hasNextPage')} AS BOOLEAN) END AS has_next
           FROM (SELECT y.id, p.p_name, y.search_json,
                   unnest(CASE WHEN {D.jtype('y.search_json', '$.data.torrentContent')} = 'OBJECT'
                               THEN {D.jget('y.search_json', '$.data.torrentContent.search.items[*]')}
                               ELSE {D.jget('y.search_json', '$.data.torrents.edges[*].node')} END) AS node
                 FROM payload y JOIN part p ON p.p_partkey = y.id) t
           WHERE {D.jtype('node')} = 'OBJECT'),
h AS (SELECT query_id, q, has_next,
             {D.normalize_info_hash(f"coalesce(nullif({D.jstr('node', '$.infoHash')}, ''), {D.jstr('node', '$.torrent.infoHash')}, '')")} AS pg_id,
             coalesce(nullif({D.jstr('node', '$.torrent.name')}, ''), nullif({D.jstr('node', '$.name')}, ''),
                      nullif({D.jstr('node', '$.title')}, ''), '') AS title FROM n),
c AS (SELECT query_id, 'keyword_payload' AS source, pg_id, title, false AS nsfw, 0.0 AS nsfw_score,
             {D.keyword_score('q', 'title')} AS score, has_next, {_title_key('title', "'keyword_payload'", 'pg_id')} AS tkey
      FROM h WHERE pg_id <> '' AND title <> ''),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tkey ORDER BY score DESC, source, pg_id) AS k FROM c) t WHERE k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS position FROM d)
SELECT query_id, position, source, pg_id, title, score, nsfw, nsfw_score, CASE WHEN has_next THEN 20 END AS next_cursor
FROM r WHERE position <= 20"""


def _responses(fx):
    """(query_id, q, search_json); payloads are far larger than the file that they are made from, so never broadcast."""
    return fx["payload"].hint("merge").join(fx.table("part").select(F.col("p_partkey").alias("id"), "p_name"), "id").select(
        F.col("id").alias("query_id"), F.split("p_name", " ")[0].alias("q"), "search_json")


@register("keyword_search_payload", PAYLOAD_SQL, ("payload",))
def keyword_search_payload(fx):
    """Ranked hits from landed keyword payloads (query = first word of the part name)."""
    return S.keyword_search_payload(_responses(fx), fx["sync_state"], S.SearchParams(), "keyword_payload")


@register("item_files", f"""
SELECT f.file_id, f.info_hash, f.idx, f.path, f.size FROM files f
WHERE {D.normalize_info_hash('f.info_hash')} IN (
  SELECT {D.normalize_info_hash("sha1(CAST(conv_id AS VARCHAR))")} FROM conversations WHERE role = 'user')""", ("files",))
def item_files(fx):
    """Files of requested items (hashes in any accepted spelling), ordered by index, capped at 2000."""
    keys = fx.table("conversations").where(F.col("role") == "user").select(
        F.upper(F.sha1(F.col("conv_id").cast("string").cast("binary"))).alias("info_hash"))
    return S.item_files(keys, fx["files"], 2000).select("file_id", "info_hash", "idx", "path", "size")


@register("latest_items", f"""
SELECT c.type || ':' || c.source || ':' || c.id AS content_uid, c.id AS tmdb_id, c.title, c.updated_at, fe.genre, fe.keywords
FROM ({ITEMS_CONTENT_SQL}) c JOIN ({FILM_ENRICH_SQL}) fe ON fe.content_type = c.type AND fe.tmdb_id = c.id
WHERE c.source = '{FILM_SOURCE}'
ORDER BY c.updated_at DESC NULLS LAST, c.id LIMIT 50""", ("items", "enrich"))
def latest_items(fx):
    """E5: the newest 50 enriched film items (the limit is the feature)."""
    out = C.latest_items(items_content(fx), film_enrich(fx), 50, FILM_SOURCE)
    return out.select(F.concat_ws(":", "type", "source", "id").alias("content_uid"), F.col("id").alias("tmdb_id"),
                      "title", "updated_at", "genre", "keywords")


IMAGE_BASE = "https://images.example/w185"


@register("item_detail", f"""
WITH film AS (SELECT CASE WHEN c.release_year <= 30 THEN c.type ELSE 'OLD' END AS content_type, CAST(c.id AS VARCHAR) AS tmdb_id,
                     array_to_string(list_filter(coalesce(json_extract_string(y.film_json, '$.genres[*].name'), []::VARCHAR[]), lambda x: coalesce(x, '') <> ''), ', ') AS genre,
                     y.film_json AS raw, CAST(NULL AS TIMESTAMP) AS updated_at
              FROM catalog c JOIN payload y ON y.id = c.id),
keys AS (SELECT CASE WHEN id % 2 = 0 THEN type ELSE 'OTHER' END AS k_type, CAST(id AS VARCHAR) AS k_id FROM catalog),
cand AS (SELECT k.*, f.content_type, f.genre, f.raw,
                row_number() OVER (PARTITION BY k.k_type, k.k_id ORDER BY (f.content_type = k.k_type) DESC,
                                   f.updated_at DESC NULLS LAST, f.content_type) AS r
         FROM keys k JOIN film f ON f.tmdb_id = k.k_id)
SELECT k_type, k_id, content_type, genre,
       CASE WHEN coalesce(json_extract_string(raw, '$.poster_path'), '') <> '' THEN '{IMAGE_BASE}' || json_extract_string(raw, '$.poster_path') END AS poster_url
FROM cand WHERE r = 1""", ("catalog", "payload"))
def item_detail(fx):
    """Detail by (type, id) with fallback to the newest row of that id; poster URL from the payload."""
    film = _film_table(fx).withColumn("updated_at", F.lit(None).cast("timestamp"))
    keys = fx["catalog"].select(F.when(F.col("id") % 2 == 0, F.col("type")).otherwise(F.lit("OTHER")).alias("k_type"),
                                F.col("id").cast("string").alias("k_id"))
    out = C.item_detail(keys, film, IMAGE_BASE)
    return out.select("k_type", "k_id", "content_type", "genre", "poster_url")


@register("sync_status", f"""
SELECT 'items' AS name, (SELECT count(*) FROM items) AS total_rows,
       (SELECT count(*) FROM sync_state WHERE source = 'items') AS synced_rows,
       (SELECT max(updated_at) FROM items) AS max_updated_at,
       (SELECT max(updated_at) FROM sync_state WHERE source = 'items') AS last_sync_updated_at,
       (SELECT max(i.updated_at) FROM items i JOIN sync_state s ON s.source = 'items' AND s.pg_id = CAST(i.id AS VARCHAR)) AS max_synced_updated_at,
       (SELECT count(*) FROM sync_state WHERE source = 'items' AND last_error IS NOT NULL) AS errors,
       (SELECT count(*) FROM ({ITEMS_CONTENT_SQL}) c WHERE c.source = '{FILM_SOURCE}') AS content_total,
       (SELECT max(updated_at) FROM ({ITEMS_CONTENT_SQL}) c WHERE c.source = '{FILM_SOURCE}') AS content_latest,
       (SELECT count(*) FROM ({FILM_ENRICH_SQL}) e) AS enrichment_total,
       (SELECT max(updated_at) FROM ({FILM_ENRICH_SQL}) e) AS enrichment_latest,
       (SELECT count(*) FROM ({FILM_ENRICH_SQL}) e WHERE coalesce(aka, '') = '' AND coalesce(keywords, '') = '') AS enrichment_missing""",
          ("items", "sync_state", "enrich"))
def sync_status(fx):
    """Per-source sync status with the film enrichment status."""
    return C.sync_status({"items": fx["items"]}, fx["sync_state"], items_content(fx), film_enrich(fx),
                         {"items": ITEMS_SYNC}, FILM_SOURCE)


@register("status_report", """
SELECT 'status' AS section, status AS key, count(*) AS n, CAST(NULL AS TIMESTAMP) AS latest FROM enrich GROUP BY status
UNION ALL
SELECT 'by_source', content_type || ':' || content_source, count(*), max(updated_at) FROM enrich GROUP BY content_type, content_source
UNION ALL
SELECT 'latest_sync', source || ':' || pg_id, 1, updated_at FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.source ORDER BY s.updated_at DESC NULLS LAST, s.pg_id) AS r
  FROM sync_state s WHERE s.pg_id IN (SELECT pg_id FROM items)) t WHERE r = 1
UNION ALL
SELECT 'latest_match', content_type || ':' || content_source || ':' || content_id, 1, updated_at FROM (
  SELECT *, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, content_id) AS r FROM enrich) t WHERE r = 1
UNION ALL
SELECT 'latest_match_by_source', content_type || ':' || content_source || ':' || content_id, 1, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY content_type, content_source ORDER BY updated_at DESC NULLS LAST, content_id) AS r
  FROM enrich) t WHERE r = 1""", ("items", "sync_state", "enrich"))
def status_report(fx):
    """The status script's sections as one table."""
    return C.status_report(fx["enrich"], fx["sync_state"], fx["items"])


_FILM_OLD_SQL = """SELECT CASE p_partkey % 5 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv_show' ELSE 'tv' END AS content_type,
       CAST(p_partkey AS VARCHAR) AS tmdb_id FROM part WHERE p_size > 25"""


def _refs_film(fx):
    return fx["refs"].select("content_type", F.col("content_id").alias("tmdb_id"))


def _film_payloads(fx):
    r = fx["refs"].select("content_type", F.col("content_id").alias("tmdb_id"))
    y = fx["payload"].select(F.col("id").cast("string").alias("tmdb_id"), "film_json")
    return r.join(y, "tmdb_id")


def _film_existing(fx):
    p = fx.table("part").where(F.col("p_size") > 25)
    t = F.when(F.col("p_partkey") % 5 == 0, "movie").when(F.col("p_partkey") % 5 == 1, "tv_show").otherwise("tv")
    base = p.select(t.alias("content_type"), F.col("p_partkey").cast("string").alias("tmdb_id"))
    for c in ("aka", "keywords", "actors", "directors", "plot", "genre", "imdb_id"):
        base = base.withColumn(c, F.lit("old") if c == "genre" else F.lit(None).cast("string"))
    return base.select("content_type", "tmdb_id", "aka", "keywords", "actors", "directors", "plot", "genre", "imdb_id",
                       F.lit(None).cast("double").alias("imdb_rating"), F.lit(None).cast("double").alias("douban_rating"),
                       F.lit(None).cast("string").alias("raw"), F.lit(None).cast("timestamp").alias("updated_at"))


@register("film_enrichment_job", f"""
WITH old AS ({_FILM_OLD_SQL}),
todo AS (SELECT DISTINCT r.content_type, r.content_id AS tmdb_id FROM refs r
         WHERE r.content_type IN ('movie', 'tv_show', 'tv')
           AND NOT EXISTS (SELECT 1 FROM old o WHERE o.content_type = r.content_type AND o.tmdb_id = r.content_id)),
batch AS (SELECT t.content_type, t.tmdb_id,
            array_to_string(list_filter(coalesce(json_extract_string(y.film_json, '$.genres[*].name'), []::VARCHAR[]), lambda x: coalesce(x, '') <> ''), ', ') AS genre,
            (CASE WHEN {D.strip_ws("coalesce(json_extract_string(y.film_json, '$.imdbRating'), '')")} IN ('', 'N/A') THEN NULL
                  ELSE TRY_CAST({D.strip_ws("json_extract_string(y.film_json, '$.imdbRating')")} AS DOUBLE) END) AS imdb_rating
          FROM todo t JOIN payload y ON CAST(y.id AS VARCHAR) = t.tmdb_id)
SELECT content_type, tmdb_id, 'old' AS genre, CAST(NULL AS DOUBLE) AS imdb_rating FROM old o
WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.content_type = o.content_type AND b.tmdb_id = o.tmdb_id)
UNION ALL SELECT * FROM batch""", ("refs", "payload"))
def film_enrichment_job(fx):
    """All missing supported refs, normalised from payloads, upserted."""
    out = EN.film_enrichment_job(_refs_film(fx), _film_existing(fx), _film_payloads(fx), NOW)
    return out.select("content_type", "tmdb_id", "genre", "imdb_rating")


_SCENE_OLD_SQL = f"""SELECT content_type, content_source, content_id, status, updated_at FROM enrich"""


@register("scene_enrichment_job", f"""
WITH refs AS (SELECT 'doc' AS content_type, source AS content_source, pg_id AS content_id, title FROM items),
stale AS (SELECT r.* FROM refs r LEFT JOIN enrich e ON e.content_type = r.content_type AND e.content_source = r.content_source
            AND e.content_id = r.content_id
          WHERE e.content_id IS NULL OR e.updated_at IS NULL
             OR (epoch_us(TIMESTAMP '{NOW}') - epoch_us(e.updated_at)) / 3.6e9 >= CASE WHEN e.status = 'not_found' THEN 48.0 ELSE 240.0 END),
todo AS (SELECT * FROM stale),
batch AS (SELECT t.content_type, t.content_source, t.content_id,
            CASE WHEN y.id IS NULL THEN 'not_found' ELSE 'success' END AS status
          FROM todo t LEFT JOIN payload y ON CAST(y.id AS VARCHAR) = t.content_id)
SELECT content_type, content_source, content_id, status FROM enrich o
WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.content_type = o.content_type AND b.content_source = o.content_source
                  AND b.content_id = o.content_id)
UNION ALL SELECT * FROM batch""", ("items", "enrich", "payload"))
def scene_enrichment_job(fx):
    """All stale refs (TTL), candidates from payloads picked by code/title, upserted."""
    refs = fx["items"].select(F.lit("doc").alias("content_type"), F.col("source").alias("content_source"),
                              F.col("pg_id").alias("content_id"), "title")
    e = fx["enrich"]
    cols = ["tpdb_id", "title", "aka", "actors", "tags", "studio", "site", "release_date", "plot", "poster_url"]
    scene = e.select("content_type", "content_source", "content_id", *[F.lit(None).cast("string").alias(c) for c in cols],
                     F.lit(None).cast("string").alias("match_method"), F.lit(None).cast("double").alias("match_score"),
                     "status", F.col("updated_at").cast("timestamp").alias("updated_at"))
    pay = refs.join(fx["payload"].select(F.col("id").cast("string").alias("content_id"), "scene_json"), "content_id").drop("title")
    out = EN.scene_enrichment_job(refs, scene, pay, NOW, 240.0, 48.0, "data.searchScene")
    return out.select("content_type", "content_source", "content_id", "status")


_FULL_F, _FULL_RAW = D.query_file_type("g.q")
_FULL_A, _FULL_S = D.detect_languages(_FULL_RAW)
_CLEANED = (f"SELECT query_id, CASE WHEN {_CLEAN_Q} <> '' THEN {_CLEAN_Q} ELSE coalesce(q, '') END AS q FROM ({SEARCH_TEXTS_SQL}) qt")
FULL_SQL = f"""
WITH g AS (SELECT t.query_id, t.q, a.embedding AS qvec, b.embedding AS svec FROM ({SEARCH_TEXTS_SQL}) t
           JOIN points a ON a.vec_id = t.query_id * 3 % 500 JOIN points b ON b.vec_id = (t.query_id * 7 + 1) % 500),
{TERMS_SQL.replace(SEARCH_TEXTS_SQL, _CLEANED)},
{ENGLISH_SQL},
f AS (SELECT g.query_id, g.qvec, {_FULL_F} AS file_type, {_FULL_A} AS audio, {_FULL_S} AS subs, {D.query_genres(_FULL_RAW)} AS genres FROM g),
s AS (SELECT f.query_id, p.source, p.pg_id, p.text_hash, coalesce(p.nsfw, false) AS nsfw, round({COS}, 6) AS score
      FROM f, points p
      WHERE (f.file_type IS NULL OR p.file_type = f.file_type)
        AND (len(f.audio) = 0 OR list_has_any(p.audio_langs, f.audio))
        AND (len(f.subs) = 0 OR list_has_any(p.subtitle_langs, f.subs))
        AND (len(f.genres) = 0 OR list_has_any(p.genre_tags, f.genres))),
prim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS r FROM s) t WHERE r <= 20),
second AS (SELECT g.query_id, g.svec AS qvec FROM g JOIN qt ON qt.query_id = g.query_id JOIN english e ON e.query_id = g.query_id
           WHERE e.english <> '' AND NOT {D.is_ascii('qt.q')}),
s2 AS (SELECT f.query_id, p.source, p.pg_id, p.text_hash, coalesce(p.nsfw, false) AS nsfw, round({COS}, 6) AS score FROM second f, points p),
sec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS r FROM s2) t WHERE r <= 20),
both_ AS (SELECT * FROM prim UNION ALL SELECT * FROM sec WHERE NOT EXISTS (
          SELECT 1 FROM prim WHERE prim.query_id = sec.query_id AND prim.source = sec.source AND prim.pg_id = sec.pg_id)),
merged AS (SELECT * FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS rank
           FROM both_) t WHERE rank <= 20),
""" + HITS_SQL.replace("HITS_OF", "merged")


@register("cross_language_search", FULL_SQL, ("queries", "points", "items", "enrich"))
def cross_language_search(fx):
    """V10 within the whole of E1, with given vectors: expansion, English second search for non-ASCII queries, merge."""
    p = S.SearchParams(expand=True, film_source=FILM_SOURCE, query_prefix="query: ")
    vec = fx["points"].select("vec_id", "embedding")
    q = search_texts(fx).withColumn("_a", F.col("query_id") * 3 % 500).withColumn("_b", (F.col("query_id") * 7 + 1) % 500)
    q = (q.join(vec.toDF("_a", "qvec"), "_a").join(vec.toDF("_b", "svec"), "_b").drop("_a", "_b"))
    return S.semantic_search(q, fx["points"], _rows(fx), p, film=film_enrich(fx), content=items_content(fx), qvec="qvec", svec="svec")


_SCENE_TEXT = f"""(CASE WHEN {D.normalize_title('p.text')} <> '' THEN {D.normalize_title('p.text')} ELSE coalesce(p.text, '') END
  || CASE WHEN coalesce(e.match_id, '') <> '' AND coalesce(e.aka, '') <> '' THEN chr(10) || e.aka || chr(10) || e.aka ELSE '' END)"""
_TEXT_PREFIX = ("upper(regexp_extract(coalesce(p.text, ''), '(?:^|[^" + D.WORD + "])([A-Za-z]{2,6})[-_ ]?\\p{Nd}{2,5}(?:$|[^" + D.WORD + "])', 1))")
_JOB_A, _JOB_S = D.detect_languages("p.text")
_FILM_TEXT = f"(CASE WHEN {D.normalize_title('p.text')} <> '' THEN {D.normalize_title('p.text')} ELSE coalesce(p.text, '') END)"


@register("sync_job", f"""
WITH pend AS ({__import__("catalux.registry.joins", fromlist=["x"]).PENDING_SQL}),
films AS (SELECT r.content_id AS pg_id, concat_ws(' ', r.title, CASE WHEN r.content_type IN ('movie', 'tv', 'tv_show') THEN p.p_type || ', War' END,
                 CASE WHEN r.content_type IN ('movie', 'tv', 'tv_show') THEN p.p_name END) AS text
          FROM refs r JOIN part p ON CAST(p.p_partkey AS VARCHAR) = r.content_id)
SELECT 'items' AS source, p.pg_id, round({D.safety_score(_SCENE_TEXT)}, 6) >= 0.7 AS nsfw, round({D.safety_score(_SCENE_TEXT)}, 6) AS nsfw_score,
       p.text_hash, coalesce(e.match_id, '') <> '' AS has_tpdb, e.match_id AS tpdb_id, {D.file_type(D.file_extension('p.text'))} AS file_type,
       {_JOB_A} AS audio_langs, {_JOB_S} AS subtitle_langs, CASE WHEN TRY_CAST(p.size AS DOUBLE) > 0 THEN TRY_CAST(p.size AS DOUBLE) END AS size, 64 AS dim
FROM pend p LEFT JOIN enrich e ON e.content_type = 'doc' AND e.content_source = 'src1' AND e.content_id = p.pg_id
WHERE NOT ({_TEXT_PREFIX} <> '' AND {_TEXT_PREFIX} NOT IN ({', '.join(D.lit(x) for x in fixed.CODE_STOP_PREFIXES)})) OR coalesce(e.match_id, '') <> ''
UNION ALL
SELECT 'films', p.pg_id, round({D.safety_score(_FILM_TEXT)}, 6) >= 0.7, round({D.safety_score(_FILM_TEXT)}, 6), md5(p.text), false, NULL,
       {D.file_type(D.file_extension('p.text'))}, {_JOB_A}, {_JOB_S}, NULL, 64 FROM films p""", ("items", "sync_state", "enrich", "refs"))
def sync_job(fx):
    """E11 over two sources: missing films enriched, pending rows gated, embedded, scored; new points and state."""
    items = SourceSpec(name="items", id_field="id", text_field="text", updated_at_field="updated_at",
                       extra_fields=("lang", "size", "title"), size_field="size", scene_enrich=True,
                       scene_key=("doc", "src1"))
    films = SourceSpec(name="films", id_field="content_id", text_field="text", extra_fields=("content_type", "content_id"),
                       size_field=None, film_refs=("content_type", "content_id"))
    scene = fx["enrich"].select("content_type", "content_source", "content_id", F.col("match_id").alias("tpdb_id"),
                                F.col("aka").alias("title"), "aka", F.lit(None).cast("string").alias("original_title"),
                                *[F.lit(None).cast("string").alias(c) for c in
                                  ("actors", "tags", "studio", "series", "site", "release_date", "plot", "poster_url")])
    refs = fx["refs"].select("content_type", "content_id", "title")

    def film_rows(film):
        found = film.select("content_type", F.col("tmdb_id").alias("content_id"), "genre", "plot")
        return refs.join(found, ["content_type", "content_id"], "left").select(
            "content_type", "content_id", F.concat_ws(" ", "title", "genre", "plot").alias("text"))

    payloads = refs.select("content_type", F.col("content_id").alias("tmdb_id")).join(
        fx["payload"].select(F.col("id").cast("string").alias("tmdb_id"), "film_json"), "tmdb_id")
    none = fx.spark.createDataFrame([], FILM_TABLE)
    pts, _, _, _ = SY.sync_all({"items": (items, fx["items"]), "films": (films, film_rows)}, fx["sync_state"], None,
                               SY.SyncParams(now=NOW, dim=64), scene=scene, film=SY.FilmInputs(none, payloads))
    return pts.select("source", "pg_id", "nsfw", F.round("nsfw_score", 6).alias("nsfw_score"), "text_hash",
                      "has_tpdb", "tpdb_id", "file_type", "audio_langs", "subtitle_langs", "size",
                      F.size("embedding").cast("bigint").alias("dim"))


@register("page_payload", PAYLOAD_SQL.replace("position <= 20", "position <= 5").replace("THEN 20 END AS next_cursor",
                                                                                       "THEN 15 END AS next_cursor"),
          ("payload",))
def page_payload(fx):
    """First page_size (5) of the deduped payload hits; next cursor = offset (10) + page_size if more pages."""
    return S.keyword_search_payload(_responses(fx), fx["sync_state"], S.SearchParams(page_size=5, cursor=10), "keyword_payload")


_EMB = f"(CASE WHEN {D.normalize_title('p.text')} <> '' THEN {D.normalize_title('p.text')} ELSE coalesce(p.text, '') END)"
_PA, _PS = D.detect_languages("p.text")


@register("point_payload", f"""
WITH p AS ({__import__("catalux.registry.joins", fromlist=["x"]).PENDING_SQL})
SELECT 'items' AS source, p.pg_id, round({D.safety_score(_EMB)}, 6) >= 0.7 AS nsfw, round({D.safety_score(_EMB)}, 6) AS nsfw_score,
       p.text_hash, 'v1' AS embedding_version, false AS has_tmdb, CAST(NULL AS VARCHAR) AS tmdb_id, false AS has_tpdb,
       CAST(NULL AS VARCHAR) AS tpdb_id, []::VARCHAR[] AS genre_tags, {D.file_type(D.file_extension('p.text'))} AS file_type,
       {_PA} AS audio_langs, {_PS} AS subtitle_langs,
       CASE WHEN TRY_CAST(p.size AS DOUBLE) > 0 THEN TRY_CAST(p.size AS DOUBLE) END AS size
FROM p""", ("items", "sync_state"))
def point_payload(fx):
    """The 15-field payload of each pending row's point (vector excluded)."""
    rows = SY.prepare(fx["items"], ITEMS_SYNC, fx["sync_state"], None)
    out = SY.point_payload(rows, ITEMS_SYNC, SY.SyncParams(now=NOW))
    return out.select("source", "pg_id", "nsfw", F.round("nsfw_score", 6).alias("nsfw_score"), "text_hash",
                      "embedding_version", "has_tmdb", "tmdb_id", "has_tpdb", "tpdb_id", "genre_tags", "file_type",
                      "audio_langs", "subtitle_langs", "size")
