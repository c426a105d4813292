"""Registered queries: scalar functions.

Each applies the Column expression to a whole table column and returns the
row key with the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalux.functions import text as X
from catalux.functions.query import query_filters, query_genres, query_tokens
from catalux.registry import duck as D
from catalux.registry import register

# Query texts: the fixed query fixture plus every item title, so the work
# grows with the items table.
QUERY_TEXTS_SQL = """
SELECT CAST(query_id AS BIGINT) AS query_id, q FROM queries
UNION ALL
SELECT 1000000000 + id AS query_id, title AS q FROM items"""


# A search takes the fixture and the titles of the items whose id is divisible by 50.
SEARCH_TEXTS_SQL = QUERY_TEXTS_SQL + " WHERE id % 50 = 0"


def search_texts(fx):
    it = fx["items"].where(F.col("id") % 50 == 0).select(
        (F.lit(1000000000) + F.col("id")).alias("query_id"), F.col("title").alias("q"))
    return fx["queries"].select(F.col("query_id").cast("bigint").alias("query_id"), "q").unionByName(it)


def query_texts(fx):
    qs = fx["queries"].select(F.col("query_id").cast("bigint").alias("query_id"), "q")
    it = fx["items"].select((F.lit(1000000000) + F.col("id")).alias("query_id"), F.col("title").alias("q"))
    return qs.unionByName(it)


@register("normalize_title", f"SELECT doc_id, {D.normalize_title('text')} AS norm_title FROM documents")
def normalize_title(fx):
    """X1 on whole document texts."""
    return fx.table("documents").select("doc_id", X.normalize_title("text").alias("norm_title"))


@register("text_hash", "SELECT doc_id, sha1(text) AS text_hash FROM documents")
def text_hash(fx):
    """X2."""
    return fx.table("documents").select("doc_id", X.text_hash("text").alias("text_hash"))


@register("content_md5", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def content_md5(fx):
    """X3."""
    return fx.table("documents").select("doc_id", X.content_md5("text").alias("text_md5"))


@register("file_extension", f"SELECT file_id, {D.file_extension('path')} AS extension FROM files", ("files",))
def file_extension(fx):
    """X4."""
    return fx["files"].select("file_id", X.file_extension("path").alias("extension"))


@register("file_type", f"SELECT file_id, {D.file_type(D.file_extension('path'))} AS file_type FROM files",
          ("files",))
def file_type(fx):
    """X5."""
    return fx["files"].select("file_id", X.file_type(X.file_extension("path")).alias("file_type"))


_A, _S = D.detect_languages("text")


@register("detect_languages", f"SELECT doc_id, {_A} AS audio_langs, {_S} AS subtitle_langs FROM documents")
def detect_languages(fx):
    """X6 on whole document texts."""
    a, s = X.detect_languages("text")
    return fx.table("documents").select("doc_id", a.alias("audio_langs"), s.alias("subtitle_langs"))


@register("genre_tags", f"""
SELECT content_id, {D.genre_tags('genre')} AS genre_tags, {D.genre_tags('keywords')} AS keyword_tags
FROM enrich""", ("enrich",))
def genre_tags(fx):
    """X7 (genre and keyword lists, both comma kinds)."""
    return fx["enrich"].select("content_id", X.genre_tags("genre").alias("genre_tags"),
                               X.genre_tags("keywords").alias("keyword_tags"))


@register("query_genres", f"SELECT query_id, {D.query_genres('q')} AS genres FROM ({QUERY_TEXTS_SQL}) t",
          ("queries", "items"))
def query_genres_q(fx):
    """X8 over query texts."""
    return query_texts(fx).select("query_id", query_genres("q").alias("genres"))


_FT, _RAW = D.query_file_type("q")
_QA, _QS = D.detect_languages(_RAW)
_CLEAN = D.strip_ws(_RAW)


@register("query_filters", f"""
SELECT query_id,
       CASE WHEN {_CLEAN} <> '' THEN {_CLEAN} ELSE coalesce(q, '') END AS cleaned,
       {_FT} AS file_type, {_QA} AS audio_langs, {_QS} AS subtitle_langs, {D.query_genres(_RAW)} AS genres
FROM ({QUERY_TEXTS_SQL}) t""", ("queries", "items"))
def query_filters_q(fx):
    """X9 over query texts."""
    f = query_filters("q")
    return query_texts(fx).select("query_id", *[f[k].alias(k) for k in
                                                ("cleaned", "file_type", "audio_langs", "subtitle_langs", "genres")])


@register("query_tokens", f"""
SELECT query_id, nullif(regexp_extract(coalesce(q, ''), '([a-zA-Z0-9]+)', 1), '') AS ascii_token,
       nullif(regexp_extract(coalesce(q, ''), '([^\\x00-\\x7F]+)', 1), '') AS other_token
FROM ({QUERY_TEXTS_SQL}) t""", ("queries", "items"))
def query_tokens_q(fx):
    """X12 over query texts."""
    a, o = query_tokens("q")
    return query_texts(fx).select("query_id", a.alias("ascii_token"), o.alias("other_token"))


@register("keyword_score", f"""
SELECT id, {D.keyword_score("split_part(title, ' ', 2)", 'title')} AS kw_score,
       {D.keyword_score('title', 'title')} AS self_score, {D.keyword_score("'zzz'", 'title')} AS miss_score,
       {D.keyword_score("''", 'title')} AS empty_score
FROM items""", ("items",))
def keyword_score(fx):
    """Second word of the title, the title itself, an absent word, an empty query."""
    it = fx["items"]
    second = F.coalesce(F.try_element_at(F.split("title", " "), F.lit(2)), F.lit(""))
    return it.select("id", X.keyword_score(second, "title").alias("kw_score"),
                     X.keyword_score("title", "title").alias("self_score"),
                     X.keyword_score(F.lit("zzz"), "title").alias("miss_score"),
                     X.keyword_score(F.lit(""), "title").alias("empty_score"))


@register("normalize_info_hash", f"""
SELECT file_id, {D.normalize_info_hash('info_hash')} AS h_plain, {D.normalize_info_hash("'\\x' || upper(info_hash)")} AS h_prefixed,
       {D.normalize_info_hash('file_id')} AS h_other
FROM files""", ("files",))
def normalize_info_hash(fx):
    """Plain hex, prefixed upper-case hex, and a non-hash id."""
    f = fx["files"]
    return f.select("file_id", X.normalize_info_hash("info_hash").alias("h_plain"),
                    X.normalize_info_hash(F.concat(F.lit("\\x"), F.upper("info_hash"))).alias("h_prefixed"),
                    X.normalize_info_hash("file_id").alias("h_other"))


@register("bare_info_hash", f"""
SELECT file_id, {D.bare_info_hash("'\\x' || info_hash")} AS b_prefixed, {D.bare_info_hash('file_id')} AS b_other,
       {D.bare_info_hash('info_hash || substring(info_hash, 1, 24)')} AS b_64,
       {D.bare_info_hash('info_hash || info_hash')} AS b_80
FROM files""", ("files",))
def bare_info_hash(fx):
    """Prefixed 40 hex, a composite id, 64 hex, 80 hex."""
    f = fx["files"]
    return f.select("file_id", X.bare_info_hash(F.concat(F.lit("\\x"), F.col("info_hash"))).alias("b_prefixed"),
                    X.bare_info_hash("file_id").alias("b_other"),
                    X.bare_info_hash(F.concat("info_hash", F.substring("info_hash", 1, 24))).alias("b_64"),
                    X.bare_info_hash(F.concat("info_hash", "info_hash")).alias("b_80"))


@register("size_coalesce", """
SELECT p_partkey, coalesce(
    CASE WHEN TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size - 20 END AS DOUBLE) > 0
         THEN TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size - 20 END AS DOUBLE) END,
    CASE WHEN TRY_CAST(p_brand AS DOUBLE) > 0 THEN TRY_CAST(p_brand AS DOUBLE) END,
    CASE WHEN TRY_CAST(CAST(p_partkey % 7 AS VARCHAR) AS DOUBLE) > 0 THEN TRY_CAST(CAST(p_partkey % 7 AS VARCHAR) AS DOUBLE) END,
    CASE WHEN p_retailprice > 0 THEN p_retailprice END) AS size
FROM part""")
def size_coalesce(fx):
    """NULL / negative / text / numeric-text candidates, first positive wins."""
    p = fx.table("part")
    return p.select("p_partkey", X.size_coalesce(
        F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.col("p_size") - 20),
        F.col("p_brand"), (F.col("p_partkey") % 7).cast("string"), F.col("p_retailprice")).alias("size"))


@register("extract_code", f"SELECT id, {D.extract_code('title')} AS code, {D.extract_code('text')} AS text_code FROM items",
          ("items",))
def extract_code(fx):
    """X18 on titles (real and false codes) and whole texts."""
    return fx["items"].select("id", X.extract_code("title").alias("code"), X.extract_code("text").alias("text_code"))


@register("point_id", f"SELECT id, {D.point_id(chr(39) + 'items' + chr(39), 'pg_id')} AS point_id FROM items",
          ("items",))
def point_id(fx):
    """UUIDv5 of 'source:pg_id'."""
    return fx["items"].select("id", X.point_id(F.lit("items"), "pg_id").alias("point_id"))


@register("safety_score", f"SELECT doc_id, round({D.safety_score('text')}, 6) AS nsfw_score FROM documents")
def safety_score(fx):
    """X27 on whole texts."""
    return fx.table("documents").select("doc_id", F.round(X.safety_score("text"), 6).alias("nsfw_score"))


@register("safety_flag", f"""
SELECT doc_id, CASE WHEN source <> 'src0' THEN coalesce({D.safety_score('text')}, 0.0) >= 0.7 ELSE false END AS nsfw
FROM documents""")
def safety_flag(fx):
    """Flag where tagging is on (every source except src0)."""
    d = fx.table("documents")
    return d.select("doc_id", X.safety_flag(X.safety_score("text"), F.col("source") != "src0").alias("nsfw"))


@register("truncate_text", "SELECT doc_id, substring(text, 1, 256) AS embed_input FROM documents")
def truncate_text(fx):
    """X30."""
    return fx.table("documents").select("doc_id", X.truncate_text("text").alias("embed_input"))


_PT = D.strip_ws("coalesce(title, '')")
_OT = D.strip_ws("coalesce(CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN title ELSE lang || ' 标题' END, '')")
_CJK = "[\\x{4e00}-\\x{9fff}]"


@register("preferred_titles", f"""
SELECT id,
  CASE WHEN regexp_matches({_PT}, '{_CJK}') THEN {_PT} WHEN regexp_matches({_OT}, '{_CJK}') THEN {_OT}
       WHEN {_PT} <> '' THEN {_PT} WHEN {_OT} <> '' THEN {_OT} ELSE '(无标题)' END AS primary_title,
  CASE WHEN regexp_matches({_PT}, '{_CJK}') THEN (CASE WHEN {_PT} <> {_OT} THEN {_OT} ELSE '' END)
       WHEN regexp_matches({_OT}, '{_CJK}') THEN (CASE WHEN {_PT} <> '' AND {_PT} <> {_OT} THEN {_PT} ELSE '' END)
       WHEN {_PT} <> '' THEN (CASE WHEN {_PT} <> {_OT} THEN {_OT} ELSE '' END) ELSE '' END AS secondary_title
FROM items""", ("items",))
def preferred_titles(fx):
    """CJK title first; the other one as secondary when different."""
    it = fx["items"]
    orig = (F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.col("title"))
            .otherwise(F.concat(F.col("lang"), F.lit(" 标题"))))
    p, s = X.preferred_titles("title", orig)
    return it.select("id", p.alias("primary_title"), s.alias("secondary_title"))


@register("magnet_uri", f"""
SELECT file_id, CASE WHEN {D.bare_info_hash('info_hash')} = '' THEN ''
  ELSE 'magnet:?xt=urn:btih:' || {D.bare_info_hash('info_hash')} || '&dn=' || {D.uri_component("coalesce(nullif(role || ' ' || path, ''), 'torrent')")} END AS magnet
FROM files""", ("files",))
def magnet_uri(fx):
    """Magnet link from the hash and the encoded name."""
    f = fx["files"]
    return f.select("file_id", X.magnet_uri("info_hash", F.concat_ws(" ", "role", "path")).alias("magnet"))


@register("pretty_size", f"""
SELECT l_orderkey, l_linenumber, {D.pretty_size('l_extendedprice * l_quantity * 1024')} AS size_text,
       {D.pretty_size('l_quantity')} AS qty_text
FROM lineitem""")
def pretty_size(fx):
    """X33 over every line item (B..TB)."""
    li = fx.table("lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     X.pretty_size(F.col("l_extendedprice") * F.col("l_quantity") * 1024).alias("size_text"),
                     X.pretty_size("l_quantity").alias("qty_text"))


@register("rating_value", f"""
SELECT event_id, {D.rating_value("CASE WHEN event_type = 'error' THEN 'N/A' END", 'props', 'value')} AS rating,
       {D.rating_value('value')} AS value_rating
FROM events""")
def rating_value(fx):
    """First parseable candidate; >= 10 rounded, else one decimal."""
    e = fx.table("events")
    return e.select("event_id", X.rating_value(F.when(F.col("event_type") == "error", F.lit("N/A")),
                                               "props", "value").alias("rating"),
                    X.rating_value("value").alias("value_rating"))


@register("preview_text", f"""
SELECT doc_id, {D.preview_text("CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END", 'source')} AS preview
FROM documents""")
def preview_text(fx):
    """First non-empty candidate cut to 90 characters."""
    d = fx.table("documents")
    return d.select("doc_id", X.preview_text(F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("text")),
                                             "source").alias("preview"))


@register("token_preview", f"SELECT content_id, {D.token_preview('aka')} AS aka_preview, "
                           f"{D.token_preview('keywords')} AS keyword_preview FROM enrich", ("enrich",))
def token_preview(fx):
    """First three list tokens joined by ' · '."""
    e = fx["enrich"]
    return e.select("content_id", X.token_preview("aka").alias("aka_preview"),
                    X.token_preview("keywords").alias("keyword_preview"))
