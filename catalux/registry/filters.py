"""Registered queries: filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalux.functions import fixed
from catalux.functions.text import extract_code
from catalux.operators import filters as FL
from catalux.registry import duck as D
from catalux.registry import register
from catalux.registry.common import ITEMS

SIZE_MIN = 100 * 1048576
STRIP = D.lit(fixed.KEYWORD_STRIP_CHARS)


@register("keyword_filter", """
SELECT id, title FROM items WHERE title ILIKE '%the%' OR text ILIKE '%the%'""", ("items",))
def keyword_filter(fx):
    """any keyword field ILIKE %q% (whole texts)."""
    return FL.keyword_filter(fx["items"], "the", fields=["title", "text"], text_field="title").select("id", "title")


@register("keyword_filter_normalized", f"""
SELECT id, title FROM items
WHERE title ILIKE '%标题 中文%' OR translate(lower(title), {STRIP}, '') LIKE '%标题中文%'
   OR title ILIKE '%abc123%' OR translate(lower(title), {STRIP}, '') LIKE '%abc123%'""", ("items",))
def keyword_filter_normalized(fx):
    """CJK query enables the normalised branch; an option enables it for ASCII."""
    it = fx["items"]
    p = FL.keyword_predicate("标题 中文", ["title"]) | FL.keyword_predicate("abc123", ["title"], True)
    return it.where(p).select("id", "title")


@register("id_lookup", "SELECT id, pg_id FROM items WHERE pg_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
          ("items",))
def id_lookup(fx):
    """id IN list, as a semi join against the id table."""
    return FL.id_lookup(fx["items"], fx.table("labels"), "pg_id", "doc_id").select("id", "pg_id")


@register("composite_id_lookup", """
SELECT f.file_id, f.idx FROM files f
WHERE EXISTS (SELECT 1 FROM conversations c
              WHERE c.role = 'user' AND sha1(CAST(c.conv_id AS VARCHAR)) = f.info_hash AND c.turn = f.idx)""",
          ("files",))
def composite_id_lookup(fx):
    """'hash:index' ids parsed and matched on the pair (ids from user turns)."""
    conv = fx.table("conversations").where(F.col("role") == "user")
    ids = conv.select(F.concat(F.lit("\\x"), F.sha1(F.col("conv_id").cast("string").cast("binary")), F.lit(":"),
                               F.col("turn").cast("string")).alias("id"))
    return FL.composite_id_lookup(fx["files"], ids, "info_hash", "idx", "file_id", "id").select("file_id", "idx")


@register("size_min_filter", f"SELECT vec_id FROM points WHERE TRY_CAST(size AS DOUBLE) >= {SIZE_MIN}", ("points",))
def size_min_filter(fx):
    """F5."""
    return fx["points"].where(FL.size_min_filter("size", FL.size_min_bytes(0.09765625))).select("vec_id")


@register("has_external_id_filter", "SELECT vec_id FROM points WHERE tmdb_id IS NOT NULL AND tmdb_id <> ''",
          ("points",))
def has_external_id_filter(fx):
    """F6."""
    return fx["points"].where(FL.has_external_id("tmdb_id")).select("vec_id")


@register("genre_any_filter", "SELECT vec_id FROM points WHERE list_has_any(genre_tags, ['War', 'Thriller'])",
          ("points",))
def genre_any_filter(fx):
    """F7."""
    return fx["points"].where(FL.any_of("genre_tags", ["War", "Thriller"])).select("vec_id")


@register("file_type_filter", "SELECT vec_id FROM points WHERE file_type = 'audio'", ("points",))
def file_type_filter(fx):
    """F8."""
    return fx["points"].where(F.col("file_type") == "audio").select("vec_id")


@register("audio_lang_any_filter", "SELECT vec_id FROM points WHERE list_has_any(audio_langs, ['en', 'jp'])",
          ("points",))
def audio_lang_any_filter(fx):
    """F9."""
    return fx["points"].where(FL.any_of("audio_langs", ["en", "jp"])).select("vec_id")


@register("subtitle_lang_any_filter", "SELECT vec_id FROM points WHERE list_has_any(subtitle_langs, ['de'])",
          ("points",))
def subtitle_lang_any_filter(fx):
    """F10."""
    return fx["points"].where(FL.any_of("subtitle_langs", ["de"])).select("vec_id")


@register("combined_metadata_filter", f"""
SELECT vec_id FROM points
WHERE tmdb_id IS NOT NULL AND tmdb_id <> '' AND list_has_any(genre_tags, ['Action'])
  AND file_type = 'video' AND list_has_any(audio_langs, ['zh']) AND list_has_any(subtitle_langs, ['en'])
  AND TRY_CAST(size AS DOUBLE) >= {SIZE_MIN}""", ("points",))
def combined_metadata_filter(fx):
    """AND of F5-F10."""
    pred = FL.metadata_filter(has_ext=True, genres=["Action"], file_type="video", audio_langs=["zh"],
                              subtitle_langs=["en"], size_min=SIZE_MIN)
    return fx["points"].where(pred).select("vec_id")


@register("safety_filter", "SELECT vec_id FROM points WHERE NOT coalesce(nsfw, false)", ("points",))
def safety_filter(fx):
    """F12."""
    return fx["points"].where(FL.safety_filter("nsfw", True)).select("vec_id")


@register("user_predicate", """
SELECT id FROM items WHERE (title ILIKE '%the%') AND (lang = 'en') AND (size > 1000)""", ("items",))
def user_predicate(fx):
    """the source's predicate text AND-ed with generated ones."""
    it = fx["items"]
    return it.where(FL.keyword_predicate("the", ["title"]) & FL.user_predicate("lang = 'en'", "size > 1000", "")
                    ).select("id")


@register("code_regex_filter", """
SELECT id FROM items WHERE regexp_matches(title, '(^|[^A-Za-z0-9])[A-Za-z]{2,6}[-_ ]?[0-9]{2,5}($|[^A-Za-z0-9])')""",
          ("items",))
def code_regex_filter(fx):
    """code pattern with look-around (oracle restates it with consumed borders)."""
    return fx["items"].where(FL.code_regex_filter("title")).select("id")


@register("missing_enrichment_filter", """
SELECT content_id FROM enrich WHERE coalesce(aka, '') = '' AND coalesce(keywords, '') = ''""", ("enrich",))
def missing_enrichment_filter(fx):
    """F15."""
    return fx["enrich"].where(FL.missing_enrichment()).select("content_id")


@register("source_selection", """
SELECT 'explicit' AS rule, id, source FROM items WHERE source IN ('src1', 'src3', 'src17')
UNION ALL SELECT 'flagged', id, source FROM items WHERE source < 'src5'
UNION ALL SELECT 'needs_field', id, source FROM items WHERE source < 'src5' AND source <> 'src2'
UNION ALL SELECT 'all', id, source FROM items""", ("items",))
def source_selection(fx):
    """F16: explicit list, else flagged sources, else all; those without a required field are skipped (src2)."""
    it = fx["items"]
    own = F.array_except(F.array(F.lit("id"), F.lit("title"), F.lit("tmdb_id")),
                         F.when(F.col("source") == "src2", F.array(F.lit("tmdb_id"))).otherwise(F.array(F.lit(""))))
    specs = it.select(F.col("source").alias("name"), (F.col("source") < "src5").alias("keyword_search"),
                      own.alias("fields")).distinct()
    rules = {"explicit": FL.select_sources(specs, explicit="src1, src3,src17, none"), "flagged": FL.select_sources(specs),
             "needs_field": FL.select_sources(specs, require_field="tmdb_id"),
             "all": FL.select_sources(specs.withColumn("keyword_search", F.lit(False)))}
    parts = [it.join(chosen.select("name"), F.col("source") == F.col("name"), "left_semi").select(
        F.lit(rule).alias("rule"), "id", "source") for rule, chosen in rules.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


_PREFIX = "upper(regexp_extract(coalesce(i.title, ''), '(?:^|[^" + D.WORD + "])([A-Za-z]{2,6})[-_ ]?\\p{Nd}{2,5}(?:$|[^" + D.WORD + "])', 1))"


@register("code_gate", f"""
SELECT i.id FROM items i LEFT JOIN enrich e ON e.content_id = i.pg_id
WHERE NOT ({_PREFIX} <> '' AND {_PREFIX} NOT IN ({', '.join(D.lit(p) for p in fixed.CODE_STOP_PREFIXES)}))
   OR (e.match_id IS NOT NULL AND e.match_id <> '')""", ("items", "enrich"))
def code_gate(fx):
    """drop coded titles without a match (prefix stop-list applies)."""
    it, en = fx["items"], fx["enrich"].select("content_id", "match_id")
    j = it.join(en, it["pg_id"] == en["content_id"], "left")
    return j.where(FL.code_gate("title", "match_id")).select("id")


@register("supported_type_filter", """
SELECT content_id, content_type, coalesce(content_type IN ('movie', 'tv_show', 'tv'), false) AS supported FROM refs""", ("refs",))
def supported_type_filter(fx):
    """supported refs flagged; the unsupported ones listed alongside."""
    r = fx["refs"]
    return r.select("content_id", "content_type", FL.supported_type("content_type").alias("supported"))


@register("ref_completeness_filter", f"""
SELECT content_id, {D.extract_code('raw_title')} IS NOT NULL AS has_code FROM refs
WHERE coalesce(content_type, '') <> '' AND coalesce(content_source, '') <> '' AND coalesce(content_id, '') <> ''""",
          ("refs",))
def ref_completeness_filter(fx):
    """complete keys only; the code requirement reported per ref."""
    r = fx["refs"].where(FL.ref_complete())
    return r.select("content_id", extract_code("raw_title").isNotNull().alias("has_code"))
