"""Shared specs and derived inputs for registered queries (Spark and SQL text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalux.spec import JoinSpec, SourceSpec

# Search view of the items table: results show the title.
ITEMS = SourceSpec(name="items", id_field="id", text_field="title", updated_at_field="updated_at",
                   extra_fields=("lang", "size"), keyword_fields=("title",), size_field="size")
# Sync view of the same table: the body text is what gets hashed and embedded.
ITEMS_SYNC = SourceSpec(name="items", id_field="id", text_field="text", updated_at_field="updated_at",
                        extra_fields=("lang", "size"), size_field="size")
NOW = "2024-01-20 00:00:00"
FILM_SOURCE = "src1"   # items of this source act as the film catalogue
CATALOG_FILM_SOURCE = "Brand#1"


def items_content(fx):
    """Items as catalogue content: (type, source, id, title, original_title, updated_at)."""
    return fx["items"].select(F.lit("doc").alias("type"), "source", F.col("pg_id").alias("id"), "title",
                              F.lit(None).cast("string").alias("original_title"), "updated_at")


ITEMS_CONTENT_SQL = """SELECT 'doc' AS type, source, pg_id AS id, title, CAST(NULL AS VARCHAR) AS original_title, updated_at
FROM items"""


def film_enrich(fx):
    """The enrich fixture as a film enrichment table keyed (content_type, tmdb_id)."""
    return fx["enrich"].select("content_type", F.col("content_id").alias("tmdb_id"), "aka", "keywords", "genre",
                               "updated_at")


FILM_ENRICH_SQL = """SELECT content_type, content_id AS tmdb_id, aka, keywords, genre, updated_at FROM enrich"""

FILES_JOIN = JoinSpec(table="files", on_left=("id",), on_right=("parent_id",), how="left",
                      fields={"paths": "path"}, agg="array_agg", order_by="idx")


def self_queries(points):
    """The query table of a search: the points whose id is divisible by 50."""
    return points.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
