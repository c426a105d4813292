"""Catalogue views (P1-P8) as DataFrame functions.

The content view joins one row per content item to its collections (many)
and two enrichment tables (one each).  The reference groups by all 32
output columns after the joins; here the many side is aggregated on its
key first and joined after, so no wide group-by or fan-out happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalux.functions.text import col_
from catalux.operators.aggregates import string_agg_distinct


def file_id(info_hash_bin, index) -> Column:
    """Hex of the binary hash, ':' and the file index."""
    return F.concat(F.lower(F.hex(col_(info_hash_bin))), F.lit(":"), col_(index).cast("string"))


def content_uid(type_, source, id_) -> Column:
    """P2: 'type:source:id', NULL if any part is NULL (concat, not concat_ws)."""
    return F.concat(col_(type_), F.lit(":"), col_(source), F.lit(":"), col_(id_).cast("string"))


def conditional_id(source, id_, film_source: str = "tmdb") -> Column:
    """The id only where the source is the film catalogue."""
    return F.when(col_(source) == film_source, col_(id_).cast("string"))


def json_field(raw, key: str) -> Column:
    """P5: raw->>'key'."""
    return F.get_json_object(col_(raw), f"$.{key}")


FILM_COLS = ["aka", "keywords", "actors", "directors", "plot", "genre", "imdb_id", "imdb_rating", "douban_rating", "raw"]
SCENE_COLS = ["tpdb_id", "title", "original_title", "aka", "actors", "tags", "studio", "series", "site",
              "release_date", "plot", "poster_url"]


def collection_names(links: DataFrame, collections: DataFrame) -> DataFrame:
    """Distinct collection names per content, sorted and space-joined (NULL when none)."""
    cc = collections.select(F.col("collection_id").alias("_cc"), "name")
    j = links.join(cc, links["collection_id"] == cc["_cc"]).where(F.col("name").isNotNull())
    return j.groupBy("content_id").agg(F.nullif(string_agg_distinct("name"), F.lit("")).alias("collection_names"))


def content_view(content: DataFrame, links: DataFrame, collections: DataFrame, film: DataFrame, scene: DataFrame,
                 film_source: str = "tmdb") -> DataFrame:
    """P6 (with P2-P5, J7, J8, A4): one row per content item."""
    names = collection_names(links, collections)
    c = content.alias("c")
    te = film.select(F.col("content_type").alias("_te_type"), F.col("tmdb_id").alias("_te_id"),
                     *[F.col(x).alias(f"te_{x}") for x in FILM_COLS])
    je = scene.select(F.col("content_type").alias("_je_type"), F.col("content_source").alias("_je_src"),
                      F.col("content_id").alias("_je_id"), *[F.col(x).alias(f"je_{x}") for x in SCENE_COLS])
    j = (c.join(names, F.col("c.id") == names["content_id"], "left").drop("content_id")
         .join(te, (F.col("_te_type") == F.col("type")) & (F.col("_te_id") == F.col("id").cast("string"))
               & (F.col("source") == film_source), "left")
         .join(je, (F.col("_je_type") == F.col("type")) & (F.col("_je_src") == F.col("source"))
               & (F.col("_je_id") == F.col("id").cast("string")), "left"))
    tmdb_id = conditional_id("source", "id", film_source)
    search = F.trim(F.concat_ws(
        " ", "title", "original_title", "overview", F.col("release_year").cast("string"), "collection_names", tmdb_id,
        "te_aka", "te_keywords", "te_actors", "te_directors", "te_plot", "te_genre",
        "je_title", "je_original_title", "je_aka", "je_actors", "je_tags", "je_studio", "je_series", "je_site",
        "je_release_date", "je_plot"))
    return j.select(
        content_uid("type", "source", "id").alias("content_uid"), "type", "source", "id", "title", "original_title",
        "overview", "release_year", "updated_at",
        (F.col("adult") if "adult" in c.columns else F.lit(None).cast("boolean")).alias("adult"), tmdb_id.alias("tmdb_id"),
        F.col("te_genre").alias("genre"), F.col("te_keywords").alias("keywords"), search.alias("search_text"),
        F.col("te_aka").alias("aka"), F.col("te_actors").alias("actors"), F.col("te_directors").alias("directors"),
        F.col("te_plot").alias("plot"), F.col("te_imdb_id").alias("imdb_id"),
        F.col("te_imdb_rating").alias("imdb_rating"), F.col("te_douban_rating").alias("douban_rating"),
        json_field("te_raw", "poster_path").alias("poster_path"), json_field("te_raw", "backdrop_path").alias("backdrop_path"),
        *[F.col(f"je_{x}").alias(x if x.startswith("tpdb_") else f"tpdb_{x}") for x in SCENE_COLS])


def render_binary(df: DataFrame) -> list[Column]:
    """Every column, binary values rendered '\\x' + hex, also inside structs and arrays."""
    def walk(c: Column, dt: T.DataType) -> Column:
        if isinstance(dt, T.BinaryType):
            return F.when(c.isNotNull(), F.concat(F.lit("\\x"), F.lower(F.hex(c))))
        if isinstance(dt, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in dt.fields]))
        if isinstance(dt, T.ArrayType):
            return F.transform(c, lambda x: walk(x, dt.elementType))
        return c
    return [walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]


def metadata_columns(rows: DataFrame, id_field: str, text_field: str, prefix: str = "meta_") -> DataFrame:
    """(id, title, meta_* for every other column with binary values rendered)."""
    rendered = rows.select(*render_binary(rows))
    others = [c for c in rendered.columns if c not in (id_field, text_field)]
    return rendered.select(F.col(id_field), F.col(text_field), *[F.col(c).alias(prefix + c) for c in others])
