"""Enrichment jobs (E9, E10) over landed metadata payloads.

The reference calls a metadata API once per missing reference; here the
payloads are landed data (``payloads``: key + JSON text), so a job is one
plan: missing refs (anti join) -> join payloads -> normalise ->
upsert.  All missing refs are done; ``max_per_batch`` > 0 caps a run (W8).
``now`` is a parameter so a rerun is reproducible.  A payload that is not
JSON never fails the job: a film stays missing (and is tried again), a
scene gets a row with status 'error'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalux.functions.match import best_candidate, normalize_film_payload, result_items, scene_frame, search_variables, vstr
from catalux.functions.text import extract_code, parse_source_rating
from catalux.operators import joins as J
from catalux.operators import upsert as U
from catalux.operators.filters import ref_complete, supported_type
from catalux.operators.ranking import numeric_id_order

FILM_KEYS = [("content_type", "content_type"), ("tmdb_id", "tmdb_id")]
SCENE_FIELDS = ("tpdb_id", "title", "original_title", "aka", "actors", "tags", "studio", "series", "site", "release_date",
                "plot", "poster_url", "external_type")
SCENE_KEYS = [("content_type", "content_type"), ("content_source", "content_source"), ("content_id", "content_id")]


def film_enrichment_job(refs: DataFrame, film: DataFrame, payloads: DataFrame, now: str, max_per_batch: int = 0,
                        force: bool = False, limits=(10, 5, 10), ratings: DataFrame | None = None) -> DataFrame:
    """(J3/J5 -> F18 -> W8 -> S9 -> X23 -> X38 -> S7) returns the film table after the upsert.

    ``refs``: (content_type, tmdb_id); ``payloads``: (content_type, tmdb_id, film_json); ``ratings``: landed answers of the
    second rating service, (imdb_id, rating_json) with the average under ``rating.average``.
    """
    sup = refs.where(supported_type("content_type")).select("content_type", "tmdb_id").distinct()
    todo = sup if force else J.anti_refs(sup, film, FILM_KEYS)
    if max_per_batch > 0:
        todo = todo.orderBy(numeric_id_order("tmdb_id"), "content_type").limit(max_per_batch)
    j = todo.join(payloads, ["content_type", "tmdb_id"]).where(F.try_parse_json("film_json").isNotNull())
    cols = normalize_film_payload(F.col("film_json"), *limits)
    batch = j.select("content_type", "tmdb_id", *[cols[k].alias(k) for k in
                                                  ("aka", "keywords", "actors", "directors", "plot", "genre", "imdb_id")],
                     parse_source_rating(cols["imdb_rating_text"]).alias("imdb_rating"),
                     F.col("film_json").alias("raw"), F.to_timestamp(F.lit(now)).alias("updated_at"))
    if ratings is None:
        batch = batch.withColumn("douban_rating", F.lit(None).cast("double"))
    else:
        second = ratings.groupBy("imdb_id").agg(F.max("rating_json").alias("_rating"))
        batch = batch.join(second, "imdb_id", "left").withColumn(
            "douban_rating", F.get_json_object("_rating", "$.rating.average").try_cast("double")).drop("_rating")
    batch = batch.select("content_type", "tmdb_id", "aka", "keywords", "actors", "directors", "plot", "genre", "imdb_id",
                         "imdb_rating", "douban_rating", "raw", "updated_at")
    return U.film_enrich_upsert(film.select(*batch.columns), batch)


def scene_enrichment_job(refs: DataFrame, scene: DataFrame, payloads: DataFrame, now: str, ttl_hours: float,
                         not_found_ttl_hours: float, result_path: str, max_per_batch: int = 0,
                         require_code: bool = False) -> DataFrame:
    """(F19 -> J6 -> W8 -> X25 -> S9 -> X22 -> W7 -> X24 -> S8) returns the scene table after the upsert.

    ``refs``: (content_type, content_source, content_id, title); ``payloads``:
    (content_type, content_source, content_id, scene_json).
    """
    r = refs.where(ref_complete())
    if require_code:
        r = r.where(extract_code("title").isNotNull())
    stale = J.stale_refs(r, scene, SCENE_KEYS, now, ttl_hours, not_found_ttl_hours)
    todo = stale.orderBy(numeric_id_order("content_id"), "content_id").limit(max_per_batch) if max_per_batch > 0 else stale
    v = search_variables("title")
    todo = todo.withColumn("raw_title", v["raw_title"])
    keys = ["content_type", "content_source", "content_id"]
    j = todo.join(payloads, keys)
    parsed = F.try_parse_json(F.col("scene_json"))
    broken = j.where(parsed.isNull() & F.col("scene_json").isNotNull()).select(*keys).distinct()
    # parsed in a projection of its own; the outer explode brings no filter that would parse once more below the join
    data = j.select(*keys, "raw_title", F.try_variant_get(parsed, "$." + result_path, "variant").alias("_data"))
    found_items = data.select(*keys, "raw_title", result_items(F.col("_data"), None).alias("_items"))
    items = found_items.select(*keys, "raw_title", F.posexplode_outer("_items").alias("pos", "it")).where(F.col("it").isNotNull())
    cands = items.select(F.concat_ws("\u0001", *keys).alias("_rk"), *keys, "pos", "it",
                         vstr(F.col("it"), "$.code").alias("code"),
                         F.coalesce(F.nullif(vstr(F.col("it"), "$.title"), F.lit("")), vstr(F.col("it"), "$.name")).alias("title"))
    rk = todo.select(F.concat_ws("\u0001", *keys).alias("_rk"), "raw_title")
    best = best_candidate(cands, rk, key="_rk", pos="pos", ref_title="raw_title", item_title="title", item_code="code")
    found = scene_frame(best.select(*keys, "it", "match_method", "match_score"), "it", [*keys, "match_method", "match_score"])
    found = found.withColumn("external_type", F.lit("scene"))
    now_c = F.to_timestamp(F.lit(now))
    none = F.lit(None).cast("string")
    raw = payloads.select(*keys, F.col("scene_json").alias("raw")).dropDuplicates(keys)
    ok = found.join(raw, keys, "left").select(
        *keys, *SCENE_FIELDS, "match_method", "match_score", F.lit("success").alias("status"), none.alias("error_message"),
        "raw", now_c.alias("updated_at"))
    missing = J.anti_refs(todo.select(*keys), best.select(*keys), SCENE_KEYS).join(broken.withColumn("_bad", F.lit(True)), keys, "left")
    status = F.when(F.col("_bad"), F.lit("error")).otherwise(F.lit("not_found"))
    nf = missing.join(raw, keys, "left").select(
        *keys, *[none.alias(c) for c in SCENE_FIELDS], status.alias("match_method"), F.lit(None).cast("double").alias("match_score"),
        status.alias("status"), F.when(F.col("_bad"), F.lit("payload is not JSON")).alias("error_message"), "raw",
        now_c.alias("updated_at"))
    batch = ok.unionByName(nf)
    # a table written before a column existed reads as NULL there
    old = scene.select(*[F.col(c) if c in scene.columns else F.lit(None).cast(batch.schema[c].dataType).alias(c)
                         for c in batch.columns])
    return U.scene_enrich_upsert(old, batch)
