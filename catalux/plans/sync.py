"""Incremental indexing job (E11): pending -> enrich -> gate -> embed -> score -> upsert.

One pass per run over every pending row (no batch loop on the driver):
rows gated out get no state, stay pending and are counted (SURVEY Q5);
rows whose embedding fails go to the failure upsert and are retried next
run (R2).  The new points and state snapshots are written to fresh
versioned folders, so re-running on unchanged input changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalux.functions import fixed
from catalux.functions.match import embed_text
from catalux.functions.text import (detect_languages, file_extension, file_type, genre_tags, point_id, safety_flag,
                                    safety_score)
from catalux.operators import joins as J
from catalux.operators import upsert as U
from catalux.operators.embed import embed_frame
from catalux.operators.filters import code_gate
from catalux.plans.enrichment import film_enrichment_job
from catalux.session import materialize
from catalux.spec import SourceSpec

MATCH_FIELDS = ["tpdb_title", "tpdb_original_title", "tpdb_aka", "tpdb_actors", "tpdb_tags", "tpdb_studio",
                "tpdb_series", "tpdb_site", "tpdb_plot"]


@dataclass(frozen=True)
class SyncParams:
    now: str
    embedding_version: str = "v1"
    dim: int = 384
    threshold: float = fixed.SAFETY_THRESHOLD
    gate_codes: bool = True


def prepare(rows: DataFrame, spec: SourceSpec, state: DataFrame, scene: DataFrame | None) -> DataFrame:
    """J1 -> P8 -> J13: pending rows with their scene match fields attached."""
    pend = J.pending_rows(rows, spec, state)
    if scene is not None and spec.scene_key:
        ctype, csrc = spec.scene_key
        pend = J.scene_fields_attach(pend, scene, ctype, csrc)
    else:
        for c in ["tpdb_id", *MATCH_FIELDS]:
            pend = pend.withColumn(c, F.lit(None).cast("string"))
    return pend


def point_payload(rows: DataFrame, spec: SourceSpec, p: SyncParams) -> DataFrame:
    """X19 -> X27 -> X28 -> X29: embed text, safety score and the 15 payload fields (no vector yet)."""
    et = embed_text("text", MATCH_FIELDS, "tpdb_id")
    r = rows.withColumn("embed_text", et).withColumn("nsfw_score", safety_score("embed_text"))
    audio, subs = detect_languages("text")
    ext = F.coalesce(F.nullif(F.col("extension"), F.lit("")), file_extension("text")) if "extension" in rows.columns \
        else file_extension("text")
    size = F.col(spec.size_field).try_cast("double") if spec.size_field and spec.size_field in rows.columns else F.lit(None)
    ext_id = F.col(spec.ext_id_field).cast("string") if spec.ext_id_field in rows.columns else F.lit(None).cast("string")
    genre = F.col("genre") if "genre" in rows.columns else F.lit(None).cast("string")
    return r.select(
        "pg_id", "embed_text",
        F.lit(spec.name).alias("source"),
        safety_flag("nsfw_score", spec.tagging_nsfw, p.threshold).alias("nsfw"),
        "nsfw_score", "text_hash",
        F.lit(p.embedding_version).alias("embedding_version"),
        (F.coalesce(ext_id, F.lit("")) != "").alias("has_tmdb"), ext_id.alias("tmdb_id"),
        (F.coalesce(F.col("tpdb_id"), F.lit("")) != "").alias("has_tpdb"), F.col("tpdb_id"),
        genre_tags(genre).alias("genre_tags"),
        file_type(ext).alias("file_type"),
        audio.alias("audio_langs"), subs.alias("subtitle_langs"),
        F.when(size > 0, size).alias("size"))


def embed_pending(rows: DataFrame, spec: SourceSpec, state: DataFrame, p: SyncParams,
                  scene: DataFrame | None = None, make_embedder=None):
    """J1 -> P8 -> J13 -> F17 -> X19 -> X30 -> V8 -> X27 -> X29: (embedded batch, gated count frame)."""
    ready = prepare(rows, spec, state, scene)
    gated = ready
    if p.gate_codes and spec.scene_enrich:
        keep = code_gate("text", "tpdb_id")
        gated = ready.where(keep)
        skipped = ready.where(~keep).agg(F.count(F.lit(1)).alias("gated_rows"))
    else:
        skipped = ready.limit(0).agg(F.count(F.lit(1)).alias("gated_rows"))
    payload = point_payload(gated, spec, p)
    vec = embed_frame(payload, "embed_text", "embedding", dim=p.dim, make_embedder=make_embedder, error_col="embed_error")
    return vec.withColumn("vector_id", point_id(F.lit(spec.name), "pg_id")), skipped


def apply_batch(vec: DataFrame, state: DataFrame, points: DataFrame | None, spec: SourceSpec, p: SyncParams):
    """S5 + S3 + S4 (R2): good vectors upserted into points and state; bad ones recorded as failures."""
    good = vec.where(F.size("embedding") == p.dim)
    bad = vec.where(F.coalesce(F.size("embedding"), F.lit(-1)) != p.dim)
    batch = good.drop("embed_text", "embed_error")
    new_state = U.sync_state_upsert(state, good.select("pg_id", "text_hash", "vector_id", "nsfw_score"),
                                    spec.name, p.now, p.embedding_version)
    fails = bad.select(F.lit(spec.name).alias("source"), "pg_id",
                       F.coalesce("embed_error", F.concat(F.lit("embedding dim mismatch: "), F.size("embedding").cast("string"),
                                                           F.lit(f", expected {p.dim}"))).alias("error"))
    new_state = U.failure_upsert(new_state, fails, p.now)
    new_points = batch if points is None else U.points_upsert(points.select(*batch.columns), batch)
    return new_points, new_state


def sync_job(rows: DataFrame, spec: SourceSpec, state: DataFrame, points: DataFrame | None, p: SyncParams,
             scene: DataFrame | None = None, make_embedder=None):
    """Returns (new_points, new_state, gated_count_frame); the batch is embedded once, whatever is written of them."""
    vec, skipped = embed_pending(rows, spec, state, p, scene, make_embedder)
    vec = materialize(vec)
    new_points, new_state = apply_batch(vec, state, points, spec, p)
    return new_points, new_state, skipped


@dataclass(frozen=True)
class FilmInputs:
    """Film table, landed payloads (content_type, tmdb_id, film_json) and landed second ratings of E9."""

    table: DataFrame
    payloads: DataFrame
    ratings: DataFrame | None = None


Rows = DataFrame | Callable[[DataFrame | None], DataFrame]


def sync_all(sources: Mapping[str, tuple[SourceSpec, Rows]], state: DataFrame, points: DataFrame | None, p: SyncParams,
             scene: DataFrame | None = None, film: FilmInputs | None = None, target: str | None = None, make_embedder=None):
    """E11 over every configured source, or ``target`` alone: (points, state, film table, gated rows by source).

    Pending rows of sources with ``film_refs`` have their missing films enriched first (E9); a source given as a
    function of the film table is then read again, so that its texts hold what was found.
    """
    chosen = {n: x for n, x in sources.items() if target in (None, n)}
    films = film.table if film else None

    def rows_of(rows: Rows) -> DataFrame:
        return rows if isinstance(rows, DataFrame) else rows(films)

    referring = [(spec, rows) for spec, rows in chosen.values() if spec.film_refs]
    if film and referring:
        refs = [J.pending_rows(rows_of(rows), spec, state).select(F.col(spec.film_refs[0]).alias("content_type"),
                                                                  F.col(spec.film_refs[1]).cast("string").alias("tmdb_id"))
                for spec, rows in referring]
        films = materialize(film_enrichment_job(reduce(lambda a, b: a.unionByName(b), refs), films, film.payloads, p.now,
                                                ratings=film.ratings))
    gated = []
    for spec, rows in chosen.values():
        points, state, skipped = sync_job(rows_of(rows), spec, state, points, p, scene, make_embedder)
        gated.append(skipped.select(F.lit(spec.name).alias("source"), "gated_rows"))
    return points, state, films, reduce(lambda a, b: a.unionByName(b), gated) if gated else None
