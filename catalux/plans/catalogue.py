"""Catalogue look-up and status plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalux.functions.text import asset_url
from catalux.operators import aggregates as A
from catalux.operators import joins as J
from catalux.operators import ranking as R
from catalux.operators.views import json_field
from catalux.spec import SourceSpec


def latest_items(content: DataFrame, film: DataFrame, limit: int = 50, film_source: str = "tmdb") -> DataFrame:
    """E5: newest film items with their enrichment (limit <= 100)."""
    return J.latest_enriched(content, film, max(1, min(limit, 100)), film_source)


def item_detail(keys: DataFrame, film: DataFrame, image_base: str, key_type: str = "k_type",
                key_id: str = "k_id") -> DataFrame:
    """Detail row by (type, id), else the newest row with that id; asset URLs from the raw payload."""
    e = film.withColumnRenamed("tmdb_id", "_eid")
    # neither side is bounded, and the rows carry whole payloads
    j = keys.join(e.hint("merge"), keys[key_id] == e["_eid"])
    order = [(F.col("content_type") == F.col(key_type)).desc(), F.desc_nulls_last("updated_at"), F.asc("content_type")]
    best = R.top_k(j, [key_type, key_id], order, 1).drop("rank")
    return best.withColumn("poster_url", asset_url(image_base, json_field("raw", "poster_path"))).withColumn(
        "backdrop_url", asset_url(image_base, json_field("raw", "backdrop_path")))


def sync_status(rows_by_source: dict, state: DataFrame, content: DataFrame, film: DataFrame,
                specs: dict[str, SourceSpec], film_source: str = "tmdb", counts: DataFrame | None = None) -> DataFrame:
    """One status row per source (A5) with the film enrichment status (A6) alongside; ``counts`` as in A5."""
    per_source = [A.source_status(rows_by_source[name], state, spec, counts) for name, spec in specs.items()]
    src = reduce(lambda a, b: a.unionByName(b), per_source)
    enr = A.enrichment_status(content, film, film_source)
    # ``enr`` is a single row: a constant-key join puts it beside every source row
    return src.withColumn("_one", F.lit(1)).join(F.broadcast(enr.withColumn("_one", F.lit(1))), "_one").drop("_one")


def status_report(scene: DataFrame, state: DataFrame, rows: DataFrame) -> DataFrame:
    """Status sections as rows (section, key, n, latest): status histogram (A7), per type/source
    counts (A8), latest synced item per source (W5), newest scene match overall and per group (W6)."""
    hist = scene.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("status").alias("section"), F.col("status").alias("key"), "n", F.lit(None).cast("timestamp").alias("latest"))
    by_src = scene.groupBy("content_type", "content_source").agg(F.count(F.lit(1)).alias("n"),
                                                                F.max("updated_at").alias("latest")).select(
        F.lit("by_source").alias("section"), F.concat_ws(":", "content_type", "content_source").alias("key"), "n",
        F.col("latest").cast("timestamp").alias("latest"))
    synced = state.join(rows.select("pg_id"), "pg_id", "left_semi")
    latest_sync = R.latest_per_group(synced, "source", "updated_at", tie=("pg_id",)).select(
        F.lit("latest_sync").alias("section"), F.concat_ws(":", "source", "pg_id").alias("key"),
        F.lit(1).cast("bigint").alias("n"), F.col("updated_at").cast("timestamp").alias("latest"))
    sc = scene.select("content_type", "content_source", "content_id", F.col("updated_at").cast("timestamp").alias("updated_at"))
    newest = sc.orderBy(F.desc_nulls_last("updated_at"), "content_id").limit(1).select(
        F.lit("latest_match").alias("section"), F.concat_ws(":", "content_type", "content_source", "content_id").alias("key"),
        F.lit(1).cast("bigint").alias("n"), F.col("updated_at").alias("latest"))
    per = R.latest_per_group(sc, ["content_type", "content_source"], "updated_at", tie=("content_id",)).select(
        F.lit("latest_match_by_source").alias("section"),
        F.concat_ws(":", "content_type", "content_source", "content_id").alias("key"),
        F.lit(1).cast("bigint").alias("n"), F.col("updated_at").alias("latest"))
    return reduce(lambda a, b: a.unionByName(b), [hist, by_src, latest_sync, newest, per])
