"""Joins (S1, J1-J14) on whole tables.

Equi keys everywhere, same types on both sides (ids are compared as text,
as the reference casts them), and the many side aggregated before it meets
the one side.  Broadcast is left to the planner: a side under
``spark.sql.autoBroadcastJoinThreshold`` (checked at plan time, and again by
AQE from real sizes) is broadcast, anything larger is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.functions.text import col_, content_md5
from catalux.spec import JoinSpec, SourceSpec

EPOCH = "1970-01-01 00:00:00"

def source_scan(df: DataFrame, spec: SourceSpec, apply_where: bool = True) -> DataFrame:
    """Project a source to (pg_id, text, text_hash=md5(text), updated_at?, extras...)."""
    if apply_where and spec.where:
        df = df.where(F.expr(spec.where))
    cols = [F.col(spec.id_field).cast("string").alias("pg_id"), F.col(spec.text_field).alias("text"),
            content_md5(spec.text_field).alias("text_hash")]
    if spec.updated_at_field:
        cols.append(F.col(spec.updated_at_field).alias("updated_at"))
    cols += [F.col(c) for c in spec.extra_fields if c not in ("pg_id", "text", "text_hash", "updated_at")]
    return df.select(*cols)


def pending_rows(df: DataFrame, spec: SourceSpec, state: DataFrame, retry_failed: bool = True,
                 apply_where: bool = True) -> DataFrame:
    """Source rows with no state, newer than their state, or with a different hash.

    With ``retry_failed`` rows whose state records an error are pending too
    (a failure stamps ``updated_at``, so the time test alone would skip them).
    """
    rows = source_scan(df, spec, apply_where)
    s = state.where(F.col("source") == spec.name).select(
        F.col("pg_id").alias("_s_id"), F.col("text_hash").alias("_s_hash"),
        F.col("updated_at").alias("_s_time"), F.col("last_error").alias("_s_err"))
    j = rows.join(s, rows["pg_id"] == s["_s_id"], "left")
    cond = F.col("_s_id").isNull() | ~F.col("_s_hash").eqNullSafe(F.col("text_hash"))
    if spec.updated_at_field:
        cond = cond | (F.col("updated_at") > F.coalesce(F.col("_s_time"), F.to_timestamp(F.lit(EPOCH))))
    if retry_failed:
        cond = cond | F.col("_s_err").isNotNull()
    return j.where(cond).drop("_s_id", "_s_hash", "_s_time", "_s_err")


def pending_batch(pending: DataFrame, spec: SourceSpec, n: int) -> DataFrame:
    """The oldest n pending rows, NULL times last (id order without a time column)."""
    order = ([F.asc_nulls_last("updated_at")] if spec.updated_at_field else []) + [F.asc("pg_id")]
    return pending.orderBy(*order).limit(n)


def aggregate_side(other: DataFrame, js: JoinSpec) -> DataFrame:
    """Group the joined table by its join key and aggregate each field (A1-A3)."""
    aggs = []
    for out, c in js.fields.items():
        if js.distinct:
            arr = F.array_sort(F.transform(F.collect_set(F.struct(F.col(c).alias("v"))), lambda x: x["v"]))
        elif js.order_by:
            arr = F.transform(F.array_sort(F.collect_list(F.struct(F.col(js.order_by).alias("o"), F.col(c).alias("v")))),
                              lambda x: x["v"])
        else:
            arr = F.transform(F.collect_list(F.struct(F.col(c).alias("v"))), lambda x: x["v"])
        aggs.append((F.to_json(arr) if js.agg in ("json_agg", "jsonb_agg") else arr).alias(out))
    return other.groupBy(*[F.col(k) for k in js.on_right]).agg(*aggs)


def configured_join(df: DataFrame, joins, tables: dict) -> DataFrame:
    """Apply N configured joins; aggregated sides are pre-grouped on their key."""
    out = df
    for i, js in enumerate(joins):
        other = tables[js.table]
        if js.agg:
            side = aggregate_side(other, js)
        else:
            side = other.select(*js.on_right, *[F.col(c).alias(o) for o, c in js.fields.items()])
        side = side.select(*[F.col(k).alias(f"_k{i}_{n}") for n, k in enumerate(js.on_right)],
                           *[F.col(o) for o in js.fields])
        cond = None
        for n, lk in enumerate(js.on_left):
            c = out[lk].cast("string") == side[f"_k{i}_{n}"].cast("string")
            cond = c if cond is None else cond & c
        out = out.join(side, cond, js.how).drop(*[f"_k{i}_{n}" for n in range(len(js.on_right))])
    return out


def anti_refs(refs: DataFrame, existing: DataFrame, keys, force: bool = False) -> DataFrame:
    """Refs that have no enrichment row yet (all refs when forced)."""
    if force:
        return refs
    ex = existing.select(*[F.col(r).alias(f"_e{i}") for i, (_, r) in enumerate(keys)]).distinct()
    cond = None
    for i, (l, _) in enumerate(keys):
        c = refs[l] == ex[f"_e{i}"]
        cond = c if cond is None else cond & c
    return refs.join(ex, cond, "left_anti")


def missing_refs(refs: DataFrame, existing: DataFrame, keys) -> DataFrame:
    """Distinct given refs minus existing ones."""
    return anti_refs(refs.select(*[l for l, _ in keys]).distinct(), existing, keys)


def stale_refs(refs: DataFrame, existing: DataFrame, keys, now, ttl_hours: float, not_found_ttl_hours: float,
               status_col: str = "status", time_col: str = "updated_at") -> DataFrame:
    """Refs absent, or older than their TTL (own TTL for not_found).

    A TTL <= 0 or an unknown age counts as stale.  ``now`` is a parameter so
    reruns are reproducible.
    """
    ex = existing.select(*[F.col(r).alias(f"_e{i}") for i, (_, r) in enumerate(keys)],
                         F.col(status_col).alias("_st"), F.col(time_col).alias("_t"))
    cond = None
    for i, (l, _) in enumerate(keys):
        c = refs[l] == ex[f"_e{i}"]
        cond = c if cond is None else cond & c
    j = refs.join(ex, cond, "left")
    now_c = F.to_timestamp(F.lit(now)) if isinstance(now, str) else col_(now)
    age_h = (F.unix_micros(now_c.cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp"))).cast("double") / 3.6e9
    ttl = F.when(F.col("_st") == "not_found", F.lit(float(not_found_ttl_hours))).otherwise(F.lit(float(ttl_hours)))
    stale = F.col("_e0").isNull() | (ttl <= 0) | F.col("_t").isNull() | (age_h >= ttl)
    return j.where(stale).drop(*[f"_e{i}" for i in range(len(keys))], "_st", "_t")


def collection_join(content: DataFrame, links: DataFrame, collections: DataFrame, id_col: str = "id") -> DataFrame:
    """Content -> link table -> collection (two left joins); collections are a dictionary."""
    lk = links.select(F.col("content_id").alias("_cid"), "collection_id")
    cc = collections.select(F.col("collection_id").alias("_coll"), F.col("name").alias("collection_name"))
    j = content.join(lk, content[id_col] == lk["_cid"], "left")
    return j.join(cc, j["collection_id"] == cc["_coll"], "left").drop("_cid", "_coll")


def latest_enriched(content: DataFrame, enrich: DataFrame, n: int, film_source: str = "tmdb") -> DataFrame:
    """Content of the film source joined to its enrichment, newest n by content time."""
    c = content.where(F.col("source") == film_source)
    e = enrich.select(F.col("content_type").alias("_et"), F.col("tmdb_id").alias("_eid"), "genre", "keywords")
    j = c.join(e, (c["type"] == e["_et"]) & (c["id"].cast("string") == e["_eid"]), "inner")
    return j.orderBy(F.desc_nulls_last("updated_at"), F.asc("id")).limit(n).drop("_et", "_eid")


def state_score_lookup(hits: DataFrame, state: DataFrame) -> DataFrame:
    """Safety score of every hit from the sync state; missing -> 0.0."""
    s = state.select(F.col("source").alias("_ss"), F.col("pg_id").alias("_sp"), F.col("nsfw_score").alias("_score"))
    j = hits.join(s, (hits["source"] == s["_ss"]) & (hits["pg_id"] == s["_sp"]), "left")
    return j.withColumn("nsfw_score", F.coalesce(F.col("_score").cast("double"), F.lit(0.0))).drop("_ss", "_sp", "_score")


def synced_rows(rows: DataFrame, state: DataFrame, id_col: str = "pg_id") -> DataFrame:
    """The rows that have a state row (of ``state``'s one source); ids are compared as text."""
    keys = state.select(F.col("pg_id").alias("_sid"))
    return rows.join(keys, rows[id_col].cast("string") == keys["_sid"], "left_semi")


SCENE_FIELDS = ["tpdb_id", "title", "original_title", "aka", "actors", "tags", "studio", "series", "site",
                "release_date", "plot", "poster_url"]


def scene_fields_attach(rows: DataFrame, scene: DataFrame, content_type: str, content_source: str | Column,
                        id_col: str = "pg_id", fields=SCENE_FIELDS) -> DataFrame:
    """Attach scene match columns (renamed tpdb_*) by content id within (type, source).

    ``content_source``: one source's name, or a Column over ``rows`` where they are of several.
    """
    s = scene.where(F.col("content_type") == content_type)
    if isinstance(content_source, str):
        s = s.where(F.col("content_source") == content_source)
        content_source = F.lit(content_source)
    s = s.select(F.col("content_id").alias("_cid"), F.col("content_source").alias("_csrc"),
                 *[F.col(f).alias(f if f.startswith("tpdb_") else f"tpdb_{f}") for f in fields])
    return rows.join(s, (rows[id_col] == s["_cid"]) & (content_source == s["_csrc"]), "left").drop("_cid", "_csrc")


def refresh_rows(pending: DataFrame, scene: DataFrame, content_type: str, content_source: str | Column, fields=SCENE_FIELDS) -> DataFrame:
    """Pending rows after enrichment: match fields attached in one join, the hash taken anew from the text."""
    out = scene_fields_attach(pending, scene, content_type, content_source, fields=fields)
    return out.withColumn("text_hash", content_md5("text"))
