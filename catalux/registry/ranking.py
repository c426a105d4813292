"""Registered queries: first-per-key, dedupe, top-k and paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalux.functions.match import best_candidate
from catalux.operators import joins as J
from catalux.operators import ranking as R
from catalux.operators.vector import knn
from catalux.registry import duck as D
from catalux.registry import register
from catalux.registry.common import self_queries
from catalux.registry.common import ITEMS_SYNC

HITS_SQL = """
hits AS (
  SELECT * FROM (SELECT q.vec_id AS query_id, p.source, p.pg_id, p.text_hash, p.size,
       round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) DESC, p.source, p.pg_id) AS rank
     FROM (SELECT * FROM points WHERE vec_id % 50 = 0) q, points p) t WHERE rank <= 20)"""


def _hits(fx, k=20):
    p = fx["points"]
    h = knn(p, self_queries(p), k)
    h = h.withColumn("score", F.round("score", 6))
    return h.join(p.select("source", "pg_id", "text_hash", "size"), ["source", "pg_id"])


@register("dedupe_hits_by_hash", f"""
WITH {HITS_SQL}
SELECT query_id, source, pg_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id,
      CASE WHEN coalesce({D.strip_ws('text_hash')}, '') <> '' THEN {D.strip_ws('text_hash')} ELSE source || ':' || pg_id END
      ORDER BY rank) AS k FROM hits) t WHERE k = 1""", ("points",))
def dedupe_hits_by_hash(fx):
    """First hit per text hash (else source:pg_id) in rank order."""
    return R.dedupe_hits_by_hash(_hits(fx)).select("query_id", "source", "pg_id", "score",
                                                   F.col("rank").cast("bigint").alias("rank"))


_TITLE_KEY = (f"CASE WHEN {D.normalize_title('i.title')} <> '' THEN 'title:' || {D.normalize_title('i.title')} "
              f"ELSE 'id:' || h.source || ':' || h.pg_id END")


@register("dedupe_results_by_title", f"""
WITH {HITS_SQL},
res AS (SELECT h.query_id, h.source, h.pg_id, h.score, i.title, {_TITLE_KEY} AS tkey
        FROM hits h JOIN items i ON h.source = 'items' AND i.pg_id = h.pg_id)
SELECT query_id, source, pg_id, score, title FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, tkey ORDER BY score DESC, source, pg_id) AS k FROM res) t
WHERE k = 1""", ("points", "items"))
def dedupe_results_by_title(fx):
    """W2 (the semantic slice): hits -> rows -> first result per normalised title in score order."""
    hits = _hits(fx)
    rows = fx["items"].select(F.lit("items").alias("_src"), F.col("pg_id").alias("_pid"), "title")
    res = hits.join(rows, (hits["source"] == rows["_src"]) & (hits["pg_id"] == rows["_pid"]))
    return R.dedupe_results_by_title(res).select("query_id", "source", "pg_id", "score", "title")


_ID_TITLE = D.strip_ws("coalesce(title, '')")


@register("dedupe_results_by_identity", f"""
SELECT type, id, title, release_year FROM (
  SELECT *, row_number() OVER (PARTITION BY type,
     CASE WHEN lower({_ID_TITLE}) <> '' THEN 'title:' || lower({_ID_TITLE}) || ':' || coalesce(CAST(release_year AS VARCHAR), '')
          ELSE 'src:' || CAST(id AS VARCHAR) END ORDER BY id) AS k FROM catalog) t WHERE k = 1""", ("catalog",))
def dedupe_results_by_identity(fx):
    """First result per hash / lower title + year / id, within each type."""
    c = fx["catalog"].withColumn("info_hash", F.lit(None).cast("string")).withColumn("pg_id", F.col("id").cast("string"))
    key = R.identity_key("info_hash", "pg_id", "title", "release_year", F.lit("src"))
    return R.first_per_key(c, "type", key, [F.asc("id")]).select("type", "id", "title", "release_year")


@register("detail_lookup", """
WITH keys AS (SELECT CASE WHEN id % 2 = 0 THEN 'doc' ELSE 'movie' END AS k_type, pg_id AS k_id FROM items),
cand AS (SELECT k.k_type, k.k_id, e.content_type, e.aka, e.updated_at,
           row_number() OVER (PARTITION BY k.k_type, k.k_id ORDER BY (e.content_type = k.k_type) DESC,
                              e.updated_at DESC NULLS LAST, e.content_type) AS r
         FROM keys k JOIN enrich e ON e.content_id = k.k_id)
SELECT k_type, k_id, content_type, aka, updated_at FROM cand WHERE r = 1""", ("items", "enrich"))
def detail_lookup(fx):
    """Row by (type, id); if absent the newest row with that id (one join, one window)."""
    keys = fx["items"].select(F.when(F.col("id") % 2 == 0, "doc").otherwise("movie").alias("k_type"),
                              F.col("pg_id").alias("k_id"))
    e = fx["enrich"].select("content_type", F.col("content_id").alias("_eid"), "aka", "updated_at")
    j = keys.join(e, keys["k_id"] == e["_eid"])
    order = [(F.col("content_type") == F.col("k_type")).desc(), F.desc_nulls_last("updated_at"), F.asc("content_type")]
    return R.top_k(j, ["k_type", "k_id"], order, 1).select("k_type", "k_id", "content_type", "aka", "updated_at")


@register("latest_synced_item", """
SELECT source, pg_id, title, updated_at FROM (
  SELECT s.source, s.pg_id, i.title, s.updated_at,
         row_number() OVER (PARTITION BY s.source ORDER BY s.updated_at DESC NULLS LAST, s.pg_id) AS r
  FROM sync_state s JOIN items i ON i.pg_id = s.pg_id) t WHERE r = 1""", ("sync_state", "items"))
def latest_synced_item(fx):
    """Most recently synced row per source."""
    s = fx["sync_state"].join(fx["items"].select("pg_id", "title"), "pg_id")
    return R.latest_per_group(s, "source", "updated_at", tie=("pg_id",)).select("source", "pg_id", "title", "updated_at")


@register("latest_scene_match", """
SELECT 'all' AS scope, content_type, content_source, content_id, updated_at FROM (
  SELECT *, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, content_id) AS r FROM enrich) t WHERE r = 1
UNION ALL
SELECT 'group' AS scope, content_type, content_source, content_id, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY content_type, content_source ORDER BY updated_at DESC NULLS LAST, content_id) AS r
  FROM enrich) t WHERE r = 1""", ("enrich",))
def latest_scene_match(fx):
    """Newest enrichment row overall and per (type, source)."""
    e = fx["enrich"].select("content_type", "content_source", "content_id", "updated_at")
    overall = e.orderBy(F.desc_nulls_last("updated_at"), F.asc("content_id")).limit(1).withColumn("scope", F.lit("all"))
    per = R.latest_per_group(e, ["content_type", "content_source"], "updated_at", tie=("content_id",)).withColumn(
        "scope", F.lit("group"))
    cols = ["scope", "content_type", "content_source", "content_id", "updated_at"]
    return overall.select(*cols).unionByName(per.select(*cols))


def _norm_or_raw(e: str) -> str:
    n = D.normalize_title(e)
    return f"(CASE WHEN {n} <> '' THEN {n} ELSE coalesce({e}, '') END)"


_RC = D.extract_code("r.raw_title")
_IC = f"coalesce(nullif(c.code, ''), {D.extract_code('c.title')})"
_NT, _NI = f"lower({_norm_or_raw('r.raw_title')})", f"lower({_norm_or_raw('c.title')})"


@register("best_candidate", f"""
WITH t AS (
  SELECT c.content_id, c.pos, c.code, c.title,
    CASE WHEN {_RC} IS NOT NULL AND {_IC} IS NOT NULL AND upper({_IC}) = upper({_RC}) THEN 1
         WHEN coalesce(r.raw_title, '') <> '' AND coalesce(c.title, '') <> '' AND {_NI} = {_NT} THEN 2
         WHEN coalesce(r.raw_title, '') <> '' AND coalesce(c.title, '') <> ''
              AND (strpos({_NI}, {_NT}) > 0 OR strpos({_NT}, {_NI}) > 0) THEN 3
         ELSE 4 END AS tier
  FROM candidates c JOIN refs r ON r.content_id = c.content_id),
b AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY tier, pos) AS rr FROM t)
SELECT content_id, pos, code, title, (['code', 'title_exact', 'title_partial', 'fallback'])[tier] AS match_method,
       ([1.0, 0.9, 0.7, 0.5])[tier] AS match_score
FROM b WHERE rr = 1""", ("candidates", "refs"))
def best_candidate_q(fx):
    """Code equality, exact title, containment, else first candidate."""
    out = best_candidate(fx["candidates"], fx["refs"])
    return out.select("content_id", "pos", "code", "title", "match_method", "match_score")


@register("enrich_cap", """
SELECT content_type, content_id FROM refs
WHERE content_type IN ('movie', 'tv_show', 'tv')
ORDER BY TRY_CAST(content_id AS BIGINT), content_type LIMIT 50""", ("refs",))
def enrich_cap(fx):
    """At most 50 refs per batch, in numeric id order (the cap is the feature)."""
    r = fx["refs"].where(F.col("content_type").isin("movie", "tv_show", "tv"))
    return r.orderBy(R.numeric_id_order("content_id"), "content_type").limit(50).select("content_type", "content_id")


@register("pending_batch", """
SELECT pg_id, updated_at FROM (
SELECT i.pg_id, i.updated_at
FROM items i LEFT JOIN sync_state s ON s.source = 'items' AND s.pg_id = CAST(i.id AS VARCHAR)
WHERE s.pg_id IS NULL OR i.updated_at > coalesce(s.updated_at, TIMESTAMP '1970-01-01 00:00:00')
   OR s.text_hash IS DISTINCT FROM md5(i.text) OR s.last_error IS NOT NULL) t
ORDER BY updated_at ASC NULLS LAST, pg_id LIMIT 100""", ("items", "sync_state"))
def pending_batch(fx):
    """The oldest 100 pending rows (the batch size is the feature)."""
    pend = J.pending_rows(fx["items"], ITEMS_SYNC, fx["sync_state"])
    return J.pending_batch(pend, ITEMS_SYNC, 100).select("pg_id", "updated_at")


@register("score_order", f"""
WITH {HITS_SQL}
SELECT query_id, source, pg_id, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS position FROM hits""",
          ("points",))
def score_order(fx):
    """Hits ordered by score (ties by key) as a position per query."""
    h = _hits(fx)
    return R.top_k(h, "query_id", [F.desc("score"), "source", "pg_id"], 1 << 30, "position").select(
        "query_id", "source", "pg_id", "score", F.col("position").cast("bigint").alias("position"))


@register("size_order", f"""
WITH {HITS_SQL}
SELECT query_id, pg_id, size, score,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN TRY_CAST(size AS DOUBLE) > 0 THEN 0 ELSE 1 END,
                     coalesce(CASE WHEN TRY_CAST(size AS DOUBLE) > 0 THEN TRY_CAST(size AS DOUBLE) END, 0.0) DESC,
                     score DESC, source, pg_id) AS position FROM hits""", ("points",))
def size_order(fx):
    """Missing sizes last, then size descending, then score descending."""
    h = _hits(fx)
    size = F.when(F.col("size").try_cast("double") > 0, F.col("size").try_cast("double"))
    order = R.size_order(size, F.col("score"), "desc") + [F.asc("source"), F.asc("pg_id")]
    return R.top_k(h, "query_id", order, 1 << 30, "position").select(
        "query_id", "pg_id", "size", "score", F.col("position").cast("bigint").alias("position"))


@register("page_vector", f"""
WITH {HITS_SQL.replace('rank <= 20)', 'rank <= 40)')},
cnt AS (SELECT query_id, count(*) AS raw_count FROM hits WHERE rank > 20 AND rank <= 40 GROUP BY query_id)
SELECT h.query_id, h.pg_id, h.rank, CASE WHEN c.raw_count = 20 THEN 40 END AS next_cursor
FROM hits h LEFT JOIN cnt c ON c.query_id = h.query_id WHERE h.rank > 20 AND h.rank <= 40""", ("points",))
def page_vector(fx):
    """T4: slice [offset, offset+k) with k = min(100, max(topk, page_size)); next cursor when the slice is full."""
    offset, k = 20, min(100, max(20, 20))
    h = _hits(fx, offset + k)
    pg = R.page(h, "query_id", [F.col("rank")], offset, k, rank_col="_r")
    cnt = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return pg.withColumn("_c", cnt).select(
        "query_id", "pg_id", F.col("rank").cast("bigint").alias("rank"),
        F.when(F.col("_c") == k, F.lit(offset + k)).cast("bigint").alias("next_cursor"))


@register("page_keyword", """
SELECT source, id, title, CASE WHEN n > 25 THEN 25 END AS next_cursor FROM (
  SELECT source, id, title, row_number() OVER (PARTITION BY source ORDER BY id) AS r,
         count(*) OVER (PARTITION BY source) AS n FROM items) t
WHERE r > 15 AND r <= 25""", ("items",))
def page_keyword(fx):
    """T5: page [15, 25) of each source's list; next cursor when more rows remain."""
    pg = R.page(fx["items"], "source", [F.asc("id")], 15, 10, rank_col="_r")
    return pg.select("source", "id", "title", F.when(F.col("has_more"), F.lit(25)).cast("bigint").alias("next_cursor"))


@register("per_source_limit", """
SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM items) t
WHERE r <= 30""", ("items",))
def per_source_limit(fx):
    """At most min(2000, max(cursor + 3*page, 3*topk)) = 30 rows per source, by id."""
    n = min(2000, max(0 + 3 * 10, 3 * 10))
    return R.top_k(fx["items"], "source", [F.asc("id")], n).select("source", "id")


@register("files_by_index", """
SELECT info_hash, idx, path FROM (
  SELECT info_hash, idx, path, row_number() OVER (PARTITION BY info_hash ORDER BY idx) AS r FROM files) t
WHERE r <= 3""", ("files",))
def files_by_index(fx):
    """Files of every item ordered by index, capped at 3 per item."""
    return R.top_k(fx["files"], "info_hash", [F.asc("idx")], 3).select("info_hash", "idx", "path")


@register("numeric_id_order", """
SELECT content_id, row_number() OVER (ORDER BY TRY_CAST(content_id AS BIGINT), content_type) AS position FROM refs""",
          ("refs",))
def numeric_id_order(fx):
    """Text ids ordered as numbers (position over the whole table)."""
    out = R.global_position(fx["refs"], [R.numeric_id_order("content_id"), F.col("content_type")])
    return out.select("content_id", "position")
