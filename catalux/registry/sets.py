"""Registered queries: set operators and query expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalux.functions.query import embed_query_text, english_expansion, expand_query
from catalux.operators.aggregates import expansion_terms as _expansion_terms
from catalux.operators.sets import distinct_refs, expansion_candidates as _candidates, hybrid_merge, multi_source_union
from catalux.operators.vector import knn
from catalux.registry import duck as D
from catalux.registry import register
from catalux.registry.common import self_queries
from catalux.registry.common import FILM_ENRICH_SQL, FILM_SOURCE, ITEMS_CONTENT_SQL, film_enrich, items_content
from catalux.registry.scalars import SEARCH_TEXTS_SQL, search_texts

# --- oracle text -------------------------------------------------------------

_T1 = "coalesce(nullif(regexp_extract(qt.q, '([a-zA-Z0-9]+)', 1), ''), qt.q)"
_T2 = "coalesce(nullif(regexp_extract(qt.q, '([^\\x00-\\x7F]+)', 1), ''), qt.q)"

CANDIDATES_SQL = f"""
qt AS ({SEARCH_TEXTS_SQL}),
fe AS ({FILM_ENRICH_SQL}),
ce AS (SELECT c.title, c.original_title, fe.* FROM ({ITEMS_CONTENT_SQL}) c
       JOIN fe ON fe.content_type = c.type AND fe.tmdb_id = c.id WHERE c.source = '{FILM_SOURCE}'),
b1 AS (SELECT * FROM (SELECT qt.query_id, fe.content_type, fe.tmdb_id, fe.aka, fe.keywords,
          row_number() OVER (PARTITION BY qt.query_id ORDER BY fe.content_type, fe.tmdb_id) AS r
        FROM qt JOIN fe ON (fe.aka ILIKE '%' || qt.q || '%' OR fe.keywords ILIKE '%' || qt.q || '%')
        WHERE coalesce(qt.q, '') <> '') t WHERE r <= 20),
b2 AS (SELECT * FROM (SELECT qt.query_id, ce.content_type, ce.tmdb_id, ce.aka, ce.keywords,
          row_number() OVER (PARTITION BY qt.query_id ORDER BY ce.content_type, ce.tmdb_id) AS r
        FROM qt JOIN ce ON (ce.title ILIKE '%' || qt.q || '%' OR ce.original_title ILIKE '%' || qt.q || '%')
        WHERE coalesce(qt.q, '') <> '') t WHERE r <= 20),
b3 AS (SELECT * FROM (SELECT qt.query_id, fe.content_type, fe.tmdb_id, fe.aka, fe.keywords,
          row_number() OVER (PARTITION BY qt.query_id ORDER BY fe.content_type, fe.tmdb_id) AS r
        FROM qt JOIN fe ON (fe.aka ILIKE '%' || {_T1} || '%' AND fe.aka ILIKE '%' || {_T2} || '%')
        WHERE coalesce(qt.q, '') <> '') t WHERE r <= 20),
cands AS (SELECT query_id, 'matched' AS branch, content_type, tmdb_id, aka, keywords FROM b1
          UNION ALL SELECT query_id, 'title_matched', content_type, tmdb_id, aka, keywords FROM b2
          UNION ALL SELECT query_id, 'aka_token_matched', content_type, tmdb_id, aka, keywords FROM b3)"""

TERMS_SQL = f"""{CANDIDATES_SQL},
raw_terms AS (
  SELECT query_id, unnest(regexp_split_to_array(coalesce(aka, ''), '[，,|/·]+')) AS term, 2 AS weight FROM cands
  UNION ALL
  SELECT query_id, unnest(regexp_split_to_array(coalesce(keywords, ''), '[，,|/·]+')) AS term, 1 AS weight FROM cands),
terms AS (SELECT query_id, {D.strip_ws('term')} AS term, max(weight) AS weight FROM raw_terms
          WHERE {D.strip_ws('term')} <> '' GROUP BY query_id, {D.strip_ws('term')})"""


def _terms(fx):
    qt = search_texts(fx)
    cands = _candidates(qt, film_enrich(fx), items_content(fx), 20, film_source=FILM_SOURCE)
    return qt, cands


@register("expansion_candidates", f"WITH {CANDIDATES_SQL} SELECT * FROM cands", ("queries", "items", "enrich"))
def expansion_candidates(fx):
    """Three limited branches (aka/keywords, film title, both query tokens) over whole tables."""
    _, cands = _terms(fx)
    return cands.select("query_id", "branch", "content_type", "tmdb_id", "aka", "keywords")


@register("expansion_terms", f"WITH {TERMS_SQL} SELECT query_id, term, weight FROM terms",
          ("queries", "items", "enrich"))
def expansion_terms(fx):
    """Aka (weight 2) and keyword (weight 1) terms, split on , ， | / ·, max weight per term."""
    _, cands = _terms(fx)
    return _expansion_terms(cands)


_RANKED = f"""
ranked AS (
  SELECT t.query_id, t.term, row_number() OVER (PARTITION BY t.query_id
           ORDER BY CASE WHEN {D.is_ascii('t.term')} THEN 0 ELSE 1 END, t.weight DESC, t.term) AS tr
  FROM terms t JOIN qt ON qt.query_id = t.query_id
  WHERE length(t.term) >= 2 AND lower(t.term) <> lower(qt.q)),
extra AS (SELECT query_id, list(term ORDER BY tr) AS extra FROM ranked WHERE tr <= 8 GROUP BY query_id),
toks AS (SELECT qt.query_id, qt.q, list_concat([qt.q], {D.synonyms('qt.q')}, coalesce(e.extra, []::VARCHAR[])) AS toks
         FROM qt LEFT JOIN extra e ON e.query_id = qt.query_id),
expanded AS (SELECT query_id, q, CASE WHEN coalesce(q, '') = '' THEN q ELSE
               array_to_string(list_filter(toks, lambda x, i: list_position(toks, x) = i), ' ') END AS expanded FROM toks)"""


@register("expand_query", f"WITH {TERMS_SQL}, {_RANKED} SELECT query_id, expanded FROM expanded",
          ("queries", "items", "enrich"))
def expand_query_q(fx):
    """Query + synonyms + at most 8 expansion terms (ASCII first, then weight), deduped."""
    qt, cands = _terms(fx)
    return expand_query(qt, _expansion_terms(cands)).select("query_id", "expanded")


_HEAD = D.strip_ws("split_part(term, ':', 1)")
ENGLISH_SQL = f"""
cand AS (
  SELECT query_id, CASE WHEN strpos(term, ':') > 0 THEN (CASE WHEN length({_HEAD}) >= 5 THEN {_HEAD} END)
                        WHEN regexp_full_match(substring(term, 1, 1), '[A-Z]') THEN term END AS cand, weight
  FROM terms WHERE {D.is_ascii('term')} AND length(term) >= 5 AND strpos(term, ' ') > 0),
best AS (SELECT query_id, cand, max(weight) AS weight FROM cand WHERE coalesce(cand, '') <> '' GROUP BY query_id, cand),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(cand) DESC, weight DESC, cand) AS r FROM best),
english AS (SELECT query_id, array_to_string(list(cand ORDER BY r), ' ') AS english FROM top WHERE r <= 3 GROUP BY query_id)"""


@register("english_expansion", f"WITH {TERMS_SQL}, {ENGLISH_SQL} SELECT query_id, english FROM english",
          ("queries", "items", "enrich"))
def english_expansion_q(fx):
    """X11: longest (then heaviest) ASCII titles from the expansion terms, top 3 joined."""
    _, cands = _terms(fx)
    return english_expansion(_expansion_terms(cands))


@register("embed_query_text", f"""
WITH {TERMS_SQL}, {_RANKED}
SELECT query_id, 'query: ' || CASE WHEN {D.normalize_title('expanded')} <> '' THEN {D.normalize_title('expanded')}
                                  ELSE expanded END AS embed_text FROM expanded""", ("queries", "items", "enrich"))
def embed_query_text_q(fx):
    """Prefix + normalised expanded query (else the expanded text)."""
    qt, cands = _terms(fx)
    ex = expand_query(qt, _expansion_terms(cands))
    return ex.select("query_id", embed_query_text("expanded", "query: ").alias("embed_text"))


@register("hybrid_merge", """
WITH s AS (SELECT q.vec_id AS query_id, p.source, p.pg_id, p.file_type,
                  round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score
           FROM (SELECT * FROM points WHERE vec_id % 50 = 0) q, points p),
prim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS r
         FROM s WHERE file_type = 'video') t WHERE r <= 10),
sec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS r
        FROM s) t WHERE r <= 10),
merged AS (SELECT query_id, source, pg_id, score FROM prim
           UNION ALL SELECT query_id, source, pg_id, score FROM sec
           WHERE NOT EXISTS (SELECT 1 FROM prim WHERE prim.query_id = sec.query_id AND prim.source = sec.source
                             AND prim.pg_id = sec.pg_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pg_id) AS rank
               FROM merged) t WHERE rank <= 10""", ("points",))
def hybrid_merge_q(fx):
    """Filtered primary hits + unfiltered secondary hits not already present, re-ranked, top k."""
    p = fx["points"]
    q = self_queries(p)
    prim = knn(p.where(F.col("file_type") == "video"), q, 10).drop("rank")
    sec = knn(p, q, 10).drop("rank")
    out = hybrid_merge(prim, sec, 10)
    return out.select("query_id", "source", "pg_id", F.round("score", 6).alias("score"),
                      F.col("rank").cast("bigint").alias("rank"))


@register("multi_source_union", """
SELECT 'items' AS source, pg_id, title, size, CAST(NULL AS VARCHAR) AS path FROM items
UNION ALL SELECT 'files' AS source, file_id AS pg_id, CAST(NULL AS VARCHAR) AS title, size, path FROM files""",
          ("items", "files"))
def multi_source_union_q(fx):
    """Candidates of every selected source in one frame (missing columns NULL)."""
    it = fx["items"].select("pg_id", "title", F.col("size").cast("bigint").alias("size"))
    fl = fx["files"].select(F.col("file_id").alias("pg_id"), F.col("size").cast("bigint").alias("size"), "path")
    return multi_source_union({"items": it, "files": fl}).select("source", "pg_id", "title", "size", "path")


@register("distinct_refs", """
SELECT DISTINCT content_type, content_source FROM refs""", ("refs",))
def distinct_refs_q(fx):
    """U4: the set of refs before look-up."""
    return distinct_refs(fx["refs"], ["content_type", "content_source"])


@register("title_match_expansion", f"WITH {CANDIDATES_SQL} SELECT query_id, content_type, tmdb_id, aka, keywords FROM b2",
          ("queries", "items", "enrich"))
def title_match_expansion(fx):
    """Film content whose title contains the query, joined to its enrichment (aka, keywords), 20 per query."""
    from catalux.operators.textjoin import contains_join
    qt = search_texts(fx)
    fe = film_enrich(fx).select("content_type", "tmdb_id", "aka", "keywords")
    c = items_content(fx).where(F.col("source") == FILM_SOURCE).select(
        F.col("type").alias("_ct"), F.col("id").alias("_cid"), "title", "original_title")
    ce = c.join(fe, (c["_ct"] == fe["content_type"]) & (c["_cid"] == fe["tmdb_id"])).withColumn(
        "_ck", F.concat_ws("\u0001", "content_type", "tmdb_id", "_cid"))
    out = contains_join(qt, "query_id", "q", ce, "_ck", ["title", "original_title"], limit_per_query=20,
                        order=[F.asc("content_type"), F.asc("tmdb_id")])
    return out.select("query_id", "content_type", "tmdb_id", "aka", "keywords")
