"""Set operations (U1-U4): unions of ranked branches and distinct ref sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.functions.query import query_tokens
from catalux.operators.filters import like_pattern
from catalux.operators.textjoin import GramIndex, contains_join
from catalux.session import materialize, stored


def film_key() -> Column:
    """Key of an enrichment row in a gram index."""
    return F.concat_ws("\u0001", "content_type", "tmdb_id")


def title_key() -> Column:
    """Key of a film content row joined to its enrichment (content id as ``_cid``)."""
    return F.concat_ws("\u0001", "content_type", "tmdb_id", "_cid")


def expansion_candidates(queries: DataFrame, enrich: DataFrame, content: DataFrame, limit: int = 20,
                         qid: str = "query_id", q: str = "q", film_source: str = "tmdb",
                         film_index: GramIndex | None = None, title_index: GramIndex | None = None) -> DataFrame:
    """UNION ALL of three branches, each limited per query (first rows by enrichment key):

    matched      - aka or keywords contain q;
    title_matched - film content title / original title contains q, joined to its enrichment;
    aka_token_matched - aka contains the first ASCII token and the first non-ASCII token of q
                        (each falls back to q itself).
    Returns (query_id, branch, content_type, tmdb_id, aka, keywords).  ``film_index`` / ``title_index``: gram indexes over
    (aka, keywords) keyed ``film_key`` and over (title, original_title) keyed ``title_key``, where they are kept.
    """
    fe = enrich.select("content_type", "tmdb_id", "aka", "keywords").withColumn("_ek", film_key())
    # both stand on whole texts where they are made from them, and each join reads its rows several times
    fe = stored(fe, "expansion-film")
    order = [F.asc("content_type"), F.asc("tmdb_id")]
    qs = materialize(queries.select(qid, q))     # each branch reads it several times
    b1 = contains_join(qs, qid, q, fe, "_ek", ["aka", "keywords"], limit_per_query=limit, order=order, index=film_index)
    c = content.where(F.col("source") == film_source).select(
        F.col("type").alias("_ct"), F.col("id").cast("string").alias("_cid"), "title", "original_title")
    ce = stored(c.join(fe, (c["_ct"] == fe["content_type"]) & (c["_cid"] == fe["tmdb_id"])).withColumn("_ck", title_key()),
                "expansion-title")
    b2 = contains_join(qs, qid, q, ce, "_ck", ["title", "original_title"], limit_per_query=limit, order=order, index=title_index)
    a, o = query_tokens(q)
    qt = qs.select(qid, F.coalesce(a, F.col(q)).alias("_t1"), F.coalesce(o, F.col(q)).alias("_t2"))
    b3 = contains_join(qt, qid, "_t1", fe, "_ek", ["aka"],
                       extra_pred=F.ilike(F.col("aka"), like_pattern(F.col("_t2"))),
                       limit_per_query=limit, order=order, index=film_index, also="_t2")
    cols = [qid, "content_type", "tmdb_id", "aka", "keywords"]
    parts = [b.select(*cols).withColumn("branch", F.lit(n))
             for b, n in ((b1, "matched"), (b2, "title_matched"), (b3, "aka_token_matched"))]
    return reduce(lambda x, y: x.unionByName(y), parts)


def hybrid_merge(primary: DataFrame, secondary: DataFrame, k: int, qid: str = "query_id",
                 keys=("source", "pg_id")) -> DataFrame:
    """Primary hits plus secondary hits not already present (by key), re-ranked by score, top k."""
    keys = list(keys)
    extra = secondary.join(primary.select(qid, *keys), [qid, *keys], "left_anti")
    merged = primary.unionByName(extra, allowMissingColumns=True)
    w = Window.partitionBy(qid).orderBy(F.desc("score"), *[F.asc(c) for c in keys])
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def multi_source_union(frames: dict) -> DataFrame:
    """Candidates of every selected source in one frame (missing columns become NULL)."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def distinct_refs(refs: DataFrame, keys) -> DataFrame:
    """U4: the set of refs before look-up."""
    return refs.select(*keys).distinct()
