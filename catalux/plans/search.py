"""Search plans (E1-E4): a table of queries in, a table of ranked hits out.

A call returns a lazy DataFrame, after computing the query table once (a
small table that is read several times).  The shuffles are: per-query windows (top-k, dedupes, paging) on ``query_id``,
the substring joins of the expansion step on a gram key, and the look-up
join of hits to source rows on (source, pg_id).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.functions.query import embed_query_text, english_expansion, expand_query, is_ascii, query_filters
from catalux.functions.text import keyword_score, normalize_info_hash, safety_flag, size_coalesce
from catalux.functions import fixed
from catalux.operators import vector as V
from catalux.operators.aggregates import expansion_terms
from catalux.operators.embed import HASH_DIM, embed_frame
from catalux.operators.filters import TEXT_FORMS, has_external_id, select_sources, size_min_filter, user_predicate
from catalux.operators.joins import configured_join
from catalux.operators import ranking as R
from catalux.operators.ranking import dedupe_hits_by_hash, dedupe_results_by_title
from catalux.operators.sets import expansion_candidates, hybrid_merge
from catalux.operators.textjoin import contains_join
from catalux.session import materialize, settled
from catalux.spec import SourceSpec


@dataclass(frozen=True)
class SearchParams:
    topk: int = 20
    page_size: int = 20
    cursor: int = 0
    exclude_nsfw: bool = True
    tmdb_only: bool = False
    expand: bool = True
    size_min_bytes: int | None = None
    size_sort: str | None = None
    query_prefix: str = ""
    expand_limit: int = 20
    film_source: str = "tmdb"
    lite: bool = True          # False: results carry a ``metadata`` struct of the row's other columns (P7)
    threshold: float = fixed.SAFETY_THRESHOLD

    @property
    def fetch_k(self) -> int:
        return min(100, max(self.topk, self.page_size))


def understand(queries: DataFrame, film: DataFrame | None, content: DataFrame | None, p: SearchParams) -> DataFrame:
    """X9 -> U1 -> A9 -> X11 -> X10 -> X39 for every query row."""
    f = query_filters("q")
    qf = queries.select("*", *[f[k].alias(k) for k in ("cleaned", "file_type", "audio_langs", "subtitle_langs", "genres")])
    # the query table feeds three substring joins and the rewrite: compute it once (and keep the
    # cleaning expressions from being inlined into pushed-down filters)
    qf = materialize(qf)
    if p.expand and film is not None and content is not None:
        cq = qf.select("query_id", F.col("cleaned").alias("q"))
        # read twice below (English titles and the rewrite): compute once
        terms = materialize(expansion_terms(expansion_candidates(cq, film, content, p.expand_limit,
                                                                 film_source=p.film_source)))
        eng = english_expansion(terms)
        ex = expand_query(qf.select("query_id", F.col("cleaned").alias("_c")), terms, q="_c").select("query_id", "expanded")
        qf = qf.join(ex, "query_id", "left").join(eng, "query_id", "left")
    else:
        qf = expand_query(qf.withColumn("_c", F.col("cleaned")), None, q="_c").drop("_c").withColumn(
            "english", F.lit(None).cast("string"))
    return qf.withColumn("final_query", embed_query_text("expanded", p.query_prefix))


def _metadata(rows: DataFrame, id_field: str, text_field: str) -> Column:
    """Every column but id and title, binary values rendered; NULL when there is none."""
    from catalux.operators.views import render_binary
    kept = [c for c, f in zip(render_binary(rows), rows.schema.fields) if f.name not in (id_field, text_field)]
    return F.struct(*kept) if kept else F.lit(None).cast("struct<>")


def semantic_search(queries: DataFrame, points: DataFrame, rows: DataFrame, p: SearchParams,
                    film: DataFrame | None = None, content: DataFrame | None = None,
                    qvec: str | None = None, make_embedder=None, dim: int | None = None,
                    cross_language: bool = True, svec: str | None = None) -> DataFrame:
    """E1.  ``queries``: (query_id, q[, qvec, svec]); ``points``: vectors + payload; ``rows``:
    (source, pg_id, title, size...) of every configured source.  ``qvec`` / ``svec`` name given vectors of the query and
    of its English form; without them the texts are embedded."""
    return semantic_pages(queries, points, rows, p, film, content, qvec, make_embedder, dim, cross_language, svec)[0]


def semantic_pages(queries: DataFrame, points: DataFrame, rows: DataFrame, p: SearchParams,
                   film: DataFrame | None = None, content: DataFrame | None = None,
                   qvec: str | None = None, make_embedder=None, dim: int | None = None,
                   cross_language: bool = True, svec: str | None = None) -> tuple[DataFrame, DataFrame]:
    """E1 as (hits, pages): ``pages`` has one row a query, (query_id, hits, next_cursor), also where every hit of
    the page was filtered away, so that such a query does not look finished."""
    qu = understand(queries, film, content, p)
    if dim is None:
        # the index decides: both searches embed at the length of its vectors
        first = points.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("d")).first()
        dim = first["d"] if first else HASH_DIM
    if qvec is None:
        qu = embed_frame(qu, "final_query", "qvec", dim=dim, make_embedder=make_embedder)
        qvec = "qvec"
    # the query table feeds the size check, the broadcast and the second search: compute it once
    qu = materialize(qu)
    has_ext = F.lit(bool(p.tmdb_only))
    smin = F.lit(float(p.size_min_bytes)) if p.size_min_bytes else None
    qc = V.query_codes(qu, file_type="file_type", audio="audio_langs", subs="subtitle_langs", genres="genres",
                       has_ext=has_ext, size_min=smin)
    pts = V.point_codes(points)
    k = p.fetch_k
    prim = V.knn(pts, qc, k + p.cursor, qid="query_id", qvec=qvec, use_filters=True)
    if cross_language:
        sec_q = qu.where(F.col("english").isNotNull() & (F.col("english") != "") & ~is_ascii("cleaned"))
        if svec is None:
            sec_q = expand_query(sec_q.select("query_id", F.col("english").alias("_e")), None, q="_e").select(
                "query_id", embed_query_text("expanded", p.query_prefix).alias("final_query"))
            sec_q = embed_frame(sec_q, "final_query", "svec", dim=dim, make_embedder=make_embedder)
        else:
            sec_q = sec_q.select("query_id", F.col(svec).alias("svec"))
        sec_c = V.query_codes(sec_q, has_ext=has_ext, size_min=smin)
        # one merged list, ranked once, then the page: a later page never repeats a hit
        sec = V.knn(pts, sec_c, k + p.cursor, qid="query_id", qvec="svec", use_filters=True).drop("rank")
        merged = hybrid_merge(prim.drop("rank"), sec, k + p.cursor)
    else:
        merged = prim
    merged = merged.where(F.col("rank") > p.cursor)
    counts = merged.groupBy("query_id").agg(F.count(F.lit(1)).alias("raw_count"))
    payload = points.select("source", "pg_id", "text_hash", F.coalesce(F.col("nsfw"), F.lit(False)).alias("nsfw"),
                            (F.col("nsfw_score") if "nsfw_score" in points.columns else F.lit(0.0)).alias("nsfw_score"))
    hits = merged.join(payload, ["source", "pg_id"])
    hits = dedupe_hits_by_hash(hits, "query_id", ["rank"])
    if p.exclude_nsfw:
        hits = hits.where(~F.col("nsfw"))
    # the filters hold for the row as well as for its point's payload, which may be older
    if p.tmdb_only and "tmdb_id" in rows.columns:
        rows = rows.where(has_external_id("tmdb_id"))
    if p.size_min_bytes:
        rows = rows.where(size_min_filter("size", p.size_min_bytes))
    extra = [] if p.lite else [_metadata(rows.drop("source"), "pg_id", "title").alias("metadata")]
    r = rows.select(F.col("source").alias("_src"), F.col("pg_id").alias("_pid"), "title", F.col("size").alias("meta_size"), *extra)
    res = hits.join(r, (hits["source"] == r["_src"]) & (hits["pg_id"] == r["_pid"])).drop("_src", "_pid")
    res = dedupe_results_by_title(res, "query_id")
    if p.size_sort in ("asc", "desc"):
        size = size_coalesce(F.col("meta_size"))
        miss = F.when(size.isNull(), 1).otherwise(0)
        s = F.coalesce(size, F.lit(0.0))
        order = [miss.asc(), s.desc() if p.size_sort == "desc" else s.asc(), F.desc("score"), "source", "pg_id"]
    else:
        order = [F.desc("score"), "source", "pg_id"]
    w = Window.partitionBy("query_id").orderBy(*order)
    out = res.withColumn("position", F.row_number().over(w).cast("bigint")).join(counts, "query_id")
    nxt = F.when(F.col("raw_count") == k, F.lit(p.cursor) + F.col("raw_count")).cast("bigint")
    found = out.select("query_id", "position", "source", "pg_id", "title", "score", "nsfw", "nsfw_score",
                       nxt.alias("next_cursor"), *([] if p.lite else ["metadata"]))
    pages = queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("raw_count", F.lit(0).cast("long")).alias("hits"), nxt.alias("next_cursor"))
    return found, pages


CANDIDATE = ("query_id long, source string, pg_id string, title string, nsfw boolean, nsfw_score double, score double, "
             "meta_size double, metadata string")


def keyword_search_sources(queries: DataFrame, sources: dict[str, tuple[SourceSpec, DataFrame]], state: DataFrame,
                           p: SearchParams, explicit: str | None = None, normalize: bool | None = None,
                           tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """E2 over the selected sources (F16): each gives its own limited candidates, which are de-duplicated, ranked and
    paged together.  No source selected, or none known: no rows."""
    spark = queries.sparkSession
    specs = spark.createDataFrame([(n, spec.keyword_search, spec.ext_id_field in spec.fields) for n, (spec, _) in sources.items()],
                                  "name string, keyword_search boolean, has_ext boolean")
    # the required field has a name of its own in each source
    specs = specs.withColumn("fields", F.when(F.col("has_ext"), F.array(F.lit("ext_id"))).otherwise(F.array().cast("array<string>")))
    chosen = {r["name"] for r in select_sources(specs, explicit, "ext_id" if p.tmdb_only else None).collect()}   # a few names
    parts = [keyword_candidates(queries, rows, spec, state, p, normalize or spec.keyword_normalize, tables)
             for n, (spec, rows) in sources.items() if n in chosen]
    if not parts:
        parts = [spark.createDataFrame([], CANDIDATE)]
    return rank_and_page(reduce(lambda a, b: a.unionByName(b), parts), p)


def keyword_search(queries: DataFrame, rows: DataFrame, spec: SourceSpec, state: DataFrame, p: SearchParams,
                   normalize: bool | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """E2 for one configured source (``keyword_search_sources`` takes several)."""
    return rank_and_page(keyword_candidates(queries, rows, spec, state, p, bool(normalize), tables), p)


def keyword_candidates(queries: DataFrame, rows: DataFrame, spec: SourceSpec, state: DataFrame, p: SearchParams,
                       normalize: bool = False, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Scored candidates of one source: its own rows that match, before ranking.

    ``rows`` is the source table; matches are found with the substring join, once for each text form (as written, and
    bare for CJK queries or by option).  Unless ``p.lite``, ``metadata`` is a JSON text of the row's other columns and of
    the fields of the source's configured joins (``tables`` by name).
    """
    f = query_filters("q")
    cleaned = materialize(queries.select("query_id", f["cleaned"].alias("cleaned")))
    qs = cleaned.select("query_id", F.col("cleaned").alias("q")).where(F.col("q") != "")
    fields = list(dict.fromkeys([*spec.keyword_fields, spec.text_field]))
    sized = spec.size_field if spec.size_field in rows.columns else None
    preds = [user_predicate(spec.where)]
    if p.tmdb_only:
        # a source without the field has no row that meets the demand
        preds.append(F.col(spec.ext_id_field).isNotNull() if spec.ext_id_field in spec.fields else F.lit(False))
    if p.size_min_bytes and sized:
        preds.append(F.col(sized) >= p.size_min_bytes)
    base = rows.where(reduce(lambda a, b: a & b, preds)).withColumn("_key", F.col(spec.id_field).cast("string"))

    def found(form) -> DataFrame:
        asked = qs.where(form.asked(F.col("q"), normalize)).select("query_id", form.fold(F.col("q")).alias("q"))
        texts = base.select("_key", *[form.fold(F.col(c)).alias(f"_t{i}") for i, c in enumerate(fields)])
        return contains_join(asked, "query_id", "q", texts, "_key", [f"_t{i}" for i in range(len(fields))]).select("query_id", "_key")

    matched = reduce(lambda a, b: a.unionByName(b), [found(form) for form in TEXT_FORMS]).distinct()
    limit = min(2000, max(p.cursor + p.page_size * 3, p.topk * 3))
    matched = R.top_k(matched, "query_id", ["_key"], limit, "_r").drop("_r")
    j = matched.join(base, "_key").join(cleaned, "query_id")
    metadata = F.lit(None).cast("string")
    if not p.lite:
        j = configured_join(j, spec.joins, tables or {})
        others = j.drop("query_id", "cleaned", "_key")
        metadata = F.lit("{}") if set(others.columns) <= {spec.id_field, spec.text_field} else F.to_json(
            _metadata(others, spec.id_field, spec.text_field), {"ignoreNullFields": "false"})
    j = j.withColumn("metadata", metadata)
    st = state.where(F.col("source") == spec.name).select(F.col("pg_id").alias("_sp"),
                                                           F.col("nsfw_score").cast("double").alias("_ns"))
    j = j.join(st, j["_key"] == st["_sp"], "left").withColumn("nsfw_score", F.coalesce("_ns", F.lit(0.0)))
    j = j.withColumn("nsfw", safety_flag("nsfw_score", spec.tagging_nsfw, p.threshold))
    if p.exclude_nsfw:
        j = j.where(~F.col("nsfw"))
    return j.select("query_id", F.lit(spec.name).alias("source"), F.col("_key").alias("pg_id"),
                    F.col(spec.text_field).alias("title"), "nsfw", "nsfw_score",
                    keyword_score("cleaned", F.col(spec.text_field)).alias("score"),
                    (F.col(sized) if sized else F.lit(None)).cast("double").alias("meta_size"), "metadata")


def rank_and_page(cand: DataFrame, p: SearchParams) -> DataFrame:
    """T2 -> W2 -> T3 -> T5 over merged candidates of all sources."""
    d = dedupe_results_by_title(cand, "query_id")
    if p.size_sort in ("asc", "desc"):
        size = size_coalesce(F.col("meta_size"))
        miss = F.when(size.isNull(), 1).otherwise(0)
        s = F.coalesce(size, F.lit(0.0))
        order = [miss.asc(), s.desc() if p.size_sort == "desc" else s.asc(), F.desc("score"), "source", "pg_id"]
    else:
        order = [F.desc("score"), "source", "pg_id"]
    page = R.page(d, "query_id", order, p.cursor, p.page_size, rank_col="position")
    nxt = F.when(F.col("has_more"), F.lit(p.cursor + p.page_size)).cast("bigint")
    return page.select("query_id", F.col("position").cast("bigint").alias("position"), "source", "pg_id", "title",
                       "score", "nsfw", "nsfw_score", nxt.alias("next_cursor"), *([] if p.lite else ["metadata"]))


def keyword_search_payload(responses: DataFrame, state: DataFrame, p: SearchParams, source_name: str,
                           query_col: str = "q", js: str = "search_json") -> DataFrame:
    """Keyword hits from landed search payloads (one payload per query)."""
    from catalux.functions.match import node_has_external_id
    from catalux.sources.payload import each_node, node_columns, search_meta, search_nodes
    meta = search_meta(F.col(js))
    # once a payload, not once a hit
    base = responses.select("query_id", query_col, search_nodes(F.col(js)).alias("_nodes"), meta["has_next_page"].alias("has_next"))
    base = each_node(base, "_nodes")
    c = node_columns(F.col("node"))
    n = base.select("query_id", query_col, "has_next", c["info_hash_raw"].alias("_hash"), c["title"].alias("title"),
                    c["size_raw"].alias("size"), *([node_has_external_id(F.col("node")).alias("has_ext")] if p.tmdb_only else []))
    n = settled(n).withColumn("pg_id", normalize_info_hash("_hash")).drop("_hash")
    n = settled(n).where((F.col("pg_id") != "") & (F.col("title") != ""))
    if p.size_min_bytes is not None:
        n = n.where(F.coalesce(F.col("size"), F.lit(0.0)) >= float(p.size_min_bytes))
    if p.tmdb_only:
        n = n.where(F.col("has_ext"))
    st = state.where(F.col("source") == source_name).select(F.col("pg_id").alias("_sp"),
                                                            F.col("nsfw_score").cast("double").alias("_ns"))
    n = n.join(st, n["pg_id"] == st["_sp"], "left").withColumn("nsfw_score", F.coalesce("_ns", F.lit(0.0)))
    n = n.withColumn("nsfw", F.col("nsfw_score") >= p.threshold)
    if p.exclude_nsfw:
        n = n.where(~F.col("nsfw"))
    cand = n.select("query_id", F.lit(source_name).alias("source"), "pg_id", "title", "nsfw", "nsfw_score",
                    keyword_score(query_col, "title").alias("score"), "has_next")
    # both windows (a title's first hit, the page) lie inside a query: one shuffle
    cand = cand.repartition("query_id")
    d = dedupe_results_by_title(cand, "query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "pg_id")
    ranked = d.withColumn("position", F.row_number().over(w)).where(F.col("position") <= p.page_size)
    nxt = F.when(F.col("has_next"), F.lit(p.cursor + p.page_size)).cast("bigint")
    return ranked.select("query_id", F.col("position").cast("bigint").alias("position"), "source", "pg_id", "title",
                         "score", "nsfw", "nsfw_score", nxt.alias("next_cursor"))


def item_files(keys: DataFrame, files: DataFrame, limit: int = 2000, key_col: str = "info_hash") -> DataFrame:
    """Files of each requested item, ordered by index, capped (limit <= 20000)."""
    limit = max(1, min(int(limit), 20000))
    k = keys.select(normalize_info_hash(F.col(key_col)).alias("_h")).distinct()
    f = files.withColumn("_h", normalize_info_hash(F.col("info_hash")))
    j = f.join(k, "_h", "left_semi")
    w = Window.partitionBy("_h").orderBy("idx")
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r", "_h")
