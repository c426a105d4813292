"""Exact vector top-k (V1-V6, V9) as a grid join.

Points and queries are cut into blocks by a hash of their keys; the pair of
block numbers is the join key, each point block is sent once for every query
block and each query block once for every point block (fragment and
replicate), and a cogroup scores one block against another with one matrix
product.  It keeps, per query, the block's best k and whatever ties with the
k-th; a ``row_number() <= k`` window over (rounded score desc, key columns
asc) picks the final k.  Neither side passes the driver, a cell holds at most
``POINT_ROWS x QUERY_ROWS`` scores, and with few queries (one block of them)
each point is shuffled once.

Filters that differ from query to query are a relation: queries of equal
filters share a signature, points are joined to the signatures they satisfy
(equi-join on one word of the signature, the rest as a predicate), and the
grid is formed inside a signature.  So a filtered query never meets a point
it may not return.  An inverted file (``ivf``) adds its cell to that key in
the same way.  A point vector of another length than the queries' fails the
job; a NULL vector is never a hit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalux.operators.filters import has_external_id
from catalux.session import shared_path

SCORE_DECIMALS = 6
METRICS = ("cosine", "dot", "l2")
POINT_ROWS, QUERY_ROWS = 8_192, 512      # of a block
LEAST_ROWS = 256                         # no more blocks than this asks for, however many cores there are

# Query-side filter columns that name a query's filters.
Q_FILE_TYPE, Q_AUDIO, Q_SUB, Q_GENRE, Q_HAS_EXT, Q_SIZE_MIN = (
    "f_file_type", "f_audio", "f_sub", "f_genre", "f_has_ext", "f_size_min")
# Point-side payload columns the filters compare against.
P_FILE_TYPE, P_AUDIO, P_SUB, P_GENRE, P_HAS_EXT, P_SIZE = (
    "c_file_type", "c_audio", "c_sub", "c_genre", "c_has_ext", "c_size")
LIST_FILTERS = ((Q_GENRE, P_GENRE), (Q_AUDIO, P_AUDIO), (Q_SUB, P_SUB))
Q_FILTERS = (Q_FILE_TYPE, Q_GENRE, Q_AUDIO, Q_SUB, Q_HAS_EXT, Q_SIZE_MIN)
P_FILTERS = (P_FILE_TYPE, P_GENRE, P_AUDIO, P_SUB, P_HAS_EXT, P_SIZE)


def point_codes(points: DataFrame, file_type="file_type", audio="audio_langs", subs="subtitle_langs",
                genres="genre_tags", ext_id="tmdb_id", size="size") -> DataFrame:
    """Add the point-side filter columns from payload columns."""
    return points.select(
        "*",
        F.col(file_type).alias(P_FILE_TYPE),
        F.col(audio).alias(P_AUDIO),
        F.col(subs).alias(P_SUB),
        F.col(genres).alias(P_GENRE),
        has_external_id(ext_id).alias(P_HAS_EXT),
        F.col(size).try_cast("double").alias(P_SIZE),
    )


def query_codes(queries: DataFrame, file_type=None, audio=None, subs=None, genres=None,
                has_ext=None, size_min=None) -> DataFrame:
    """Add query-side filter columns; None (or an empty list) leaves that filter off."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    none_arr = F.lit(None).cast("array<string>")
    return queries.select(
        "*",
        (c(file_type) if file_type is not None else F.lit(None).cast("string")).alias(Q_FILE_TYPE),
        (c(audio) if audio is not None else none_arr).alias(Q_AUDIO),
        (c(subs) if subs is not None else none_arr).alias(Q_SUB),
        (c(genres) if genres is not None else none_arr).alias(Q_GENRE),
        (F.coalesce(c(has_ext).cast("boolean"), F.lit(False)) if has_ext is not None else F.lit(False)).alias(Q_HAS_EXT),
        (c(size_min).cast("double") if size_min is not None else F.lit(None).cast("double")).alias(Q_SIZE_MIN),
    )


# --- filters as a relation ---------------------------------------------------

def _with_signature(queries: DataFrame) -> DataFrame:
    """``queries`` with ``_sig``, a text that is equal where all filters are equal."""
    plain = [F.nullif(F.col(Q_FILE_TYPE), F.lit("")).alias(Q_FILE_TYPE)]
    plain += [F.when(F.size(q) > 0, F.array_sort(F.array_distinct(F.array_compact(q)))).alias(q) for q, _ in LIST_FILTERS]
    plain += [F.when(F.col(Q_HAS_EXT), F.lit(True)).alias(Q_HAS_EXT), F.col(Q_SIZE_MIN)]
    return queries.withColumn("_sig", F.to_json(F.struct(*plain)))


def _words(file_type: str, lists) -> list[Column]:
    """One array a filter column of 'column:word' texts."""
    return [F.array_compact(F.array(F.concat(F.lit("t:"), F.nullif(F.col(file_type), F.lit("")))))] + \
        [F.transform(F.coalesce(F.array_compact(c), F.array().cast("array<string>")), _tagger(f"{i}:")) for i, c in enumerate(lists)]


def _tagger(tag: str):
    return lambda w: F.concat(F.lit(tag), w)


def allowed(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Points with the ``_sig`` of every filter combination of ``queries`` that they satisfy (one row a pair).

    A signature is found through one of its filters, the first that it has: the point has one of that filter's words.
    Where it has several of them, the first one counts.  Signatures without such a filter are found through '*'.
    """
    sigs = queries.select("_sig", *Q_FILTERS).dropDuplicates(["_sig"])
    any_word = F.array(F.lit("*"))
    first = any_word
    for words in reversed(_words(Q_FILE_TYPE, [q for q, _ in LIST_FILTERS])):
        first = F.when(F.size(words) > 0, F.array_distinct(words)).otherwise(first)
    sigs = sigs.withColumn("_via", first).withColumn("_word", F.explode("_via"))
    own = F.array_distinct(F.concat(any_word, *_words(P_FILE_TYPE, [p for _, p in LIST_FILTERS])))
    met = points.withColumn("_own", own).withColumn("_word", F.explode("_own"))
    ok = F.element_at(F.array_intersect("_via", "_own"), 1) == F.col("_word")
    ok &= (F.coalesce(F.col(Q_FILE_TYPE), F.lit("")) == "") | F.col(P_FILE_TYPE).eqNullSafe(F.col(Q_FILE_TYPE))
    for q, p in LIST_FILTERS:
        ok &= (F.coalesce(F.size(F.array_compact(q)), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap(F.col(p), F.col(q)), F.lit(False))
    ok &= ~F.col(Q_HAS_EXT) | F.col(P_HAS_EXT)
    ok &= F.col(Q_SIZE_MIN).isNull() | F.coalesce(F.col(P_SIZE) >= F.col(Q_SIZE_MIN), F.lit(False))
    return met.join(sigs, "_word").where(ok).drop("_word", "_own", "_via", *Q_FILTERS)


# --- the grid ----------------------------------------------------------------

def _matrix(vectors: pa.ChunkedArray, dim: int | None) -> np.ndarray:
    """Rows of a list column as float64, all of one length."""
    arr = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.unique(arr.value_lengths().to_numpy(zero_copy_only=False))
    dim = int(lengths[0]) if dim is None else dim
    if (wrong := lengths[lengths != dim]).size:
        raise ValueError(f"embedding dim mismatch: a vector of {wrong[0]}, others of {dim}")
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), dim)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":      # negative squared euclidean distance
        return -(np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", x, x)[None, :] - 2.0 * (q @ x.T))
    if metric == "cosine":
        q, x = (m / np.where(n == 0, np.nan, n)[:, None] for m, n in ((q, np.linalg.norm(q, axis=1)), (x, np.linalg.norm(x, axis=1))))
    return q @ x.T


def _block_best(k: int, metric: str, key_cols: list[str], vec_col: str, qid: str, qvec: str, schema: pa.Schema):
    """Cogroup function: a block of points and a block of queries -> each query's best k there, and ties of the k-th."""
    def best(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not points.num_rows or not queries.num_rows:
            return schema.empty_table()
        q = _matrix(queries[qvec], None)
        x = _matrix(points[vec_col], q.shape[1])
        s = np.round(_scores(q, x, metric), SCORE_DECIMALS)
        s[np.isnan(s)] = -np.inf
        m = min(k, s.shape[1])
        least = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        out = [queries[qid].take(pa.array(row)), *[points[c].take(pa.array(col)) for c in key_cols], pa.array(s[row, col])]
        return pa.table([c.cast(f.type) for c, f in zip(out, schema)], schema=schema)
    return best


def _blocks(n: Column, rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(float(rows)))).cast("int")


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine",
        key_cols=("source", "pg_id"), vec_col: str = "embedding", qid: str = "query_id",
        qvec: str = "qvec", use_filters: bool = False, route: str | None = None, point_counts: DataFrame | None = None,
        point_rows: int = POINT_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Top-k points per query: (query id, key columns..., score, rank).

    ``score`` is cosine similarity, dot product or negative squared L2
    distance, rounded to 6 decimals; ties are broken by the key columns.
    ``use_filters``: columns of ``point_codes`` and ``query_codes`` restrict each query's points.  ``route``: a column of
    both sides that must be equal for a point to be scored (a query may stand in several rows, with different routes);
    ``point_counts`` (route, n) tells how many points each route has, where that is known.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    key_cols = list(key_cols)
    routes = [route] if route else []
    q = queries.where(F.col(qvec).isNotNull())
    p = points.where(F.col(vec_col).isNotNull())
    q = q.select(qid, qvec, *routes, *(Q_FILTERS if use_filters else ()))
    p = p.select(*key_cols, vec_col, *routes, *(P_FILTERS if use_filters else ()))
    if use_filters:
        q = _with_signature(q)
        p = allowed(p, q)
        routes = [*routes, "_sig"]
    n_points, n_queries = points.count(), q.count()
    p, q = p.select(*routes, *key_cols, vec_col), q.select(*routes, qid, qvec)
    if routes and (n_points > point_rows or n_queries > query_rows):
        # block numbers by the size of each route
        size = q.groupBy(*routes).agg(_blocks(F.count(F.lit(1)), query_rows).alias("_qn"))
        counts = point_counts if point_counts is not None and not use_filters else p.groupBy(*routes).agg(F.count(F.lit(1)).alias("n"))
        size = size.join(counts.select(*routes, _blocks(F.col("n"), point_rows).alias("_pn")), routes)
        p, q = p.join(size, routes), q.join(size, routes)
    else:
        # no route is larger than the whole: one block each where that is one block
        least = 1 if routes else min(points.sparkSession.sparkContext.defaultParallelism, -(-n_points // LEAST_ROWS))
        sizes = {"_pn": max(1, least, -(-n_points // point_rows)), "_qn": max(1, -(-n_queries // query_rows))}
        p, q = (df.withColumns({c: F.lit(n) for c, n in sizes.items()}) for df in (p, q))
    p = p.withColumn("_pb", F.pmod(F.xxhash64(*key_cols), F.col("_pn")).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.col("_qn") - 1)))
    q = q.withColumn("_qb", F.pmod(F.xxhash64(qid), F.col("_qn")).cast("int")).withColumn(
        "_pb", F.explode(F.sequence(F.lit(0), F.col("_pn") - 1)))
    cell = [*routes, "_pb", "_qb"]
    # names of their own on the query side, so that both sides may derive from one table
    q = q.select(*[F.col(c).alias(f"q{c}") for c in cell], F.col(qid).alias("_id"), F.col(qvec).alias("_qv"))
    out = T.StructType([T.StructField(qid, queries.schema[qid].dataType), *[T.StructField(c, points.schema[c].dataType) for c in key_cols],
                        T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    kernel = _block_best(k, metric, key_cols, vec_col, "_id", "_qv", to_arrow_schema(out))
    found = (p.select(*cell, *key_cols, vec_col).groupBy(*cell).cogroup(q.groupBy(*[f"q{c}" for c in cell]))
             .applyInArrow(kernel, out))
    w = Window.partitionBy(qid).orderBy(F.desc("score"), *[F.asc(c) for c in key_cols])
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dim_check(points: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """V9: rows whose vector length differs from the index dimension."""
    return points.where(F.coalesce(F.size(vec_col), F.lit(-1)) != dim)


def assert_dim(points: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """V9 as a guard: fails the job on the first vector of the wrong length."""
    return points.withColumn(
        "_dim_ok", F.assert_true(F.size(vec_col) == dim, F.lit(f"embedding dim mismatch, expected {dim}"))
    ).drop("_dim_ok")


@dataclass(frozen=True)
class Checked:
    """Vectors of the right length, the others set aside, and the figures of the pass that told them apart."""

    good: DataFrame
    quarantine: DataFrame
    figures: dict


def checked(points: DataFrame, dim: int, path: str | None = None, vec_col: str = "embedding") -> Checked:
    """V9 without stopping the job: one pass writes good and wrong vectors apart and counts both on the way.

    ``path`` (default: a fresh place in the shared folder) holds ``ok=true`` and ``ok=false``; the latter, the quarantine,
    carries ``dim_found`` (-1: NULL vector).
    """
    path = path or shared_path(points.sparkSession, "checked")
    found = F.coalesce(F.size(vec_col), F.lit(-1))
    seen = Observation("dim_check")
    marked = points.withColumn("dim_found", found).withColumn("ok", F.col("dim_found") == dim).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ok")).alias("good"), F.count_if(~F.col("ok")).alias("wrong"),
        F.count_if(F.col("dim_found") == -1).alias("missing"))
    marked.write.partitionBy("ok").parquet(path)
    back = points.sparkSession.read.schema(marked.schema).parquet(path)
    return Checked(back.where("ok").select(*points.columns), back.where("NOT ok").select(*points.columns, "dim_found"), seen.get)
