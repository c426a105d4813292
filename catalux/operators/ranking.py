"""First-per-key, dedupe, top-k and paging.

The reference expresses these as first-wins loops over an ordered list;
here each is a window over the group (query, source, ...) with a total
order, so results do not depend on partitioning.  ``row_number() <= k``
with nothing in between plans as a partial WindowGroupLimit before the
shuffle and a final one after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.functions.text import bare_info_hash, col_, normalize_title, strip_ws
from catalux.session import materialize


def _cols(cs) -> list[Column]:
    return [col_(c) for c in ([] if cs is None else ([cs] if isinstance(cs, (str, Column)) else cs))]


def first_per_key(df: DataFrame, group, key: Column, order) -> DataFrame:
    """Keep the first row (by ``order``) of every (group, key); other rows are dropped."""
    w = Window.partitionBy(*_cols(group), key).orderBy(*_cols(order))
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def top_k(df: DataFrame, group, order, k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group (T2/T4/T7 building block)."""
    w = Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def page(df: DataFrame, group, order, offset: int, size: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked offset+1 .. offset+size within each group, plus ``has_more``.

    Only offset+size+1 rows per group survive the row-number filter, which
    Spark runs as a partial limit before the shuffle; ``has_more`` comes from
    that bounded remainder, so a group holding a third of the rows is never
    sorted whole in one task.
    """
    w = Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
    keep = offset + size + 1
    ranked = df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= keep)
    more = F.max(rank_col).over(Window.partitionBy(*_cols(group))) > offset + size
    return (ranked.withColumn("has_more", more)
            .where((F.col(rank_col) > offset) & (F.col(rank_col) <= offset + size)))


def hash_key(text_hash="text_hash", source="source", pg_id="pg_id") -> Column:
    """W1 key: text hash, else 'source:pg_id'."""
    h = strip_ws(F.coalesce(col_(text_hash), F.lit("")))
    return F.when(h != "", h).otherwise(F.concat(col_(source), F.lit(":"), col_(pg_id)))


def dedupe_hits_by_hash(hits: DataFrame, group="query_id", order=("rank",)) -> DataFrame:
    """First hit per text hash in rank order."""
    return first_per_key(hits, group, hash_key(), list(order))


def title_key(title="title", meta_title=None, source="source", pg_id="pg_id") -> Column:
    """W2 key: 'title:' + normalised title (else metadata title), else 'id:source:pg_id'."""
    t = normalize_title(title)
    if meta_title is not None:
        t = F.when(t != "", t).otherwise(normalize_title(meta_title))
    return F.when(t != "", F.concat(F.lit("title:"), t)).otherwise(
        F.concat(F.lit("id:"), col_(source), F.lit(":"), col_(pg_id)))


def dedupe_results_by_title(results: DataFrame, group="query_id", order=None, meta_title=None) -> DataFrame:
    """First result per normalised title (case-sensitive) in score order."""
    order = order or [F.desc("score"), F.asc("source"), F.asc("pg_id")]
    return first_per_key(results, group, title_key(meta_title=meta_title), order)


def identity_key(info_hash="info_hash", pg_id="pg_id", title="title", year="release_year",
                 source="source") -> Column:
    """W3 key: 'hash:' + bare hash, else 'title:' + lower title + ':' + year, else 'source:pg_id'."""
    h = bare_info_hash(F.coalesce(F.nullif(col_(info_hash), F.lit("")), col_(pg_id)))
    t = F.lower(strip_ws(F.coalesce(col_(title), F.lit(""))))
    y = strip_ws(F.coalesce(col_(year).cast("string"), F.lit("")))
    return (F.when(h != "", F.concat(F.lit("hash:"), h))
            .when(t != "", F.concat(F.lit("title:"), t, F.lit(":"), y))
            .otherwise(F.concat(col_(source), F.lit(":"), col_(pg_id))))


def dedupe_results_by_identity(results: DataFrame, group="query_id", order=None, **key_cols) -> DataFrame:
    """First result per hash / title+year / id."""
    order = order or [F.desc("score"), F.asc("source"), F.asc("pg_id")]
    return first_per_key(results, group, identity_key(**key_cols), order)


def latest_per_group(df: DataFrame, group, time_col: str, tie=()) -> DataFrame:
    """The newest row of every group (NULL times last)."""
    return top_k(df, group, [F.desc_nulls_last(time_col), *[F.asc(c) for c in tie]], 1).drop("rank")


def size_order(size: Column, score: Column, direction: str) -> list[Column]:
    """T3 sort keys: missing sizes last in both directions, then size, then score desc."""
    missing = F.when(size.isNull(), 1).otherwise(0)
    s = F.coalesce(size, F.lit(0.0))
    return [missing.asc(), (s.desc() if direction == "desc" else s.asc()), score.desc()]


def numeric_id_order(c) -> Column:
    """Text id ordered as a number."""
    return col_(c).try_cast("bigint")


def global_position(df: DataFrame, order, col: str = "position") -> DataFrame:
    """1-based position of every row in a total order, computed without one-task windows.

    The frame is range-partitioned and sorted by ``order``; each partition's
    row count becomes an offset (a table with one row per partition), and
    the position is offset + row number inside the partition.
    """
    keys = _cols(order)
    # written once: counts and positions must come from the same exchange
    srt = materialize(df.sort(*keys).withColumn("_pid", F.spark_partition_id()))
    counts = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select("_pid", (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(*keys)
    return (srt.join(F.broadcast(offsets), "_pid")
            .withColumn(col, (F.col("_off") + F.row_number().over(w)).cast("bigint"))
            .drop("_pid", "_off"))
