"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalux.llm.tables import written


ROWS = 100_000      # of a task


def _in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many tasks as about ``rows`` rows ask for, so that rounds over few edges are short."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))


def _pointed(pairs: DataFrame, rows: int, name: str) -> DataFrame:
    """(src, dst) with the smallest neighbour of src, as ``low``; written first, so that a hot src is split by the join."""
    low = written(_in_tasks(pairs.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low")), rows), name)
    return pairs.join(low, "src")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest node it reaches."""
    def tidy(df: DataFrame, rows: int) -> DataFrame:
        return written(_in_tasks(df.where("src <> dst").distinct(), rows), "edges")

    now = tidy(edges.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")), edges.count())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rows = 2 * state[0]
        large = tidy(_pointed(both, rows, "large").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")), rows)
        near = _pointed(large, rows, "small")
        now = tidy(near.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
                   .union(large.groupBy("src").agg(F.min("dst").alias("dst"))), rows)
        if (after := _state(now)) == state:
            break
        state = after
    # now every edge points at the root of its component
    return written(_in_tasks(now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
                             .union(now.select("dst", "dst").distinct()), 2 * state[0]), "components")
