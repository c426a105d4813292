"""Aggregations (A1-A13).  All are partial + final hash aggregates: Spark
combines map-side before the shuffle, so a hot key costs one row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalux.functions import fixed
from catalux.functions.text import strip_ws
from catalux.operators.filters import missing_enrichment
from catalux.operators.joins import synced_rows
from catalux.session import materialize
from catalux.spec import SourceSpec


def one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side by side of two single-row aggregates (equi-join on a constant key)."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def array_agg_keep_nulls(c: str, order: str | None = None):
    """A1: array of a column per group with NULLs kept (collect_list alone drops them)."""
    if order:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))),
                           lambda x: x["v"])
    return F.transform(F.collect_list(F.struct(F.col(c).alias("v"))), lambda x: x["v"])


def array_agg_distinct(c: str):
    """A2: distinct values sorted ascending, NULL last."""
    return F.array_sort(F.transform(F.collect_set(F.struct(F.col(c).alias("v"))), lambda x: x["v"]))


def string_agg_distinct(c: str, sep: str = " "):
    """A4: distinct non-NULL values joined in sorted order."""
    return F.array_join(F.array_sort(F.collect_set(F.col(c))), sep)


def state_counts(state: DataFrame) -> DataFrame:
    """The state's part of A5: per source rows with a state, newest sync time, errors."""
    return state.groupBy("source").agg(F.count(F.lit(1)).alias("synced_rows"), F.max("updated_at").alias("last_sync_updated_at"),
                                       F.count(F.when(F.col("last_error").isNotNull(), 1)).alias("errors"))


def source_status(rows: DataFrame, state: DataFrame, spec: SourceSpec, counts: DataFrame | None = None) -> DataFrame:
    """A5 in one pass: per source total, synced, newest source time, newest sync time,
    newest source time among synced rows, errors.  ``counts``: ``state_counts`` where they are kept."""
    st = state.where(F.col("source") == spec.name)
    # one row, also where the source has no state yet
    s_agg = (counts if counts is not None else state_counts(st)).where(F.col("source") == spec.name).agg(
        F.coalesce(F.max("synced_rows"), F.lit(0)).alias("synced_rows"), F.max("last_sync_updated_at").alias("last_sync_updated_at"),
        F.coalesce(F.max("errors"), F.lit(0)).alias("errors"))
    r = rows.select(F.col(spec.id_field).cast("string").alias("pg_id"),
                    (F.col(spec.updated_at_field) if spec.updated_at_field else F.lit(None).cast("timestamp")).alias("_t"))
    r_agg = r.agg(F.count(F.lit(1)).alias("total_rows"), F.max("_t").alias("max_updated_at"))
    synced = synced_rows(r, st).agg(F.max("_t").alias("max_synced_updated_at"))
    return (one_row_join(one_row_join(r_agg, synced), s_agg)
            .select(F.lit(spec.name).alias("name"), "total_rows", "synced_rows", "max_updated_at",
                    "last_sync_updated_at", "max_synced_updated_at", "errors"))


def enrichment_status(content: DataFrame, enrich: DataFrame, film_source: str = "tmdb") -> DataFrame:
    """Film content total / latest, enrichment total / latest / missing lists."""
    c = content.where(F.col("source") == film_source).agg(
        F.count(F.lit(1)).alias("content_total"), F.max("updated_at").alias("content_latest"))
    e = enrich.agg(F.count(F.lit(1)).alias("enrichment_total"), F.max("updated_at").alias("enrichment_latest"),
                   F.count(F.when(missing_enrichment(), 1)).alias("enrichment_missing"))
    return one_row_join(c, e)


def expansion_terms(cands: DataFrame, qid: str = "query_id", aka: str = "aka", keywords: str = "keywords",
                    pattern: str = fixed.EXPANSION_SPLIT) -> DataFrame:
    """Split aka (weight 2) and keywords (weight 1), strip, drop empty, max weight per term."""
    def terms(c, w):
        return F.transform(F.split(F.coalesce(F.col(c), F.lit("")), pattern), lambda x: F.struct(x.alias("term"), F.lit(w).alias("weight")))
    # one pass: the candidates are three joins
    t = cands.select(qid, F.inline(F.concat(terms(aka, 2), terms(keywords, 1))))
    t = t.withColumn("term", strip_ws("term")).where(F.col("term") != "")
    return t.groupBy(qid, "term").agg(F.max("weight").alias("weight"))


def file_list_total(files: DataFrame, parent: str = "parent_id", size: str = "size") -> DataFrame:
    """A10: per item, file count and the sum of positive sizes."""
    s = F.col(size).try_cast("double")
    return files.groupBy(parent).agg(F.count(F.lit(1)).alias("file_count"),
                                     F.coalesce(F.sum(F.when(s > 0, s)), F.lit(0.0)).alias("total_size"))


GRID = 500       # steps of the sketch inside a bracket
PASSES = 8


def exact_median(df: DataFrame, group, value: str, accuracy: int = 10000, margin: int = 20, most: int = 1_000_000) -> DataFrame:
    """Exact (interpolated) median per group without buffering a whole group in one task.

    A quantile sketch brackets the two middle ranks within +/- margin/accuracy of the group's size; while a bracket still
    holds more than ``most`` rows, a sketch of the rows inside it narrows it to a few of its GRID steps.  Values below a
    bracket are only counted, so the ranks stay exact.  Then the values inside are counted per value (with map-side
    combining, so ties cost one row) and the running counts of these find the two middle ones.
    """
    group = [group] if isinstance(group, str) else list(group)
    eps = margin / accuracy
    base = df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())

    def beside(b: DataFrame) -> DataFrame:
        """Every row of ``base`` with its group's bracket."""
        own = [c for c in b.columns if c not in group]
        same = None
        for c in group:
            t = F.col(f"base.{c}").eqNullSafe(F.col(f"b.{c}"))
            same = t if same is None else same & t
        return base.alias("base").join(b.alias("b"), same).select(*[F.col(f"base.{c}") for c in group], "_v", *own)

    middle = [F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)]
    b = base.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)], accuracy).alias("_b"))
    b = materialize(b.select(*group, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi")))
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    for _ in range(PASSES):
        if (b.agg(F.max(F.col("_n") * (2 * eps))).first()[0] or 0) <= most:
            break       # the first bracket is narrow enough in every group
        counted = materialize(beside(b).groupBy(*group, "_n", "_lo", "_hi").agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(inside).alias("_in")))
        is_wide = (F.col("_in") > most) & (F.col("_lo") < F.col("_hi"))
        if counted.where(is_wide).isEmpty():
            break
        sketch = beside(counted.where(is_wide)).where(inside).groupBy(*group, "_n", "_below", "_in").agg(
            F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], accuracy).alias("_q"))
        at = [(m - F.col("_below")) * F.lit(float(GRID)) / (F.col("_in") - 1) for m in middle]
        low = F.greatest(F.lit(0), F.floor(at[0]) - 1).cast("int")
        high = F.least(F.lit(GRID), F.ceil(at[1]) + 1).cast("int")
        narrowed = sketch.select(*group, "_n", F.get("_q", low).alias("_lo"), F.get("_q", high).alias("_hi"))
        b = materialize(narrowed.unionByName(counted.where(~is_wide).select(*narrowed.columns)))
    # below the bracket one row a group, inside it one a value
    place = F.when(F.col("_v") < F.col("_lo"), F.lit(float("-inf"))).otherwise(F.col("_v"))
    counts = (beside(b).where(F.col("_v") <= F.col("_hi")).withColumn("_p", place)
              .groupBy(*group, "_n", "_p").agg(F.count(F.lit(1)).alias("_c")))
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    run = counts.withColumn("_z", upto)

    def value_at(k):
        return F.max(F.when((F.col("_z") - F.col("_c") <= k) & (k < F.col("_z")), F.col("_p")))
    return run.groupBy(*group, "_n").agg(((value_at(middle[0]) + value_at(middle[1])) / 2.0).alias("median")).drop("_n")


def latency_summary(timings: DataFrame, group, value: str) -> DataFrame:
    """Min / median / mean / max of recorded timings per group (median exact, see exact_median)."""
    stats = timings.groupBy(group).agg(F.min(value).alias("min_v"), F.avg(value).alias("mean_v"),
                                       F.max(value).alias("max_v"))
    med = exact_median(timings, group, value).withColumnRenamed("median", "p50_v")
    return stats.join(med, group, "left")


def sync_summary(log: DataFrame, group: str, rows: str, started: str) -> DataFrame:
    """Per source: batches, rows, elapsed seconds, rows per second."""
    secs = (F.unix_micros(F.max(started).cast("timestamp")) - F.unix_micros(F.min(started).cast("timestamp"))).cast("double") / 1e6
    return log.groupBy(group).agg(F.count(F.lit(1)).alias("batches"), F.sum(rows).alias("rows"),
                                  secs.alias("seconds")).withColumn(
        "rows_per_sec", F.try_divide(F.col("rows"), F.col("seconds")))
