"""Document fingerprints (operator 1): threshold-scaled sketches, in Spark SQL expressions only.

A sketch keeps every distinct 5-word shingle hash below a fixed fraction (1/``scale``) of the hash
range, whatever the length of the text, so sketches of very unequal documents stay comparable and
two sketches merge by set union.  The smallest hash is kept as well (it merges the same way), so a
text with words never has an empty sketch.  A text of fewer than five words has one shingle: the
whole word sequence.

Defined results: null, empty and blank texts have an empty sketch; two empty sketches are alike 1.0,
an empty and a filled one 0.0; equal texts have equal sketches; rows that share a doc_id are ordered
by text hash, then text; rows without doc_id come last.  Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.llm.sqltext import let, shingles, words
from catalux.llm.tables import pick

SCALE = 8
SHINGLE = 5
ROWS_PER_RANGE = 64
MAX_RANGES = 20_000


def threshold(scale: int) -> Column:
    """The largest hash that is always retained."""
    return F.lit(-(1 << 63) + (1 << 64) // scale - 1)


def sketch(text: Column, scale: int = SCALE, size: int = SHINGLE) -> Column:
    """Sorted array<bigint> of the retained shingle hashes."""
    top = threshold(scale)
    hashes = let(words(text), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
                 .when(F.size(w) < size, F.array(F.xxhash64(F.array_join(w, " "))))
                 .otherwise(shingles(w, size)))
    return let(hashes, lambda h: F.when(F.size(h) == 0, h).otherwise(F.sort_array(F.array_distinct(
        F.concat(F.array(F.array_min(h)), F.filter(h, lambda x: x <= top))))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        let(both, lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1))).cast("double"))


def retained(sk: Column, scale: int = SCALE) -> Column:
    """The hashes below the threshold: without a smallest one that is kept only for itself."""
    return F.filter(sk, lambda x: x <= threshold(scale))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that are in b (1.0 for an empty a), by the retained hashes alone.

    Where a retains none, its smallest hash decides: 1.0 if b has it, else 0.0.
    """
    return let(retained(a, scale), lambda r: F.when(F.size(a) == 0, F.lit(1.0)).when(
        F.size(r) == 0, F.array_contains(b, F.element_at(a, 1)).cast("double")).otherwise(
        (F.size(F.array_intersect(r, b)) / F.size(r)).cast("double")))


def merged(sketches: DataFrame, key: str, column: str = "sketch", scale: int = SCALE) -> DataFrame:
    """Sketch of all texts of each ``key``, as (key, hash) rows of any number, pre-aggregated: the sketch of the union of
    their shingles.  Retained hashes merge by union, smallest ones by minimum (it stays alone where nothing is retained)."""
    each = sketches.select(F.col(key).alias("key"), F.explode(column).alias("hash"))
    least = each.groupBy("key").agg(F.min("hash").alias("hash")).where(F.col("hash") > threshold(scale))
    return each.where(F.col("hash") <= threshold(scale)).distinct().unionByName(least).withColumnRenamed("key", key)


def as_text(fingerprint: Column) -> Column:
    """16 hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(rows: DataFrame, columns: list[str], per_range: int = ROWS_PER_RANGE,
              max_ranges: int = MAX_RANGES) -> DataFrame:
    """Each row with ``columns`` of the next one in descending doc_id (after the last: of the first).

    Ids are cut into equal ranges, each a window of its own; the highest row of every range is also
    put, as a guest, at the end of the next higher range (the highest of all into the lowest).  Only one
    id a range reaches the driver, and there are at most ``max_ranges`` of them.
    """
    lo, hi, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    ranges = max(1, min(max_ranges, n // per_range))
    width = max(1, -(-(hi - lo + 1) // ranges))
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(
        F.floor((F.col("doc_id").cast("double") - float(lo)) / float(width))).cast("long")
    heads = sorted(rows.groupBy(at.alias("r")).agg(F.max("doc_id").alias("head")).collect(),
                   key=lambda x: -x["r"])
    guests = [(x["r"], x["head"], heads[k - 1]["r"]) for k, x in enumerate(heads)]
    to = rows.sparkSession.createDataFrame(guests, "g_range long, g_head long, g_to long")
    placed = (rows.withColumn("r", at)
              .join(F.broadcast(to), (F.col("r") == F.col("g_range")) & F.col("doc_id").eqNullSafe(F.col("g_head")), "left")
              .withColumn("place", F.explode(F.when(
                  F.col("g_to").isNull(), F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("guest"))))
                  .otherwise(F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("guest")),
                                     F.struct(F.col("g_to").alias("r"), F.lit(True).alias("guest")))))))
    w = (Window.partitionBy("place.r")
         .orderBy("place.guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"))
    return (placed.select(*rows.columns, "place", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
            .where(~F.col("place.guest")).drop("place"))


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprint of every text, of its edited text, and how alike they and the next document's are."""
    d = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("sketch", sketch(F.col("text"), scale))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    e = with_next(d, ["text", "sketch"]).select(
        "doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch",
        F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    e = e.withColumn("edited_sketch", sketch(F.col("edited"), scale))
    return e.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
