"""Reading inputs and cutting lineage through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalux.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: the lineage ends there,
    and the files outlive the executors that wrote them."""
    path = shared_path(df.sparkSession, "llm", name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names and types: clashing extra columns cannot interfere.

    ``columns`` maps the wanted name to a Spark type; the source column has the same name.
    """
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in columns.items()])


def held_out(doc_id: str, modulus: int, remainder: int):
    """crc32 of the decimal doc_id, modulo ``modulus``, equals ``remainder`` (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


BITMAP_BITS = 1 << 24


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from every column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_likely(df: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """``df`` with boolean ``flag``: false only where ``key`` is certainly not in the one column of ``wanted``.

    A bitmap of hashed keys (2 MB, whatever the input) is joined to the scan, so that a shuffle after it
    carries little beyond the wanted rows.  An exact join must follow.
    """
    (name,) = wanted.columns
    part, mask = (unused(df, x) for x in ("bm_part", "bm_bits"))

    def bit(c):
        return F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS))

    bits = (wanted.select(bit(F.col(name)).alias("b"))
            .groupBy(F.bitmap_bucket_number("b").alias(part))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias(mask)))
    at = F.bitmap_bit_position(bit(F.col(key)))
    byte = F.conv(F.hex(F.substring(F.col(mask), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.col(mask).isNotNull() & (F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
    # at most BITMAP_BITS / 32768 rows of 4 KB: a proven bound for the broadcast
    return (df.join(F.broadcast(bits), F.bitmap_bucket_number(bit(F.col(key))) == F.col(part), "left")
            .select(*df.columns, F.coalesce(set_, F.lit(False)).alias(flag)))


def likely_members(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``wanted``; no wanted row is lost."""
    flag = unused(df, "bm_likely")
    return with_likely(df, key, wanted, flag).where(F.col(flag)).drop(flag)
