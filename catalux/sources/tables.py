"""Base tables: one parquet dataset per name under a directory.

A live deployment points the same names at a JDBC source with a partition
column instead (``jdbc_table``); every operator only sees DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one base table; filters and projections applied later reach the scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, root: str, names=BASE_TABLES) -> None:
    """Expose base tables as temp views for SQL-written fixtures."""
    for name in names:
        table(spark, root, name).createOrReplaceTempView(name)


def jdbc_table(spark: SparkSession, url: str, dbtable: str, partition_column: str,
               lower: int, upper: int, partitions: int, properties: dict | None = None) -> DataFrame:
    """A relational table read in ``partitions`` parallel range slices."""
    return spark.read.jdbc(url, dbtable, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=partitions,
                           properties=properties or {})
