"""Approximate top-k with an inverted file (V7), built apart from the search.

Build: spherical k-means on a bounded sample (``SAMPLE_ROWS`` vectors by a
hash of their keys, one task) gives the cells; every point is assigned to its
nearest centroid where it lies and written to a folder of its cell.  The
centroids are a table beside it, with at most ``MAX_CELLS`` rows: the one
thing that is sent to all tasks.

Search: a query row becomes one row for each of its ``nprobe`` nearest cells;
the distinct probed cells (at most ``MAX_CELLS``) are joined to the scan, so
dynamic partition pruning leaves the folders of other cells unread; inside the
cells the exact grid join ranks.  A cell that holds a large share of the
points is cut into blocks like any other.  With ``nprobe == cells`` the result
equals the exact top-k.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalux.operators import upsert as U
from catalux.operators.vector import _matrix, knn
from catalux.session import shared_path

SAMPLE_ROWS = 20_000      # vectors that the cells are fitted on; every vector is indexed
MAX_CELLS = 4_096
ITERATIONS = 8
FILE_ROWS = 200_000


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm == 0, 1.0, norm)[:, None]


def _centroids(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Spherical k-means from distinct random rows; an empty cell keeps its centroid."""
    x = _unit(x)
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(ITERATIONS):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        met = np.bincount(own, minlength=len(c)) > 0
        c[met] = _unit(sums[met])
    return c


@dataclass(frozen=True)
class InvertedFile:
    """Points by cell (a partition column), and the centroid of each cell."""

    points: DataFrame
    centroids: DataFrame      # cell, centroid
    sizes: DataFrame          # cell, n (points)
    path: str

    @property
    def cells(self) -> int:
        return self.centroids.count()


def default_cells(n: int) -> int:
    """About the square root of the points, a power of two."""
    return min(MAX_CELLS, max(1, 2 ** round(math.log2(max(1.0, math.sqrt(n))))))


def build_index(points: DataFrame, cells: int | None = None, path: str | None = None, key_cols=("source", "pg_id"),
                vec_col: str = "embedding", seed: int = 7, sample_rows: int = SAMPLE_ROWS) -> InvertedFile:
    """Fit the cells, write all points by cell under ``path`` (default: a fresh place in the shared folder)."""
    spark = points.sparkSession
    path = path or shared_path(spark, "ivf")
    have = points.where(F.col(vec_col).isNotNull())
    n = have.count()
    cells = min(cells or default_cells(n), MAX_CELLS)
    share = min(1.0, 1.2 * sample_rows / max(n, 1))
    pick = F.pmod(F.xxhash64(F.lit(seed), *key_cols, F.col(vec_col)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    out = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.DoubleType()))])

    def fit(batches):
        held = [b.column(0) for b in batches if b.num_rows]
        x = _matrix(pa.chunked_array(held), None) if held else np.zeros((0, 0))
        c = _centroids(x, cells, seed) if len(x) else x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c.tolist(), pa.list_(pa.float64()))],
                                         ["cell", "centroid"])

    # in an order of their own, so that the fit does not depend on how the points are stored
    sample = have.where(pick).select(vec_col).repartition(1).sortWithinPartitions(vec_col)
    sample.mapInArrow(fit, out).write.parquet(f"{path}/centroids")
    centroids = spark.read.schema(out).parquet(f"{path}/centroids")
    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType())])
    placed = _nearest(points, centroids, 1, vec_col, schema)
    splits = max(1, -(-4 * n // (max(1, cells) * FILE_ROWS)))      # a large cell is several files
    (placed.repartition(F.col("cell"), F.pmod(F.xxhash64(*key_cols), F.lit(splits)))
     .write.partitionBy("cell").parquet(f"{path}/points"))
    spark.read.parquet(f"{path}/points").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/sizes")
    U.mark_done(spark, path)
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> InvertedFile:
    return InvertedFile(*[spark.read.parquet(f"{path}/{name}") for name in ("points", "centroids", "sizes")], path)


def _nearest(rows: DataFrame, centroids: DataFrame, n: int, vec_col: str, schema: T.StructType) -> DataFrame:
    """``rows`` once for each of the ``n`` cells nearest to their vector, as ``cell``; NULL vectors are in cell -1."""
    # at most MAX_CELLS rows
    table = centroids.orderBy("cell").toArrow()
    c = _matrix(table["centroid"], None) if table.num_rows else np.zeros((0, 0))
    cell_ids = table["cell"].to_numpy().astype(np.int32)

    def near(batches):
        for b in batches:
            vec = b.column(b.schema.get_field_index(vec_col))
            have = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False))
            lost = np.flatnonzero(~vec.is_valid().to_numpy(zero_copy_only=False))
            m = min(n, len(c))
            if len(have) and m:
                s = _unit(_matrix(vec.take(pa.array(have)), c.shape[1])) @ c.T
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            else:
                top = np.zeros((len(have), 0), np.int64)
            row = np.concatenate([np.repeat(have, top.shape[1]), lost])
            cell = np.concatenate([cell_ids[top.ravel()], np.full(len(lost), -1, np.int32)]) if len(row) else np.zeros(0, np.int32)
            order = np.argsort(row, kind="stable")
            out = b.take(pa.array(row[order]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell[order], pa.int32())], names=[*b.schema.names, "cell"])

    return rows.mapInArrow(near, schema)


def knn_ivf(index: InvertedFile, queries: DataFrame, k: int, nprobe: int, key_cols=("source", "pg_id"),
            vec_col: str = "embedding", qid: str = "query_id", qvec: str = "qvec") -> DataFrame:
    """Approximate cosine top-k: the exact grid join inside each query's ``nprobe`` nearest cells."""
    q = queries.where(F.col(qvec).isNotNull()).select(qid, qvec)
    schema = T.StructType([*q.schema.fields, T.StructField("cell", T.IntegerType())])
    probes = _nearest(q, index.centroids, nprobe, qvec, schema).where("cell >= 0")
    probed = probes.select("cell").distinct()
    # at most MAX_CELLS rows: a proven bound for the broadcast, which prunes the folders of the scan
    points = index.points.join(F.broadcast(probed), "cell")
    return knn(points, probes, k, key_cols=key_cols, vec_col=vec_col, qid=qid, qvec=qvec, route="cell",
               point_counts=index.sizes)


def recall_at_k(approx: DataFrame, exact: DataFrame, qid: str = "query_id", keys=("source", "pg_id")) -> float:
    """Share of exact top-k hits the approximate search returned (one small aggregate)."""
    keys = [qid, *keys]
    hit = exact.select(*keys).join(approx.select(*keys), keys, "left_semi").count()
    total = exact.count()
    return hit / total if total else 1.0
