"""Vector code compression (operator 12): a product quantizer fitted by ball k-means, in integers.

Components become floor(1024 x); a vector is cut into ``PARTS`` equal parts, and a part is coded by the nearest of up to
``ENTRIES`` entries of its position's codebook (squared Euclidean distance, ties to the lower index).

Ball k-means: the parts that an entry codes form its ball.  Entry j can win a part x from entry i only if
d(i, j) <= 2 d(x, i).  So the entries within twice a ball's radius are its neighbours; parts nearer to their entry than half of the
nearest neighbour's distance (the stable core) are not compared at all; the others lie in rings, which restrict the candidates
to the neighbours that are near enough; and where an entry has not moved, only neighbours that have moved are candidates.
All comparisons are between squared integers, so the result is that of comparing every part with every entry.

A round is one pass over the written vectors: each task assigns its parts, writes them with their new codes, and adds one row of
sums for each entry that it met.  Only the codebooks (``PARTS * ENTRIES`` entries, whatever the input) reach the driver.

Defined results: vectors that are null or hold null or non-finite components are dropped; vectors shorter than the longest (or
a length that is no multiple of ``PARTS``) are filled up with zeros; components beyond +-LIMIT / 1024 count as LIMIT; rows of
equal vec_id are coded each, seeds of equal vec_id go by components, null vec_ids seed last; fewer vectors than ``ENTRIES`` give
smaller codebooks; null labels are one label; only vec_id, embedding and label are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalux.llm.tables import written
from catalux.session import shared_path

PARTS, ENTRIES, ROUNDS = 4, 256, 4
LIMIT = 1 << 24        # of an integer component: distances of parts of up to 2,048 components then fit 64 bits
RINGS = (8, 32, 96, ENTRIES)
STATE = "kind int, vec_id long, label string, v array<int>, code binary, error long, part int, entry int, n long, far long, sums array<long>"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (as text) and v (integers, of one length) of the rows that are kept."""
    e = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["label"].cast("string").alias("label"),
                          embeddings["embedding"].cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform("x", lambda c: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(c * 1024).cast("double"))).cast("int"))
    out = written(e.where(F.col("x").isNotNull() & ~bad).select("vec_id", "label", v.alias("v")), "vectors")
    longest = out.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    return out.withColumn("v", F.when(F.size("v") == width, F.col("v"))
                          .otherwise(F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v")))))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c`` (int64)."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:     # products and sums are exact in doubles
        x, c = x.astype(float), c.astype(float)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


@dataclass
class Balls:
    """One part's codebook; for each entry its candidates by distance, and those distances (squared)."""

    entries: np.ndarray
    near: list[np.ndarray] | None = None
    gaps: list[np.ndarray] | None = None

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray, far: np.ndarray) -> "Balls":
        """``far``: the largest squared distance of a ball's parts to its entry as it stood ``before``."""
        between = distances(entries, entries)
        moved = (entries != before).any(1)
        drift = np.sqrt(((entries - before) ** 2).sum(1).astype(float))
        reach = 4 * (np.sqrt(far.astype(float)) + drift) ** 2 * (1 + 1e-9) + 1      # twice an upper bound of the radius, squared
        near, gaps = [], []
        for i in range(len(entries)):
            ok = (between[i] <= reach[i]) & (moved | moved[i])
            ok[i] = False
            ids = np.flatnonzero(ok)
            ids = ids[np.argsort(between[i][ids], kind="stable")]
            near.append(ids)
            gaps.append(between[i][ids])
        return Balls(entries, near, gaps)

    def assign(self, x: np.ndarray, code: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each row, its squared distance, and how many distances that took."""
        if code is None or self.near is None:
            d = distances(x, self.entries)
            code = d.argmin(1)
            return code, d[np.arange(len(x)), code], d.size
        d = ((x - self.entries[code]) ** 2).sum(1)
        new, work = code.copy(), len(x)
        order = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[order], np.arange(len(self.entries) + 1))
        for i in np.unique(code):
            rows = order[ends[i]:ends[i + 1]]
            ring = np.searchsorted(self.gaps[i], 4 * d[rows], side="right")     # 0: the stable core
            low = 0
            for high in RINGS:
                here = rows[(ring > low) & (ring <= high)]
                low = high
                if len(here):
                    some = np.sort(np.append(self.near[i][:high], i))
                    away = distances(x[here], self.entries[some])
                    best = away.argmin(1)
                    new[here], d[here] = some[best], away[np.arange(len(here)), best]
                    work += away.size
        return new, d, work


def _pass(rows: DataFrame, balls: list[Balls], width: int, seen: bool) -> DataFrame:
    """``rows`` (vec_id, label, v, code) with new codes and errors (kind 0), and each task's sums by entry (kind 1); written."""
    part = width // PARTS
    size = len(balls[0].entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int32())),
                            ("code", pa.binary()), ("error", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                            ("far", pa.int64()), ("sums", pa.list_(pa.int64()))])

        def batch_of(length: int, /, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(length, f.type)) for f in schema], schema=schema)

        n, far = np.zeros((PARTS, size), np.int64), np.zeros((PARTS, size), np.int64)
        sums = np.zeros((PARTS, size, part), np.int64)
        for batch in batches:
            rows_in = batch.num_rows
            if not rows_in:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows_in, width)
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(rows_in, PARTS) if seen else None
            codes, error = np.zeros((rows_in, PARTS), np.uint8), np.zeros(rows_in, np.int64)
            for p, ball in enumerate(balls):
                own = x[:, p * part:(p + 1) * part]
                code, d, _ = ball.assign(own, None if old is None else old[:, p].astype(np.int64))
                codes[:, p] = code
                error += d
                n[p] += np.bincount(code, minlength=size)
                np.maximum.at(far[p], code, d)
                order = np.argsort(code, kind="stable")
                met, first = np.unique(code[order], return_index=True)
                sums[p][met] += np.add.reduceat(own[order], first, axis=0) if part else 0
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), rows_in, [None, pa.py_buffer(codes.tobytes())])
            yield batch_of(rows_in, kind=pa.array(np.zeros(rows_in, np.int32)), vec_id=batch.column("vec_id"), label=batch.column("label"),
                           v=batch.column("v"), code=data.cast(pa.binary()), error=pa.array(error))
        p, e = np.nonzero(n)
        if len(p):
            ends = pa.array(np.arange(len(p) + 1) * part, pa.int32())
            yield batch_of(len(p), kind=pa.array(np.ones(len(p), np.int32)), part=pa.array(p.astype(np.int32)),
                           entry=pa.array(e.astype(np.int32)), n=pa.array(n[p, e]), far=pa.array(far[p, e]),
                           sums=pa.ListArray.from_arrays(ends, pa.array(sums[p, e].ravel())))

    out = rows.select("vec_id", "label", "v", *(["code"] if seen else [])).mapInArrow(run, STATE)
    path = shared_path(rows.sparkSession, "llm", "codes")
    out.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(STATE).parquet(path)


def _moved(done: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codebooks after the pass ``done``, and the largest squared distance in each ball."""
    sums = done.where("kind = 1")
    totals = (sums.select("part", "entry", F.posexplode_outer("sums").alias("at", "x")).groupBy("part", "entry", "at")
              .agg(F.sum("x").alias("x")).where("at IS NOT NULL").toArrow())
    balls = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far")).toArrow()
    new, far = [b.copy() for b in books], [np.zeros(len(b), np.int64) for b in books]
    n = [np.zeros(len(b), np.int64) for b in books]
    p, e = (balls[c].to_numpy() for c in ("part", "entry"))
    for k in range(PARTS):
        n[k][e[p == k]] = balls["n"].to_numpy()[p == k]
        far[k][e[p == k]] = balls["far"].to_numpy()[p == k]
    p, e, at, x = (totals[c].to_numpy() for c in ("part", "entry", "at", "x"))
    for k in range(PARTS):
        here = p == k
        new[k][e[here], at[here]] = x[here] // n[k][e[here]]
    return new, far


def fitted(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], DataFrame | None]:
    """Final codebooks by part, and the coded rows (vec_id, label, v, code, error); no vectors: no codebooks, None."""
    seeds = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    if not seeds:
        return [], None
    first = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), -1)
    width = first.shape[1]
    books = [np.ascontiguousarray(b) for b in np.split(first, PARTS, axis=1)]
    balls, rows = [Balls(b) for b in books], vectors
    for r in range(rounds):
        done = _pass(rows, balls, width, seen=r > 0)
        rows = done.where("kind = 0")
        after, far = _moved(done, books)
        balls = [Balls.of(*x) for x in zip(after, books, far)]
        books = after
    return books, _pass(rows, balls, width, seen=rounds > 0).where("kind = 0").select("vec_id", "label", "v", "code", "error")


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry, position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    spark: SparkSession = embeddings.sparkSession
    books, rows = fitted(integer_vectors(embeddings))
    if rows is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return (rows.join(by_label, F.expr("label <=> of"))
            .select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
