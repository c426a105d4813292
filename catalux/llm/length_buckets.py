"""Packing (operator 7): optimal length buckets, token-budget batches inside each.

A global histogram of token counts reaches the driver; dynamic programming over it chooses the bucket boundaries
that minimise padding: the sum over documents of (longest length in the bucket - own length).  The histogram has one
row a length up to 2^20, then 256 an octave: at most 1,051,392 rows of 32 bytes whatever the input, and no more than
about the square root of twice its tokens.  Only boundaries among documents of over 2^20 tokens are chosen by bins,
which costs such a document less than 1/256 of its length.  Documents of a bucket are dealt into cells of a few
thousand by hash, and batches of at most ``budget`` padded tokens form inside a cell, so no window spans a whole bucket.

A document's token count is its number of words plus one end token.

Defined results: null, empty and blank texts count 1; a document longer than the budget is a batch of its own;
every row is in exactly one batch, repeated rows included; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.llm.sqltext import words

BUCKETS = 12
BUDGET = 16_384
EXACT = 1 << 20
STEPS = 256
CELL = 4_096


def bin_of(n: Column, exact: int = 1_024) -> Column:
    """Bin of a length: itself up to ``exact``, then STEPS bins an octave; larger lengths never get smaller bins."""
    octave = F.floor(F.log2(n.cast("double") / exact))
    low = F.pow(F.lit(2.0), octave) * exact
    return F.when(n <= exact, n.cast("long")).otherwise(
        (exact + octave * STEPS + F.floor((n - low) / low * STEPS) + 1).cast("long"))


def _last_boundaries(base: np.ndarray, rows: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j from 1: the least base[i] - longest[j - 1] * rows[i] over i < j, and the first i that gives it (place 0 unused).

    That i never falls as j grows (rows and longest ascend), so it is found for every second j of a stride, then between
    those found: about 2 n entries a stride, log2(n) strides.
    """
    n = len(longest)
    best, choice = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    step = 1 << (n.bit_length() - 1)
    while step:
        j = np.arange(step, n + 1, 2 * step)
        right = j + step
        lo = choice[j - step]
        hi = np.minimum(j - 1, np.where(right <= n, choice[np.minimum(right, n)], n))
        size = hi - lo + 1
        start = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(lo - start, size)
        value = base[at] - np.repeat(longest[j - 1], size) * rows[at]
        best[j] = np.minimum.reduceat(value, start)
        hit = np.flatnonzero(value == np.repeat(best[j], size))
        owner = np.searchsorted(start, hit, side="right")
        choice[j] = at[hit[np.flatnonzero(np.diff(owner, prepend=0))]]
        step >>= 1
    return best, choice


def optimal_boundaries(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Padded length of each bucket, ascending, with the least padding for at most ``buckets`` of them.

    One entry a bin, ascending: its longest length, its documents and the sum of their lengths.
    """
    n = len(longest)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(count)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(total)]).astype(float)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        best, choice = _last_boundaries(cost + tokens, rows, longest.astype(float))
        after = np.concatenate([[0.0], best[1:] + longest * rows[1:] - tokens[1:]])
        back.append(choice)
        if np.array_equal(after, cost):
            break
        cost = after
    out, j = [], n
    for choice in reversed(back):
        if j == 0:
            break
        out.append(int(longest[j - 1]))
        j = int(choice[j])
    return out[::-1]


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, exact: int = EXACT) -> DataFrame:
    """doc_id, n_tokens, padded_length, batch_id and slot of every row; lengths up to ``exact`` are counted one by one."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       (F.size(words(docs["text"].cast("string"))) + 1).cast("long").alias("n_tokens"),
                       F.xxhash64(docs["text"].cast("string")).alias("h"))
    bins = (rows.groupBy(bin_of(F.col("n_tokens"), exact).alias("bin"))
            .agg(F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total")).toArrow().sort_by("bin"))
    longest, count, total = (bins[c].to_numpy() for c in ("longest", "n", "total"))
    ends = optimal_boundaries(longest, count, total, buckets)
    size = dict(zip(ends, np.bincount(np.searchsorted(ends, longest), count, len(ends)).astype(int).tolist()))
    padded, cells = F.lit(None).cast("long"), F.lit(1).cast("long")
    for end in reversed(ends):
        padded = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(padded)
        # whole batches a cell: a cell leaves one batch unfilled at most
        cells = F.when(F.col("n_tokens") <= end, F.lit(max(1, size[end] // CELL)).cast("long")).otherwise(cells)
    placed = rows.select("doc_id", "n_tokens", "h", padded.alias("padded_length"),
                         F.pmod(F.xxhash64("doc_id", "h"), cells).alias("cell"))
    w = Window.partitionBy("padded_length", "cell").orderBy("doc_id", "h")
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded_length")))
    at = F.row_number().over(w) - 1
    return placed.select(
        "doc_id", "n_tokens", "padded_length",
        F.concat_ws("-", "padded_length", "cell", F.floor(at / per_batch)).alias("batch_id"),
        F.pmod(at, per_batch).cast("int").alias("slot"))
