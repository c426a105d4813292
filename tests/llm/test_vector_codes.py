from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from catalux.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], b, "x", 9) for i, v, b in rows], SCHEMA)


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], b) for i, v, b in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    kept = [(i, v + [0] * (width - len(v)), b) for i, v, b in kept]
    w = width // 4
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][1]))
    books = [[kept[k][1][p * w:(p + 1) * w] for k in order[:entries]] for p in range(4)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    def assign():
        return [[nearest(p, v[p * w:(p + 1) * w]) for p in range(4)] for _, v, _ in kept]

    for _ in range(rounds):
        codes = assign()
        for p in range(4):
            for e in range(len(books[p])):
                own = [v[p * w:(p + 1) * w] for (_, v, _), c in zip(kept, codes) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    codes = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in codes]
    by = {}
    for (_, _, b), e in zip(kept, errors):
        by[b] = by.get(b, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in c), err, by[b], sha) for (i, _, b), c, err in zip(kept, codes, errors)), key=repr)


def coded(df):
    return sorted((tuple(r) for r in V.coded(df).collect()), key=repr)


def clustered(n, seed=4, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (40, dims))
    return [(int(i), (centres[rng.integers(40)] + rng.normal(0, 0.02, dims)).tolist(), int(rng.integers(5))) for i in rng.permutation(n)]


def test_equals_plain_k_means(spark):
    rows = clustered(700) + [(5_000 + k, [0.25] * 8, 1) for k in range(60)] + [(3, [0.5] * 8, None), (3, [0.5] * 8, 2), (None, [1.0] * 8, None)]
    bad = [(900, None, 1), (901, [float("nan")] + [0.0] * 7, 1), (902, [float("inf")] + [0.0] * 7, 1), (903, [None] + [0.0] * 7, 2)]
    assert coded(table(spark, rows + bad).repartition(5)) == brute(rows)


def test_odd_lengths_few_rows_and_empty(spark):
    rows = [(1, [1.5, -2.25, 3.0, 0.125, 7.0], 1), (2, [], None), (3, [0.5], 1), (4, [-0.0001, 2.0, 1.0], None)]
    assert coded(table(spark, rows)) == brute(rows)
    assert coded(table(spark, [(1, [], 0), (2, [], 0)])) == [(1, "00000000", 0, 0, hashlib.sha256(b"").hexdigest()), (2, "00000000", 0, 0, hashlib.sha256(b"").hexdigest())]
    assert V.coded(table(spark, [])).count() == 0 and V.coded(table(spark, [(1, None, 2)])).count() == 0


def test_large_components_are_exact_and_clamped(spark):
    rows = [(k, [800.0 * k, -16_000.0, 3.0 * k, 12_345.678], k % 2) for k in range(20)]
    assert coded(table(spark, rows)) == brute(rows)
    got = V.integer_vectors(table(spark, [(1, [3e38, -3e38, 1.0, 0.0], 1)])).first()["v"]
    assert got == [V.LIMIT, -V.LIMIT, 1024, 0]


def test_rings_and_cores_save_work_and_change_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-800, 800, (64, 6))
    x = (centres[rng.integers(0, 64, 5_000)] + rng.integers(-9, 10, (5_000, 6))).astype(np.int64)
    before = x[:64].copy()
    code, d, full = V.Balls(before).assign(x, None)
    after, far = before.copy(), np.zeros(64, np.int64)
    for e in range(64):
        if (code == e).any():
            after[e] = x[code == e].sum(0) // (code == e).sum()
            far[e] = d[code == e].max()
    ball = V.Balls.of(after, before, far)
    new, error, work = ball.assign(x, code)
    want = V.distances(x, after)
    assert (new == want.argmin(1)).all() and (error == want.min(1)).all() and work < full / 3
    still = V.Balls.of(after, after, np.array([error[new == e].max(initial=0) for e in range(64)]))
    same, _, none = still.assign(x, new)
    assert (same == new).all() and none == len(x)      # nothing moved: no distance but to the own entry


def test_ties_go_to_the_lower_index_and_repartition_changes_nothing(spark):
    rows = [(k, [float(k % 4), 0.0, 1.0, float(k % 2)], k % 3) for k in range(400)]
    df = table(spark, rows)
    assert coded(df) == brute(rows) == coded(df.repartition(7, F.col("label")))
