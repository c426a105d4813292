from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from catalux.llm import source_mix as M
from tests.llm.conftest import DOCS
from tests.llm.test_scaled_sketch import word_list


def table(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    return df.select("*", F.lit(1).alias("size"), F.lit("x").alias("target"), F.lit(2).alias("n"))


def some_rows(seed=1, n=600):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.paretovariate(0.9)) % 3_000)), f"s{min(rng.randint(0, 9), 5)}") for i in range(n)]
    return rows + [(9_000, None, "s1"), (9_001, "", "s2"), (9_002, "a b", None), (9_003, "  ", None), (9_004, "x y z", ""), (9_005, None, "void")]


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / share > 3 * size[s]} if share else set()
        if not over:
            return {s: float(3 * size[s]) if s in full else rest * weight[s] / share for s in names}
        full |= over


def checked(docs, rows):
    got = [r.asDict() for r in docs]
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(word_list(t or ""))
    want = brute_targets(size)
    source = {i: s for i, _, s in rows}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(word_list(t or ""))) for i, t, _ in rows)
    words = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and math.isclose(r["target"], want[s], rel_tol=1e-12, abs_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
        words[s] += r["taken"]
    return got, want, words, source


def test_targets_caps_and_words(spark):
    rows = some_rows()
    _, want, words, _ = checked(M.mixed(table(spark, rows)).collect(), rows)
    for s in want:
        assert abs(words[s] - want[s]) <= max(3, 0.01 * want[s]), s
    assert any(want[s] and words[s] == want[s] for s in ("",))     # a tiny source stops at three times its size


def test_rates_solve_the_dual(spark):
    rows = some_rows(2)
    got, want, _, source = checked(M.mixed(table(spark, rows)).collect(), rows)
    for s in {"s0", "s1", "s2", "s3", "s4", "s5"}:
        own = [r for r in got if source[r["doc_id"]] == s]
        sizes = [r["size"] for r in own]
        if want[s] >= 3 * sum(sizes):
            continue
        assert abs(sum(r["rate"] * r["size"] for r in own) - want[s]) <= max(0.02, 1e-6 * want[s])
        lo, hi = -1e3, 1e3                                          # the tilt by bisection
        for _ in range(200):
            m = (lo + hi) / 2
            if sum(3 * x / (1 + 2 * math.exp(min(700, -m * x))) for x in sizes) < want[s]:
                lo = m
            else:
                hi = m
        for r in own:
            assert abs(r["rate"] - 3 / (1 + 2 * math.exp(min(700, -lo * r["size"])))) < 1e-3


def test_reruns_and_partitions_agree(spark):
    df = table(spark, some_rows(3))
    first = sorted(map(tuple, M.mixed(df).collect()))
    assert first == sorted(map(tuple, M.mixed(df.repartition(7)).collect()))


def test_repeated_and_missing_ids_share_evenly(spark):
    rows = [(1, "a b c", "x")] * 50 + [(None, "a b c", "x")] * 30 + [(2, "d e f", "x")] + [(5, "w " * 40, "y")] * 20
    got, want, words, _ = checked(M.mixed(table(spark, rows)).collect(), rows)
    assert len(got) == len(rows)
    for s in want:
        assert abs(words[s] - want[s]) <= 40
    many = [r["copies"] for r in got if r["doc_id"] == 1]
    assert len(many) == 50 and max(many) - min(many) <= 1


def test_without_words_and_empty(spark, empty_docs):
    assert M.mixed(empty_docs).count() == 0
    got = M.mixed(table(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
    one = M.mixed(table(spark, [(1, "a b c", "a")])).first()
    assert (one["target"], one["taken"]) == (3.0, 3)


def test_main_path_has_no_python(spark):
    plan = M.mixed(table(spark, some_rows(4, 50)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
