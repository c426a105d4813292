from __future__ import annotations

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from catalux.llm import length_buckets as B
from tests.llm.conftest import DOCS, rows_of
from tests.llm.test_scaled_sketch import word_list


def test_every_row_once_within_budget_and_least_padding(docs):
    by_id = rows_of(docs)
    rows = B.packed(docs, buckets=5, budget=600).collect()
    n = {i: len(word_list(t or "")) + 1 for i, t in by_id.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == n and len(rows) == len(n)
    batches = defaultdict(list)
    for r in rows:
        batches[r["batch_id"]].append(r)
    for own in batches.values():
        assert len({r["padded_length"] for r in own}) == 1 and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert sum(r["padded_length"] for r in own) <= 600 or len(own) == 1
    ends = sorted({r["padded_length"] for r in rows})
    assert len(ends) <= 5 and all(r["padded_length"] == next(e for e in ends if e >= r["n_tokens"]) for r in rows)
    lengths = sorted(n.values())
    values = sorted(set(lengths))
    best = {0: {0: 0}}
    for k in range(1, 6):      # plain dynamic programme over distinct lengths
        best[k] = {0: 0}
        for j in range(1, len(values) + 1):
            best[k][j] = min(best[k - 1][i] + sum(values[j - 1] - x for x in lengths if values[i] <= x <= values[j - 1])
                             for i in range(j) if i in best[k - 1])
    assert sum(r["padded_length"] - r["n_tokens"] for r in rows) == best[5][len(values)]


def test_bins_are_monotone(spark):
    from pyspark.sql import functions as F
    rows = spark.range(1, 40_000).select("id", B.bin_of(F.col("id")).alias("b")).orderBy("id").collect()
    assert all(x["b"] <= y["b"] for x, y in zip(rows, rows[1:])) and rows[1023]["b"] == 1024 and rows[-1]["b"] < 1024 + 6 * 256


def test_ties_and_empty(spark, empty_docs):
    assert B.packed(empty_docs).count() == 0
    df = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 3 + [(None, None, "en", "s", 0)], DOCS)
    rows = B.packed(df).collect()
    assert len(rows) == 4 and len({(r["batch_id"], r["slot"]) for r in rows}) == 4


def least_padding(count: dict, buckets: int) -> int:
    """By trying every last boundary for every length."""
    values = sorted(count)
    cost = {0: 0}
    for _ in range(buckets):
        cost = {0: 0} | {j: min(cost[i] + sum(count[v] * (values[j - 1] - v) for v in values[i:j]) for i in range(j) if i in cost)
                         for j in range(1, len(values) + 1)}
    return cost[len(values)]


@given(st.dictionaries(st.integers(1, 5_000), st.integers(1, 60), min_size=1, max_size=24), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_boundaries_are_optimal(count, buckets):
    lengths = np.array(sorted(count))
    docs = np.array([count[v] for v in sorted(count)])
    ends = B.optimal_boundaries(lengths, docs, lengths * docs, buckets)
    assert ends == sorted(set(ends)) and len(ends) <= buckets and ends[-1] == lengths[-1]
    assert sum(n * (min(e for e in ends if e >= v) - v) for v, n in count.items()) == least_padding(count, buckets)


def test_many_lengths():
    """A hundred thousand lengths are solved at once; another boundary next to any chosen one is no better."""
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1, 1 << 20, 100_000))
    docs = rng.integers(1, 50, len(lengths))

    def padding(ends):
        return int((docs * (np.array(ends)[np.searchsorted(ends, lengths)] - lengths)).sum())

    ends = B.optimal_boundaries(lengths, docs, lengths * docs, 8)
    place = np.searchsorted(lengths, ends)
    for k in range(len(ends) - 1):
        for step in (-1, 1):
            assert padding([*ends[:k], int(lengths[place[k] + step]), *ends[k + 1:]]) >= padding(ends)


def test_long_documents_get_exact_boundaries(spark):
    """Lengths of 1,500 and 1,501 fell into one bin of a histogram with 256 steps an octave."""
    texts = ["w " * (n - 1) for n in [1_500] * 40 + [1_501] * 3 + [1_502] * 40]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    rows = B.packed(df, buckets=2).collect()
    assert {r["padded_length"] for r in rows} == {1_500, 1_502} and sum(r["padded_length"] - r["n_tokens"] for r in rows) == 3
    coarse = B.packed(df, buckets=2, exact=1_024).collect()
    assert len(coarse) == len(rows) and all(r["padded_length"] >= r["n_tokens"] for r in coarse)
