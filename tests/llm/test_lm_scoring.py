from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from catalux.llm import lm_scoring as L
from tests.llm.conftest import DOCS, rows_of


def tokens(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), "</end>"]


def brute(by_id):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in by_id}
    uni, bi = Counter(), Counter()
    for i, t in by_id.items():
        if not held[i]:
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["</end>", *w], w))
    n, v = sum(uni.values()), len(uni)

    def kind(c):
        return sum(c >= x for x in L.SEEN)

    def p(c_w, c_h, c_hw, b, total):
        root = (c_w + 0.5) / (total + 0.5 * (v + 1))
        return (1 - b) * c_hw / c_h + b * root if c_h > 0 else root

    loo = Counter()
    for i, t in by_id.items():
        if not held[i]:
            w = tokens(t)
            for h, x in zip(["</end>", *w], w):
                for b in L.BACKOFF:
                    loo[kind(uni[h] - 1), b] += math.log10(p(uni[x] - 1, uni[h] - 1, bi[h, x] - 1, b, n - 1))
    best = [max(L.BACKOFF, key=lambda b: loo[k, b]) for k in range(len(L.SEEN) + 1)]
    out = {}
    for i, t in by_id.items():
        w = tokens(t)
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = sum(math.log10(p(uni[x], uni[h], bi[h, x], best[kind(uni[h])], n)) for h, x in zip(["</end>", *w], w))
        out[i] = (held[i], len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out


def test_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 8_000)
    monkeypatch.setattr(L, "RANGE_BYTES", 4_000)
    want = brute(rows_of(docs))
    got = {r["doc_id"]: r for r in L.scores(docs).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert abs(r["base_score"] - w[4]) < 1e-6 and abs(r["score"] - w[5]) < 1e-6


def test_model_beats_the_base_on_held_out_copies(docs):
    rows = [r for r in L.scores(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_weights_sum_to_one():
    """From any state, the arcs of all known words and of one unknown word share the whole mass."""
    import numpy as np
    counts = np.array([5.0, 3, 2, 0])           # the last one stands for unknown words
    after = np.array([2.0, 0, 1, 0])
    a = L.Automaton(counts, np.full(4, 3.0), after, 10.0, 3.0)
    for b in L.BACKOFF:
        assert abs(a.weights(b).sum() - 1) < 1e-12
    assert abs(a.root_weights().sum() - 1) < 1e-12


def test_empty_null_and_untrained(spark, empty_docs):
    assert L.scores(empty_docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(held, "a b", "en", "s", 3)], DOCS)
    r = L.scores(df).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == r["base_score"] == 0
    df = spark.createDataFrame([(None, None, "en", "s", 3), (None, "x", "en", "s", 3)], DOCS)
    got = sorted((r["n_tokens"], r["held_out"], r["train_tokens"]) for r in L.scores(df).collect())
    assert got == [(1, False, 3), (2, False, 3)]


def test_totals_beyond_32_bits():
    """Three blocks with 2^32 - 2^30 of each word and bigram: totals of 3 * 2^32 - 3 * 2^30, and of exactly 2^32, come back whole."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"], "held_out": [False]})
    data = L._packed(batch)
    t = L.Tokens.of(data)
    for each in (3 << 30, 1 << 30):
        blocks, met = (3, 4)[each == 1 << 30], []
        for kind, values in ((0, t.token), (1, t.bigram)):
            keys = np.unique(values)
            count = pa.compress(np.full(len(keys), each, "<u4").tobytes(), codec="zstd", asbytes=True)
            out = L._totals(pd.DataFrame([{"kind": kind, "owner": 0, "block": k, "keys": keys.tobytes(), "counts": count}
                                          for k in range(blocks)]))
            met.append(out[out["block"] == 0][["block", "kind", "owner", "n", "data"]])
        met.append(pd.DataFrame([{"block": 0, "kind": -1, "owner": -1, "n": 0, "data": data}]))
        total = blocks * each
        r = L._traversed(3.0 * total, 3.0)(pd.concat(met)).iloc[0]
        root = (total + 0.5) / (3 * total + 2)
        assert total >= 1 << 32 and r["n_known"] == 3 and abs(r["base_score"] - 3 * math.log10(root)) < 1e-9
        want = [3 * math.log10((1 - b) + b * root) for b in L.BACKOFF]
        assert np.allclose(r["sums"].reshape(-1, len(L.BACKOFF))[-1], want)
