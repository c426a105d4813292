from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from catalux.llm import source_audit as A
from tests.llm.conftest import DOCS


def terms_of(text):
    lower = {i: i + 32 for i in range(65, 91)}
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute(rows):
    docs, occ = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = Counter(terms_of(text))
        occ[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= 10) for lang, c in docs.items()}

    def p(counts, lang):
        n, v = sum(counts[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * v) for t in kept[lang]}

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    whole = defaultdict(Counter)
    for (lang, _), c in occ.items():
        whole[lang].update(c)
    ps = {g: p(c, g[0]) for g, c in occ.items()}
    qs = {lang: p(c, lang) for lang, c in whole.items()}
    out = []
    for lang, source in occ:
        own = ps[lang, source]
        pairs = [(h, sum(f(own[t], ps[g, h][t]) for t in own)) for g, h in occ if g == lang and h != source]
        over = [(t, f(x, qs[lang][t])) for t, x in own.items() if occ[lang, source][t] and x > qs[lang][t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", over, 10)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, i, v, k) for k, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def audited(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, g, s, 0) for i, (t, g, s) in enumerate(rows)], DOCS)
    from pyspark.sql import functions as F
    return A.divergences(df.select("*", F.lit("x").alias("term"), F.lit(1).alias("block"), F.lit("k").alias("item")), **kw)


def mixed_rows(texts, n=1):
    rng = np.random.default_rng(5)
    extra = ["Foo, foo (FOO) ärger-Ärger x2y.foo", "é" * 50 + " 日本語,テキスト foo", "123 --- 4.5", "Foo bar foo\x1cbar"]
    rows = [(t, ["en", "de", None][k % 3], f"s{rng.integers(0, 7)}" if k % 11 else None) for k, t in enumerate([*texts, *(extra * 12)] * n)]
    return rows + [(None, "fr", "a"), ("", "fr", "b"), ("one two", "fr", "")]


@pytest.mark.parametrize("block_bytes,tile,slab", [(2_000, 2, 8), (1 << 20, 128, 4096)])
def test_equals_brute_force(spark, texts, block_bytes, tile, slab):
    rows = mixed_rows(texts)
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"}
    assert found(audited(spark, rows, block_bytes=block_bytes, tile=tile, slab=slab)) == want


def test_each_distinct_chunk_is_cut_once_and_blocks_hold_every_document(spark, docs):
    blocks = A.blocks(A.cleaned(docs), 0, 3_000)
    assert blocks.count() > 5
    data = blocks.toArrow()
    assert sum(len(x) for x in data["groups"].to_pylist()) == docs.count()
    total = sum(int(A._unpacked(t.as_py())[2].sum()) for t in data["triples"])
    assert total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect())
    back, terms = A.chunk_terms(blocks, 0, 3)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    # a term that may be kept is never lost to the bound
    held = Counter()
    for r in docs.collect():
        held.update(set(terms_of(r["text"])))
    assert {t for t, n in held.items() if n >= 3} <= {r["term"] for r in terms.collect()}


def test_shared_hashes_start_again(spark, texts, monkeypatch):
    rows = mixed_rows(texts)
    tried = []
    real = A._divergences

    def once(d, seed, *more):
        tried.append(seed)
        if not seed:
            A._checked(spark.createDataFrame([(1, "a"), (1, "b")], "cid long, chunk string"), "cid")
        return real(d, seed, *more)

    monkeypatch.setattr(A, "_divergences", once)
    assert found(audited(spark, rows)) == brute(rows) and tried == [0, 1]


def test_empty_and_termless(spark, empty_docs):
    assert A.divergences(empty_docs).count() == 0
    got = found(audited(spark, [("a b", "en", "x"), (None, "en", "y"), ("c", None, None)]))
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_probabilities_are_exact_for_very_large_counts(spark):
    n = 3 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, n), ("en", "a", 2, 5)], "lang string, source string, tid long, n long")
    groups = spark.sql(f"SELECT 'en' AS lang, 'a' AS source, CAST({n + 5 + 4} AS DECIMAL(38,0)) AS d")
    got = {r["tid"]: r["p"] for r in A.with_p(counts, groups).collect()}
    assert got == {1: 1 + 10**9 * (n + 2) // (n + 9), 2: 1 + 10**9 * 7 // (n + 9)}
