from __future__ import annotations

import re

import numpy as np

from catalux.llm import minhash
from catalux.llm.components import components
from tests.llm.conftest import DOCS, rows_of


def shingle_set(t: str | None, size: int) -> frozenset:
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(by_id: dict, size: int) -> dict:
    sets = {i: shingle_set(t, size) for i, t in by_id.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_against_brute_force(docs):
    by_id = rows_of(docs)
    for size in (4, 5):
        got = {r[0]: (r[1], r[2], r[3]) for r in minhash.near_duplicates(docs, size).select(
            "doc_id", "n_shingles", "component_id", "kept").collect()}
        assert got == brute(by_id, size)


def test_links_that_do_not_pass_through_the_smallest(spark):
    """A chain of texts, each near the next only, and two families that differ: blocks across components must find all."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(30):
        rows.append((1000 - 7 * k, " ".join(words[3 * k: 3 * k + 100])))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {r[0]: (r[1], r[2], r[3]) for r in minhash.near_duplicates(df, 4).select(
        "doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(dict(rows), 4)


def test_circulant_estimates_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64) * np.uint64(2)
    for shared in (0, 450, 810):
        y = np.concatenate([x[:shared], rng.integers(0, 2**63, 900 - shared, dtype=np.uint64) * np.uint64(2)])
        a, b = (minhash.circulant_signature(v, 1024) for v in (x, y))
        assert abs((a == b).mean() - shared / (1800 - shared)) < 0.07


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(tuple(r) for r in components(df).collect())
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[150] == got[100] == 100 and 300 not in got


def test_nulls_and_empty(spark, empty_docs):
    assert minhash.near_duplicates(empty_docs).count() == 0
    t = " ".join(f"v{i}" for i in range(50))
    df = spark.createDataFrame([(None, t, "en", "s", 1), (None, t, "en", "s", 1), (7, t + " end", "en", "s", 1),
                                (None, "lonely words only here now", "en", "s", 1), (8, None, "en", "s", 0)], DOCS)
    got = sorted([(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()], key=str)
    assert got == sorted([(None, 7, False), (None, 7, False), (7, 7, True), (None, None, True), (8, 8, True)], key=str)


def brute_rows(rows: list, size: int) -> list:
    """As brute, where doc_ids repeat: equal sets are one class under its smallest doc_id, all classes of a doc_id one node."""
    node = {}
    for i, t in rows:
        s = shingle_set(t, size)
        node[s] = min(i, node.get(s, i))
    root = {i: i for i in node.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = list(node)
    for k, x in enumerate(sets):
        for y in sets[k + 1:]:
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                a, b = find(node[x]), find(node[y])
                root[max(a, b)] = min(a, b)
    found = [(i, len(s), find(node[s])) for i, s in ((i, shingle_set(t, size)) for i, t in rows)]
    return sorted((i, n, c, i == c) for i, n, c in found)


def test_doc_ids_that_repeat(spark):
    """Two near texts share every band with a smaller third that is not near: only blocks find them, also where rows repeat."""
    rng = np.random.default_rng(5)
    common = [f"c{j}" for j in range(90)]
    rows = [(1000, " ".join(common + [f"a{j}" for j in range(10)]))] * 3 + [(1001, " ".join(common + [f"b{j}" for j in range(10)]))]
    for k in range(40):
        rows.append((k + 1, " ".join([common[j] for j in rng.permutation(90)[:78]] + [f"p{k}_{j}" for j in range(20)])))
    # further texts of the same doc_ids, one of them also elsewhere; two empty texts are no link
    rows += [(1000, " ".join(f"x{j}" for j in range(60))), (1001, " ".join(f"y{j}" for j in range(60))),
             (999, " ".join(f"y{j}" for j in range(60))), (1000, ""), (1, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = sorted(tuple(r) for r in minhash.near_duplicates(df, 1).where("n_shingles > 0").select(
        "doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute_rows([(i, t) for i, t in rows if t], 1)


def test_large_components_are_not_copied_against_themselves(spark, monkeypatch):
    """Two members beside 3,000 of one component make about two rows a member, and all pairs across components meet once."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    label = {0: [7] * 3000 + [8, 9], 1: [1] * 40 + [2] * 30 + [3] * 5 + [4] * 5, 2: list(range(50))}
    rows, at = [], {}
    for band, labels in label.items():
        for x in labels:
            at[len(rows)] = (band, x)
            rows.append((band, 0, len(rows), len(rows), x))
    spread, copies = minhash._block_pairs(spark.createDataFrame(rows, "band long, at int, no long, node long, label long"))
    blocks = {}
    for r in spread.collect():
        blocks.setdefault((r["band"], r["i"], r["j"]), {}).setdefault(r["c"], []).append(r["no"])
    assert copies == sum(len(x) for b in blocks.values() for x in b.values())
    assert sum(len(x) for k, b in blocks.items() for x in b.values() if k[0] == 0) <= 2 * 3000 + 2
    met = []
    for (_, i, j), b in blocks.items():
        x, y = b.get(i, []), b.get(j, [])
        met += [(min(p, q), max(p, q)) for p in x for q in y if (i != j or p < q) and at[p][1] != at[q][1]]
    want = {(p, q) for p, (b, x) in at.items() for q, (c, y) in at.items() if p < q and b == c and x != y}
    assert sorted(met) == sorted(want)


def test_ids_of_the_whole_range_and_rows_without_one(spark):
    """Ids beyond 2^62 and below -2^62 are ids like any other; a class without an id never names a component."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words), " ".join([*words, "x"]), " ".join([*words, "x", "y"])]
    apart = " ".join(f"v{i}" for i in range(40))
    by_id = {2**63 - 1: near[0], 2**62 + 5: near[1], -(2**63): apart, -(2**62) - 9: near[2], 7: "alone here"}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in by_id.items()], DOCS)
    rows = minhash.near_duplicates(df, 4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == brute(by_id, 4)
    some = spark.createDataFrame([(None, near[0], "en", "s", 1), (2**62 + 5, near[1], "en", "s", 1), (2**62 + 9, near[2], "en", "s", 1),
                                  (None, apart, "en", "s", 1)], DOCS)
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(some, 4).collect()}
    first = 2**62 + 5
    assert got == {(None, 57): (first, False), (first, 58): (first, True), (2**62 + 9, 59): (first, False), (None, 37): (None, True)}


def test_any_column_name_stays(spark, docs):
    from pyspark.sql import functions as F
    clashing = ["__id", "__hash", "__row", "__likely", "bm_bits", "bm_part", "bm_likely", "BM_BITS_", "component_id", "c0", "d_id", "s_key"]
    wide = docs.select("*", *[F.lit(f"keep {c}").alias(c) for c in clashing])
    got, plain = minhash.one_of_each(wide), minhash.one_of_each(docs)
    assert got.columns == wide.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in plain.collect()}
    assert all(r[c] == f"keep {c}" for r in rows for c in clashing)
