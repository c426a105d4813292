from __future__ import annotations

import hashlib

from catalux.llm import scaled_sketch
from tests.llm.conftest import DOCS, rows_of

SCALE_ALL = 1


def edited_texts(by_id: dict) -> dict:
    order = sorted(by_id, reverse=True)
    out = {}
    for k, i in enumerate(order):
        t, nxt = by_id[i] or "", by_id[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        out[i] = t[: len(t) - half] + nxt[:half]
    return out


def word_list(t: str) -> list[str]:
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def shingle_set(t: str) -> set:
    w = word_list(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a: set, b: set) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(docs):
    by_id = rows_of(docs)
    edited = edited_texts(by_id)
    order = sorted(by_id, reverse=True)
    got = {r["doc_id"]: r for r in scaled_sketch.fingerprints(docs).collect()}
    exact = {r["doc_id"]: r for r in scaled_sketch.fingerprints(docs, scale=1).collect()}
    assert set(got) == set(by_id)
    for k, i in enumerate(order):
        t = by_id[i] or ""
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        assert (got[i]["fingerprint"] == "") == (not word_list(t))
        # the whole hash range retained: the estimate is the exact similarity
        assert abs(exact[i]["near_edited"] - jaccard(shingle_set(t), shingle_set(edited[i]))) < 1e-12
        nxt = by_id[order[(k + 1) % len(order)]] or ""
        assert abs(exact[i]["near_next"] - jaccard(shingle_set(t), shingle_set(nxt))) < 1e-12
        assert abs(got[i]["near_edited"] - exact[i]["near_edited"]) < 0.35 or len(word_list(t)) < 200
    same = {}
    for i, t in by_id.items():
        assert same.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_containment_and_merge(spark):
    from pyspark.sql import functions as F
    long_ = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(1000, 1400))
    df = spark.createDataFrame([(1, long_, part)], "id long, a string, b string").select(
        "id", scaled_sketch.sketch(F.col("a")).alias("a"), scaled_sketch.sketch(F.col("b")).alias("b"))
    r = df.select(scaled_sketch.containment(F.col("b"), F.col("a")), scaled_sketch.containment(F.col("a"), F.col("b")),
                  F.size("a")).first()
    assert r[0] >= 0.95 and abs(r[1] - 0.1) < 0.06 and 350 < r[2] < 650
    both = df.select(F.explode(F.array("a", "b")).alias("sketch"), F.lit(1).alias("k"))
    assert scaled_sketch.merged(both, "k").count() == df.select(F.size(F.array_union("a", "b"))).first()[0]


def test_merging_gives_the_sketch_of_the_union(spark):
    from pyspark.sql import functions as F
    parts = [(k % 3, f"a{k} b{k} c{k} d{k} e{k}") for k in range(400)] + [(7, "only one shingle is here"), (8, ""), (9, "x")]
    df = spark.createDataFrame(parts, "k long, t string").select("k", scaled_sketch.shingles(scaled_sketch.words(F.col("t")), 5).alias("h"),
                                                                  scaled_sketch.sketch(F.col("t")).alias("sketch"))
    got = {}
    for r in scaled_sketch.merged(df, "k").collect():
        got.setdefault(r["k"], set()).add(r["hash"])
    top = -(1 << 63) + (1 << 64) // scaled_sketch.SCALE - 1
    for k in (0, 1, 2):
        whole = {x for r in df.where(F.col("k") == k).collect() for x in r["h"]}
        assert got[k] == ({x for x in whole if x <= top} or {min(whole)}) and len(got[k]) < 40
    assert len(got[7]) == 1 and 8 not in got and len(got[9]) == 1


def test_ties_nulls_single_empty(spark, empty_docs):
    assert scaled_sketch.fingerprints(empty_docs).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f", "en", "s", 11)], DOCS)
    r = scaled_sketch.fingerprints(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b c a b c"[:6] + b"a b c").hexdigest()
    odd = spark.createDataFrame([(None, "x y", "en", "s", 3), (3, "p", "en", "s", 1), (3, "p", "en", "s", 1),
                                 (3, "q", "en", "s", 1), (-(2**60), None, "en", "s", 0)], DOCS)
    assert scaled_sketch.fingerprints(odd).count() == 5
