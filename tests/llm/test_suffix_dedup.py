from __future__ import annotations

import hashlib

from catalux.llm import suffix_dedup
from tests.llm.conftest import DOCS, rows_of
from tests.llm.test_kernels import brute_repeats


def spans_of(places: set) -> int:
    return sum(1 for p in places if p - 1 not in places)


def expected(by_id: dict) -> dict:
    ids = sorted(by_id)
    texts = [(by_id[i] or "").encode() for i in ids]
    out = {}
    for i, t, gone in zip(ids, texts, brute_repeats(texts, suffix_dedup.LENGTH)):
        kept = bytes(b for k, b in enumerate(t) if k not in gone)
        out[i] = (len(t), len(gone), spans_of(gone), hashlib.sha256(kept).hexdigest())
    return out


def results(docs) -> dict:
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeats(docs).collect()}


def test_against_brute_force(docs):
    want = expected(rows_of(docs))
    assert any(w[1] and w[1] < w[0] for w in want.values())
    assert results(docs) == want


def test_large_buckets_are_counted_over_all_tasks(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "PART", 5)
    assert results(docs) == expected(rows_of(docs))


def test_a_common_passage_makes_few_rows(spark, monkeypatch):
    """Many texts around one passage: pieces that agree are finished, only their ends are counted window by window."""
    import random
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage, near = word(330), word(400)
    by_id = {i: word(rnd.randint(0, 220)) + passage + word(rnd.randint(0, 220)) for i in range(60)}
    by_id |= {100 + i: near[: 40 + 9 * i] + "#" + near[41 + 9 * i:] for i in range(38)}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in by_id.items()], DOCS)
    made, real = {}, suffix_dedup.written

    def keep(frame, name):
        made[name] = real(frame, name)
        return made[name]

    monkeypatch.setattr(suffix_dedup, "written", keep)
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    assert results(df) == expected(by_id)
    hot = made["stretch-texts"].where("many").selectExpr("count(*) n", "sum(width) w").first()
    assert hot.n > 60
    assert made["pieces"].count() < hot.n * (suffix_dedup.REACH // suffix_dedup.CELL + 1)
    assert 0 < made["windows"].count() < hot.w // 2


def test_pipeline_form(docs):
    by_id, want = rows_of(docs), expected(rows_of(docs))
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    for r in got.collect():
        if want[r["doc_id"]][1] == 0:
            assert r["text"] == by_id[r["doc_id"]]
        else:
            assert r["n_chars"] == len(r["text"]) and len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1]


def test_ties_nulls_empty(spark, empty_docs):
    assert suffix_dedup.repeats(empty_docs).count() == 0
    t = "".join(chr(97 + (i * i) % 23) + str(i) for i in range(100))
    df = spark.createDataFrame([(1, t, "en", "s", 1), (1, t, "en", "s", 1), (None, t + "z", "en", "s", 1), (1, "short", "en", "s", 1),
                                (None, None, "en", "s", 1)], DOCS)
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.repeats(df).collect())
    n = len(t)
    assert got == [(0, 0, 0), (5, 0, 0), (n, n, 1), (n, n, 1), (n + 1, n, 1)]


def test_texts_of_one_doc_id_are_told_apart(spark):
    """Two texts under one doc_id that agree in the 16 bits of the second key: the one without a repeat keeps every byte."""
    from pyspark.sql import functions as F
    twice = "".join(f"{i * i:x}-" for i in range(90))
    tie = F.xxhash64("text", F.lit("row")).bitwiseAND(0xFFFF)
    wanted = spark.createDataFrame([(twice,)], "text string").select(tie).first()[0]
    clear = "".join(f"{i * 7919 % 10007}," for i in range(80))
    pool = spark.range(400_000).select(F.concat(F.lit(clear), F.col("id").cast("string")).alias("text"))
    other = pool.where(tie == wanted).first()["text"]
    df = spark.createDataFrame([(1, twice, "en", "s", 1), (1, other, "en", "s", 1), (2, twice, "en", "s", 1)], DOCS)
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeats(df).collect())
    assert got == sorted([(len(twice), len(twice)), (len(twice), len(twice)), (len(other), 0)])


def test_a_group_sorted_together_stays_small():
    """Pipeline, executor memory: a bucket as large as one may be, in the part of others, is sorted within 200 MB."""
    import tracemalloc

    import numpy as np
    import pandas as pd
    n, width = suffix_dedup.HOT + suffix_dedup.PART, suffix_dedup.REACH
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 122, width + suffix_dedup.LENGTH - 1, dtype=np.uint8).tobytes() for _ in range(n)]
    frame = pd.DataFrame({"key": np.arange(n), "tie": 0, "bucket": 1, "many": False, "start": 0, "width": width, "bytes": texts})
    tracemalloc.start()
    try:
        assert len(suffix_dedup._sorted_part(frame)) == 0
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()
