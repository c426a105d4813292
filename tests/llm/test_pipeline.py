"""Each stage of the pipeline against brute force, on the stage's own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalux.llm import length_buckets, quality_classifier
from catalux.llm.tables import table, written
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_quality_rules import brute as rule_verdict
from tests.llm.test_suffix_dedup import expected as repeats

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    out, docs = [], table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, SF), name)
        out.append((name, docs, result))
        docs = result
    return {name: (before, after) for name, before, after in out}


def by_id(df):
    rows = df.select("doc_id", "text").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r["text"] for r in rows}


def test_shape(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "minhash_near_dedup",
                                                      "suffix_array_dedup", "length_packing"]
    for name, (before, after) in steps.items():
        if name != "length_packing":
            assert after.columns == COLUMNS and after.schema == before.schema


def test_quality_classifier(spark, steps):
    before, after = steps["quality_classifier"]
    model = quality_classifier.fit(before, table(spark, SF, "labels"))
    want = {r["doc_id"] for r in quality_classifier.score(before, model).where("predicted = 1").collect()}
    assert set(by_id(after)) == want and 0 < len(want) <= before.count()


def test_quality_rules(steps):
    before, after = steps["quality_rules"]
    texts = by_id(before)
    assert by_id(after) == {i: t for i, t in texts.items() if rule_verdict(t)["kept"]}


def test_near_dedup(steps):
    before, after = steps["minhash_near_dedup"]
    texts = by_id(before)
    groups = near_groups(texts, 5)
    assert by_id(after) == {i: t for i, t in texts.items() if groups[i][2]}
    assert len(by_id(after)) < len(texts)


def test_suffix_dedup(steps):
    before, after = steps["suffix_array_dedup"]
    texts, got = by_id(before), by_id(after)
    want = repeats(texts)
    assert set(got) == set(texts) and any(w[1] for w in want.values())
    for i, w in want.items():
        assert (got[i] == texts[i]) if w[1] == 0 else (0 <= w[0] - w[1] - len(got[i].encode()) <= 8 * w[2])
    sizes = {r["doc_id"]: r["n_chars"] for r in after.collect()}
    assert all(sizes[i] == len(t) for i, t in got.items())


def test_packing(steps):
    before, after = steps["length_packing"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(by_id(before))
    load = after.groupBy("batch_id").agg(F.sum("padded_length").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["s"] <= length_buckets.BUDGET or r["n"] == 1 for r in load)


def test_run_is_the_stages_in_order(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps["length_packing"][1].collect()))


def test_awkward_documents_go_through_every_stage(spark, docs, empty_docs):
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, empty_docs):
            out = stage(spark, d, SF)
            out.count()
            assert name == "length_packing" or out.columns == d.columns


def test_one_of_each_with_ties(spark):
    from catalux.llm import minhash
    from tests.llm.conftest import DOCS
    t = " ".join(f"v{i}" for i in range(60))
    rows = [(3, t), (3, t), (9, t + " x"), (3, t + " y"), (None, "a b c d e f"), (None, "a b c d e f"), (4, None), (4, None)]
    df = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in minhash.one_of_each(df).collect()]
    assert len(got) == 4 and sum(i == 3 for i, _ in got) == 1 and got.count((4, None)) == 2 and (None, "a b c d e f") in got
