from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from catalux.llm import quality_classifier as Q
from catalux.llm.tables import table
from tests.llm.conftest import DOCS, awkward_texts

SF = "/root/testdata/sf0.01"


def test_flattened_traversal_equals_walking():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    trees = Q.fit_trees(x, y)
    got = trees.score(x)
    for r in range(0, 800, 37):
        raw = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + (2 if x[r, trees.feature[t, node]] > trees.threshold[t, node] else 1)
            raw += trees.value[t, node - trees.feature.shape[1]]
        assert abs(got[r] - 1 / (1 + np.exp(-raw))) < 1e-12
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.97


def test_features_by_hand():
    texts = awkward_texts() + ["The THE the!!\n\nThe THE the!!\n|a b|"]
    f = Q.document_features(pa.array(texts))
    names = {n: k for k, n in enumerate(Q.FEATURES)}
    assert np.isfinite(f).all() and (f[[0, 1, 2]] == 0).all()
    last = f[-1]
    assert last[names["bangs"]] == 4 / 8 and last[names["bars"]] == 2 / 8
    assert abs(last[names["repeated_lines"]] - 1 / 3) < 1e-12
    one = Q.document_features(pa.array([texts[-1]]))[0]
    assert (one == last).all()


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = Q.fit(docs, labels)
    rows = Q.score(docs, model).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == Q.score(docs, model).where("predicted = 1").count()


def test_null_empty_unlabelled(spark, empty_docs, docs):
    labels = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])
    none = spark.createDataFrame([(None, 1), (5, None)], labels)
    model = Q.fit(docs, none)
    assert {r["score"] for r in Q.score(docs, model).collect()} == {0.5}
    assert Q.score(empty_docs, Q.fit(empty_docs, none)).count() == 0
    assert Q.keep_good(docs, Q.Trees(9.0, *(np.zeros((0, 1)),) * 2, np.zeros((0, 2)))).columns == docs.columns
