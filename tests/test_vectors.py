"""Vector operators against numpy brute force on small generated frames."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from catalux.operators import ivf
from catalux.operators import vector as V
from catalux.operators.embed import embed_frame


def _frames(spark, n=300, q=25, d=8, seed=3):
    rng = np.random.default_rng(seed)
    pts = rng.normal(size=(n, d)).astype(np.float32)
    pts[5] = pts[4]                                   # an exact tie
    qs = rng.normal(size=(q, d)).astype(np.float32)
    pdf = spark.createDataFrame([("s" if i % 3 else "t", str(i), pts[i].tolist(), ["a", "b"][i % 2], float(i))
                                 for i in range(n)],
                                "source string, pg_id string, embedding array<float>, file_type string, size double")
    qdf = spark.createDataFrame([(j, qs[j].tolist()) for j in range(q)], "query_id long, qvec array<float>")
    return pts, qs, pdf, qdf


def _brute(pts, qs, keys, k, metric="cosine", mask=None):
    p = pts.astype(np.float64)
    out = {}
    for j, qv in enumerate(qs.astype(np.float64)):
        if metric == "cosine":
            s = p @ qv / (np.linalg.norm(p, axis=1) * np.linalg.norm(qv))
        elif metric == "dot":
            s = p @ qv
        else:
            s = -((p - qv) ** 2).sum(axis=1)
        s = np.round(s, 6)
        cand = [(-s[i], keys[i], i) for i in range(len(p)) if mask is None or mask[j][i]]
        out[j] = [c[2] for c in sorted(cand)[:k]]
    return out


def test_knn_matches_brute_force_all_metrics(spark):
    pts, qs, pdf, qdf = _frames(spark)
    keys = [("s" if i % 3 else "t", str(i)) for i in range(len(pts))]
    for metric in ("cosine", "dot", "l2"):
        got = V.knn(pdf, qdf, 7, metric=metric).collect()
        by_q = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            by_q.setdefault(r["query_id"], []).append(int(r["pg_id"]))
        assert by_q == _brute(pts, qs, keys, 7, metric), metric


def test_knn_blocks_split_queries(spark):
    pts, qs, pdf, qdf = _frames(spark)
    one = sorted(map(tuple, V.knn(pdf, qdf, 5).collect()))
    many = sorted(map(tuple, V.knn(pdf, qdf, 5, point_rows=37, query_rows=4).collect()))
    assert one == many


def test_knn_per_query_filters(spark):
    pts, qs, pdf, qdf = _frames(spark)
    q = V.query_codes(qdf.withColumn("ft", F.when(F.col("query_id") % 2 == 0, F.lit("a"))),
                      file_type="ft", size_min=F.when(F.col("query_id") % 3 == 0, F.lit(100.0)))
    p = V.point_codes(pdf.withColumn("l", F.array("file_type")), audio="l", subs="l", genres="l", ext_id="source")
    got = V.knn(p, q, 4, use_filters=True).collect()
    keys = [("s" if i % 3 else "t", str(i)) for i in range(len(pts))]
    mask = [[((j % 2) or i % 2 == 0) and ((j % 3) or i >= 100) for i in range(len(pts))] for j in range(len(qs))]
    by_q = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_q.setdefault(r["query_id"], []).append(int(r["pg_id"]))
    assert by_q == _brute(pts, qs, keys, 4, mask=mask)


def test_ivf_all_cells_equals_exact_and_recall_grows(spark):
    pts, qs, pdf, qdf = _frames(spark, n=400, q=30)
    index = ivf.build_index(pdf, 8)
    assert index.points.count() == 400 and index.cells == 8
    exact = V.knn(pdf, qdf, 10)
    full = ivf.knn_ivf(index, qdf, 10, nprobe=8)
    assert sorted(tuple(r) for r in full.collect()) == sorted(tuple(r) for r in exact.collect())
    recalls = [ivf.recall_at_k(ivf.knn_ivf(index, qdf, 10, nprobe=p), exact) for p in (1, 2, 4, 8)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_ivf_reads_only_probed_cells_and_keeps_null_vectors(spark):
    pts, qs, pdf, qdf = _frames(spark, n=400, q=30)
    more = pdf.unionByName(spark.createDataFrame([("s", "none", None, "a", 1.0)], pdf.schema))
    index = ivf.load_index(spark, ivf.build_index(more, 16).path)
    assert index.points.count() == 401 and index.points.where("cell = -1").count() == 1
    one = qdf.where("query_id = 3")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")        # so that the plan that ran can be read
    try:
        out = ivf.knn_ivf(index, one, 5, nprobe=2)
        assert len(out.collect()) == 5
        plan = out._jdf.queryExecution().executedPlan()
        assert "dynamicpruning" in plan.toString()
        leaves = plan.collectLeaves()
        read = [leaves.apply(i).metrics().apply("numPartitions").value() for i in range(leaves.size())
                if "FileScan" in leaves.apply(i).toString() and leaves.apply(i).metrics().contains("numPartitions")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    assert read and min(read) == 2, read                          # of 17 folders


def test_wrong_vectors_are_set_aside_and_counted_in_one_pass(spark):
    rows = [("s", str(i), [1.0] * (4 if i % 5 else 3)) for i in range(50)] + [("s", "x", None)]
    df = spark.createDataFrame(rows, "source string, pg_id string, embedding array<float>")
    out = V.checked(df, 4)
    assert out.figures == {"rows": 51, "good": 40, "wrong": 11, "missing": 1}
    assert out.good.count() == 40 and out.good.columns == df.columns
    assert sorted(r["dim_found"] for r in out.quarantine.collect()) == [-1] + [3] * 10


def test_search_keeps_both_sides_off_the_driver(spark):
    pts, qs, pdf, qdf = _frames(spark)
    q = V.query_codes(qdf.withColumn("ft", F.when(F.col("query_id") % 2 == 0, F.lit("a"))), file_type="ft")
    p = V.point_codes(pdf.withColumn("l", F.array("file_type")), audio="l", subs="l", genres="l", ext_id="source")
    for out in (V.knn(pdf, qdf, 5), V.knn(p, q, 5, use_filters=True)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_hash_embedder_is_deterministic_unit_length(spark):
    df = spark.createDataFrame([("hello",), ("x" * 1000,)], "t string")
    rows = embed_frame(df, "t", "e", dim=16).collect()
    for r in rows:
        v = np.asarray(r["e"], dtype=np.float64)
        assert v.shape == (16,) and abs(np.linalg.norm(v) - 1) < 1e-5
    h = hashlib.sha1("hello".encode()).digest()
    rng = np.random.default_rng(int.from_bytes(h[:8], "big") ^ 42)
    ref = rng.normal(0, 1, 16).astype(np.float32)
    assert np.allclose(rows[0]["e"], ref / np.linalg.norm(ref), atol=1e-6)
