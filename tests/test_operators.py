"""Relational operators: properties and edge cases on hand-made frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalux.operators import filters as FL
from catalux.operators import joins as J
from catalux.operators import ranking as R
from catalux.operators import upsert as U
from catalux.operators.aggregates import exact_median
from catalux.operators.textjoin import contains_join
from catalux.spec import SourceSpec

STATE = ("source string, pg_id string, text_hash string, embedding_version string, vector_id string, "
         "nsfw_score double, updated_at timestamp, last_error string")


def _state(spark, rows):
    return spark.createDataFrame(rows, STATE)


def test_upsert_is_idempotent_and_latest_wins(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    old = _state(spark, [("s", "1", "h1", "v1", "a", 0.1, t, "boom"), ("s", "2", "h2", "v1", "b", 0.2, t, None)])
    rows = spark.createDataFrame([("1", "h9", "x", 0.5)], "pg_id string, text_hash string, vector_id string, nsfw_score double")
    once = U.sync_state_upsert(old, rows, "s", "2024-02-01 00:00:00", "v2")
    twice = U.sync_state_upsert(once, rows, "s", "2024-02-01 00:00:00", "v2")
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    got = {r["pg_id"]: r for r in once.collect()}
    assert got["1"]["text_hash"] == "h9" and got["1"]["last_error"] is None and got["2"]["text_hash"] == "h2"


def test_failure_upsert_truncates_and_keeps_columns(spark):
    import datetime as dt
    old = _state(spark, [("s", "1", "h1", "v1", "a", 0.1, dt.datetime(2024, 1, 1), None)])
    fails = spark.createDataFrame([("s", "1", "e" * 600), ("s", "9", "new")], "source string, pg_id string, error string")
    out = {r["pg_id"]: r for r in U.failure_upsert(old, fails, "2024-03-01 00:00:00").collect()}
    assert len(out["1"]["last_error"]) == 512 and out["1"]["text_hash"] == "h1"
    assert out["9"]["last_error"] == "new" and out["9"]["text_hash"] is None


def test_pending_rows_rules(spark):
    import datetime as dt
    spec = SourceSpec(name="s", id_field="id", text_field="t", updated_at_field="u")
    rows = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 5)), (2, "b", dt.datetime(2024, 1, 5)),
                                  (3, "c", dt.datetime(2024, 1, 5)), (4, "d", dt.datetime(2024, 1, 5))],
                                 "id int, t string, u timestamp")
    import hashlib
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    st = _state(spark, [("s", "1", md5("a"), "v", "x", 0.0, dt.datetime(2024, 2, 1), None),     # fresh
                        ("s", "2", md5("b"), "v", "x", 0.0, dt.datetime(2024, 1, 1), None),     # older
                        ("s", "3", md5("zz"), "v", "x", 0.0, dt.datetime(2024, 2, 1), None)])   # changed
    got = sorted(r["pg_id"] for r in J.pending_rows(rows, spec, st).collect())
    assert got == ["2", "3", "4"]


def test_composite_lookup_falls_back_when_any_id_is_bad(spark):
    files = spark.createDataFrame([("a" * 40, 0, "a" * 40 + ":0"), ("a" * 40, 1, "x:1")], "info_hash string, idx int, file_id string")
    good = spark.createDataFrame([("\\x" + "a" * 40 + ":1",)], "id string")
    assert [r["idx"] for r in FL.composite_id_lookup(files, good).collect()] == [1]
    mixed = spark.createDataFrame([("\\x" + "a" * 40 + ":1",), ("x:1",)], "id string")
    assert [r["file_id"] for r in FL.composite_id_lookup(files, mixed).collect()] == ["x:1"]


def test_stale_refs_ttl(spark):
    import datetime as dt
    refs = spark.createDataFrame([("t", "s", "1"), ("t", "s", "2"), ("t", "s", "3")], "content_type string, content_source string, content_id string")
    ex = spark.createDataFrame([("t", "s", "1", "success", dt.datetime(2024, 1, 19)),
                                ("t", "s", "2", "not_found", dt.datetime(2024, 1, 17))],
                               "content_type string, content_source string, content_id string, status string, updated_at timestamp")
    keys = [(c, c) for c in ("content_type", "content_source", "content_id")]
    got = sorted(r["content_id"] for r in J.stale_refs(refs, ex, keys, "2024-01-20 00:00:00", 48, 24).collect())
    assert got == ["2", "3"]
    always = sorted(r["content_id"] for r in J.stale_refs(refs, ex, keys, "2024-01-20 00:00:00", 0, 0).collect())
    assert always == ["1", "2", "3"]


def test_dedupe_keeps_exactly_one_per_key(spark):
    df = spark.createDataFrame([(1, "s", str(i), f"h{i % 3}", i) for i in range(12)],
                               "query_id int, source string, pg_id string, text_hash string, rank int")
    out = R.dedupe_hits_by_hash(df).collect()
    assert sorted(r["text_hash"] for r in out) == ["h0", "h1", "h2"]
    assert sorted(r["rank"] for r in out) == [0, 1, 2]


def test_pages_concatenate_to_the_full_list(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(23)], "g int, v int")
    pages = [R.page(df, "g", ["v"], off, 5).collect() for off in range(0, 25, 5)]
    got = sorted((r["g"], r["v"]) for p in pages for r in p)
    assert got == sorted((g, i) for g in range(3) for i in range(23))


def test_global_position_is_a_permutation(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    pos = R.global_position(df, ["v"]).collect()
    assert sorted(r["position"] for r in pos) == list(range(1, 1001))
    assert all(r["position"] == r["v"] + 1 for r in pos)


def test_exact_median_matches_python(spark):
    import statistics
    vals = [float((i * 37) % 101) for i in range(1001)] + [5.5]
    df = spark.createDataFrame([("g", v) for v in vals], "k string, v double")
    got = exact_median(df, "k", "v", accuracy=100, margin=5).collect()[0]["median"]
    assert got == statistics.median(vals)


def test_contains_join_equals_brute_force(spark):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(
        ["The Matrix", "matrix reloaded", "ab", "a", "Zed%", "x_y", None, "Ünïcode Straße"])], "k string, t string")
    queries = spark.createDataFrame([(1, "matrix"), (2, "a"), (3, "ab"), (4, "%"), (5, "x_y"), (6, "STRASSE"),
                                     (7, "ünï"), (8, "m%x")], "qid int, q string")
    got = sorted((r["qid"], r["k"]) for r in contains_join(queries, "qid", "q", rows, "k", ["t"]).collect())
    brute = sorted((r["qid"], r["k"]) for r in queries.crossJoin(rows).where(
        F.ilike(F.col("t"), F.concat(F.lit("%"), F.col("q"), F.lit("%")))).collect())
    assert got == brute


def test_incomplete_snapshot_version_is_never_read(spark):
    import os
    from catalux.session import shared_path
    root = shared_path(spark, "snap-test")
    df1 = spark.createDataFrame([(1, "a")], "k int, v string")
    U.write_snapshot(df1, root)
    # a writer that died mid-job leaves a newer folder without the commit marker
    os.makedirs(f"{root}/v999999999999999", exist_ok=True)
    open(f"{root}/v999999999999999/part-0.parquet", "w").write("garbage")
    assert [tuple(r) for r in U.read_snapshot(spark, root).collect()] == [(1, "a")]
    df2 = spark.createDataFrame([(2, "b")], "k int, v string")
    U.write_snapshot(df2, root)
    assert [tuple(r) for r in U.read_snapshot(spark, root).collect()] == [(2, "b")]


def test_paging_uses_partial_group_limit(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), "id")
    plan = R.page(df, "g", ["id"], 20, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
