"""Bucketed tables with one commit, streams over them, and the polled table source."""

from __future__ import annotations

import os
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalux.operators import upsert as U
from catalux.operators.store import Conflict, Store
from catalux.plans.sync import SyncParams
from catalux.session import shared_path
from catalux.sources.poll import PolledTable, polled_stream
from catalux.spec import SourceSpec
from catalux.streaming import incremental as INC

SPEC = SourceSpec("items", "id", "text", updated_at_field="updated_at", extra_fields=("title",))
PARAMS = SyncParams(now="2024-01-20 00:00:00", dim=8)
RAW = "id long, text string, title string, updated_at timestamp"


def raw(spark, ids, text="text"):
    return spark.createDataFrame([(i, f"{text} {i}") for i in ids], "id long, text string").select(
        "id", "text", F.col("text").alias("title"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("updated_at"))


def as_rows(batch):
    return batch.withColumn("pg_id", F.col("id").cast("string"))


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path.replace("file://", "")) for f in names if f.endswith(".parquet")}


def content(df):
    return sorted(map(tuple, df.collect()))


def kv(spark, ids, v):
    return spark.createDataFrame([(str(i), v) for i in ids], "k string, v string")


def test_a_small_batch_rewrites_only_its_buckets(spark):
    root = shared_path(spark, "store")
    s = Store(spark, root, {"t": ["k"]}, buckets=16)
    assert s.read("t") is None and s.touched("t", kv(spark, range(500), "a")) == list(range(16))
    s.commit({"t": (kv(spark, range(500), "a"), range(16))})
    before = files_of(root)
    batch = kv(spark, range(495, 505), "b")
    own = s.touched("t", batch)
    assert 0 < len(own) <= 10
    s.commit({"t": (U.upsert(s.read("t", own), batch, ["k"]), own)})
    added = files_of(root) - before
    assert len(added) == len(own) and before <= files_of(root)
    assert content(s.read("t")) == sorted([(str(i), "a") for i in range(495)] + [(str(i), "b") for i in range(495, 505)])
    assert Store(spark, root, {"t": ["k"]}, buckets=99).buckets == 16        # fixed when the store was made


def test_all_tables_change_in_one_commit_and_writers_conflict(spark, monkeypatch):
    s = Store(spark, shared_path(spark, "store"), {"a": ["k"], "b": ["k"]}, buckets=4)
    one = kv(spark, range(8), "1")
    s.commit({"a": (one, range(4)), "b": (one, range(4))}, "st", 0)
    real = s._write

    def dies_on_b(name, *rest):
        if name == "b":
            raise OSError("lost")
        return real(name, *rest)

    monkeypatch.setattr(s, "_write", dies_on_b)
    two = kv(spark, range(8), "2")
    with pytest.raises(OSError):
        s.commit({"a": (two, range(4)), "b": (two, range(4))}, "st", 1)
    monkeypatch.undo()
    assert content(s.read("a")) == content(s.read("b")) == content(one) and s.epoch("st") == 0
    other = Store(spark, s.root, s.keys)
    monkeypatch.setattr(other, "manifest", lambda n=None, old=s.manifest(): old)
    s.commit({"a": (two, range(4)), "b": (two, range(4))}, "st", 1)
    with pytest.raises(Conflict):
        other.commit({"a": (one, range(4))})
    assert content(s.read("a")) == content(s.read("b")) == content(two) and s.epoch("st") == 1


def test_replaced_buckets_go_after_some_commits(spark):
    root = shared_path(spark, "store")
    s = Store(spark, root, {"t": ["k"]}, buckets=1, retain=2)
    for v in "abcde":
        s.commit({"t": (kv(spark, range(3), v), [0])})
        assert content(s.read("t")) == content(kv(spark, range(3), v))
    assert len(files_of(root)) == 2 and s._commits() == [4, 5]


def test_sync_crash_between_the_writes_and_replay(spark, monkeypatch):
    land, root = shared_path(spark, "land"), shared_path(spark, "sync")
    raw(spark, range(20)).coalesce(1).write.parquet(land)
    schema = T._parse_datatype_string(RAW)
    publish = Store._publish

    def dies(self, manifest):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(Store, "_publish", dies)
    with pytest.raises(Exception, match="driver lost"):
        INC.incremental_sync(spark, land, schema, as_rows, SPEC, PARAMS, root, buckets=8)
    monkeypatch.setattr(Store, "_publish", publish)
    store = INC.sync_store(spark, root, 8)
    assert store.read("points") is None and store.read("state") is None
    out = INC.incremental_sync(spark, land, schema, as_rows, SPEC, PARAMS, root, buckets=8)
    assert out["store"].read("points").count() == out["store"].read("state").count() == 20
    # a commit that the stream did not note is not applied again
    assert spark.read.parquet(out["runs"]).count() == 1
    first = out["store"].manifest()["commit"]
    raw(spark, [3, 50], "new").coalesce(1).write.mode("append").parquet(land)
    before = files_of(store.root)
    INC.incremental_sync(spark, land, schema, as_rows, SPEC, PARAMS, root, buckets=8)
    assert store.manifest()["commit"] == first + 1
    assert len(files_of(store.root) - before) <= 4                # at most two buckets in each of two tables
    state = {r["pg_id"]: r["text_hash"] for r in store.read("state").collect()}
    assert len(state) == 21 and len(set(state.values())) == 21


def test_a_batch_that_was_committed_is_skipped(spark):
    land, root = shared_path(spark, "land"), shared_path(spark, "sync")
    raw(spark, range(5)).coalesce(1).write.parquet(land)
    schema = T._parse_datatype_string(RAW)
    seen = []

    def rows(batch):
        seen.append(batch.count())
        return as_rows(batch)

    out = INC.incremental_sync(spark, land, schema, rows, SPEC, PARAMS, root, buckets=4)
    (me,) = out["store"].manifest()["epochs"]
    assert me == str(out["query"].id) and out["store"].epoch(me) == 0 and seen == [5]


def test_failed_refs_wait_for_the_next_run_also_after_a_restart(spark):
    land, root = shared_path(spark, "refs"), shared_path(spark, "loop")
    schema = T._parse_datatype_string("content_id string")
    empty = spark.createDataFrame([], "content_id string, status string")
    calls: list = []

    def job(refs, table):
        ids = sorted(r["content_id"] for r in refs.collect())
        calls.append(ids)
        return U.upsert(table, spark.createDataFrame([(i, "error" if i == "bad" else "success") for i in ids],
                                                     "content_id string, status string"), ["content_id"])

    def add(*ids):
        spark.createDataFrame([(i,) for i in ids], schema).coalesce(1).write.mode("append").parquet(land)

    def go(run, force=False):
        return INC.enrichment_loop(spark, land, schema, job, ["content_id"], root, empty, run, force=force, buckets=4)["store"]

    add("bad", "fine")
    go("monday")
    add("bad", "other")            # a restart within the run
    go("monday")
    add("bad", "fine")
    go("tuesday")
    add("bad")
    store = go("tuesday", force=True)
    assert calls == [["bad", "fine"], ["other"], ["bad", "fine"], ["bad"]]
    assert {r["content_id"]: r["status"] for r in store.read("table").collect()} == {"bad": "error", "fine": "success", "other": "success"}


def test_status_is_a_streaming_aggregation(spark):
    land, root = shared_path(spark, "landed"), shared_path(spark, "status")
    schema = T._parse_datatype_string("source string, pg_id string, updated_at timestamp, last_error string")

    def add(rows):
        spark.createDataFrame([(s, p, None, e) for s, p, e in rows], schema).withColumn(
            "updated_at", F.to_timestamp(F.concat(F.lit("2024-01-0"), F.col("pg_id")))).coalesce(1).write.mode("append").parquet(land)

    def refresh():
        out = INC.status_snapshot(spark, land, schema, lambda counts: counts, root, trigger="availableNow")
        return {r["source"]: (r["synced_rows"], r["last_sync_updated_at"].day, r["errors"], r["epoch"])
                for r in U.read_snapshot(spark, out["status"]).collect()}

    add([("a", "1", None), ("a", "2", "x"), ("b", "3", None)])
    assert refresh() == {"a": (2, 2, 1, 0), "b": (1, 3, 0, 0)}
    add([("a", "4", None)])
    assert refresh() == {"a": (3, 4, 1, 1), "b": (1, 3, 0, 1)}


def test_a_table_is_polled_by_key(spark, tmp_path):
    file = str(tmp_path / "items.db")

    def run(sql, rows=()):
        con = sqlite3.connect(file)
        con.executemany(sql, rows) if rows else con.execute(sql)
        con.commit()
        con.close()

    run("CREATE TABLE items (id INTEGER, text TEXT, title TEXT, updated_at TEXT)")
    run("INSERT INTO items VALUES (?, ?, ?, ?)", [(i, f"text {i}", "t", f"2024-01-01 00:00:{i // 5:02d}") for i in range(100)])
    run("INSERT INTO items VALUES (?, ?, ?, ?)", [(900, "never", "t", None)])
    table = PolledTable(lambda: sqlite3.connect(file), "items", "id", "updated_at", ("id", "text", "title", "updated_at"))
    schema = T._parse_datatype_string("id long, text string, title string, updated_at string")
    cuts = table.cuts(None, table.last(), 4)
    assert len(cuts) == 3 and cuts == sorted(cuts) and table.last("2024-01-01 00:00:07") == ("2024-01-01 00:00:07", 39)
    root, batches = shared_path(spark, "polled"), []

    def rows(batch):
        out = as_rows(batch.withColumn("updated_at", F.to_timestamp("updated_at")))
        batches.append(out.count())
        return out

    def poll():
        return INC.incremental_sync(spark, polled_stream(spark, table, schema, slices=4), None, rows, SPEC, PARAMS, root, buckets=4)["store"]

    assert poll().read("state").count() == 100
    run("INSERT INTO items VALUES (?, ?, ?, ?)", [(200, "late", "t", "2024-01-01 00:00:19"), (201, "late too", "t", "2024-02-01 00:00:00")])
    run("UPDATE items SET text = 'changed', updated_at = '2024-02-01 00:00:00' WHERE id = 7")
    store = poll()
    state = {r["pg_id"]: r["text_hash"] for r in store.read("state").collect()}
    assert len(state) == 102 and state["7"] != state["8"]
    poll()
    assert [b for b in batches if b] == [100, 3]
