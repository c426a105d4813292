"""Plans that must hold on large tables: nothing heavy where a small file's few splits are read, no payload broadcast."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalux.functions import match as M

DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _below_spread(plan: str) -> str:
    """The lines between a scan of a base table and the shuffle that deals its rows."""
    out, lines = [], plan.split("\n")
    for i, line in enumerate(lines):
        if "REPARTITION_BY_NUM" in line:
            depth = re.search(r"[A-Z]", line).start()
            for below in lines[i + 1:]:
                if not re.search(r"[A-Z]", below) or re.search(r"[A-Z]", below).start() <= depth:
                    break
                out.append(below)
    return "\n".join(out)


@pytest.mark.parametrize("name", ["content_view", "item_detail"])
def test_payloads_are_not_broadcast(spark, name):
    """a file of some MB makes payloads of GBs; its size must not decide for a broadcast."""
    plan = _plan(entry.queries()[name](spark, DIR))
    for block in plan.split("BroadcastExchange")[1:]:
        first = block.split("\n", 2)[1]
        assert "concat({" not in first and "film_json" not in first and "scene_json" not in first


@pytest.mark.parametrize("name", ["keyword_search_payload", "page_payload", "search_payload_nodes", "node_has_external_id"])
def test_payloads_are_parsed_after_the_rows_are_dealt(spark, name):
    """parsing happens behind the shuffle of the narrow rows, and once a payload."""
    plan = _plan(entry.queries()[name](spark, DIR))
    assert "REPARTITION_BY_NUM" in plan
    assert "parseJson" not in _below_spread(plan)
    above = plan.split("Generate explode")[0]
    assert "parseJson" not in above


def test_json_shapes(spark):
    """Type tests that do not build a value's schema agree with the schema."""
    vals = ["{}", '{"a":1}', "[]", '[1,{"a":2}]', "[[1],null]", '"x"', '""', "null", "0", "-0.0", "0.5", "true", "false", None,
            "nope", '{"a":null}', "12345678901234567890123", '"2020-01-01"', '{"":1}', "[{}]"]
    v = F.try_parse_json("j")
    t = F.schema_of_variant(v)
    rows = spark.createDataFrame([(x,) for x in vals], "j string").select(
        M.is_obj(v).alias("o"), F.coalesce(t.startswith("OBJECT<"), F.lit(False)).alias("o2"),
        M.is_list(v).alias("l"), F.coalesce(t.startswith("ARRAY<"), F.lit(False)).alias("l2"),
        M.is_str(v).alias("s"), F.coalesce(t == "STRING", F.lit(False)).alias("s2"), M.truthy(v).alias("t")).collect()
    assert all((r.o, r.l, r.s) == (r.o2, r.l2, r.s2) for r in rows)
    truth = [False, True, False, True, True, True, False, False, False, False, True, True, False, False, False, True, True, True, True, True]
    assert [r.t for r in rows] == truth


def test_long_patterns_meet_few_rows(spark):
    """Rows that hold every 3-gram of a long pattern, but not the pattern, are no candidates."""
    from catalux.operators.textjoin import SIZES, candidates, contains_join
    text = "abcdefghijklmnop"
    apart = " ".join(text[i:i + 3] for i in range(len(text) - 2))
    rows = spark.createDataFrame([(str(i), apart) for i in range(50)] + [("x", f"-{text}-")], "k string, t string")
    qs = spark.createDataFrame([(1, text), (2, text), (3, "a"), (4, None)], "query_id int, q string")
    met = candidates(qs.where("query_id = 1").selectExpr("query_id", "q AS _lit", "'' AS _lit2"), "query_id", rows, "k", ["t"], None, SIZES)
    assert [r["_rk"] for r in met.collect()] == ["x"]
    out = contains_join(qs, "query_id", "q", rows, "k", ["t"], limit_per_query=2, order=[F.desc("k")])
    assert sorted((r.query_id, r.k) for r in out.collect()) == [(1, "x"), (2, "x"), (3, "9"), (3, "x")]


def test_both_tokens_narrow_the_candidates(spark):
    """The second token of a query is looked up too, not only asked of the rows that hold the first."""
    from catalux.operators.textjoin import contains_join
    rows = spark.createDataFrame([(str(i), f"part {i} end") for i in range(50)], "k string, t string")
    qs = spark.createDataFrame([(1, "part", "17 end")], "query_id int, a string, b string")
    out = contains_join(qs, "query_id", "a", rows, "k", ["t"], extra_pred=F.col("t").contains(F.col("b")), also="b")
    assert [r.k for r in out.collect()] == ["17"]
    assert "_lit2" not in out.columns


def test_texts_are_folded_once(spark):
    """A text is lower-cased once a list and cleaned once, however many words are looked for."""
    from catalux.functions.text import detect_languages
    df = spark.createDataFrame([("English subtitle",), ("中文 english",), (None,)], "text string")
    audio, subs = detect_languages("text")
    out = df.select(audio.alias("a"), subs.alias("s"))
    assert _plan(out).count("lower(") <= 2
    assert [(r.a, r.s) for r in out.collect()] == [([], ["en"]), (["zh", "en"], ["zh", "en"]), ([], [])]
    assert _plan(df.select(M.embed_text("text", [], F.lit("m")).alias("e"))).count("truehd") == 1


def _recorded(monkeypatch, module) -> dict:
    frames, real = {}, module.stored

    def keep(df, name):
        frames[name] = real(df, name)
        return frames[name]

    monkeypatch.setattr(module, "stored", keep)
    return frames


@pytest.mark.parametrize("few", [100_000, 0])
def test_a_query_with_a_missing_gram_looks_nothing_up(spark, monkeypatch, few):
    """The common gram of a pair such as (r, É) would fetch every row, for each such query."""
    from catalux.operators import textjoin as J
    monkeypatch.setattr(J, "FEW", few)
    frames = _recorded(monkeypatch, J)
    texts = [f"part {i} r" for i in range(40)] + ["xyz part r", None]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, t string")
    qs = spark.createDataFrame([(1, "r", "É"), (2, "r", "xyz"), (3, "PART", "17"), (4, "a%r", "_")], "query_id int, a string, b string")
    out = J.contains_join(qs, "query_id", "a", rows, "k", ["t"], extra_pred=F.ilike("t", F.concat(F.lit("%"), "b", F.lit("%"))), also="b")
    got = sorted((r.query_id, r.k) for r in out.collect())
    assert got == sorted([(2, "40"), (3, "17")] + [(4, str(i)) for i in range(41)])
    grams = {r.gram for r in frames["picked-grams"].collect()}
    # neither for (r, É) nor, where the other gram is rare, for (r, xyz): r is in all rows
    assert "xyz" in grams and not grams & {"r", "é"}


@pytest.mark.parametrize("few", [100_000, 0])
def test_postings_are_made_once_by_all_tasks(spark, monkeypatch, few):
    """Few narrow files are few tasks, and a row makes some hundred grams; what nobody asks for is not shuffled."""
    from catalux.operators import textjoin as J
    monkeypatch.setattr(J, "FEW", few)
    plans, real = {}, J.stored

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString() if name == "postings" else ""
        return real(df, name)

    monkeypatch.setattr(J, "stored", keep)
    rows = spark.range(300).select(F.col("id").cast("string").alias("k"), F.sha1(F.col("id").cast("string")).alias("t")).coalesce(1)
    qs = rows.where("k % 50 = 0").select(F.col("k").alias("q_id"), F.substring("t", 5, 20).alias("q"))
    out = J.contains_join(qs, "q_id", "q", rows, "k", ["t"])
    assert sorted((r.q_id, r.k) for r in out.collect()) == sorted((str(i), str(i)) for i in range(0, 300, 50))
    made = plans["postings"]
    assert "RepartitionByExpression" in made and ("bit_or" in made) == (few == 0)
    assert "array_distinct" not in _plan(out)         # read back, not made again


def test_expansion_reads_no_text_more_than_once(spark):
    """The rows of the three joins are made once; terms take one pass over the candidates."""
    for name in ("english_expansion", "expansion_candidates"):
        plan = _plan(entry.queries()[name](spark, DIR))
        assert "documents.parquet" not in plan and "events.parquet" not in plan


def test_sync_state_upsert_reads_texts_once(spark):
    """the new state is read for its keys and for its rows, the old one for both sides; neither is made twice."""
    plan = _plan(entry.queries()["sync_state_upsert"](spark, DIR))
    assert "documents.parquet" not in plan and "text:string" not in plan


def test_enrichment_loop_makes_titles_and_payloads_once(spark, monkeypatch):
    """F16: a micro-batch of the loop neither reads the texts behind its titles again nor makes a payload more than once."""
    from catalux.plans import enrichment as EN
    plans, real = [], EN.scene_enrichment_job

    def job(refs, table, payloads, *args):
        plans.append(_plan(refs) + _plan(payloads))
        return real(refs, table, payloads, *args)

    monkeypatch.setattr(EN, "scene_enrichment_job", job)
    assert entry.queries()["enrichment_loop"](spark, DIR).count() == 200
    assert plans
    assert not any(x in p for p in plans for x in ("documents.parquet", "events.parquet", "part.parquet", "concat({"))
