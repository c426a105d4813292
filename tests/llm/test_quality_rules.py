from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from catalux.llm import quality_rules as Q
from tests.llm.conftest import rows_of


def brute(t: str | None) -> dict:
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
           "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    out["base_failed"] = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    upper, letters = len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t))
    out["kept"] = not (out["base_failed"] or 100 * out["n_symbols"] > 20 * len(w)
                       or 100 * out["n_dup_lines"] > 50 * len(lines) or out["word_chars"] > 16 * len(w)
                       or out["word_chars"] < 2 * len(w) or 2 * upper > letters
                       or 100 * t.count("!!") > 20 * len(w)
                       or 100 * len(re.findall("[0-9]", t)) > 40 * out["word_chars"])
    return out


def test_statistics_and_verdict(docs):
    by_id = rows_of(docs)
    got = {r["doc_id"]: r.asDict() for r in Q.judged(docs).collect()}
    assert set(got) == set(by_id)
    for i, t in by_id.items():
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, t


def test_order_is_by_rejection_per_cost_and_does_not_change_the_verdict(docs):
    a, b, c = (Q.Measured(Q.Rule(n, None), s, r) for n, s, r in (("a", 1.0, 0.5), ("b", 0.1, 0.1), ("c", 0.1, 0.0)))
    assert [r.name for r in Q.ordered([c, a, b])] == ["b", "a", "c"]
    rules = (*Q.BASE_RULES, *Q.MORE_RULES)

    def verdict(order):
        return lambda s: Q.first_failure(s, order)

    ways = [docs.where(Q.with_words(F.col("text"), verdict(order)).isNull()).select("doc_id") for order in (rules, rules[::-1])]
    assert sorted(ways[0].collect()) == sorted(ways[1].collect()) == sorted(Q.keep_clean(docs).select("doc_id").collect())
    assert Q.keep_clean(docs).columns == docs.columns


def test_costs_are_measured_rule_by_rule(spark):
    """A dear rule that rejects more goes behind a cheap one, in every run."""
    texts = spark.range(3_000).select(F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    dear = Q.Rule("dear", lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(3_000)), F.lit(0), lambda a, x: a + x % 7)
                  + F.length(s["text"]) % 10 < 100_000_000)
    cheap = Q.Rule("cheap", lambda s: s["n_words"] * 0 + F.length(s["text"]) % 2 == 0)
    never = Q.Rule("never", lambda s: s["n_words"] < 0)
    for _ in range(3):
        by_name = {m.rule.name: m for m in Q.measured(texts, (dear, never, cheap))}
        assert by_name["dear"].rejected == 1.0 and 0.1 < by_name["cheap"].rejected < 0.95 and by_name["never"].rejected == 0.0
        assert by_name["dear"].seconds_per_row > 10 * by_name["cheap"].seconds_per_row > 0
        assert [r.name for r in Q.ordered(list(by_name.values()))] == ["cheap", "dear", "never"]


def test_the_sample_is_bounded_where_rows_repeat(spark):
    same = spark.range(20_000).select(F.lit("one and the same text").alias("text"))
    seen = Q.measured(same, Q.BASE_RULES[:1], sample_rows=200)
    assert seen[0].rejected == 1.0


def test_empty(empty_docs):
    assert Q.judged(empty_docs).count() == 0 and Q.keep_clean(empty_docs).count() == 0
