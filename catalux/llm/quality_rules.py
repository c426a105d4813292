"""Quality rules (operator 3): a short-circuit cascade, in Spark SQL expressions only.

Each ``Rule`` says which documents it rejects.  ``measured`` runs every rule over a bounded sample, in one job that
reads the clock before and after each rule of each row, and notes its seconds a row and the share it rejects;
``ordered`` sorts by rejection per cost; ``first_failure`` is one lazily evaluated CASE in that order, so a document
stops at the first rule that rejects it.  The words of a text are cut once, before the first rule.  The order changes the
work only: which documents are kept does not depend on it.

Defined results: null, empty and blank texts have no words (all counts 0) and fail ``few_words``;
repeated rows are judged alike; only ``doc_id`` and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalux.llm.sqltext import let, shingles, words
from catalux.llm.tables import pick, written

SAMPLE_ROWS = 2_000
WINDOW = 5


def n_repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that are found twice or more in the text, first ones included."""
    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(by_hash, lambda s: F.sort_array(F.filter(F.transform(
            s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull())))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x)),
            F.lit(0).cast("long"), lambda a, x: a + x))

    return let(shingles(w, WINDOW), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")


def expressions(text: Column, w: Column) -> dict[str, Column]:
    """Every statistic as an expression of the text (not null) and its words."""
    return {
        "text": text,
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(w),
    }


def with_words(text: Column, body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of the statistics' expressions, with the words of the text cut once."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return let(F.struct(text.alias("t"), words(text).alias("w")), lambda x: body(expressions(x["t"], x["w"])))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base statistics of every row."""
    d = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    w = F.col("words")
    e = expressions(F.col("text"), w)
    return d.withColumn("words", words(F.col("text"))).select(
        "doc_id", "text", F.size(w).cast("long").alias("n_words"), e["word_chars"].alias("word_chars"),
        e["n_symbols"].alias("n_symbols"), e["n_dup_lines"].alias("n_dup_lines"),
        n_repeat_words(w).alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the statistics (by name) to a boolean Column."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda s: s["n_words"] < 10),
    Rule("repeated_words", lambda s: 100 * s["n_repeat_words"] > 20 * s["n_words"]),
)
MORE_RULES = (
    Rule("symbols", lambda s: 100 * s["n_symbols"] > 20 * s["n_words"]),
    Rule("repeated_lines", lambda s: 100 * s["n_dup_lines"] > 50 * n_lines(s["text"])),
    Rule("long_words", lambda s: s["word_chars"] > 16 * s["n_words"]),
    Rule("short_words", lambda s: s["word_chars"] < 2 * s["n_words"]),
    Rule("shouting", lambda s: 2 * F.regexp_count(s["text"], F.lit("[A-Z]"))
         > F.regexp_count(s["text"], F.lit("[A-Za-z]"))),
    Rule("exclaiming", lambda s: 100 * F.regexp_count(s["text"], F.lit("!!")) > 20 * s["n_words"]),
    Rule("digits", lambda s: 100 * F.regexp_count(s["text"], F.lit("[0-9]")) > 40 * s["word_chars"]),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds_per_row: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds_per_row, 1e-9)


def clock() -> Column:
    """Nanoseconds of the executor's clock when the row is evaluated."""
    return F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def measured(texts: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and selectivity of each rule on about ``sample_rows`` rows of the one column of ``texts``, whatever rows repeat."""
    share = sample_rows / max(texts.count(), sample_rows)
    # the first rows of a task run before the compiler has met them: once for warmth, once for the clock
    sample = written(texts.toDF("text").where(F.rand(7) < share), "rules-sample").select("text", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass"))

    def timed(stats: Mapping[str, Column]) -> Column:
        return F.struct(clock().alias("t0"), *[x for k, rule in enumerate(rules, 1) for x in (
            F.coalesce(rule.rejects(stats), F.lit(False)).alias(f"r{k}"), clock().alias(f"t{k}"))])

    each = sample.select("pass", with_words(F.col("text"), timed).alias("x")).where("pass = 1")
    figures = each.agg(F.count(F.lit(1)).alias("n"), *[c for k in range(1, len(rules) + 1) for c in (
        F.sum(F.col(f"x.t{k}") - F.col(f"x.t{k - 1}")).alias(f"s{k}"), F.count_if(F.col(f"x.r{k}")).alias(f"r{k}"))]).first()
    n = max(figures["n"], 1)
    return [Measured(rule, (figures[f"s{k}"] or 0) / 1e9 / n, figures[f"r{k}"] / n) for k, rule in enumerate(rules, 1)]


def ordered(figures: Sequence[Measured]) -> list[Rule]:
    """Most rejection per cost first; equal worth: cheapest first."""
    return [m.rule for m in sorted(figures, key=lambda m: (-m.worth, m.seconds_per_row, m.rule.name))]


def first_failure(stats: Mapping[str, Column], rules: Sequence[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects the document; null if all pass."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(stats), F.lit(rule.name)).otherwise(out)
    return out


def judged(docs: DataFrame) -> DataFrame:
    """Base statistics, ``base_failed`` and ``kept`` of every document."""
    columns = ("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = ordered(measured(pick(docs, text="string"), MORE_RULES))
    d = with_statistics(docs)
    stats = {c: F.col(c) for c in columns}
    base = BASE_RULES[0].rejects(stats) | BASE_RULES[1].rejects(stats)
    return (d.withColumn("base_failed", base)
            .withColumn("kept", F.when(F.col("base_failed"), F.lit(False))
                        .otherwise(first_failure(stats, order).isNull()))
            .select("doc_id", *columns[1:], "base_failed", "kept"))


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns unchanged; rules run in measured order."""
    rules = ordered(measured(docs.select(docs[text].cast("string")), (*BASE_RULES, *MORE_RULES)))
    return docs.where(with_words(docs[text], lambda stats: first_failure(stats, rules)).isNull())
