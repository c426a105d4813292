"""Query understanding as Column expressions.

A "request" is a row of a query table; these functions derive filter and
rewrite columns for every row at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.functions import fixed
from catalux.functions.text import col_, detect_languages, normalize_title, strip_ws


def query_genres(q, table: dict = fixed.QUERY_GENRES) -> Column:
    """Local + English genre tags for every genre word in the query, table order."""
    qc = F.coalesce(col_(q), F.lit(""))
    parts = [F.when(F.instr(qc, k) > 0, F.array(*[F.lit(v) for v in vs])).otherwise(F.array().cast("array<string>"))
             for k, vs in table.items()]
    return F.array_distinct(F.flatten(F.array(*parts)))


def query_filters(q, file_types=fixed.QUERY_FILE_TYPES) -> dict[str, Column]:
    """Strip the first file-type phrase, then derive type, languages and genres.

    Returns columns: cleaned (falls back to the original), file_type,
    audio_langs, subtitle_langs, genres.
    """
    qc = F.coalesce(col_(q), F.lit(""))
    ftype = None
    raw = None
    for phrase, kind in file_types:
        hit = F.instr(qc, phrase) > 0
        ftype = F.when(hit, F.lit(kind)) if ftype is None else ftype.when(hit, F.lit(kind))
        raw = F.when(hit, F.replace(qc, F.lit(phrase), F.lit(""))) if raw is None else raw.when(
            hit, F.replace(qc, F.lit(phrase), F.lit("")))
    raw = raw.otherwise(qc)
    audio, subs = detect_languages(raw)
    cleaned = strip_ws(raw)
    return {
        "cleaned": F.when(cleaned != "", cleaned).otherwise(qc),
        "file_type": ftype,
        "audio_langs": audio,
        "subtitle_langs": subs,
        "genres": query_genres(raw),
    }


def is_ascii(c) -> Column:
    return col_(c).rlike("^[\\x00-\\x7F]*$")


def synonyms(q, table: dict = fixed.QUERY_SYNONYMS) -> Column:
    qc = F.coalesce(col_(q), F.lit(""))
    parts = [F.when(F.instr(qc, k) > 0, F.array(*[F.lit(v) for v in vs])).otherwise(F.array().cast("array<string>"))
             for k, vs in table.items()]
    return F.flatten(F.array(*parts))


def ranked_expansion_terms(queries: DataFrame, terms: DataFrame, qid: str = "query_id", q: str = "q",
                           max_terms: int = 8) -> DataFrame:
    """Top ``max_terms`` expansion terms per query: ASCII first, then weight, then term.

    Terms shorter than 2 or equal (case-insensitively) to the query are skipped
    and do not count.  ``terms`` has (query_id, term, weight).
    """
    t = (terms.join(queries.select(qid, q), qid)
         .where((F.length("term") >= 2) & (F.lower("term") != F.lower(F.col(q)))))
    w = Window.partitionBy(qid).orderBy(F.when(is_ascii("term"), 0).otherwise(1), F.desc("weight"), F.asc("term"))
    return t.withColumn("term_rank", F.row_number().over(w)).where(F.col("term_rank") <= max_terms)


def expand_query(queries: DataFrame, terms: DataFrame | None, qid: str = "query_id", q: str = "q",
                 max_terms: int = 8, out: str = "expanded") -> DataFrame:
    """Query + built-in synonyms + ranked expansion terms, deduped, space-joined."""
    if terms is None:
        tokens = F.concat(F.array(F.col(q)), synonyms(q))
        return queries.withColumn(out, F.when(F.coalesce(F.col(q), F.lit("")) == "", F.col(q)).otherwise(
            F.array_join(F.array_distinct(tokens), " ")))
    else:
        ranked = ranked_expansion_terms(queries, terms, qid, q, max_terms)
        extra = (ranked.groupBy(qid)
                 .agg(F.sort_array(F.collect_list(F.struct("term_rank", "term"))).alias("_t"))
                 .select(qid, F.transform("_t", lambda s: s["term"]).alias("extra")))
    tokens = F.concat(F.array(F.col(q)), synonyms(q), F.coalesce(F.col("extra"), F.array().cast("array<string>")))
    expanded = F.when(F.coalesce(F.col(q), F.lit("")) == "", F.col(q)).otherwise(
        F.array_join(F.array_distinct(tokens), " "))
    return queries.join(extra, qid, "left").withColumn(out, expanded).drop("extra")


def english_candidates(terms: DataFrame) -> DataFrame:
    """Candidate English titles of X11 from (query_id, term, weight) rows."""
    t = F.col("term")
    head = strip_ws(F.substring_index(t, ":", 1))
    cand = (F.when(F.instr(t, ":") > 0, F.when(F.length(head) >= 5, head))
            .otherwise(F.when(F.substring(t, 1, 1).rlike("^[A-Z]$"), t)))
    return (terms.where(is_ascii(t) & (F.length(t) >= 5) & (F.instr(t, " ") > 0))
            .select("query_id", cand.alias("cand"), "weight")
            .where(F.col("cand").isNotNull() & (F.col("cand") != "")))


def english_expansion(terms: DataFrame, max_terms: int = 3, qid: str = "query_id") -> DataFrame:
    """X11: per query, the longest (then heaviest) distinct English titles, top ``max_terms`` joined."""
    c = english_candidates(terms).groupBy(qid, "cand").agg(F.max("weight").alias("weight"))
    w = Window.partitionBy(qid).orderBy(F.desc(F.length("cand")), F.desc("weight"), F.asc("cand"))
    top = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_terms)
    return (top.groupBy(qid)
            .agg(F.sort_array(F.collect_list(F.struct("r", "cand"))).alias("_c"))
            .select(qid, F.array_join(F.transform("_c", lambda s: s["cand"]), " ").alias("english")))


def query_tokens(q):
    """First ASCII letter/digit run and first non-ASCII run (NULL when absent)."""
    qc = F.coalesce(col_(q), F.lit(""))
    a = F.regexp_extract(qc, "([a-zA-Z0-9]+)", 1)
    n = F.regexp_extract(qc, "([^\\x00-\\x7F]+)", 1)
    return F.nullif(a, F.lit("")), F.nullif(n, F.lit(""))


def embed_query_text(expanded, prefix: str = "") -> Column:
    """Prefix + normalised query (else the expanded text itself)."""
    e = col_(expanded)
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(normalize_title(e), F.lit("")), e))
