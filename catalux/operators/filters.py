"""Filters and predicates (F1-F19) as Column builders and semi/anti joins.

Predicates on plain columns stay plain Column expressions so Catalyst can
push them into the parquet scan; list look-ups are semi joins against a
DataFrame of keys rather than literal IN lists, so they scale with the
list size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalux.functions import fixed
from catalux.functions.text import col_, extract_code, strip_ws

CJK = r"[\x{4e00}-\x{9fff}]"
COMPOSITE_ID = r"^(\\x)?[0-9a-f]{40}:\d+$"


def _and(parts) -> Column:
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _or(parts) -> Column:
    return reduce(lambda a, b: a | b, parts)


def strip_chars(c: Column, chars: str = fixed.KEYWORD_STRIP_CHARS) -> Column:
    """Delete every character of ``chars`` (SQL translate with an empty target)."""
    return F.translate(c, chars, "")


@dataclass(frozen=True)
class TextForm:
    """One way in which a text holds a keyword: ``fold`` of the text contains ``fold`` of the keyword.

    ``asked(keyword, wanted)`` says for which keywords the form is tried (``wanted``: the source's option).
    """

    fold: Callable[[Column], Column]
    asked: Callable[[Column, bool], Column]


AS_WRITTEN = TextForm(F.lower, lambda q, wanted: F.lit(True))
BARE = TextForm(lambda c: F.lower(strip_chars(c)), lambda q, wanted: F.lit(bool(wanted)) | q.rlike(CJK))
TEXT_FORMS = (AS_WRITTEN, BARE)


def like_pattern(q: Column) -> Column:
    """'%q%' for LIKE: '%' and '_' of the query stay wildcards, a backslash stands for itself."""
    return F.concat(F.lit("%"), F.replace(q, F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def keyword_predicate(query: str | Column, columns, normalize: bool = False) -> Column:
    """some column holds the keyword in some text form; '%' and '_' of the keyword are wildcards.

    An empty keyword (also one that a form folds to nothing) is found nowhere.
    """
    q = F.lit(query) if isinstance(query, str) else query
    found = [form.asked(q, normalize) & (form.fold(q) != "") & F.like(form.fold(F.col(c)), like_pattern(form.fold(q)))
             for form in TEXT_FORMS for c in columns]
    return F.coalesce(_or(found), F.lit(False))


def keyword_filter(df: DataFrame, query: str, fields=None, text_field: str = "title",
                   normalize: bool = False, where: str | None = None) -> DataFrame:
    """F1/F2 (+F13): rows whose keyword fields (those that ``df`` has, and always the text field) hold the keyword."""
    columns = dict.fromkeys([*(f for f in fields or () if f in df.columns), text_field])
    return df.where(keyword_predicate(query, columns, normalize) & user_predicate(where))


def id_lookup(df: DataFrame, ids: DataFrame, id_col: str = "pg_id", ids_col: str = "id") -> DataFrame:
    """rows whose text id is in the id table (semi join, no literal IN list)."""
    keys = ids.select(F.col(ids_col).cast("string").alias("_id")).distinct()
    return df.join(keys, df[id_col].cast("string") == keys["_id"], "left_semi")


def parse_composite_ids(ids: DataFrame, ids_col: str = "id") -> DataFrame:
    """Split 'hash:index' ids into (hash_hex, idx); ok=False where the pattern fails."""
    t = F.lower(strip_ws(F.col(ids_col)))
    ok = t.rlike(COMPOSITE_ID)
    h = F.regexp_replace(F.substring_index(t, ":", 1), r"^\\x", "")
    return ids.select(F.col(ids_col), ok.alias("ok"), F.when(ok, h).alias("hash_hex"),
                      F.when(ok, F.substring_index(t, ":", -1).cast("int")).alias("idx"))


def composite_id_lookup(df: DataFrame, ids: DataFrame, hash_col: str = "info_hash", idx_col: str = "idx",
                        id_col: str = "file_id", ids_col: str = "id") -> DataFrame:
    """match parsed (hash, index) pairs; if any id fails to parse, fall back to F3 on ``id_col``.

    The fallback decision is one scalar over the id table (a bounded action);
    both branches are semi joins.
    """
    parsed = parse_composite_ids(ids, ids_col)
    if parsed.where(~F.col("ok")).limit(1).count() > 0:
        return id_lookup(df, ids, id_col, ids_col)
    pairs = parsed.select("hash_hex", "idx").distinct()
    return df.join(pairs, (F.lower(df[hash_col]) == pairs["hash_hex"]) & (df[idx_col] == pairs["idx"]), "left_semi")


def size_min_bytes(size_min_gb: float | None) -> int | None:
    """GB -> bytes as int(gb * 1024**3); None or 0 means no filter (Q7)."""
    if size_min_gb is None:
        return None
    b = int(max(size_min_gb, 0) * (1024 ** 3))
    return b or None


def size_min_filter(size, min_bytes) -> Column:
    """drop missing / non-numeric sizes and sizes below the minimum."""
    return col_(size).try_cast("double") >= F.lit(float(min_bytes))


def has_external_id(c="tmdb_id") -> Column:
    """external id present (non-empty)."""
    return col_(c).isNotNull() & (col_(c).cast("string") != "")


def any_of(arr, values) -> Column:
    """array column shares at least one value with the list."""
    return F.coalesce(F.arrays_overlap(col_(arr), F.array(*[F.lit(v) for v in values])), F.lit(False))


def metadata_filter(has_ext: bool = False, genres=None, file_type: str | None = None, audio_langs=None,
                    subtitle_langs=None, size_min=None, genre_col="genre_tags", file_type_col="file_type",
                    audio_col="audio_langs", subtitle_col="subtitle_langs", size_col="size",
                    ext_col="tmdb_id") -> Column:
    """AND of F5-F10; absent parts are ignored."""
    return _and([
        has_external_id(ext_col) if has_ext else None,
        any_of(genre_col, genres) if genres else None,
        (F.col(file_type_col) == file_type) if file_type else None,
        any_of(audio_col, audio_langs) if audio_langs else None,
        any_of(subtitle_col, subtitle_langs) if subtitle_langs else None,
        size_min_filter(size_col, size_min) if size_min else None,
    ])


def safety_filter(flag="nsfw", exclude: bool = True) -> Column:
    """drop flagged rows when excluding."""
    return ~F.coalesce(col_(flag), F.lit(False)) if exclude else F.lit(True)


def user_predicate(*clauses: str | None) -> Column:
    """SQL predicate texts AND-ed (blank ones skipped)."""
    parts = [F.expr(c) for c in clauses if c and str(c).strip()]
    return _and(parts)


CODE_LOOKAROUND = r"(?i)(?<![A-Z0-9])[A-Z]{2,6}[-_ ]?[0-9]{2,5}(?![A-Z0-9])"


def code_regex_filter(c="title", pattern: str = CODE_LOOKAROUND) -> Column:
    """case-insensitive code pattern with look-around."""
    return col_(c).rlike(pattern)


def missing_enrichment(aka="aka", keywords="keywords") -> Column:
    """aka and keywords both NULL or ''."""
    return (F.coalesce(col_(aka), F.lit("")) == "") & (F.coalesce(col_(keywords), F.lit("")) == "")


def select_sources(specs: DataFrame, explicit: str | None = None, require_field: str | None = None) -> DataFrame:
    """F16: explicit comma list, else sources flagged for keyword search, else all.

    ``specs`` has (name, keyword_search, fields array); with ``require_field``
    sources lacking it are skipped.
    """
    if explicit:
        names = [s.strip() for s in explicit.split(",") if s.strip()]
        chosen = specs.where(F.col("name").isin(names))
    else:
        flagged = specs.where(F.coalesce(F.col("keyword_search"), F.lit(False)))
        chosen = flagged if flagged.limit(1).count() > 0 else specs
    if require_field:
        chosen = chosen.where(F.array_contains("fields", require_field))
    return chosen


def code_prefix(c) -> Column:
    """Upper-cased letters of the first code-like word (NULL when none)."""
    pat = "(?iU)\\b" + fixed.CODE_PATTERN + "\\b"
    letters = F.regexp_extract(F.coalesce(col_(c), F.lit("")), pat, 1)
    return F.when(letters != "", F.upper(letters))


def code_gate(text="text", match_id="tpdb_id", stop=fixed.CODE_STOP_PREFIXES) -> Column:
    """F17 keep-predicate: drop rows that carry a code (prefix not stop-listed) but have no match yet."""
    prefix = code_prefix(text)
    is_code = prefix.isNotNull() & ~prefix.isin(stop)
    has_match = col_(match_id).isNotNull() & (col_(match_id).cast("string") != "")
    return ~is_code | has_match


def supported_type(c="content_type", types=fixed.SUPPORTED_FILM_TYPES) -> Column:
    """reference type is movie / tv_show / tv."""
    return F.coalesce(col_(c).isin(types), F.lit(False))


def ref_complete(type_col="content_type", source_col="content_source", id_col="content_id",
                 require_code: bool = False, title_col: str = "title") -> Column:
    """all three key parts non-empty; optionally a code in the title."""
    parts = [F.coalesce(col_(c).cast("string"), F.lit("")) != "" for c in (type_col, source_col, id_col)]
    if require_code:
        parts.append(extract_code(title_col).isNotNull())
    return _and(parts)
