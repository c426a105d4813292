"""Text, hash and id scalar functions.

All are Column expressions: they run inside whole-stage codegen, no Python
per row.  Regexes are Java patterns; ``(?U)`` makes ``\\b``, ``\\d`` and
``\\s`` Unicode-aware so word borders hold next to CJK letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalux.functions import fixed

# Whitespace as Python's str.isspace() sees it (Unicode White_Space plus the
# four information separators); used wherever the semantics say "strip".
WS_CLASS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"

# Bracket rule as the reference applies it: only the literal runs "[{}]" and
# "\{}]" are replaced (its character class closes early), plus an option to
# strip every bracket character.
BRACKET_RUN = r"[\\\[]\{\}\]"
ANY_BRACKET = r"[\[\]{}()]"
SEPARATORS = r"[._\\\-]+"
NOISE = "(?iU)\\b(" + "|".join(fixed.TITLE_NOISE_WORDS) + ")\\b"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda variable, not a copied subtree).

    Column builders that reference an input many times would otherwise copy
    the input's whole expression tree at every reference.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_ws(c) -> Column:
    """Trim Unicode whitespace on both ends (Spark's trim only drops spaces)."""
    return F.regexp_replace(col_(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def normalize_title(c, strip_brackets: bool = False) -> Column:
    """Drop bracket run, separators to space, noise words out, squeeze spaces."""
    x = F.coalesce(col_(c), F.lit(""))
    x = F.regexp_replace(x, ANY_BRACKET if strip_brackets else BRACKET_RUN, " ")
    x = F.regexp_replace(x, SEPARATORS, " ")
    x = F.regexp_replace(x, NOISE, " ")
    x = F.regexp_replace(x, f"{WS_CLASS}+", " ")
    return F.trim(x)


def text_hash(c) -> Column:
    """sha1 hex of the UTF-8 text."""
    return F.sha1(col_(c).cast("binary"))


def content_md5(c) -> Column:
    """md5 hex of the text."""
    return F.md5(col_(c).cast("binary"))


def file_extension(c) -> Column:
    """Text after the last dot, lower-cased and stripped; '' without a dot."""
    t = col_(c)
    ext = strip_ws(F.lower(F.substring_index(t, ".", -1)))
    return F.when(t.isNull() | (t == "") | (F.instr(t, ".") == 0), F.lit("")).otherwise(ext)


def file_type(ext, table: dict = fixed.FILE_TYPE_EXTENSIONS) -> Column:
    """Extension -> video/audio/image/subtitle/archive/other (first table hit)."""
    e = F.lower(F.coalesce(col_(ext), F.lit("")))
    out = None
    for kind, exts in table.items():
        out = (F.when(e.isin(exts), kind) if out is None else out.when(e.isin(exts), kind))
    return out.otherwise("other")


def _contains_any(lower: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | lower.contains(w.lower())      # bytes; instr counts characters
    return cond


def detect_languages(c, words: dict = fixed.LANGUAGE_WORDS, subtitle_words=fixed.SUBTITLE_WORDS):
    """(audio_langs, subtitle_langs) by substring hits, in table order.

    A subtitle marker sends every hit to subtitles only, otherwise a hit
    counts for both lists.
    """
    def langs(lower: Column) -> Column:
        hits = F.array(*[F.when(_contains_any(lower, ws), F.lit(code)) for code, ws in words.items()])
        return F.filter(hits, lambda x: x.isNotNull())

    def spoken(lower: Column) -> Column:
        return F.when(_contains_any(lower, subtitle_words), F.array().cast("array<string>")).otherwise(langs(lower))

    # lower-cased once a list, not once a word
    lower = F.lower(F.coalesce(col_(c), F.lit("")))
    return let(lower, spoken), let(lower, langs)


def genre_tags(c) -> Column:
    """Split on ',' or full-width comma, strip, drop empties; NULL -> []."""
    parts = F.split(F.replace(F.coalesce(col_(c), F.lit("")), F.lit("，"), F.lit(",")), ",")
    return F.filter(F.transform(parts, strip_ws), lambda x: x != "")


def keyword_score(query, title) -> Column:
    """1.0 equal, 0.1 absent, else max(0.2, 0.9/(1+pos)); 0.0 when either is empty."""
    def score(qt: Column) -> Column:
        q, t = qt["q"], qt["t"]
        pos = F.instr(t, q) - 1
        return (F.when((q == "") | (t == ""), F.lit(0.0))
                .when(q == t, F.lit(1.0))
                .when(pos < 0, F.lit(0.1))
                .otherwise(F.greatest(F.lit(0.2), F.lit(0.9) / (pos + 1).cast("double"))))
    return let(F.struct(F.lower(strip_ws(F.coalesce(col_(query), F.lit("")))).alias("q"),
                        F.lower(strip_ws(F.coalesce(col_(title), F.lit("")))).alias("t")), score)


def normalize_info_hash(c) -> Column:
    """40 hex -> '\\x' + lower; '\\x' + 40 -> lower; anything else unchanged."""
    t = strip_ws(F.coalesce(col_(c), F.lit("")))
    lo = F.lower(t)
    return (F.when(t == "", F.lit(""))
            .when(t.startswith("\\x") & (F.length(t) == 42), lo)
            .when(lo.rlike("^[0-9a-f]{40}$"), F.concat(F.lit("\\x"), lo))
            .otherwise(t))


def bare_info_hash(c) -> Column:
    """Strip '\\x'; 40-64 hex digits lower-cased, else ''."""
    t = strip_ws(F.coalesce(col_(c), F.lit("")))
    h = F.when(t.startswith("\\x"), F.substring(t, 3, 1 << 30)).otherwise(t)
    return F.when(h.rlike("^[0-9a-fA-F]{40,64}$"), F.lower(h)).otherwise(F.lit(""))


def size_coalesce(*cols) -> Column:
    """First value that parses as a positive number, else NULL."""
    vals = [F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double") for c in cols]
    return F.coalesce(*[F.when(v > 0, v) for v in vals])


def extract_code(c) -> Column:
    """First 'LETTERS[-_ ]DIGITS' word as 'LETTERS-DIGITS' (upper-cased), else NULL."""
    pat = "(?iU)\\b" + fixed.CODE_PATTERN + "\\b"
    t = F.coalesce(col_(c), F.lit(""))
    letters = F.regexp_extract(t, pat, 1)
    digits = F.regexp_extract(t, pat, 2)
    return F.when(letters != "", F.concat(F.upper(letters), F.lit("-"), digits))


def point_id(source, pg_id, namespace_hex: str = fixed.UUID_URL_NAMESPACE) -> Column:
    """UUIDv5 of 'source:pg_id' in the URL namespace, as canonical text."""
    name = F.concat(col_(source), F.lit(":"), col_(pg_id))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def safety_score(c, keywords=fixed.SAFETY_KEYWORDS) -> Column:
    """min(0.15*hits, 0.9) + max(0.05, 0.6*(1 - distinct/total tokens)), capped at 1.0."""
    kws = [k.strip().lower() for k in keywords if k.strip()]

    def score(lower: Column) -> Column:
        hits = sum(lower.contains(k).cast("int") for k in kws) if kws else F.lit(0)
        base = F.least(F.lit(0.15) * hits.cast("double"), F.lit(0.9))

        def with_tokens(tokens: Column) -> Column:
            ratio = (F.size(F.array_distinct(tokens)).cast("double")
                     / F.greatest(F.size(tokens), F.lit(1)).cast("double"))
            return F.least(base + F.greatest(F.lit(0.05), F.lit(0.6) * (F.lit(1.0) - ratio)), F.lit(1.0))
        s = let(F.filter(F.split(lower, f"{WS_CLASS}+"), lambda x: x != ""), with_tokens)
        return F.when(lower == "", F.lit(0.05)).otherwise(s)
    return let(F.lower(F.coalesce(col_(c), F.lit(""))), score)


def safety_flag(score, enabled=True, threshold: float = fixed.SAFETY_THRESHOLD) -> Column:
    """Score >= threshold where tagging is on, else false."""
    on = enabled if isinstance(enabled, Column) else F.lit(bool(enabled))
    return F.when(on, F.coalesce(col_(score), F.lit(0.0)) >= threshold).otherwise(F.lit(False))


def truncate_text(c, n: int = fixed.EMBED_MAX_CHARS) -> Column:
    """First n code points."""
    return F.substring(col_(c), 1, n)


CJK = "[\\x{4e00}-\\x{9fff}]"


def preferred_titles(title, original):
    """(primary, secondary) title, CJK title first."""
    p = strip_ws(F.coalesce(col_(title), F.lit("")))
    s = strip_ws(F.coalesce(col_(original), F.lit("")))
    p_cjk, s_cjk = p.rlike(CJK), s.rlike(CJK)
    primary = (F.when(p_cjk, p).when(s_cjk, s).when(p != "", p).when(s != "", s)
               .otherwise(F.lit("(无标题)")))
    secondary = (F.when(p_cjk, F.when(p != s, s).otherwise(""))
                 .when(s_cjk, F.when((p != "") & (p != s), p).otherwise(""))
                 .when(p != "", F.when(p != s, s).otherwise(""))
                 .otherwise(F.lit("")))
    return primary, secondary


def uri_component(c) -> Column:
    """encodeURIComponent: form-encode, then undo the characters it leaves alone."""
    x = F.url_encode(col_(c))
    for enc, ch in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        x = F.replace(x, F.lit(enc), F.lit(ch))
    return x


def magnet_uri(info_hash, title) -> Column:
    """Magnet URI from a hash and the encoded title; '' without a usable hash."""
    h = bare_info_hash(info_hash)
    name = uri_component(F.coalesce(F.nullif(col_(title), F.lit("")), F.lit("torrent")))
    return F.when(h == "", F.lit("")).otherwise(F.concat(F.lit("magnet:?xt=urn:btih:"), h, F.lit("&dn="), name))


def _one_decimal(v: Column) -> Column:
    """Fixed one-decimal text as JS toFixed(1): the nearest n/10 to the exact value, ties up.

    x*10 is rounded in double arithmetic, so when it lands exactly on k+0.5
    the exact product (Dekker two-product error term) decides the side.
    """
    def digits(x: Column) -> Column:
        p = x * 10.0
        c = x * 134217729.0
        hi = c - (c - x)
        lo = x - hi
        err = (hi * 10.0 - p) + lo * 10.0
        f = F.floor(p)
        return F.when(p - f == 0.5, F.when(err < 0, f).otherwise(f + 1)).otherwise(F.floor(p + 0.5)).cast("bigint")

    def text(n: Column) -> Column:
        a = F.abs(n)
        return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")),
                        (a / 10).cast("bigint").cast("string"), F.lit("."), (a % 10).cast("string"))
    return let(let(v, digits), text)


def pretty_size(c) -> Column:
    """Bytes to 'n.n UNIT' (B..TB, 1024 steps)."""
    units = fixed.SIZE_UNITS

    def fmt(num: Column) -> Column:
        idx = None
        for i in range(len(units) - 1, 0, -1):
            step = num >= float(1024 ** i)
            idx = F.when(step, F.lit(i)) if idx is None else idx.when(step, F.lit(i))
        idx = idx.otherwise(F.lit(0))

        def with_idx(i: Column) -> Column:
            unit = F.element_at(F.array(*[F.lit(u) for u in units]), i + 1)
            return F.concat(_one_decimal(num / F.pow(F.lit(1024.0), i)), F.lit(" "), unit)
        return F.when(num.isNull() | F.isnan(num), F.lit("")).otherwise(let(idx, with_idx))
    return let(col_(c).try_cast("double"), fmt)


def parse_rating(c) -> Column:
    """First number in the text (JS-style), else NULL."""
    t = strip_ws(F.coalesce(col_(c).cast("string"), F.lit("")))
    return F.regexp_extract(t, r"(\d+(\.\d+)?)", 1).try_cast("double")


def rating_value(*cols) -> Column:
    """First parseable rating; >= 10 rounded to an integer, else one decimal."""
    v = F.coalesce(*[parse_rating(c) for c in cols])
    return (F.when(v.isNull(), F.lit(""))
            .when(v >= 10, F.floor(v + 0.5).cast("bigint").cast("string"))
            .otherwise(_one_decimal(v)))


def preview_text(*cols, n: int = 90) -> Column:
    """First non-empty candidate, stripped, cut to n characters + '...'."""
    t = strip_ws(F.coalesce(*[F.nullif(col_(c), F.lit("")) for c in cols], F.lit("")))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("...")))


def token_preview(c, n: int = 3, pattern: str = fixed.PREVIEW_SPLIT_PERSON) -> Column:
    """Split a list text, strip, keep non-empty, first n joined by ' · '."""
    parts = F.filter(F.transform(F.split(F.coalesce(col_(c), F.lit("")), pattern), strip_ws), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, n), " · ")


def asset_url(base: str, path) -> Column:
    """Base URL + path, else NULL."""
    p = col_(path)
    return F.when(p.isNotNull() & (p != ""), F.concat(F.lit(base), p))


def parse_source_rating(c) -> Column:
    """Rating text to double; 'N/A', empty or unparsable -> NULL."""
    t = strip_ws(F.coalesce(col_(c), F.lit("")))
    return F.when((t == "") | (F.upper(t) == "N/A"), F.lit(None).cast("double")).otherwise(t.try_cast("double"))
