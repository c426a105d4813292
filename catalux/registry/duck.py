"""DuckDB SQL text for the oracle side of the scalar functions.

These restate the semantics independently in DuckDB's dialect (RE2 regex,
ASCII-only ``\\b``), so the oracle checks the Spark expressions rather than
reusing them.
"""

from __future__ import annotations

from catalux.functions import fixed

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"\p{L}\p{Nl}\p{Nd}\p{M}\p{Pc}\x{200C}\x{200D}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def normalize_title(e: str) -> str:
    alts = "|".join(w.replace("(264|265)", "(?:264|265)").replace(r"\d", r"\p{Nd}") for w in fixed.TITLE_NOISE_WORDS)
    noise = f"(^|[^{WORD}])(?:{alts})($|[^{WORD}])"
    x = f"coalesce({e}, '')"
    x = f"regexp_replace({x}, '[\\\\\\[]\\{{\\}}\\]', ' ', 'g')"
    x = f"regexp_replace({x}, '[._\\\\\\-]+', ' ', 'g')"
    # borders are consumed here (no \b), so a second pass catches adjacent words
    x = f"regexp_replace({x}, '{noise}', '\\1 \\2', 'gi')"
    x = f"regexp_replace({x}, '{noise}', '\\1 \\2', 'gi')"
    x = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    return f"trim({x})"


def contains_any(lower: str, words) -> str:
    return "(" + " OR ".join(f"strpos({lower}, {lit(w.lower())}) > 0" for w in words) + ")"


def detect_languages(e: str) -> tuple[str, str]:
    lower = f"lower(coalesce({e}, ''))"
    is_sub = contains_any(lower, fixed.SUBTITLE_WORDS)
    audio = ", ".join(f"CASE WHEN {contains_any(lower, ws)} AND NOT {is_sub} THEN {lit(c)} END"
                      for c, ws in fixed.LANGUAGE_WORDS.items())
    subs = ", ".join(f"CASE WHEN {contains_any(lower, ws)} THEN {lit(c)} END" for c, ws in fixed.LANGUAGE_WORDS.items())
    return (f"list_filter([{audio}], lambda x: x IS NOT NULL)", f"list_filter([{subs}], lambda x: x IS NOT NULL)")


def file_extension(e: str) -> str:
    ext = strip_ws(f"lower(split_part({e}, '.', -1))")
    return f"(CASE WHEN {e} IS NULL OR {e} = '' OR strpos({e}, '.') = 0 THEN '' ELSE {ext} END)"


def file_type(ext: str) -> str:
    parts = " ".join(f"WHEN lower(coalesce({ext}, '')) IN ({', '.join(lit(x) for x in xs)}) THEN {lit(k)}"
                     for k, xs in fixed.FILE_TYPE_EXTENSIONS.items())
    return f"(CASE {parts} ELSE 'other' END)"


def keyword_score(q: str, t: str) -> str:
    qq = "lower(" + strip_ws(f"coalesce({q}, '')") + ")"
    tt = "lower(" + strip_ws(f"coalesce({t}, '')") + ")"
    return (f"(CASE WHEN {qq} = '' OR {tt} = '' THEN 0.0 WHEN {qq} = {tt} THEN 1.0 "
            f"WHEN strpos({tt}, {qq}) = 0 THEN 0.1 "
            f"ELSE greatest(0.2, 0.9 / CAST(strpos({tt}, {qq}) AS DOUBLE)) END)")


def genre_tags(e: str) -> str:
    parts = f"string_split(replace(coalesce({e}, ''), '，', ','), ',')"
    return f"list_filter(list_transform({parts}, lambda x: {strip_ws('x')}), lambda x: x <> '')"


def extract_code(e: str) -> str:
    pat = f"(?:^|[^{WORD}])([A-Za-z]{{2,6}})[-_ ]?(\\p{{Nd}}{{2,5}})(?:$|[^{WORD}])"
    t = f"coalesce({e}, '')"
    letters = f"regexp_extract({t}, '{pat}', 1, 'i')"
    digits = f"regexp_extract({t}, '{pat}', 2, 'i')"
    return f"(CASE WHEN {letters} <> '' THEN upper({letters}) || '-' || {digits} END)"


def safety_score(e: str) -> str:
    lower = f"lower(coalesce({e}, ''))"
    kws = [k.strip().lower() for k in fixed.SAFETY_KEYWORDS if k.strip()]
    hits = " + ".join(f"(CASE WHEN strpos({lower}, {lit(k)}) > 0 THEN 1 ELSE 0 END)" for k in kws)
    tokens = f"list_filter(regexp_split_to_array({lower}, '{WS}+'), lambda x: x <> '')"
    ratio = f"(CAST(len(list_distinct({tokens})) AS DOUBLE) / CAST(greatest(len({tokens}), 1) AS DOUBLE))"
    base = f"least(0.15 * CAST(({hits}) AS DOUBLE), 0.9)"
    return (f"(CASE WHEN {lower} = '' THEN 0.05 ELSE "
            f"least({base} + greatest(0.05, 0.6 * (1.0 - {ratio})), 1.0) END)")


def normalize_info_hash(e: str) -> str:
    t = strip_ws(f"coalesce({e}, '')")
    return (f"(CASE WHEN {t} = '' THEN '' WHEN starts_with({t}, '\\x') AND length({t}) = 42 THEN lower({t}) "
            f"WHEN regexp_full_match(lower({t}), '[0-9a-f]{{40}}') THEN '\\x' || lower({t}) ELSE {t} END)")


def bare_info_hash(e: str) -> str:
    t = strip_ws(f"coalesce({e}, '')")
    h = f"(CASE WHEN starts_with({t}, '\\x') THEN substring({t}, 3) ELSE {t} END)"
    return f"(CASE WHEN regexp_full_match({h}, '[0-9a-fA-F]{{40,64}}') THEN lower({h}) ELSE '' END)"


def one_decimal(v: str) -> str:
    p = f"(({v}) * 10.0)"
    c = f"(({v}) * 134217729.0)"
    hi = f"({c} - ({c} - ({v})))"
    lo = f"(({v}) - {hi})"
    err = f"(({hi} * 10.0 - {p}) + {lo} * 10.0)"
    n = (f"CAST(CASE WHEN {p} - floor({p}) = 0.5 THEN (CASE WHEN {err} < 0 THEN floor({p}) ELSE floor({p}) + 1 END) "
         f"ELSE floor({p} + 0.5) END AS BIGINT)")
    return (f"((CASE WHEN {n} < 0 THEN '-' ELSE '' END) || CAST(abs({n}) // 10 AS VARCHAR) || '.' "
            f"|| CAST(abs({n}) % 10 AS VARCHAR))")


def pretty_size(e: str) -> str:
    num = f"TRY_CAST({e} AS DOUBLE)"
    idx = (f"(CASE WHEN {num} >= {float(1024**4)} THEN 4 WHEN {num} >= {float(1024**3)} THEN 3 "
           f"WHEN {num} >= {float(1024**2)} THEN 2 WHEN {num} >= 1024.0 THEN 1 ELSE 0 END)")
    cur = f"({num} / pow(1024.0, {idx}))"
    unit = f"(['B','KB','MB','GB','TB'])[{idx} + 1]"
    return f"(CASE WHEN {num} IS NULL OR isnan({num}) THEN '' ELSE {one_decimal(cur)} || ' ' || {unit} END)"


def parse_rating(e: str) -> str:
    t = strip_ws(f"coalesce(CAST({e} AS VARCHAR), '')")
    return f"TRY_CAST(nullif(regexp_extract({t}, '(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE)"


def rating_value(*cols: str) -> str:
    v = "coalesce(" + ", ".join(parse_rating(c) for c in cols) + ")"
    return (f"(CASE WHEN {v} IS NULL THEN '' WHEN {v} >= 10 THEN CAST(CAST(floor({v} + 0.5) AS BIGINT) AS VARCHAR) "
            f"ELSE {one_decimal(v)} END)")


def preview_text(*cols: str, n: int = 90) -> str:
    t = strip_ws("coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ", '')")
    return f"(CASE WHEN length({t}) <= {n} THEN {t} ELSE substring({t}, 1, {n}) || '...' END)"


def token_preview(e: str, n: int = 3) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array(coalesce({e}, ''), '[，,;/|\\n]+'), lambda x: {strip_ws('x')}), lambda x: x <> '')"
    return f"array_to_string(list_slice({parts}, 1, {n}), ' · ')"


def query_genres(e: str) -> str:
    q = f"coalesce({e}, '')"
    parts = ", ".join(f"CASE WHEN strpos({q}, {lit(k)}) > 0 THEN [{', '.join(lit(v) for v in vs)}] ELSE []::VARCHAR[] END"
                      for k, vs in fixed.QUERY_GENRES.items())
    return f"flatten([{parts}])"


def synonyms(e: str) -> str:
    q = f"coalesce({e}, '')"
    parts = ", ".join(f"CASE WHEN strpos({q}, {lit(k)}) > 0 THEN [{', '.join(lit(v) for v in vs)}] ELSE []::VARCHAR[] END"
                      for k, vs in fixed.QUERY_SYNONYMS.items())
    return f"flatten([{parts}])"


def query_file_type(e: str) -> tuple[str, str]:
    q = f"coalesce({e}, '')"
    ft = " ".join(f"WHEN strpos({q}, {lit(p)}) > 0 THEN {lit(k)}" for p, k in fixed.QUERY_FILE_TYPES)
    raw = " ".join(f"WHEN strpos({q}, {lit(p)}) > 0 THEN replace({q}, {lit(p)}, '')" for p, _ in fixed.QUERY_FILE_TYPES)
    return f"(CASE {ft} END)", f"(CASE {raw} ELSE {q} END)"


def is_ascii(e: str) -> str:
    return f"regexp_full_match({e}, '[\\x00-\\x7F]*')"


def uri_component(e: str) -> str:
    x = f"url_encode({e})"
    for enc, ch in (("%21", "!"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%27", "''")):
        x = f"replace({x}, '{enc}', '{ch}')"
    return x


def point_id(src: str, pid: str) -> str:
    h = f"sha1(unhex('{fixed.UUID_URL_NAMESPACE}') || encode({src} || ':' || {pid}))"
    variant = f"lower(printf('%x', (('0x' || substring({h}, 17, 1))::INTEGER % 4) + 8))"
    return (f"(substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-5' || substring({h}, 14, 3) || '-' "
            f"|| {variant} || substring({h}, 18, 3) || '-' || substring({h}, 21, 12))")


# --- JSON (payload) helpers --------------------------------------------------

def jtype(v: str, path: str = "$") -> str:
    return f"json_type({v}, '{path}')"


def jstr(v: str, path: str = "$") -> str:
    return f"json_extract_string({v}, '{path}')"


def jget(v: str, path: str) -> str:
    return f"json_extract({v}, '{path}')"


def truthy(v: str) -> str:
    t = jtype(v)
    return (f"(CASE WHEN {v} IS NULL OR {t} IS NULL OR {t} = 'NULL' THEN false "
            f"WHEN {t} = 'VARCHAR' THEN {jstr(v)} <> '' WHEN {t} = 'ARRAY' THEN json_array_length({v}) > 0 "
            f"WHEN {t} = 'OBJECT' THEN CAST({v} AS VARCHAR) <> '{{}}' WHEN {t} = 'BOOLEAN' THEN CAST({jstr(v)} AS BOOLEAN) "
            f"ELSE TRY_CAST({jstr(v)} AS DOUBLE) <> 0 END)")


def first_truthy(*vs: str) -> str:
    return "(CASE " + " ".join(f"WHEN {truthy(v)} THEN {v}" for v in vs) + " END)"


def any_str(v: str) -> str:
    return f"(CASE WHEN {truthy(v)} THEN (CASE WHEN {jtype(v)} = 'VARCHAR' THEN {jstr(v)} ELSE CAST({v} AS VARCHAR) END) ELSE '' END)"


def _object_name(o: str) -> str:
    perf = jget(o, "$.performer")
    return (f"(CASE WHEN {jtype(o, '$.performer')} = 'OBJECT' AND {truthy(perf)} "
            f"THEN coalesce(nullif({jstr(o, '$.performer.name')}, ''), nullif({jstr(o, '$.performer.title')}, '')) "
            f"ELSE coalesce(nullif({jstr(o, '$.name')}, ''), nullif({jstr(o, '$.title')}, ''), nullif({jstr(o, '$.label')}, '')) END)")


def join_names(v: str) -> str:
    names = (f"list_filter(list_transform({jget(v, '$[*]')}, lambda x: CASE WHEN {jtype('x')} = 'VARCHAR' "
             f"THEN nullif({jstr('x')}, '') WHEN {jtype('x')} = 'OBJECT' THEN {_object_name('x')} END), "
             f"lambda n: coalesce(n, '') <> '')")
    t = jtype(v)
    return (f"(CASE WHEN NOT {truthy(v)} THEN '' WHEN {t} = 'VARCHAR' THEN {jstr(v)} "
            f"WHEN {t} = 'ARRAY' THEN array_to_string({names}, ', ') "
            f"WHEN {t} = 'OBJECT' THEN coalesce({_object_name(v)}, '') ELSE '' END)")


def _image_of(v: str) -> str:
    keys = " ".join(f"WHEN {truthy(jget(v, '$.' + k))} THEN {jstr(v, '$.' + k)}" for k in ("url", "path", "src"))
    return (f"(CASE WHEN {jtype(v)} = 'VARCHAR' THEN nullif({jstr(v)}, '') "
            f"WHEN {jtype(v)} = 'OBJECT' THEN (CASE {keys} END) END)")


def first_image_url(v: str) -> str:
    lst = f"list_filter(list_transform({jget(v, '$[*]')}, lambda x: {_image_of('x')}), lambda u: u IS NOT NULL)"
    return (f"(CASE WHEN NOT {truthy(v)} THEN NULL WHEN {jtype(v)} = 'ARRAY' THEN {lst}[1] ELSE {_image_of(v)} END)")


def result_items(payload: str, path: str) -> str:
    data = jget(payload, "$." + path)
    objs = lambda arr: f"list_filter({arr}, lambda x: {jtype('x')} = 'OBJECT')"
    wrapped = " ".join(f"WHEN {jtype(data, '$.' + k)} = 'ARRAY' THEN {objs(jget(data, '$.' + k + '[*]'))}"
                       for k in fixed.RESULT_LIST_KEYS)
    return (f"(CASE WHEN {jtype(data)} = 'ARRAY' THEN {objs(jget(data, '$[*]'))} "
            f"WHEN {jtype(data)} = 'OBJECT' THEN (CASE {wrapped} ELSE [{data}] END) ELSE []::JSON[] END)")
