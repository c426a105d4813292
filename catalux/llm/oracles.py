"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, chr(31))]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], chr(31))) END)) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id
                        GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, t, {WORDS.format(t="t")} AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) x),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], chr(31)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d) x),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) x WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest(range(0, 5)) AS k) y GROUP BY doc_id),
s AS (
  SELECT d.doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars > 16 * n_words OR word_chars < 2 * n_words
            OR 2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^A-Za-z]', '', 'g'))
            OR 100 * len(regexp_extract_all(t, '!!')) > 20 * n_words
            OR 100 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 40 * word_chars) AS kept
FROM s"""

_BASE32 = ("array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + "
           "(((('0x' || substr({h}, 5 * (k // 4) + 1, 5))::BIGINT) >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '')")

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT h, max(page_id) AS first_id FROM p GROUP BY h)
SELECT p.page_id, strlen(p.h) AS payload_bytes, {_BASE32.format(h='p.d')} AS payload_digest,
       CASE WHEN p.page_id = m.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> m.first_id THEN m.first_id END AS refers_to
FROM p JOIN m ON m.h = p.h"""

OP9 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, i, CASE WHEN i + 200 <= n THEN md5(substr(hx, 2 * i + 1, 400)) END AS h, substr(hx, 2 * i + 1, 2) AS x
      FROM (SELECT doc_id, hx, n, unnest(range(0, n)) AS i FROM t) y),
again AS (SELECT h FROM b WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
f AS (SELECT b.doc_id, b.i, b.x, max(CASE WHEN a.h IS NOT NULL THEN b.i END)
             OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS UNBOUNDED PRECEDING) AS start
      FROM b LEFT JOIN again a ON a.h = b.h),
c AS (SELECT doc_id, i, x, coalesce(i - start < 200, false) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
             coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256
FROM t LEFT JOIN r ON r.doc_id = t.doc_id"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) x GROUP BY ALL),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, sum(t.n)::HUGEINT AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
gd AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT + 2 * coalesce(max(v.v), 0) AS den
       FROM g LEFT JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT gd.lang, gd.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // gd.den AS p
      FROM gd JOIN kept k ON k.lang = gd.lang LEFT JOIN c ON c.lang = gd.lang AND c.source = gd.source AND c.term = k.term),
ld AS (SELECT c.lang, sum(c.n)::HUGEINT + 2 * max(v.v) AS den FROM c JOIN v ON v.lang = c.lang GROUP BY c.lang),
q AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n)::HUGEINT + 2)) // max(ld.den) AS q
      FROM c JOIN ld ON ld.lang = c.lang GROUP BY c.lang, c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                     FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
          ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value
          FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) x WHERE rank <= 10"""


def _op12(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain k-means of the parts in SQL, every part against every entry."""
    near = """a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, min(row(CAST(p.xx - 2 * list_inner_product(p.x, e.x) + list_inner_product(e.x, e.x) AS BIGINT), e.entry)) AS b
  FROM p JOIN e{r} e ON e.part = p.part GROUP BY ALL)"""
    move = """e{s} AS MATERIALIZED (
  SELECT e.part, e.entry, coalesce(m.x, e.x) AS x FROM e{r} e LEFT JOIN (
    SELECT part, entry, list(floor(s / n) ORDER BY i) AS x FROM (
      SELECT part, entry, i, sum(c) AS s, count(*) AS n FROM (
        SELECT a.part, a.b[2] AS entry, unnest(p.x) AS c, unnest(range(len(p.x))) AS i FROM a{r} a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part) y
      GROUP BY ALL) z GROUP BY ALL) m ON m.part = e.part AND m.entry = e.entry)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, s=r + 1), near.format(r=r + 1)]
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, x, list_inner_product(x, x) AS xx FROM (
       SELECT vec_id, label, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS x
       FROM (SELECT *, unnest(range({parts})) AS part FROM v) y) z),
e0 AS MATERIALIZED (SELECT part, entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) y
                    WHERE entry < {entries}),
{", ".join(steps)},
k AS (SELECT vec_id, label, string_agg(lower(printf('%02x', a.b[2])), '' ORDER BY part) AS code, sum(a.b[1])::BIGINT AS error
      FROM a{rounds} a GROUP BY vec_id, label),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM k GROUP BY label),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds})
SELECT k.vec_id, k.code, k.error, l.label_error, s.codebooks_sha256 FROM k JOIN l ON l.label IS NOT DISTINCT FROM k.label, s"""


OP12 = _op12()
