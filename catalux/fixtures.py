"""Test inputs derived from the driver's tables.

Each fixture is one SELECT that runs unchanged in Spark SQL and in DuckDB
(the oracle), so both engines see identical inputs.  Spark builds them as
lazy DataFrames over the parquet scans; the oracle prepends them as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalux.session import spread
from catalux.sources.tables import BASE_TABLES, register_tables

# further hits of a keyword payload: every third one has the first one's title again
_MORE_HITS = ", ".join(
    f"""',{{"infoHash":"', sha1(concat(CAST(p_partkey AS STRING), '-{k}')), '","title":"', p_name, '{"" if k % 3 == 0 else f" part {k}"}',
                '","torrent":{{"name":"', p_name, '{"" if k % 3 == 0 else f" part {k}"}","size":', CAST(p_size * {k} AS STRING), '}}}}'""" for k in range(2, 10))

FIXTURE_SQL: dict[str, str] = {
    "items": """
SELECT d.doc_id AS id, CAST(d.doc_id AS STRING) AS pg_id, d.text, d.lang, d.source, d.n_chars AS size,
       e.ts AS updated_at,
       concat(substring(replace(d.text, chr(10), ' '), 1, 40),
              CASE d.doc_id % 6 WHEN 0 THEN '.1080p.x264-GRP' WHEN 1 THEN ' ABC-123' WHEN 2 THEN ' HD 720'
                                WHEN 3 THEN ' 标题 中文字幕' WHEN 4 THEN ' [web-dl]' ELSE '' END) AS title
FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "sync_state": """
SELECT 'items' AS source, i.pg_id,
       CASE WHEN i.id % 5 = 0 THEN md5(concat(i.text, 'x')) ELSE md5(i.text) END AS text_hash,
       'v1' AS embedding_version, concat('items:', i.pg_id) AS vector_id,
       CAST(coalesce(l.toxic, 0) AS DOUBLE) AS nsfw_score,
       CASE WHEN i.id % 7 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' ELSE TIMESTAMP '2025-01-01 00:00:00' END AS updated_at,
       CASE WHEN i.id % 11 = 0 THEN 'timeout' ELSE NULL END AS last_error
FROM items i LEFT JOIN labels l ON l.doc_id = i.id
WHERE i.id % 4 <> 3""",
    "files": """
SELECT concat(sha1(CAST(conv_id AS STRING)), ':', CAST(turn AS STRING)) AS file_id,
       sha1(CAST(conv_id AS STRING)) AS info_hash, conv_id AS parent_id, CAST(turn AS INT) AS idx, role,
       concat('dir/part', CAST(turn AS STRING),
              CASE turn % 5 WHEN 0 THEN '.mkv' WHEN 1 THEN '.srt' WHEN 2 THEN '.JPG' WHEN 3 THEN '.zip' ELSE '' END) AS path,
       CASE WHEN turn % 4 = 3 THEN NULL ELSE length(text) END AS size
FROM conversations""",
    "points": """
SELECT vec_id, embedding, label, CAST(vec_id AS STRING) AS pg_id,
       CASE WHEN label < 8 THEN 'items' ELSE 'unknown' END AS source,
       md5(CAST(vec_id - vec_id % 2 AS STRING)) AS text_hash,
       CASE WHEN vec_id % 10 = 0 THEN NULL ELSE vec_id * 1048576 END AS size,
       CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id AS STRING) ELSE NULL END AS tmdb_id,
       split(CASE label % 3 WHEN 0 THEN 'Drama,Action' WHEN 1 THEN 'Action' ELSE 'War' END, ',') AS genre_tags,
       CASE label % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'subtitle' ELSE 'other' END AS file_type,
       split(CASE label % 2 WHEN 0 THEN 'zh,en' ELSE 'fr' END, ',') AS audio_langs,
       split(CASE label % 2 WHEN 0 THEN 'en' ELSE 'fr,de' END, ',') AS subtitle_langs,
       label = 9 AS nsfw
FROM embeddings""",
    "enrich": """
SELECT 'doc' AS content_type, i.source AS content_source, i.pg_id AS content_id,
       CASE WHEN i.id % 3 = 0 THEN '' ELSE concat('Big Title ', i.pg_id, ' : Part A, 标题', i.pg_id, ' | Alt ', i.pg_id) END AS aka,
       CASE WHEN i.id % 6 = 0 THEN NULL ELSE 'drama，slow burn/noir' END AS keywords,
       CASE WHEN i.id % 4 = 0 THEN NULL ELSE 'Drama, War' END AS genre,
       CASE i.id % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'error' ELSE 'success' END AS status,
       CASE WHEN i.id % 5 > 1 THEN concat('T', i.pg_id) ELSE NULL END AS match_id,
       l.quality, l.toxic, i.updated_at
FROM labels l JOIN items i ON i.id = l.doc_id""",
    "refs": """
SELECT CASE p_partkey % 5 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv_show' WHEN 2 THEN 'tv' WHEN 3 THEN 'music' ELSE NULL END AS content_type,
       'tmdb' AS content_source, CAST(p_partkey AS STRING) AS content_id, p_name AS title,
       concat(p_name, ' ABC-', CAST(100 + p_partkey AS STRING)) AS raw_title
FROM part""",
    "candidates": """
SELECT r.content_id, k.pos,
       CASE WHEN r_num % 4 = 0 AND k.pos = 2 THEN concat('ABC-', CAST(100 + r_num AS STRING)) ELSE NULL END AS code,
       CASE WHEN r_num % 4 = 1 AND k.pos = 1 THEN r.raw_title
            WHEN r_num % 4 = 2 AND k.pos = 1 THEN concat('The ', r.raw_title, ' Cut')
            ELSE concat('other ', CAST(k.pos AS STRING)) END AS title
FROM (SELECT *, CAST(content_id AS INT) AS r_num FROM refs) r
CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) k""",
    "payload": """
SELECT p_partkey AS id,
       concat('{"genres":[{"name":"', p_type, '"},{"name":"War"}],"keywords":{"',
              CASE WHEN p_partkey % 2 = 0 THEN 'keywords' ELSE 'results' END, '":[{"name":"k1"},{"name":""}]},',
              '"credits":{"cast":[{"name":"A1"},{"name":"A2"}],"crew":[{"name":"D1","job":"Director"},{"name":"W1","job":"Writer"}]},',
              '"overview":"', p_name, '","poster_path":"/p', CAST(p_partkey AS STRING), '.jpg","imdbRating":"',
              CASE WHEN p_partkey % 3 = 0 THEN 'N/A' ELSE '7.5' END, '"}') AS film_json,
       concat('{"data":{"searchScene":', CASE WHEN p_partkey % 5 = 0 THEN '{"items":[' ELSE '[' END,
              '{"id":"s', CAST(p_partkey AS STRING), '","title":"', p_name, '","code":"ABC-', CAST(100 + p_partkey AS STRING),
              '","details":"d","date":"2020-01-01","urls":[{"url":"u","site":{"name":"web"}}],"studio":',
              CASE WHEN p_partkey % 2 = 0 THEN '{"id":"1","name":"St"}' ELSE '"St"' END,
              ',"tags":["t1",{"name":"t2"},{"label":"t3"}],"images":[{"width":1},{"url":"http://x/i.jpg"}],',
              '"performers":[{"performer":{"name":"P1"}},{"title":"P2"}]}',
              CASE WHEN p_partkey % 5 = 0 THEN ']}' ELSE ']' END, '}}') AS scene_json,
       CASE WHEN p_partkey % 4 = 3 THEN
         concat('{"data":{"torrents":{"totalCount":1,"edges":[{"node":{"infoHash":"', sha1(CAST(p_partkey AS STRING)),
                '","name":"', p_name, '","size":', CAST(p_size AS STRING), '}},{"node":null}]}}}')
       ELSE
         concat('{"data":{"torrentContent":{"search":{"totalCount":2,"hasNextPage":',
                CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"items":[{"infoHash":"', sha1(CAST(p_partkey AS STRING)),
                '","title":"', p_name, '","contentSource":"', CASE WHEN p_partkey % 3 = 0 THEN 'tmdb' ELSE 'none' END,
                '","content":{"attributes":[{"key":"', CASE WHEN p_partkey % 5 = 0 THEN 'tmdb_id' ELSE 'poster' END, '","value":"v"}]}',
                ',"torrent":{"name":"', p_name, '","size":', CAST(p_size AS STRING), '}}',
                """ + _MORE_HITS + """, ']}}}}')
       END AS search_json,
       concat('{"data":{"torrent":{"files":{"totalCount":2,"hasNextPage":false,"items":[{"index":0,"path":"a.mkv","extension":"mkv","size":',
              CAST(p_size AS STRING), ',"updatedAt":"2024-01-01T00:00:00Z"},{"index":1,"path":"b.srt","size":null}]}}}}') AS file_json
FROM part""",
    "links": """
SELECT DISTINCT l_partkey AS content_id, l_suppkey AS collection_id FROM lineitem""",
    "catalog": """
SELECT p_partkey AS id, p_name AS title, p_type AS type, p_brand AS source, p_size AS release_year,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS overview
FROM part""",
    "collections": """
SELECT s_suppkey AS collection_id, s_name AS name FROM supplier""",
    "queries": """
SELECT * FROM (VALUES (1, '惊悚电影'), (2, '视频文件 动作 国语'), (3, 'english subtitle horror'), (4, 'Big Title 5'),
                      (5, 'jojo奇妙冒险'), (6, '压缩包'), (7, '  '), (8, 'the')) AS t(query_id, q)""",
}

FIXTURE_DEPS: dict[str, tuple[str, ...]] = {
    "items": (),
    "sync_state": ("items",),
    "files": (),
    "points": (),
    "enrich": ("items",),
    "refs": (),
    "candidates": ("refs",),
    "payload": (),
    "links": (),
    "catalog": (),
    "collections": (),
    "queries": (),
}


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FIXTURE_DEPS[n]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_fixtures(sql: str, names) -> str:
    """Prefix ``sql`` with the CTEs of the named fixtures (and their inputs)."""
    order = _closure(names)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in order)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


class Fixtures:
    """Lazy fixture DataFrames over one directory of base tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._cache: dict[str, DataFrame] = {}
        register_tables(spark, root, BASE_TABLES)
        # narrow rows in few row groups, from which the payloads (some KB each) are made
        spread(spark.table("part"), "p_partkey").createOrReplaceTempView("part")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            for dep in FIXTURE_DEPS[name]:
                self[dep].createOrReplaceTempView(dep)
            self._cache[name] = self.spark.sql(FIXTURE_SQL[name])
            # later fixtures may read this one by name
            self._cache[name].createOrReplaceTempView(name)
        return self._cache[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name) if name in BASE_TABLES else self[name]
