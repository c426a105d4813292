"""Scalar functions on hand-made edge cases."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from catalux.functions import text as X
from catalux.functions.query import query_filters, query_genres, query_tokens


def col_values(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize("raw,expected", [
    ("Movie.Name.2019.1080p.BluRay.x264-GRP", "Movie Name 2019 GRP"),
    ("[{}]Title", "Title"),                      # the literal bracket run is replaced
    ("Title (2019) [web-dl]", "Title (2019) [web dl]"),  # ordinary brackets survive (Q1), dash split (Q2)
    ("h.264 cut", "h 264 cut"),                  # dot becomes a space first (Q2)
    ("中文1080p版", "中文1080p版"),                # no word border inside CJK + digits (Q3)
    ("x264 x265 aac", ""),
    ("  spaced\t\tout  ", "spaced out"),
    ("", ""),
    (None, ""),
])
def test_normalize_title(spark, raw, expected):
    assert col_values(spark, [raw], X.normalize_title) == [expected]


def test_normalize_title_strip_brackets_option(spark):
    out = col_values(spark, ["Title (2019) [x]"], lambda c: X.normalize_title(c, strip_brackets=True))
    assert out == ["Title 2019 x"]


def test_file_extension_and_type(spark):
    vals = ["a/b.MKV", "noext", "x.tar.gz", "", None, "weird. Srt "]
    assert col_values(spark, vals, X.file_extension) == ["mkv", "", "gz", "", "", "srt"]
    assert col_values(spark, vals, lambda c: X.file_type(X.file_extension(c))) == \
        ["video", "other", "archive", "other", "other", "subtitle"]


def test_detect_languages(spark):
    df = spark.createDataFrame([("国语 English",), ("中文字幕 eng",), ("",)], "t string")
    a, s = X.detect_languages("t")
    rows = df.select(a.alias("a"), s.alias("s")).collect()
    assert rows[0]["a"] == ["zh", "en"] and rows[0]["s"] == ["zh", "en"]
    assert rows[1]["a"] == [] and rows[1]["s"] == ["zh", "en"]   # subtitle marker: subtitles only
    assert rows[2]["a"] == [] and rows[2]["s"] == []


def test_genre_tags_full_width(spark):
    assert col_values(spark, ["Drama， War ,, ", None], X.genre_tags) == [["Drama", "War"], []]


def test_keyword_score(spark):
    df = spark.createDataFrame([("abc", "abc"), ("b", "abc"), ("z", "abc"), ("", "abc"), ("c", "ab c")], "q string, t string")
    out = [r[0] for r in df.select(X.keyword_score("q", "t")).collect()]
    assert out == [1.0, pytest.approx(0.45), 0.1, 0.0, pytest.approx(0.225)]


def test_info_hashes(spark):
    h40 = "A" * 40
    assert col_values(spark, [h40, "\\x" + h40, "zz", ""], X.normalize_info_hash) == \
        ["\\x" + "a" * 40, "\\x" + "a" * 40, "zz", ""]
    assert col_values(spark, ["\\x" + "b" * 64, "b" * 39, "c" * 41], X.bare_info_hash) == ["b" * 64, "", "c" * 41]


def test_size_coalesce_bad_text(spark):
    df = spark.createDataFrame([("abc", None, "12"), ("-1", "0", "x")], "a string, b string, c string")
    assert [r[0] for r in df.select(X.size_coalesce("a", "b", "c")).collect()] == [12.0, None]


def test_extract_code(spark):
    vals = ["abc-123 title", "标题ABC-123", "HD 720", "noise", "ABCDEFG-123"]
    assert col_values(spark, vals, X.extract_code) == ["ABC-123", None, "HD-720", None, None]


def test_point_id_is_uuid5(spark):
    df = spark.createDataFrame([("items", "1"), ("files", "abc:3")], "s string, p string")
    got = [r[0] for r in df.select(X.point_id("s", "p")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, "items:1")), str(uuid.uuid5(uuid.NAMESPACE_URL, "files:abc:3"))]


def test_safety_score_edges(spark):
    out = col_values(spark, ["", "   ", "a a a a", "porn"], X.safety_score)
    assert out[0] == pytest.approx(0.05)
    assert out[1] == pytest.approx(0.6)
    assert out[2] == pytest.approx(0.45)           # 0.6 * (1 - 1/4)
    assert out[3] == pytest.approx(0.15 + 0.05)


@pytest.mark.parametrize("v,expected", [(1.25, "1.3"), (1.45, "1.4"), (0.05, "0.1"), (2.675, "2.7"), (0.25, "0.3"),
                                        (1.35, "1.4"), (9.96, "10.0")])
def test_one_decimal_matches_js_tofixed(spark, v, expected):
    assert col_values(spark, [v], X._one_decimal, "double") == [expected]


def test_pretty_size_and_rating(spark):
    assert col_values(spark, [0.0, 1023.0, 1280.0, 5.0 * 1024 ** 4 * 2048, None], X.pretty_size, "double") == \
        ["0.0 B", "1023.0 B", "1.3 KB", "10240.0 TB", ""]
    df = spark.createDataFrame([("N/A", "7.25 /10"), (None, "12.5")], "a string, b string")
    assert [r[0] for r in df.select(X.rating_value("a", "b")).collect()] == ["7.3", "13"]


def test_token_preview_splits_on_newline_not_letter_n(spark):
    assert col_values(spark, ["Ann, Bob\nCarl|Dan"], X.token_preview) == ["Ann · Bob · Carl"]


def test_magnet_uri_encoding(spark):
    df = spark.createDataFrame([("a" * 40, "x y!(z)"), ("bad", "t")], "h string, t string")
    out = [r[0] for r in df.select(X.magnet_uri("h", "t")).collect()]
    assert out == ["magnet:?xt=urn:btih:" + "a" * 40 + "&dn=x%20y!(z)", ""]


def test_query_understanding(spark):
    df = spark.createDataFrame([(1, "视频文件 动作 国语"), (2, "  "), (3, "jojo奇妙冒险")], "id int, q string")
    f = query_filters("q")
    a, o = query_tokens("q")
    rows = {r["id"]: r for r in df.select("id", *[f[k].alias(k) for k in f], query_genres("q").alias("g"),
                                          a.alias("a"), o.alias("o")).collect()}
    assert rows[1]["file_type"] == "video" and rows[1]["cleaned"] == "动作 国语"
    assert rows[1]["genres"] == ["动作", "Action"] and rows[1]["audio_langs"] == ["zh"]
    assert rows[2]["cleaned"] == "  "                      # blank falls back to the original
    assert rows[3]["a"] == "jojo" and rows[3]["o"] == "奇妙冒险"
