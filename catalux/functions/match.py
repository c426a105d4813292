"""Metadata payload functions (X16, X19-X25) over VARIANT values.

Landed payloads mix shapes in one field (a string here, an object or a list
of strings and objects there).  They are parsed once with ``parse_json``
and inspected with ``schema_of_variant``, so each rule below is one Column
expression evaluated JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.functions import fixed
from catalux.functions.text import col_, extract_code, let, normalize_title, strip_ws


def vget(v: Column, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, path, typ)


def vtype(v: Column) -> Column:
    """'STRING', 'OBJECT<...>', 'ARRAY<...>', 'BIGINT', 'VOID' (JSON null) or NULL (missing)."""
    return F.schema_of_variant(v)


def is_obj(v: Column) -> Column:
    """An object casts to a struct without fields; its schema, which names every value inside, is never built."""
    return vget(v, "$", "struct<>").isNotNull()


def is_list(v: Column) -> Column:
    return vget(v, "$", "array<struct<>>").isNotNull()


def is_str(v: Column) -> Column:
    return F.when(is_obj(v) | is_list(v), F.lit(False)).otherwise(F.coalesce(vtype(v) == "STRING", F.lit(False)))


def vstr(v: Column, path: str = "$") -> Column:
    return vget(v, path, "string")


def truthy(v: Column) -> Column:
    """Python truthiness of a JSON value."""
    t = vtype(v)
    return (F.when(v.isNull(), F.lit(False))
            .when(is_obj(v), vstr(v) != "{}")
            .when(is_list(v), F.size(vget(v, "$", "array<struct<>>")) > 0)
            .when(t == "VOID", F.lit(False))
            .when(t == "STRING", vstr(v) != "")
            .when(t == "BOOLEAN", vget(v, "$", "boolean"))
            .otherwise(F.coalesce(vget(v, "$", "double") != 0, F.lit(False))))


def first_truthy(*vs: Column) -> Column:
    """``a or b or c`` over JSON values (NULL when none is truthy)."""
    out = None
    for v in vs:
        out = F.when(truthy(v), v) if out is None else out.when(truthy(v), v)
    return out


def nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _object_name(o: Column) -> Column:
    perf = vget(o, "$.performer")
    perf_ok = is_obj(perf) & truthy(perf)
    pname = F.coalesce(nz(vstr(perf, "$.name")), nz(vstr(perf, "$.title")))
    oname = F.coalesce(nz(vstr(o, "$.name")), nz(vstr(o, "$.title")), nz(vstr(o, "$.label")))
    return F.when(perf_ok, pname).otherwise(oname)


def join_names(v: Column) -> Column:
    """Names from a string, an object, or a list of strings / objects, comma-joined."""
    items = vget(v, "$", "array<variant>")
    names = F.filter(F.transform(items, lambda x: F.when(is_str(x), nz(vstr(x))).when(is_obj(x), _object_name(x))),
                     lambda n: n.isNotNull() & (n != ""))
    return (F.when(~truthy(v), F.lit(""))
            .when(is_str(v), vstr(v))
            .when(is_list(v), F.array_join(names, ", "))
            .when(is_obj(v), F.coalesce(_object_name(v), F.lit("")))
            .otherwise(F.lit("")))


def _image_of(v: Column) -> Column:
    return (F.when(is_str(v), nz(vstr(v)))
            .when(is_obj(v), F.coalesce(*[F.when(truthy(vget(v, f"$.{k}")), vstr(v, f"$.{k}"))
                                          for k in ("url", "path", "src")])))


def first_image_url(v: Column) -> Column:
    """A string, the first of url/path/src of an object, or the first usable list entry."""
    items = vget(v, "$", "array<variant>")
    from_list = F.element_at(F.filter(F.transform(items, _image_of), lambda u: u.isNotNull()), 1)
    return (F.when(~truthy(v), F.lit(None).cast("string"))
            .when(is_list(v), from_list)
            .otherwise(_image_of(v)))


def result_items(payload: Column, result_path: str | None) -> Column:
    """Items array<variant> under a dotted path (list as is; object via items/results/...; else itself)."""
    data = payload
    if result_path:
        data = vget(payload, "$." + ".".join(p for p in result_path.split(".") if p))
    objs = lambda arr: F.filter(arr, is_obj)
    wrapped = None
    for k in fixed.RESULT_LIST_KEYS:
        sub = vget(data, f"$.{k}")
        wrapped = (F.when(is_list(sub), objs(vget(sub, "$", "array<variant>"))) if wrapped is None
                   else wrapped.when(is_list(sub), objs(vget(sub, "$", "array<variant>"))))
    empty = F.array().cast("array<variant>")
    return (F.when(is_list(data), objs(vget(data, "$", "array<variant>")))
            .when(is_obj(data), F.coalesce(wrapped.otherwise(F.lit(None)), F.array(data)))
            .otherwise(empty))


def node_has_external_id(node: Column, marker: str = "tmdb") -> Column:
    """Source is the film catalogue, or an attribute key mentions it with a non-empty value."""
    src = F.lower(F.coalesce(nz(vstr(node, "$.contentSource")), nz(vstr(node, "$.content_source")), F.lit("")))
    attrs = vget(node, "$.content.attributes", "array<variant>")
    hit = F.exists(F.coalesce(attrs, F.array().cast("array<variant>")),
                   lambda a: is_obj(a) & (strip_ws(F.coalesce(vstr(a, "$.value"), F.lit(""))) != "")
                   & F.lower(F.coalesce(vstr(a, "$.key"), F.lit(""))).contains(marker))
    return (src == marker) | (is_obj(vget(node, "$.content")) & F.coalesce(hit, F.lit(False)))


SCENE_COLUMNS = ["tpdb_id", "external_type", "title", "original_title", "aka", "actors", "tags", "studio",
                 "series", "site", "release_date", "plot", "poster_url"]


def _any_str(v: Column) -> Column:
    """str(value) for a truthy JSON value ('' otherwise)."""
    return F.when(truthy(v), F.when(is_str(v), vstr(v)).otherwise(F.to_json(v))).otherwise(F.lit(""))


_SCENE_KEYS = ["id", "uuid", "type", "__typename", "title", "name", "original_title", "originalTitle", "aka",
               "alternateTitles", "code", "performers", "actors", "tags", "studio", "series", "site", "urls",
               "release_date", "releaseDate", "date", "production_date", "description", "overview", "plot", "details",
               "image", "images", "poster"]
_SCENE_CHOICES = {
    "c_id": ["id", "uuid"], "c_type": ["type", "__typename"], "c_title": ["title", "name"],
    "c_orig": ["original_title", "originalTitle"], "c_aka": ["aka", "alternateTitles"],
    "c_actors": ["performers", "actors"], "c_date": ["release_date", "releaseDate", "date", "production_date"],
    "c_plot": ["description", "overview", "plot", "details"], "c_image": ["image", "images", "poster"],
}


def _k(key: str) -> str:
    return "_v_" + key.strip("_")


def scene_frame(df: DataFrame, item: str, keep) -> DataFrame:
    """X24 over a frame: the 13 scene columns with their per-field fallbacks.

    Evaluated in stages (raw fields, truthiness, chosen values, outputs) so
    every stage references plain columns; nesting the fallbacks in one
    expression would repeat each JSON extraction many times over.
    """
    keep = list(keep)
    it = F.col(item)
    s1 = df.select(*keep, *[vget(it, f"$.{k}").alias(_k(k)) for k in _SCENE_KEYS])
    s2 = s1.select("*", *[truthy(F.col(_k(k))).alias("_ok" + _k(k)) for k in _SCENE_KEYS])
    chosen = []
    for name, keys in _SCENE_CHOICES.items():
        c = None
        for k in keys:
            c = F.when(F.col("_ok" + _k(k)), F.col(_k(k))) if c is None else c.when(F.col("_ok" + _k(k)), F.col(_k(k)))
        chosen.append(c.alias(name))
    s3 = s2.select(*keep, *[F.col(_k(k)) for k in ("code", "tags", "studio", "series", "site", "urls")],
                   *[F.col("_ok" + _k(k)) for k in ("code", "site")], *chosen)
    url_sites = F.filter(F.transform(F.coalesce(vget(F.col(_k("urls")), "$", "array<variant>"), F.array().cast("array<variant>")),
                                     lambda u: F.when(is_obj(u) & is_obj(vget(u, "$.site")), nz(vstr(u, "$.site.name")))
                                     .when(is_obj(u) & is_str(vget(u, "$.site")), vstr(u, "$.site"))),
                         lambda x: x.isNotNull() & (x != ""))
    site = F.when(F.col("_ok" + _k("site")), join_names(F.col(_k("site")))).otherwise(F.array_join(url_sites, ", "))
    aka = F.when(F.col("c_aka").isNull(),
                 F.when(F.col("_ok" + _k("code")), _any_str(F.col(_k("code")))).otherwise(F.lit(""))).otherwise(
        F.when(is_str(F.col("c_aka")), vstr(F.col("c_aka"))).otherwise(join_names(F.col("c_aka"))))
    return s3.select(
        *keep,
        F.nullif(_any_str(F.col("c_id")), F.lit("")).alias("tpdb_id"),
        F.nullif(_any_str(F.col("c_type")), F.lit("")).alias("external_type"),
        _any_str(F.col("c_title")).alias("title"),
        _any_str(F.col("c_orig")).alias("original_title"),
        aka.alias("aka"),
        join_names(F.col("c_actors")).alias("actors"),
        join_names(F.col(_k("tags"))).alias("tags"),
        join_names(F.col(_k("studio"))).alias("studio"),
        join_names(F.col(_k("series"))).alias("series"),
        site.alias("site"),
        F.coalesce(_any_str(F.col("c_date")), F.lit("")).alias("release_date"),
        F.coalesce(_any_str(F.col("c_plot")), F.lit("")).alias("plot"),
        first_image_url(F.col("c_image")).alias("poster_url"),
    )


def first_item_frame(df: DataFrame, js: str, result_path: str, keep) -> DataFrame:
    """(keep..., n_items, it): parse once, resolve the result path, take the first item."""
    keep = list(keep)
    data = df.select(*keep, F.try_parse_json(F.col(js)).alias("_payload"))
    if result_path:
        data = data.select(*keep, vget(F.col("_payload"), "$." + result_path).alias("_data"))
    else:
        data = data.withColumnRenamed("_payload", "_data")
    data = data.select(*keep, "_data", vtype(F.col("_data")).alias("_dt"))
    items = result_items(F.col("_data"), None)
    return data.select(*keep, items.alias("_items")).select(
        *keep, F.size("_items").cast("bigint").alias("n_items"), F.element_at("_items", 1).alias("it"))


FILM_SCHEMA = (
    "STRUCT<genres: ARRAY<STRUCT<name: STRING>>, "
    "keywords: STRUCT<keywords: ARRAY<STRUCT<name: STRING>>, results: ARRAY<STRUCT<name: STRING>>>, "
    "credits: STRUCT<cast: ARRAY<STRUCT<name: STRING>>, crew: ARRAY<STRUCT<name: STRING, job: STRING>>>, "
    "alternative_titles: STRUCT<titles: ARRAY<STRUCT<title: STRING>>, results: ARRAY<STRUCT<title: STRING>>>, "
    "overview: STRING, poster_path: STRING, backdrop_path: STRING, external_ids: STRUCT<imdb_id: STRING>, "
    "imdb_id: STRING, imdbRating: STRING>")


def _names(arr: Column, field: str) -> Column:
    return F.array_join(F.filter(F.transform(arr, lambda x: x[field]), lambda n: n.isNotNull() & (n != "")), ", ")


def _nonempty(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def normalize_film_payload(js: Column, actors: int = 10, directors: int = 5, aka: int = 10) -> dict[str, Column]:
    """Genres, keywords, first N actors, directors by job, first N aka, plot, poster, imdb id."""
    p = F.from_json(js, FILM_SCHEMA, {"mode": "PERMISSIVE"})
    kw = F.coalesce(_nonempty(p["keywords"]["keywords"]), _nonempty(p["keywords"]["results"]),
                    F.array().cast("array<struct<name: string>>"))
    alt = F.coalesce(_nonempty(p["alternative_titles"]["titles"]), _nonempty(p["alternative_titles"]["results"]),
                     F.array().cast("array<struct<title: string>>"))
    cast = F.coalesce(p["credits"]["cast"], F.array().cast("array<struct<name: string>>"))
    crew = F.coalesce(p["credits"]["crew"], F.array().cast("array<struct<name: string, job: string>>"))
    directors_l = F.filter(F.transform(F.filter(crew, lambda c: c["job"] == "Director"), lambda c: c["name"]),
                           lambda n: n.isNotNull() & (n != ""))
    return {
        "aka": _names(F.slice(alt, 1, aka), "title"),
        "keywords": _names(kw, "name"),
        "actors": _names(F.slice(cast, 1, actors), "name"),
        "directors": F.array_join(F.slice(directors_l, 1, directors), ", "),
        "plot": F.coalesce(nz(p["overview"]), F.lit("")),
        "genre": _names(F.coalesce(p["genres"], F.array().cast("array<struct<name: string>>")), "name"),
        "poster_path": p["poster_path"],
        "backdrop_path": p["backdrop_path"],
        "imdb_id": F.coalesce(nz(p["external_ids"]["imdb_id"]), nz(p["imdb_id"])),
        "imdb_rating_text": p["imdbRating"],
    }


def norm_or_raw(c) -> Column:
    """The reference's title cleaner: normalised title, else the text itself."""
    # cleaned once: where this meets filters and joins, Spark copies the expression at each mention of it
    return let(normalize_title(c), lambda n: F.when(n != "", n).otherwise(F.coalesce(col_(c), F.lit(""))))


def search_variables(title) -> dict[str, Column]:
    """Search term = code, else cleaned title, else raw title."""
    t = F.coalesce(col_(title), F.lit(""))
    cleaned = F.when(t != "", norm_or_raw(t)).otherwise(F.lit(""))
    code = extract_code(t)
    return {"term": F.coalesce(code, nz(cleaned), t), "title": cleaned, "raw_title": t, "code": code}


def embed_text(text, fields: dict, match_id) -> Column:
    """Normalised text (else the original), plus the non-empty match fields on new lines when matched."""
    t = F.coalesce(col_(text), F.lit(""))
    base = norm_or_raw(t)
    extras = F.concat_ws("\n", *[nz(col_(c).cast("string")) for c in fields])
    matched = col_(match_id).isNotNull() & (col_(match_id).cast("string") != "")
    return F.when(matched & (extras != ""), F.concat(base, F.lit("\n"), extras)).otherwise(base)


def best_candidate(cands: DataFrame, refs: DataFrame, key: str = "content_id", pos: str = "pos",
                   ref_title: str = "raw_title", item_title: str = "title", item_code: str = "code") -> DataFrame:
    """Per ref the first candidate by code equality (1.0), exact title (0.9),
    containment either way (0.7), else the first candidate (0.5)."""
    r = refs.select(F.col(key).alias("_ref_key"), F.col(ref_title).alias("_rt"))
    j = cands.join(r, cands[key] == r["_ref_key"]).drop("_ref_key")
    rcode = extract_code("_rt")
    icode = F.coalesce(nz(F.col(item_code)), extract_code(item_title))
    rt, it = F.coalesce(F.col("_rt"), F.lit("")), F.coalesce(F.col(item_title), F.lit(""))
    nt, ni = F.lower(norm_or_raw(rt)), F.lower(norm_or_raw(it))
    t1 = rcode.isNotNull() & icode.isNotNull() & (F.upper(icode) == F.upper(rcode))
    t2 = (rt != "") & (it != "") & (ni == nt)
    t3 = (rt != "") & (it != "") & ((F.instr(ni, nt) > 0) | (F.instr(nt, ni) > 0))
    tier = F.when(t1, 1).when(t2, 2).when(t3, 3).otherwise(4)
    w = Window.partitionBy(key).orderBy("_tier", pos)
    best = j.withColumn("_tier", tier).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    method = F.element_at(F.array(*[F.lit(m) for m in ("code", "title_exact", "title_partial", "fallback")]), F.col("_tier"))
    score = F.element_at(F.array(*[F.lit(s) for s in (1.0, 0.9, 0.7, 0.5)]), F.col("_tier"))
    return best.withColumn("match_method", method).withColumn("match_score", score).drop("_tier", "_r", "_rt")
