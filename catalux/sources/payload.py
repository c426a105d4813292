"""Landed metadata payloads (S9-S12): JSON text columns or JSON files.

The reference fetches these over HTTP per item; here they are landed data
read in bulk (``spark.read.json`` with a declared schema, or a JSON text
column) and flattened with DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalux.functions.match import is_list, is_obj, vget, vstr
from catalux.functions.text import let


def read_payload_files(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Landed JSON documents, one per line; a declared schema avoids an inference pass."""
    reader = spark.read.option("mode", "PERMISSIVE")
    if schema:
        reader = reader.schema(schema)
    return reader.json(path)


def search_nodes(js: Column) -> Column:
    """Hit nodes of a keyword payload in either shape, non-object entries dropped.

    data.torrentContent.search.items[]  or  data.torrents.edges[].node
    """
    def nodes_of(v: Column) -> Column:
        items = F.coalesce(vget(v, "$.data.torrentContent.search.items", "array<variant>"), F.array().cast("array<variant>"))
        edges = F.coalesce(vget(v, "$.data.torrents.edges", "array<variant>"), F.array().cast("array<variant>"))
        nodes = F.transform(F.filter(edges, is_obj), lambda e: vget(e, "$.node"))
        return F.when(is_obj(vget(v, "$.data.torrentContent")), F.filter(items, is_obj)).otherwise(F.filter(nodes, is_obj))
    return let(F.try_parse_json(js), nodes_of)


def each_node(df: DataFrame, nodes: str, out: str = "node") -> DataFrame:
    """A row an entry of the array ``nodes``, whose entries are never NULL.

    A plain explode brings a filter on the array's size with it, which is pushed, with the parsing of the payload, to
    where the few splits of a small file are read; the outer one does not.
    """
    return df.withColumn(out, F.explode_outer(nodes)).drop(nodes).where(F.col(out).isNotNull())


def search_meta(js: Column) -> dict[str, Column]:
    """totalCount and hasNextPage of a keyword payload (hasNextPage only in the first shape)."""
    def first(v: Column) -> Column:
        return is_obj(vget(v, "$.data.torrentContent"))

    def total(v: Column) -> Column:
        return F.when(first(v), vget(v, "$.data.torrentContent.search.totalCount", "bigint")).otherwise(
            vget(v, "$.data.torrents.totalCount", "bigint"))

    def more(v: Column) -> Column:
        return F.when(first(v), vget(v, "$.data.torrentContent.search.hasNextPage", "boolean"))
    return {"total_count": let(F.try_parse_json(js), total), "has_next_page": let(F.try_parse_json(js), more)}


FILE_ITEM_FIELDS = {"index": "bigint", "path": "string", "extension": "string", "size": "bigint"}


def file_rows(df: DataFrame, js: str, keep=()) -> DataFrame:
    """One row per file entry of a file-list payload; updatedAt -> updated_at."""
    v = F.try_parse_json(F.col(js))
    items = vget(v, "$.data.torrent.files.items", "array<variant>")
    ex = df.select(*keep, F.posexplode(F.filter(F.coalesce(items, F.array().cast("array<variant>")), is_obj)).alias("pos", "it"))
    return ex.select(*keep, "pos", *[vget(F.col("it"), f"$.{k}", t).alias(k) for k, t in FILE_ITEM_FIELDS.items()],
                     vstr(F.col("it"), "$.updatedAt").alias("updated_at"))


def node_columns(node: Column) -> dict[str, Column]:
    """Fields of a keyword hit node used by the payload search."""
    torrent = vget(node, "$.torrent")
    t_obj = is_obj(torrent)
    return {
        "info_hash_raw": F.coalesce(F.nullif(vstr(node, "$.infoHash"), F.lit("")), vstr(node, "$.torrent.infoHash"), F.lit("")),
        "title": F.coalesce(F.nullif(F.when(t_obj, vstr(torrent, "$.name")), F.lit("")), F.nullif(vstr(node, "$.name"), F.lit("")),
                            F.nullif(vstr(node, "$.title"), F.lit("")), F.lit("")),
        "size_raw": F.coalesce(F.when(t_obj, vget(torrent, "$.size", "double")), vget(node, "$.size", "double")),
        "content_source": vstr(node, "$.contentSource"),
    }


def is_array(v: Column) -> Column:
    return is_list(v)
