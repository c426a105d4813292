"""Source divergence audit (operator 11): which words set a source apart, by chunk factorization.

Terms are maximal runs outside ``\\x00-\\x40 \\x5B-\\x60 \\x7B-\\x7F`` (letters and all beyond ASCII), A-Z lower-cased.  A term never
crosses white space, so the texts are cut into whitespace chunks only, and the costlier cutting into terms is done once for
each chunk of the whole corpus:

1. tasks cut whole texts into blocks and count, in Arrow and numpy, the chunks of each document; a block is one row: its distinct
   chunks and the packed (document, chunk, count) triples, written to the shared folder;
2. each distinct chunk of all blocks is tokenized once, in SQL; a term whose chunks stand in fewer than ``LEAST`` documents
   together cannot be a kept term; the others are joined back to the blocks that hold their chunks;
3. each block turns its triples into distinct (document, term) pairs and adds up documents and occurrences by group (language
   and source) and term;
4. these are added up; terms in ``LEAST`` documents of a language are its kept terms;
5. probabilities and divergences are integers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)).
   Pairs of sources are computed in tiles of about ``TILE`` sources by slabs of about ``SLAB`` terms, each one a small dense matrix.

Terms travel as numbers, chunks and groups as 64-bit hashes.  Each set of hashes is checked against the texts it stands for: should
two texts of the corpus ever share one, the audit starts again with another seed, so results are exact.

A document is a row (repeated doc_ids are several documents).  Defined results: null text, language and source read as '';
a (lang, source) group without kept terms still stands in part ``pair``; a language without kept terms has values 0; ties rank
by item; only text, lang and source are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalux.llm.tables import pick, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 10             # documents of a language that a kept term is in
TOP = 10               # ranks of part "term"
SCALE = 1_000_000_000
BLOCK_BYTES = 24 << 20
TILE, SLAB = 128, 4_096

BLOCK = "block long, groups array<long>, chunks array<string>, docs array<int>, triples binary"
COUNTS = "gid long, tid long, docs long, n long"


class Collision(Exception):
    """Two texts share a hash under this seed."""


def _checked(df: DataFrame, hash_col: str) -> DataFrame:
    """``df`` (a row for each text), if no hash stands twice."""
    if not df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").isEmpty():
        raise Collision
    return df


# ---------------------------------------------------------------- 1: chunks of each document

def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length as compressed int32 arrays; the first two are sorted, so differences are small."""
    pair = np.vstack([np.diff(columns[0], prepend=0), np.diff(columns[1], prepend=0), columns[2]]).astype("<i4")
    return pa.compress(pair.tobytes(), codec="zstd", asbytes=True) + len(columns[0]).to_bytes(8, "little")


def _unpacked(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[-8:], "little")
    a, b, c = np.frombuffer(pa.decompress(data[:-8], 12 * n, codec="zstd"), "<i4").reshape(3, n).astype(np.int64)
    return [np.cumsum(a), np.cumsum(b), c]


def _block(block: int, rows: pa.Table) -> pa.RecordBatch:
    """One row: the distinct chunks of some documents and, per document and chunk, its count."""
    text = pc.ascii_trim_whitespace(rows["text"].combine_chunks())
    if text.nbytes > 1 << 30:
        text = text.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(text)
    coded = lists.flatten().dictionary_encode()
    chunks, size = coded.dictionary.cast(pa.string()), max(len(coded.dictionary), 1)
    key = np.repeat(np.arange(len(lists), dtype=np.int64) * size, np.diff(lists.offsets.to_numpy()))
    key += coded.indices.to_numpy(zero_copy_only=False)
    del text, lists, coded
    key.sort()
    start = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(start, append=len(key))
    doc, code = np.divmod(key[start], size)
    if (none := pc.index(chunks, "").as_py()) >= 0:      # a text without words
        doc, code, count = (x[code != none] for x in (doc, code, count))

    def one(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    docs = np.bincount(code, minlength=len(chunks)).astype(np.int32)
    out = pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), one(rows["gid"].combine_chunks()), one(chunks), one(pa.array(docs)),
         pa.array([_packed([doc, code, count])], pa.binary())], ["block", "groups", "chunks", "docs", "triples"])
    del key, start, doc, code, count
    pa.default_memory_pool().release_unused()
    return out


def cleaned(docs: DataFrame) -> DataFrame:
    d = pick(docs, text="string", lang="string", source="string")
    return d.select(*[F.coalesce(c, F.lit("")).alias(c) for c in d.columns])


def group_names(d: DataFrame, seed: int) -> DataFrame:
    """lang, source, gid of every group that occurs."""
    names = d.select("lang", "source").distinct().withColumn("gid", F.xxhash64(F.lit(seed), "lang", "source"))
    return _checked(written(names, "groups"), "gid")


def blocks(d: DataFrame, seed: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Chunk counts of all documents, packed in blocks of about ``block_bytes`` of text (a longer text is a block of its own)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= block_bytes or at < batch.num_rows:
                    yield _block(block, pa.Table.from_batches(held))
                    block, held, size = block + 1, [], 0
        if held:
            yield _block(block, pa.Table.from_batches(held))

    rows = d.select("text", F.xxhash64(F.lit(seed), "lang", "source").alias("gid"))
    return written(rows.mapInArrow(run, BLOCK), "chunk-blocks")


# ---------------------------------------------------------------- 2: terms of each distinct chunk

def chunk_terms(found: DataFrame, seed: int = 0, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(of, code, tid): the possible kept terms in the chunks of every block, a row for each occurrence in the chunk; and
    (tid, term).  Each distinct chunk is cut once."""
    hashed = F.xxhash64(F.lit(seed), "chunk")
    cut = (found.select(F.explode(F.arrays_zip("chunks", "docs")).alias("x"))
           .groupBy(F.col("x.chunks").alias("chunk")).agg(F.sum("x.docs").alias("docs"))
           .select(hashed.alias("cid"), "docs", F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0)).alias("terms")))
    cut = written(cut.withColumn("terms", F.transform("terms", lambda t: F.translate(t, UPPER, LOWER))), "chunks")
    _checked(cut, "cid")
    terms = (cut.select("docs", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("docs").alias("bound"))
             .where(F.col("bound") >= least).select("term"))
    terms = written(terms.withColumn("tid", F.monotonically_increasing_id()), "terms")      # numbered once, when written
    known = written(cut.select("cid", F.explode("terms").alias("term")).join(terms, "term").select("cid", "tid"), "chunk-terms")
    rows = found.select(F.col("block").alias("of"), F.posexplode("chunks").alias("code", "chunk")).select("of", "code", hashed.alias("cid"))
    return rows.join(known, "cid").select("of", "code", "tid"), terms


# ---------------------------------------------------------------- 3: documents and occurrences of a block's terms

def _block_terms(data: pa.Table, terms: pa.Table) -> pa.Table:
    """Per group and term of a block: documents that have it, and its occurrences."""
    schema = pa.schema([(c, pa.int64()) for c in ("gid", "tid", "docs", "n")])
    if not data.num_rows or not terms.num_rows:
        return schema.empty_table()
    doc, code, count = _unpacked(data["triples"][0].as_py())
    tids, term = np.unique(terms["tid"].to_numpy(), return_inverse=True)
    owner = terms["code"].to_numpy().astype(np.int64)
    # terms of each chunk, in chunk order; repeats inside a chunk stay and are added up below
    order = np.argsort(owner, kind="stable")
    owner, term = owner[order], term[order]
    first = np.searchsorted(owner, np.arange(int(code.max()) + 2))
    per = (first[1:] - first[:-1])[code]
    at = np.repeat(first[code] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(int(per.sum()))
    pairs, n = _added(np.repeat(doc, per) * len(tids) + term[at], np.repeat(count, per))
    doc, term = pairs // len(tids), pairs % len(tids)
    gids, group_of = np.unique(data["groups"].combine_chunks().flatten().to_numpy(), return_inverse=True)
    key = group_of[doc] * len(tids) + term
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    key = key[start]
    return pa.table([gids[key // len(tids)], tids[key % len(tids)], np.diff(start, append=len(n)).astype(np.int64),
                     np.add.reduceat(n, start) if len(start) else n], schema=schema)


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their ``n``."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    return key[start], np.add.reduceat(n, start) if len(start) else n


def term_counts(found: DataFrame, back: DataFrame) -> DataFrame:
    """gid, tid, docs, n of all blocks together."""
    by_block = (found.select("block", "groups", "triples").groupBy("block").cogroup(back.groupBy("of"))
                .applyInArrow(_block_terms, COUNTS))
    return written(by_block.groupBy("gid", "tid").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "term-counts")


# ---------------------------------------------------------------- 4 and 5: kept terms, probabilities, divergences

def _p(n: str) -> str:
    return f"1 + (CAST({SCALE} AS DECIMAL(38,0)) * ({n} + 2)) div d"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def with_p(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``counts`` with p; ``groups`` has lang, source, d = N + 2 V."""
    return counts.join(groups.select("lang", "source", "d"), ["lang", "source"]).withColumn("p", F.expr(_p("n")))


def divergences(docs: DataFrame, block_bytes: int = BLOCK_BYTES, tile: int = TILE, slab: int = SLAB) -> DataFrame:
    """lang, source, part, item, value, rank."""
    seed = 0
    while True:
        try:
            return _divergences(cleaned(docs), seed, block_bytes, tile, slab)
        except Collision:
            seed += 1


def _divergences(d: DataFrame, seed: int, block_bytes: int, tile: int, slab: int) -> DataFrame:
    names, found = group_names(d, seed), blocks(d, seed, block_bytes)
    back, terms = chunk_terms(found, seed)
    all_counts = term_counts(found, back).join(names, "gid")
    kept = written(all_counts.groupBy("lang", "tid").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST)
                   .select("lang", "tid"), "kept-terms")
    counts = written(all_counts.join(kept, ["lang", "tid"]).select("lang", "source", "tid", "n"), "kept-counts")
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = (names.select("lang", "source").join(v, "lang", "left").join(n, ["lang", "source"], "left").na.fill(0, ["v", "n"])
              .withColumn("d", F.expr("CAST(n AS DECIMAL(38,0)) + 2 * v")))
    groups = written(groups, "group-sums")
    ps = written(with_p(counts, groups), "probabilities")

    langs = groups.groupBy("lang").agg(F.sum("d").alias("sum_d"), F.max("v").alias("v"), F.count(F.lit(1)).alias("s"))
    # N of the language is the sum over its sources
    whole = langs.select("lang", F.expr("sum_d - 2 * v * (s - 1)").cast("decimal(38,0)").alias("d"))
    q = counts.groupBy("lang", "tid").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "tid", F.expr(_p("n")).alias("q"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    apart = (ps.join(q, ["lang", "tid"]).where("p > q").join(terms, "tid")
             .select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
             .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP))
    pairs = pair_values(ps, groups, tile, slab).withColumn("rank", F.row_number().over(by))

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")

    return part(pairs, "pair").unionByName(part(apart, "term"))


def pair_values(ps: DataFrame, groups: DataFrame, tile: int = TILE, slab: int = SLAB) -> DataFrame:
    """lang, source, item (every other source of the language), value: f summed over all kept terms.

    A term that neither source has counts f of their two least probabilities, so the matrices hold only terms that occur.
    """
    size = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("v").alias("v")).select(
        "lang", F.expr(f"(s + {tile - 1}) div {tile}").alias("tiles"), F.expr(f"greatest(1, (v + {slab - 1}) div {slab})").alias("slabs"))

    def paired(df: DataFrame) -> DataFrame:
        """Each row once for every pair of tiles (i <= j) that its source's tile is in."""
        own = F.pmod(F.xxhash64("source"), F.col("tiles"))
        return (df.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
                .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))

    sides = paired(groups.join(size, "lang")).withColumn("slab", F.explode(F.expr("sequence(0L, slabs - 1)"))).select(
        "lang", "i", "j", "slab", "own", "source", "v",
        F.expr(f"CASE WHEN v > 0 THEN {_p('0')} ELSE 1 END").cast("long").alias("p0"))
    cells = paired(ps.join(size, "lang")).select("lang", "i", "j", F.pmod("tid", F.col("slabs")).alias("slab"),
                                                 "source", "tid", F.col("p").cast("long").alias("p"))
    key = ["lang", "i", "j", "slab"]
    sums = sides.groupBy(*key).cogroup(cells.groupBy(*key)).applyInArrow(
        _tile, "lang string, source string, item string, v long, f0 long, present long, value long")
    return (sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("s"), F.max("f0").alias("f0"), F.max("v").alias("v"),
                                                       F.sum("present").alias("present"))
            .select("lang", "source", "item", F.expr("s + (v - present) * f0").alias("value")))


def _tile(sides: pa.Table, cells: pa.Table) -> pa.Table:
    """Sums of f over the terms of one slab, for all pairs of sources of two tiles."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("v", pa.int64()), ("f0", pa.int64()),
                        ("present", pa.int64()), ("value", pa.int64())])
    if not sides.num_rows:
        return schema.empty_table()
    names = sides["source"].to_pylist()
    place = {s: k for k, s in enumerate(names)}
    base, own = (sides[c].to_numpy() for c in ("p0", "own"))
    i, j = sides["i"][0].as_py(), sides["j"][0].as_py()
    terms, column = np.unique(cells["tid"].to_numpy(), return_inverse=True)
    p = np.repeat(base[:, None], len(terms), 1)              # a row for each source
    sources = cells["source"].combine_chunks().dictionary_encode()
    row = np.array([place[s] for s in sources.dictionary.to_pylist()], np.int64)
    p[row[sources.indices.to_numpy(zero_copy_only=False)], column] = cells["p"].to_numpy()

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    out = []
    right = np.flatnonzero(own == j)
    for a in np.flatnonzero(own == i):
        value = f(p[a], p[right]).sum(1)
        f0 = f(base[a], base[right])
        for b, x, y in zip(right, value.tolist(), f0.tolist()):
            if a != b:
                out.append((names[a], names[b], y, x))
                if i != j:
                    out.append((names[b], names[a], y, x))
    n = len(out)
    a, b, f0, value = zip(*out) if out else ((), (), (), ())
    return pa.table([pa.array(sides["lang"][:1].to_pylist() * n, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()),
                     pa.array(sides["v"][:1].to_pylist() * n, pa.int64()), pa.array(f0, pa.int64()),
                     pa.array([len(terms)] * n, pa.int64()), pa.array(value, pa.int64())], schema=schema)
