"""Near-duplicate detection (operator 2): circulant MinHash, banding, exact Jaccard verification.

Two permutations make all signature coordinates: the first scrambles the shingle universe once, the
second is applied to the scrambled value shifted circularly by 0, 1, 2, ... (Li and Li, C-MinHash).

Steps: (1) documents with equal shingle sets form a class, and one row a class goes on; (2) in each
band bucket all members are paired with the smallest one, never with each other; the pairs are
confirmed on full shingle sets and connected; (3) buckets whose members are not yet all in one component
are compared block against block inside tasks, large components only against others: a pair across components goes on only if its signatures allow
the threshold and so does an exact bound, the shingles of either that are not rare among these members plus
the rare ones that both have; what goes on is confirmed on full sets as well.  No list of members, links or components
reaches the driver, and no bucket is capped.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and are kept; a row
without doc_id may be linked, but never names a component while one with an id is there; classes whose smallest
doc_id is the same count as one document, and a link of any of them links it.  Only doc_id and the text are read.
Equality of shingles is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalux.llm.components import components
from catalux.llm.tables import likely_members, pick, with_likely, written
from catalux.llm.textnp import U64, mix, shingle_hashes, word_hashes

BANDS, ROWS = 28, 4          # a pair at 0.8 shares no band with probability (1 - 0.8^4)^28 = 4e-7
THRESHOLD_PERCENT = 80
MARGIN = 0.18                # 4.8 standard errors of an estimate from 112 coordinates at 0.8
BLOCK = 512
PART = 4_000                 # rows of block pairs that one call of the comparison takes, about
RARE = 64                    # a shingle of at most so many open members is rare
NO_ID = 0x6A09E667F3BCC908   # the node of a class without any doc_id is its k1 with these bits turned


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit integers (in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(shingles: np.ndarray, length: int) -> np.ndarray:
    """``length`` coordinates for a set of shingle hashes; their upper half is the scrambled universe of 2^32."""
    scrambled = (shingles >> U64(32)).astype(np.uint32)
    shifts = np.arange(length, dtype=np.uint32)[:, None]
    out = np.full(length, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(scrambled), 512):
        np.minimum(out, second_permutation(scrambled[None, i: i + 512] + shifts).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set key (k1, k2), n_shingles and signature of every text."""
    length = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            k1, k2, count = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
            sig = [b""] * n
            for i, words, first in word_hashes(batch.column("text")):
                for r in range(len(first) - 1):
                    s = np.unique(shingle_hashes(words[first[r]: first[r + 1]], size))
                    if len(s):
                        k1[i + r], k2[i + r], count[i + r] = s.sum(), mix(s ^ U64(0x5851F42D4C957F2D)).sum(), len(s)
                        sig[i + r] = circulant_signature(s, length).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                 pa.array(count), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "k1", "k2", "n_shingles", "sig"])

    return (pick(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
            .mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, n_shingles long, sig binary"))


def _sets_of(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(no, node, set) of the wanted classes, one row each whatever rows repeat; only their texts are shuffled, as sets."""
    text = pick(docs, doc_id="long", text="string")
    rows = likely_members(text.where("doc_id is not null"), "doc_id", wanted.select("node")).unionByName(
        text.where("doc_id is null").distinct())
    key = ["node", "k1", "k2"]
    return written(_sets(rows, size).join(wanted, key).dropDuplicates(key).select("no", "node", "set"), "sets")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
            .select("a", "b", "set_a", "set_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("set_a"), batch.column("set_b")
            ok = np.zeros(batch.num_rows, dtype=bool)
            for r in range(batch.num_rows):
                x, y = np.frombuffer(sa[r].as_buffer(), np.uint64), np.frombuffer(sb[r].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both_sorted = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both_sorted[1:] == both_sorted[:-1]).sum())
                ok[r] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return written(both.mapInArrow(check, "a long, b long").distinct(), "links")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, k1, k2, set): sorted distinct shingle hashes of each text and their class; a task gives a class of a node once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            doc, out = batch.column("doc_id").to_pylist(), []
            for i, words, first in word_hashes(batch.column("text")):
                for r in range(len(first) - 1):
                    s = np.unique(shingle_hashes(words[first[r]: first[r + 1]], size))
                    if not len(s):
                        continue
                    k1, k2 = s.sum(), mix(s ^ U64(0x5851F42D4C957F2D)).sum()
                    node = int((k1 ^ U64(NO_ID)).view(np.int64)) if doc[i + r] is None else doc[i + r]
                    key = (node, int(k1.view(np.int64)), int(k2.view(np.int64)))
                    if key not in met:
                        met.add(key)
                        out.append((*key, s.tobytes()))
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["node", "k1", "k2", "set"])

    return rows.mapInArrow(run, "node long, k1 long, k2 long, set binary")


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """(no, own, rare): how many shingles of each set no other has, and those that 2 to RARE of the sets have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, blob = batch.column("no"), batch.column("set")
            for r in range(0, batch.num_rows, 256):
                parts = [np.frombuffer(x.as_buffer(), np.int64) for x in blob.slice(r, 256)]
                who = np.repeat(no.slice(r, 256).to_numpy(), [len(x) for x in parts])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate(parts))], ["no", "shingle"])

    each = sets.mapInArrow(run, "no long, shingle long")
    seen = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("no"))
    # a shingle of one set is counted there; only those of several sets are needed one by one
    split = written(seen.where("n = 1").groupBy("no").agg(F.count(F.lit(1)).alias("own")).select(
        "no", "own", F.lit(None).cast("long").alias("shingle")).unionByName(
        seen.where((F.col("n") > 1) & (F.col("n") <= RARE)).select(
            F.lit(None).cast("long").alias("no"), F.lit(None).cast("long").alias("own"), "shingle")), "rare")
    several = split.where("shingle is not null").select("shingle")
    # a list is no longer than its document; half a hash suffices for an upper bound of what two sets share
    lists = (likely_members(each, "shingle", several).join(several, "shingle").groupBy("no")
             .agg(F.array_sort(F.collect_list(F.shiftright("shingle", 32).cast("int"))).alias("rare")))
    return split.where("no is not null").select("no", "own").join(lists, "no", "full")


def _open_pairs(sig: np.ndarray, label: np.ndarray, n: np.ndarray, rare: list, common: np.ndarray, band: int,
                x: np.ndarray, y: np.ndarray, need: float, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of places (one of x, one of y) that may be links across components and share no earlier band."""
    same_block = x is y
    for k, i in enumerate(x.tolist()):
        other = y[k + 1:] if same_block else y
        other = other[label[other] != label[i]]
        if not len(other):
            continue
        equal = sig[other] == sig[i]
        other, equal = other[(hit := equal.sum(axis=1) >= need)], equal[hit]
        first = equal.reshape(len(other), -1, ROWS).all(axis=2).argmax(axis=1) if len(other) else other
        for j in other[first == band].tolist():
            # |A and B| >= t (|A| + |B|) / (1 + t) for a link
            least = percent * (n[i] + n[j]) / (100 + percent)
            most = min(common[i], common[j])
            if most + min(len(rare[i]), len(rare[j])) >= least and (
                    most >= least or most + int(np.isin(rare[i], rare[j]).sum()) >= least):
                yield i, j


def _block_pairs(rows: DataFrame) -> tuple[DataFrame, int]:
    """Members of open buckets, once for each pair of blocks (i, j) to be compared, c being their own; and the number of these rows.

    A component with BLOCK members or more in a bucket has blocks of its own there, which never meet each other;
    the members of all smaller ones share the first ``small`` blocks.
    """
    sizes = written(rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "own", F.when(F.col("n") >= BLOCK, F.ceil(F.col("n") / BLOCK))), "sizes")
    buckets = written(sizes.groupBy("band").agg(
        F.ceil(F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(0)) / BLOCK).alias("small"),
        F.sum(F.coalesce("own", F.lit(0))).alias("large")), "blocks")
    before = Window.partitionBy("band").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.where("own is not null").select(
        "band", "label", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("low"))
    low, hash_ = F.col("small") + F.col("low"), F.xxhash64("no")
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("small") + F.col("large") - 1),
                   lambda k: F.col("own").isNull() | (k < low) | (k >= low + F.col("own")))
    placed = rows.join(buckets, "band").join(ranges, ["band", "label"], "left").withColumn(
        "c", F.when(F.col("own").isNull(), F.pmod(hash_, F.col("small"))).otherwise(low + F.pmod(hash_, F.col("own"))))
    spread = placed.select("band", "at", "no", "node", "label", "c", F.explode(met).alias("k"))
    copies = sizes.join(buckets, "band").agg(F.sum(
        F.col("n") * (F.col("small") + F.col("large") - F.coalesce("own", F.lit(0))))).first()[0]
    return (spread.withColumn("i", F.least("c", "k")).withColumn("j", F.greatest("c", "k")).drop("k"), int(copies or 0))


def _pairs_across(rows: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of members of one bucket that are in different components and may be links."""
    need = (percent / 100 - MARGIN) * BANDS * ROWS

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["band", "i", "j"], kind="stable").reset_index(drop=True)
        sig = np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(len(frame), -1)
        label, n, node = (frame[c].to_numpy() for c in ("label", "n_shingles", "node"))
        key = frame[["band", "i", "j"]].to_numpy()
        c, at = frame["c"].to_numpy(), frame["at"].to_numpy()
        none = np.zeros(0, np.int32)
        rare = [none if v is None else np.asarray(v, np.int32) for v in frame["rare"]]
        common = n - frame["own"].fillna(0).to_numpy().astype(np.int64) - np.array([len(v) for v in rare], dtype=np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        out = []
        for a, z in zip(cut, cut[1:]):
            place = np.arange(a, z)
            x = place[c[a:z] == key[a, 1]]
            y = x if key[a, 1] == key[a, 2] else place[c[a:z] == key[a, 2]]
            out += _open_pairs(sig, label, n, rare, common, int(at[a]), x, y, need, percent)
        pair = node[np.array(out, dtype=np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": pair.max(axis=1), "b": pair.min(axis=1)})

    spread, copies = _block_pairs(rows)
    return (spread.join(about, "no").withColumn("part", F.pmod(F.xxhash64("band", "i", "j"), F.lit(max(1, copies // PART))))
            .groupBy("part").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (plus text_hash and the set key k1, k2) of every row of ``docs``."""
    signed = written(signatures(docs, size), "signatures")
    classes = written(
        signed.where("n_shingles > 0").groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
        .withColumn("node", F.coalesce("doc_id", F.col("k1").bitwiseXOR(F.lit(NO_ID))))
        # a node may have several classes (texts under one doc_id): sets, signatures and bounds go by the class
        .withColumn("no", F.monotonically_increasing_id()), "classes")
    bands = classes.select("no", "node", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda j: F.xxhash64(j, F.substring(F.col("sig"), j * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("at", "band"))
    buckets = written(bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members"))
                      .where("members > 1"), "buckets")
    shared = written(bands.drop("no").join(buckets, "band"), "shared")
    star = written(shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "star")
    near = written(classes.select("no", "node", "k1", "k2").join(
        star.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "wanted")
    sets = _sets_of(near, docs, size)
    links = _confirmed(star, sets, percent)
    found = components(links)
    labelled = shared.join(found, "node", "left").select(
        "band", F.coalesce("component", "node").alias("label"))
    mixed = written(labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"))
                    .where("x <> y").select("band"), "mixed")
    rest = written(likely_members(bands, "band", mixed).join(mixed, "band").join(found, "node", "left").select(
        "band", "at", "no", "node", F.coalesce("component", "node").alias("label")), "open")
    compared = rest.select("no").distinct()
    rare = _rare_shingles(sets.join(compared, "no", "left_semi"))
    about = written(classes.select("no", "sig", "n_shingles").join(compared, "no", "left_semi").join(rare, "no", "left"), "about")
    more = written(_pairs_across(rest, about, percent).join(star, ["a", "b"], "left_anti"), "across")
    if not more.isEmpty():
        links = links.unionByName(_confirmed(more, sets, percent))
        found = components(links)
    named = written(classes.join(found, "node", "left").select(
        "k1", "k2", "doc_id", F.coalesce("component", "node").alias("component")), "named")
    # a component goes by its smallest doc_id, which is its smallest node unless some class has none
    if named.where("doc_id is null").isEmpty():
        named = named.select("k1", "k2", F.col("component").alias("smallest"))
    else:
        smallest = named.groupBy("component").agg(F.min("doc_id").alias("smallest"))
        named = named.join(smallest, "component").select("k1", "k2", "smallest")
    out = signed.drop("sig").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "k1", "k2")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates (that of the smallest doc_id), all columns unchanged.

    Texts without words stay.  Of rows that share that doc_id, or of a group without any doc_id, the smallest text hash stays.
    """
    near = written(near_duplicates(docs, size, percent).where("n_shingles > 0"), "near")
    group = [F.col("component_id").alias("g0"), *[F.when(F.col("component_id").isNull(), F.col(k)).alias(f"g_{k}") for k in ("k1", "k2")]]
    tied = written(near.where("kept").groupBy(*group).agg(F.min("text_hash").alias("first_hash"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").drop("n"), "tied")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("h0", "g0"), ("h_k1", "g_k1"), ("h_k2", "g_k2"))]
    judged = near.select("doc_id", "text_hash", "kept", *[g.alias(h) for g, h in zip(group, ("h0", "h_k1", "h_k2"))]).join(
        tied, same[0] & same[1] & same[2], "left")
    special = written(judged.where("not kept or first_hash is not null").groupBy("doc_id", "text_hash").agg(
        F.max(F.col("kept") & (F.col("text_hash") == F.col("first_hash"))).alias("s_stays"))
        .select("s_stays", F.col("doc_id").alias("s_doc"), F.col("text_hash").alias("s_text"),
                F.xxhash64("doc_id", "text_hash").alias("s_key")), "special")
    # positions for names: any column of ``docs`` may stay
    names = [f"c{k}" for k in range(len(docs.columns))]
    doc, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*names).select("*", doc.cast("long").alias("d_id"), F.xxhash64(text.cast("string")).alias("d_hash"))
    flagged = with_likely(rows.withColumn("d_row", F.xxhash64("d_id", "d_hash")), "d_row", special.select("s_key"), "d_likely")
    met = flagged.where("d_likely").join(special, (F.col("d_row") == F.col("s_key")) & F.col("d_id").eqNullSafe(F.col("s_doc"))
                                         & (F.col("d_hash") == F.col("s_text")), "left")
    return (flagged.where("not d_likely").select(*names)
            .unionByName(met.where("s_stays is null").select(*names))
            .unionByName(met.where("s_stays").dropDuplicates(["d_id", "d_hash"]).select(*names))).toDF(*docs.columns)
