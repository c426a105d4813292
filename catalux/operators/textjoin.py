"""Substring join: every (query, row) pair where a text column ILIKE '%q%'.

The reference runs one ``ILIKE`` scan per request (with a trigram index
under it).  A table of queries against a table of rows would be a cross
product, so this is planned as an exact n-gram index join instead:

1. a gram index of the rows: postings (n, gram, salt, key) for n = 1, 2, 3, 12 over
   lower-cased text and the frequency of every gram.  The longest grams serve long
   patterns: how many rows hold a short gram grows with the table, and candidates
   by short grams with the square of it.  ``GramIndex.build``
   writes it, partitioned by (n, bucket of the gram), for any number of
   calls; without one, the postings of the call's own grams are derived
   from the rows;
2. each query keeps the longest literal run of its pattern ('%' and '_' are
   wildcards) and picks that run's two rarest grams (of the longest size that
   the run has).  Only grams that some query has are looked up or counted, and
   equal patterns are looked up once;
3. an equi-join on (gram, salt) and an intersection yield candidates - a
   superset of the answer, since a match must contain every gram of its
   literal run.  The salt spreads a gram that many rows have over tasks;
4. candidates are verified with the real ``ilike`` on the row.

Queries with no literal character match every row whose text is as long as
they ask ('_' is one character, '%' any number); they are joined on that
length, and their output is the answer itself, cut by ``limit_per_query``
when given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.operators.filters import like_pattern
from catalux.session import shared_path, spread, stored

SIZES = (1, 2, 3, 12)
SALTS = 8
BUCKETS = 16
PICKS = 2
WORTH = 4           # a further gram is looked up only where at most so many times the rows of the rarest one hold it
FEW = 100_000       # grams (of some 30 bytes) that are broadcast to the postings
BITS = 1 << 24      # of more grams a bitmap is broadcast (at most BITS / 64 rows of 16 bytes), whatever their number


def grams(text: Column, n: int) -> Column:
    """Every window of ``n`` characters of the lower-cased text."""
    t = F.lower(text)
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)),
                                                 lambda i: F.substring(t, i, n))).otherwise(
        F.array().cast("array<string>"))


def postings(rows: DataFrame, key: str, text_cols, sizes) -> DataFrame:
    """Distinct (n, gram, _rk) over the given text columns.

    Grams are de-duplicated within each row before the explode, so they need
    no shuffle (keys are unique per row).  The rows are dealt over all tasks
    before: a row makes some hundred grams, and few narrow files are few tasks.
    """
    def sized(n: int) -> Column:
        found = F.concat(*[F.coalesce(grams(F.col(c), n), F.array().cast("array<string>")) for c in text_cols])
        return F.transform(F.array_distinct(found), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    per_row = [sized(n) for n in sizes]
    rows = spread(rows.select(*dict.fromkeys([key, *text_cols])), key)
    return rows.select(F.col(key).alias("_rk"), F.explode(F.concat(*per_row)).alias("_g")).select("_g.n", "_g.gram", "_rk")


def _salt(key: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


@dataclass(frozen=True)
class GramIndex:
    """Postings and frequencies of a table's texts; serves any substring join over (some of) those texts."""

    postings: DataFrame        # n, bucket, gram, salt, _rk
    frequencies: DataFrame     # n, bucket, gram, df
    salts: int
    buckets: int

    @staticmethod
    def build(rows: DataFrame, key: str, text_cols, path: str | None = None, salts: int = SALTS,
              buckets: int = BUCKETS) -> "GramIndex":
        """Write the index of ``rows`` under ``path`` (default: a fresh place in the shared folder).

        A join reads only the folders of its queries' grams.  ``buckets`` and ``salts`` grow with the table: about
        100 MB of postings a file is a good size.
        """
        path = path or shared_path(rows.sparkSession, "gram-index")
        p = postings(rows, key, text_cols, SIZES).withColumn("salt", _salt("_rk", salts)).withColumn(
            "bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        p.repartition("n", "bucket", "salt").write.partitionBy("n", "bucket").parquet(f"{path}/postings")
        GramIndex._read(rows.sparkSession, f"{path}/postings").groupBy("n", "bucket", "gram").agg(
            F.count(F.lit(1)).alias("df")).write.partitionBy("n", "bucket").parquet(f"{path}/frequencies")
        return GramIndex.load(rows.sparkSession, path, salts, buckets)

    @staticmethod
    def _read(spark, path: str) -> DataFrame:
        return spark.read.parquet(path)

    @staticmethod
    def load(spark, path: str, salts: int = SALTS, buckets: int = BUCKETS) -> "GramIndex":
        return GramIndex(GramIndex._read(spark, f"{path}/postings"), GramIndex._read(spark, f"{path}/frequencies"), salts, buckets)


def _literal_run(pattern: Column) -> Column:
    """Longest run of the lower-cased pattern between wildcards (first one on ties)."""
    pieces = F.split(F.lower(pattern), "[%_]")
    return F.aggregate(pieces, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))


def _size(lit: Column) -> Column:
    """The gram size that a literal run is looked up with; 0 for an empty one."""
    n = F.length(lit)
    return reduce(lambda acc, k: F.when(n >= k, F.lit(k)).otherwise(acc), SIZES, F.lit(0))


def _pieces(lit: Column) -> Column:
    """The grams of a literal run, as structs (n, gram)."""
    n = _size(lit)
    found = reduce(lambda acc, k: F.when(n == k, grams(lit, k)).otherwise(acc), SIZES, F.array().cast("array<string>"))
    return F.transform(found, lambda g: F.struct(n.alias("n"), g.alias("gram")))


def _likely(own: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``own`` without most of what is not in ``wanted``, and nothing of it shuffled; an exact join must follow."""
    def bit(df: DataFrame) -> DataFrame:
        return df.withColumn("_bit", F.pmod(F.xxhash64(*on), F.lit(BITS))).withColumn("_word", F.shiftright("_bit", 6))

    place = "cast(_bit & 63 as int)"
    words = bit(wanted).groupBy("_word").agg(F.bit_or(F.expr(f"shiftleft(1L, {place})")).alias("_mask"))
    return (bit(own).join(F.broadcast(words), "_word").where(F.expr(f"(shiftright(_mask, {place}) & 1L) = 1L"))
            .drop("_bit", "_word", "_mask"))


def candidates(qs: DataFrame, qid: str, rows: DataFrame, key: str, text_cols, index: GramIndex | None, sizes) -> DataFrame:
    """(qid, _rk): rows that hold the rarest grams (PICKS at most) of the query's literal runs ``_lit`` and ``_lit2``.

    A query with a gram that no row holds has none, and looks nothing up: its other gram may be one that all rows hold.
    For the same reason a second gram that is much more frequent than the rarest is left to the verification.
    """
    pieces = F.array_distinct(F.concat(_pieces(F.col("_lit")), _pieces(F.col("_lit2"))))
    asked = qs.where(F.length("_lit") > 0).select(qid, F.explode(pieces).alias("_g")).select(qid, "_g.n", "_g.gram")
    salts = index.salts if index else SALTS
    on = ["n", "gram"]
    if index:
        on = ["n", "bucket", "gram"]
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(index.buckets)).cast("int"))
    wanted = asked.select(*on).distinct()
    if index:
        own, freq = index.postings, index.frequencies.join(wanted, on, "left_semi")
    else:
        own = postings(rows, key, text_cols, sizes)
        wanted = stored(wanted, "grams")
        # made once, for the frequencies and for the last join, and cut down before any shuffle
        own = (own.join(F.broadcast(wanted), on, "left_semi") if wanted.count() <= FEW else _likely(own, wanted, on))
        own = stored(own.withColumn("salt", _salt("_rk", salts)), "postings")
        freq = own.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy(qid).orderBy(F.asc("df"), F.asc("gram"))
    picked = (asked.join(freq, on, "left").withColumn("df", F.coalesce("df", F.lit(0)))
              .withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= PICKS)
              .withColumn("_least", F.min("df").over(Window.partitionBy(qid)))
              .where((F.col("_least") > 0) & (F.col("df") <= F.col("_least") * WORTH)).drop("_least"))
    # few are left of queries that match little
    picked = stored(picked, "picked-grams")
    need = picked.groupBy(qid).agg(F.count(F.lit(1)).alias("_need"))
    few = not index and picked.count() <= FEW
    if not index:     # most of the asked grams are not picked
        kept = picked.select(*on).distinct()
        own = own.join(F.broadcast(kept) if few else kept, on, "left_semi")
    if few:
        met = own.join(F.broadcast(picked.select(qid, *on)), on)
    else:
        probe = picked.select(qid, *on, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        met = own.join(probe, [*on, "salt"])
    met = met.groupBy(qid, "_rk").agg(F.count(F.lit(1)).alias("_met"))
    return met.join(need, qid).where(F.col("_met") == F.col("_need")).select(qid, "_rk")


def contains_join(queries: DataFrame, qid: str, q: str, rows: DataFrame, key: str, text_cols,
                  extra_pred=None, limit_per_query: int | None = None, order=None, index: GramIndex | None = None,
                  also: str | None = None) -> DataFrame:
    """Pairs (query columns..., row columns...) where any text column ILIKE '%q%' (and ``extra_pred``).

    ``order`` (Columns over row columns) with ``limit_per_query`` keeps the
    first rows per query after verification.  ``index``: a gram index of the
    rows over (at least) ``text_cols``.  ``also``: a query column with a second
    pattern that ``extra_pred`` demands of the same texts; its grams narrow the
    candidates as those of ``q`` do.
    """
    text_cols, own = list(text_cols), [c for c in queries.columns if c != qid]
    asked_by = queries.where(F.col(q).isNotNull() & (F.col(q) != "")).withColumn("_pid", F.md5(F.to_json(F.struct(*own))))
    # equal patterns have equal answers
    found = _contains(asked_by.select("_pid", *own).distinct(), "_pid", q, rows, key, text_cols, extra_pred, limit_per_query, order,
                      index, also)
    return _limit(asked_by.select(qid, "_pid").join(found, "_pid").drop("_pid"), qid, limit_per_query, order)


def _contains(queries: DataFrame, qid: str, q: str, rows: DataFrame, key: str, text_cols, extra_pred, limit_per_query, order,
              index: GramIndex | None, also: str | None) -> DataFrame:
    qs = queries.withColumn("_lit", _literal_run(F.col(q))).withColumn(
        "_lit2", F.coalesce(_literal_run(F.col(also)), F.lit("")) if also else F.lit(""))
    qs = qs.withColumn("_llen", F.length("_lit"))
    # one small action: which gram sizes and whether the wildcard-only branch are needed
    has = {n: (_size(F.col("_lit")) == n) | ((_size(F.col("_lit2")) == n) & F.lit(n > 0)) for n in (0, *SIZES)}
    need = qs.agg(*[F.max(c.cast("int")).alias(f"n{n}") for n, c in has.items()]).first()
    sizes = [n for n in SIZES if need[f"n{n}"]] or [SIZES[-1]]
    # 1) queries with a literal run: gram index join
    cand = candidates(qs, qid, rows, key, text_cols, index, sizes)
    pairs = cand.join(qs.drop("_lit", "_lit2", "_llen"), qid).join(rows, F.col("_rk") == rows[key]).drop("_rk")
    pattern = like_pattern(F.col(q))
    verify = reduce(lambda a, b: a | b, [F.ilike(F.col(c), pattern) for c in text_cols])
    if extra_pred is not None:
        verify = verify & extra_pred
    found = pairs.where(verify)
    # 2) patterns of wildcards only: a text matches by its length alone ('_' asks for one character each), so they
    # are joined on the length they need, one row a needed length and text; the limit is applied like any other
    wild = qs.where(F.col("_llen") == 0).drop("_lit", "_lit2", "_llen")
    if not need["n0"]:
        return _limit(found, qid, limit_per_query, order)
    wild = wild.withColumn("_need", F.length(F.col(q)) - F.length(F.replace(F.col(q), F.lit("_"), F.lit(""))))
    asked = wild.select("_need").distinct()
    longest = F.greatest(*[F.coalesce(F.length(F.col(c)), F.lit(-1)) for c in text_cols], F.lit(-1))
    rows_ok = rows.withColumn("_len", longest).where(F.col("_len") >= 0)
    if extra_pred is None and limit_per_query is not None and order is not None:
        # of each needed length only the first rows can be answers: one small frame each, never queries x rows
        firsts = [rows_ok.where(F.col("_len") >= r["_need"]).orderBy(*order).limit(limit_per_query)
                  .withColumn("_need", F.lit(r["_need"])) for r in asked.collect()]   # distinct counts of '_' in a query
        wild_pairs = wild.join(reduce(lambda a, b: a.unionByName(b), firsts), "_need").drop("_need", "_len")
    else:
        top = int(asked.agg(F.max("_need")).first()[0])
        met = rows_ok.withColumn("_need", F.explode(F.sequence(F.lit(0), F.least(F.col("_len"), F.lit(top)))))
        wild_pairs = wild.join(met.join(asked, "_need", "left_semi"), "_need").drop("_need", "_len")
        if extra_pred is not None:      # it may ask about the query as well as the row
            wild_pairs = wild_pairs.where(extra_pred)
    return _limit(found.unionByName(wild_pairs), qid, limit_per_query, order)


def _limit(out: DataFrame, qid: str, limit_per_query, order) -> DataFrame:
    if limit_per_query is None or order is None:
        return out
    w2 = Window.partitionBy(qid).orderBy(*order)
    return out.withColumn("_lr", F.row_number().over(w2)).where(F.col("_lr") <= limit_per_query).drop("_lr")
