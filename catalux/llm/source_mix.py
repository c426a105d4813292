"""Mixing sources to target weights (operator 13): entropy balancing, in Spark SQL expressions only.

A document's rate is how often the mix takes it.  Among all rates between 0 and ``CAP`` whose words come to the
target of every source, entropy balancing picks those closest to 1 in (bounded) relative entropy.  The solution is an
exponential tilt of a document's size s, with one multiplier m for each source:

    rate(s) = CAP / (1 + (CAP - 1) * exp(-m * s / scale))        (m = 0: rate 1)

The multipliers solve the convex dual, whose gradient is (words taken - target): Newton steps, kept inside a bracket,
each one aggregation over a histogram of (source, size), which is all that the rates depend on.  Terms are added as
decimals, so the sums, and with them reruns, do not depend on the order of rows.

Rates become whole copies in two moves.  (1) Each class of equal (source, size) gets whole copies by rounding the running
sum of expected copies in descending size: the words of a source are then off by at most half its largest document;
what is left is mended by single moves of the class that brings it nearest to zero.  (2) The copies of a class are dealt
evenly over its documents in the order of a hash of doc_id.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ...; they share all words by weight, a target stops at
CAP times the source's words and the excess is shared again by weight until none is above.

Defined results: null, empty and blank texts have size 0 and take 0 words; null is a source of its own, apart from '';
a source without words has target 0; every row comes back, rows of equal (doc_id, source, size) share their copies; null doc_ids
are allowed; an empty table gives no rows; only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalux.llm.sqltext import words
from catalux.llm.tables import pick, written
from catalux.operators.ranking import global_position

CAP = 3
WEIGHTS = (1, 2, 3)
STEPS = 60
NEAR = 1e-7            # the dual is solved when words are off by this share of the target, or by
WORD = 0.01            # this many words
MOVES = 12
FINE = 1_000_000       # expected copies are added in millionths
BINS = 64              # size bins an octave in the running sum
CHUNK = 4_096

EXACT = "decimal(38,9)"
WHOLE = "decimal(38,0)"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of every row; the texts are read here and nowhere else."""
    d = pick(docs, doc_id="long", source="string", text="string")
    return written(d.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """source, sid, source_size, target (double), full (the target is CAP times the size) of each source."""
    s = global_position(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.asc_nulls_last("source")], "sid")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = written(s.withColumn("weight", weight.cast("long")), "sources")
    total, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, share, full = int(total), int(weights), 0

    def above(rest: int, share: int) -> Column:
        return F.col("source_size").cast(WHOLE) * CAP * F.lit(share).cast(WHOLE) < F.lit(rest).cast(WHOLE) * F.col("weight")

    while True:     # the set of full sources only grows
        is_full = above(rest, share)
        n, held, left = s.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("source_size") * CAP)), F.lit(0)),
                              F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0))).first()
        if n == full:
            break
        rest, share, full = int(total) - int(held), int(left), n
    own = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(share, 1)))
    most = F.col("source_size") * F.lit(float(CAP))
    return written(s.select("source", "sid", "source_size", F.when(is_full, most).otherwise(own).alias("target"))
                   .withColumn("full", F.col("target") >= most), "targets")


def rate(multiplier: Column, size: Column, scale: Column) -> Column:
    return F.lit(float(CAP)) / (1 + (CAP - 1) * F.exp(-multiplier * size / scale))


def solved(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, m, scale for each source whose target lies inside (0, CAP times its size): distributed Newton steps on the dual.

    ``classes`` has sid, size, n; ``wanted`` has sid, target, full.
    """
    n, size = F.col("n").cast(WHOLE), F.col("size").cast(WHOLE)
    scale = (classes.where("size > 0").groupBy("sid")
             .agg((F.sum(n * size * size).cast("double") / F.sum(n * size).cast("double")).alias("scale")))
    state = written(wanted.where("target > 0 AND NOT full").join(scale, "sid")
                    .select("sid", "target", "scale", F.lit(0.0).alias("m"), F.lit(None).cast("double").alias("lo"),
                            F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done")), "dual")
    for _ in range(STEPS):
        if state.where("NOT done").isEmpty():
            break
        w, s = F.col("w"), F.col("size")
        sums = (classes.join(state.where("NOT done"), "sid").withColumn("w", rate(F.col("m"), s, F.col("scale"))).groupBy("sid")
                .agg(F.sum((F.col("n") * w * s).cast(EXACT)).cast("double").alias("words"),
                     F.sum((F.col("n") * w * (1 - w / CAP) * s * (s / F.col("scale"))).cast(EXACT)).cast("double").alias("slope")))
        off = F.col("words") - F.col("target")
        lo = F.when(off < 0, F.col("m")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("m")).otherwise(F.col("hi"))
        newton = F.col("m") - F.try_divide(off, F.col("slope"))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        # outside the bracket: halve it; a side still open: go on by doubling
        other = (F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2)
                 .when(off < 0, 2 * F.abs("m") + 1).otherwise(-2 * F.abs("m") - 1))
        far = F.abs(newton - F.col("m")) > 4 * F.abs("m") + 8         # a flat slope: do not leap
        done = F.abs(off) <= F.greatest(F.lit(WORD), NEAR * F.col("target"))
        moved = (state.where("NOT done").join(sums, "sid").withColumn("done", done).withColumn("lo", lo).withColumn("hi", hi)
                 .withColumn("m", F.when(F.col("done"), F.col("m")).when(inside & ~far, newton).otherwise(other)).select(*state.columns))
        state = written(state.where("done").union(moved), "dual")
    return state.select("sid", "m", "scale")


def whole_copies(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, size, n, rate, k (copies that the class takes in all, at most CAP * n).

    ``classes`` has sid, size, n and rate; running sums go by size bins and then inside a bin, so no window spans a source.
    """
    c = classes.withColumn("e", F.round(F.col("n") * F.col("rate") * FINE).cast("long"))
    c = c.withColumn("bin", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * BINS)).otherwise(-1))
    sums = c.groupBy("sid", "bin").agg(F.sum("e").alias("b"))
    before = Window.partitionBy("sid").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("b").over(before), F.lit(0))).drop("b")
    within = Window.partitionBy("sid", "bin").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)

    c = c.join(sums, ["sid", "bin"]).withColumn("end", F.col("start") + F.sum("e").over(within))
    half = FINE // 2
    c = c.selectExpr("sid", "size", "n", "rate", f"least({CAP} * n, (end + {half}) div {FINE} - (end - e + {half}) div {FINE}) AS k")
    return mended(written(c, "copies"), wanted)


def mended(c: DataFrame, wanted: DataFrame) -> DataFrame:
    """``c`` with single moves that bring each source's words nearest to its target, until no move helps (MOVES at most)."""
    for _ in range(MOVES):
        left = (c.groupBy("sid").agg(F.sum(F.col("k") * F.col("size")).alias("words")).join(wanted, "sid")
                .select("sid", (F.round("target").cast("long") - F.col("words")).alias("left")).where("left <> 0"))
        room = F.when(F.col("left") > 0, CAP * F.col("n") - F.col("k")).otherwise(F.col("k"))
        move = (c.join(left, "sid").withColumn("room", room).where("room > 0 AND size > 0")
                .withColumn("q", F.expr("greatest(1, least(room, abs(left) div size))"))
                .withColumn("then", F.abs(F.abs("left") - F.col("q") * F.col("size"))).where("then < abs(left)")
                .groupBy("sid").agg(F.min_by(F.struct("size", (F.signum("left") * F.col("q")).cast("long").alias("d")),
                                             F.struct("then", "size")).alias("x"))
                .select("sid", "x.size", "x.d"))
        move = written(move, "moves")
        if move.isEmpty():
            break
        c = written(c.join(move, ["sid", "size"], "left").withColumn("k", F.col("k") + F.coalesce("d", F.lit(0))).drop("d"), "copies")
    return c


def dealt(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """``copies`` of every row of ``sizes``; the k copies of a class go evenly over its documents in the order of a hash of doc_id.

    ``classes`` has source, size, n, k and further columns, which are kept.  A class is cut into about sqrt(n) runs by hash,
    so that no window holds a large class.  Rows of equal (doc_id, source, size) are one unit until the end.
    """
    units = sizes.groupBy("source", "size", "doc_id").agg(F.count(F.lit(1)).alias("r"))
    u = (units.withColumnRenamed("source", "u_source").join(classes, F.expr("u_source <=> source") & (units["size"] == classes["size"]))
         .drop(units["size"]).drop("u_source")
         .withColumn("h", F.xxhash64("doc_id"))
         .withColumn("run", F.pmod(F.col("h"), F.ceil(F.sqrt("n")))))
    u = written(u, "units")
    first = Window.partitionBy("sid", "size").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (u.groupBy("sid", "size", "run").agg(F.sum("r").alias("in_run"))
            .withColumn("start", F.coalesce(F.sum("in_run").over(first), F.lit(0))).drop("in_run"))
    within = Window.partitionBy("sid", "size", "run").orderBy("h", F.asc_nulls_first("doc_id")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.join(runs, ["sid", "size", "run"]).withColumn("z", F.col("start") + F.sum("r").over(within))

    def share(at: str, k: str, n: str) -> Column:
        """floor(at * k / n), exact."""
        return F.expr(f"CAST({at} AS {WHOLE}) * {k} div {n}")

    u = u.withColumn("c", share("z", "k", "n") - share("(z - r)", "k", "n"))
    # back to rows: r times, in chunks
    u = u.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (r - 1) div {CHUNK})")))
    u = u.withColumn("i", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(r, (chunk + 1) * {CHUNK}) - 1)")))
    return u.withColumn("copies", share("(i + 1)", "c", "r") - share("i", "c", "r"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies and rate of every row of ``docs``."""
    sizes = sized(docs)
    wanted = targets(sizes)
    n = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    classes = written(n.withColumnRenamed("source", "c_source").join(wanted, F.expr("c_source <=> source"))
                      .select("source", "sid", "size", "n"), "classes")
    tilted = solved(classes, wanted)
    rates = classes.join(tilted, "sid", "left").join(wanted.select("sid", "full"), "sid").withColumn(
        "rate", F.when(F.col("m").isNotNull(), rate(F.col("m"), F.col("size"), F.col("scale")))
        .when(F.col("full") & (F.col("size") > 0), F.lit(float(CAP))).otherwise(F.lit(1.0)))
    k = whole_copies(rates.select("sid", "size", "n", "rate"), wanted.select("sid", "target"))
    full = k.join(wanted.drop("full"), "sid")
    return dealt(sizes, full).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        F.col("copies").cast("int").alias("copies"), "rate")
