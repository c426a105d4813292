"""Session construction and cluster-shared storage locations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a production job wants regardless of scale.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Row-number <= k is planned as a partial + final WindowGroupLimit.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "catalux") -> SparkSession:
    """A local session for tests and the bench (cluster jobs get theirs from spark-submit)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read.
    Where it is unset, a local run (tests) gets a private folder; a cluster
    job is refused, since its executors share no local folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="catalux-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local on a cluster)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([root, *parts, uuid.uuid4().hex])


def spread(df, *keys):
    """Deal narrow rows over all tasks by key before they are made wide or worked on: a small file is one split."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settled(df):
    """The same rows, with every column computed before what follows.

    A filter on a computed column is otherwise pushed below it with a copy of its expression, and so for each reference.
    """
    from pyspark.sql import functions as F
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def stored(df, name: str):
    """Write ``df`` under the shared folder and read it back: computed once, and the planner knows its size.

    For narrow frames that are read several times and stand on wide ones (texts), which would be shuffled each time.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df):
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    Used where one intermediate feeds several actions (for example the
    query-understanding table of a search feeds the size check, the vector
    broadcast and the final plan).  The frame is persisted first so the
    checkpoint's write job reads it back instead of recomputing the plan;
    the reliable checkpoint files on shared storage survive the loss of the
    executors that computed them, and the cache is dropped afterwards.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
