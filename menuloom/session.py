"""Session settings, the shared folder for checkpoints, and size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# A group with more rows than this is never handed to one task.
HOT_GROUP_ROWS_CONF = "spark.menuloom.hotGroupRows"
HOT_GROUP_ROWS_DEFAULT = 2_000_000
# Rows of a hot group that one task works on at a time, about.
CHUNK_ROWS_CONF = "spark.menuloom.chunkRows"
CHUNK_ROWS_DEFAULT = 250_000
# The most rows and bytes an explicitly broadcast table may have.
BROADCAST_ROWS_CONF = "spark.menuloom.broadcastRows"
BROADCAST_ROWS_DEFAULT = 100_000
BROADCAST_BYTES_CONF = "spark.menuloom.broadcastBytes"
BROADCAST_BYTES_DEFAULT = 32 << 20


def build_session(app: str = "menuloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for. On a cluster
    the master, sizes and ``spark.checkpoint.dir`` come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Checkpoints that nothing refers to any more are removed.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the Python line of every column costs more than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Whole pages go to Python in batches bounded by size, not only by rows.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. A local session that names
    none uses a folder beside its warehouse, which is on the default file system."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/menuloom-shared"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor never
    changes a value that was fixed at this point."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_FIXED_WIDTH = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a lookup table is small enough to send to every executor, in rows and
    in bytes of its values. Reads no more than the limit plus one row."""
    spark = df.sparkSession
    limit = int_conf(spark, BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT)
    texts = [c for c, kind in df.dtypes if kind not in _FIXED_WIDTH]
    wide = [F.coalesce(F.length(F.to_json(F.struct(*texts))), F.lit(0))] if texts else []
    width = sum(wide, F.lit(8 * len(df.columns)))
    rows, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return rows <= limit and size <= int_conf(spark, BROADCAST_BYTES_CONF, BROADCAST_BYTES_DEFAULT)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Fix a table that should be small, count it, and mark it for broadcast only
    if it is. Marking it beforehand keeps the large side of the join from being
    shuffled, which a later decision by adaptive execution would not."""
    stored = reliable_checkpoint(df)
    return F.broadcast(stored) if fits_broadcast(stored) else stored
