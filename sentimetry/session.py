"""Session helpers: building a session, size-checked broadcast, shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row bound under which a parameter table (lexicon, valence list, stop words,
# timeline, weights) is hinted for broadcast.
BROADCAST_MAX_ROWS = 2_000_000


def get_spark(master: str | None = None, partitions: int = 8, app: str = "sentimetry") -> SparkSession:
    """Session used by tests, bench and the CLI; cluster jobs bring their own."""
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("SPARK_MAX_PARTITION_BYTES", "64m"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session, never overridden.  Where it
    is unset, a session in local mode (tests, one machine) gets a scratch
    folder once; on a cluster that would be machine-local, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="sentimetry-local-")
    return _LOCAL_DIRS[app]


_LOCAL_DIRS: dict[str, str] = {}


# Proven row bounds of DataFrames built from Python lists (parameter tables)
# and of tables derived from them by row-preserving or row-reducing steps.
_BOUNDS: "weakref.WeakKeyDictionary[DataFrame, int]" = weakref.WeakKeyDictionary()


def mark_bounded(df: DataFrame, rows: int) -> DataFrame:
    """Record that ``df`` has at most ``rows`` rows (known when it was built)."""
    _BOUNDS[df] = rows
    return df


def inherit_bound(derived: DataFrame, source: DataFrame) -> DataFrame:
    """``derived`` has no more rows than ``source`` (a projection, filter,
    de-duplication or first-per-key of it)."""
    if source in _BOUNDS:
        _BOUNDS[derived] = _BOUNDS[source]
    return derived


def row_bound(df: DataFrame) -> int | None:
    """The proven bound on the rows of ``df``, None where there is none."""
    return _BOUNDS.get(df)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Hint ``df`` for broadcast when its row count is proven <= max_rows.

    Only parameter tables have a proven bound: ``known_rows`` or one recorded
    by :func:`mark_bounded`.  Any other table is returned as it is, without a
    count of its own, and AQE decides from its size at run time.
    """
    if known_rows is None:
        known_rows = _BOUNDS.get(df)
    return F.broadcast(df) if known_rows is not None and known_rows <= max_rows else df


def materialize(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame reading it:
    lineage is cut, and a lost executor re-reads files instead of re-running
    the plan.  Files are in zstd, which takes a fifth to a half less than the default.
    ``by``: a column of few values, each in files of its own."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def is_written(df: DataFrame) -> bool:
    """Whether :func:`materialize` made ``df``."""
    return df in _PATHS


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` wrote and nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
