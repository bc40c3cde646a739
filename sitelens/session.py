"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}


def build_session(app: str = "sitelens", master: str = "local[*]",
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, ANSI, AQE).

    Used by the tests and the bench. On a cluster the caller brings the session.
    """
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # HotSpot does not compile methods beyond 8000 bytes of bytecode.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call-site capture makes building wide expressions several times slower.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir``.

    A cluster must name a shared folder there. Only a local master, where every
    task runs on this machine, gets a temporary folder when it is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder every executor can reach")
    app_id = spark.sparkContext.applicationId
    if app_id not in _local_root:
        _local_root[app_id] = tempfile.mkdtemp(prefix="sitelens-")
    return _local_root[app_id]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Cuts lineage so that a lost executor re-reads files instead of re-running the
    plan, and lets several consumers prune columns from one written table.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stage-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    # The shuffles behind a written table are not read again. Spark deletes their files once
    # the driver has collected what points at them, else only every half hour.
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def staged_bytes(df: DataFrame) -> int:
    """Size of the files of a table that ``materialise`` has written; 0 of any other table."""
    return _on_path(df, lambda fs, path: fs.getContentSummary(path).getLength()) or 0


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` has written and nothing will read again. Others are left alone."""
    _on_path(df, lambda fs, path: fs.delete(path, True))


def _on_path(df: DataFrame, use):
    path = df.__dict__.get("_staged")
    if path is not None:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return use(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)
