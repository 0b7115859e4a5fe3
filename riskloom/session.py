"""Session construction and the shared scratch location.

Everything that must survive an executor loss (checkpoints, intermediate
tables, saved models in tests) goes below ``spark.checkpoint.dir``.  On a
cluster that setting names a shared, fault-tolerant folder and is read from
the session.  Only when it is unset *and* the master is local (tests, bench)
do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "riskloom") -> SparkSession:
    """Local/test session with the settings every plan in this repo assumes."""
    master = master or os.environ.get("RISKLOOM_MASTER", "local[*]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RISKLOOM_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings the plans rely on; safe to call on a session we did not build."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  If unset, a folder is created only for local
    masters; on a cluster an unset value is a configuration error, because a
    machine-local folder would not survive the loss of that machine.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running riskloom jobs on a cluster")
    root = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, name: str = "table"):
    """Cut lineage by writing a Parquet table into the shared checkpoint
    folder and reading it back (never ``localCheckpoint``).

    Unlike an eager ``Dataset.checkpoint`` (which computes the plan once for
    the count and again for the checkpoint write), the plan runs once, and
    later scans get column pruning and filter pushdown on the table.  A lost
    executor costs nothing: the table lives in the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _hadoop(spark, path)
    return fs.exists(jvm_path)


def path_stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, newest modification time) of a file or folder: tells whether a
    table has changed since it was last looked at."""
    fs, jvm_path = _hadoop(spark, path)
    status = fs.getFileStatus(jvm_path)
    newest = max([status.getModificationTime(), *(x.getModificationTime() for x in fs.listStatus(jvm_path))])
    return fs.getContentSummary(jvm_path).getLength(), newest


def delete_path(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _hadoop(spark, path)
    fs.delete(jvm_path, True)


def drop_scratch(*tables) -> None:
    """Delete tables that ``cut_lineage`` wrote, once what was made of them has
    been written in its turn.  Other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            table._scratch_path = None
            delete_path(table.sparkSession, path)
