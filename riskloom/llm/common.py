"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"

ROW = "_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pack(df: DataFrame) -> DataFrame:
    """The whole input row as one struct column, so that columns an operator
    adds can't clash with columns the input happens to have."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unpack(df: DataFrame, row_columns: list[str], *added: Column | str) -> DataFrame:
    """The input's columns again, followed by ``added``; an added column
    replaces an input column of the same name (case-insensitively, as Spark
    resolves names)."""
    extra = [F.col(a) if isinstance(a, str) else a for a in added]
    names = {n.lower() for n in df.select(*extra).columns} if extra else set()
    return df.select(*[F.col(ROW)[c].alias(c) for c in row_columns if c.lower() not in names], *extra)


#: Rows that Spark hands to a Python task at once.  Texts may be long: by
#: default it would be 10,000, and a batch lives in the JVM and in the task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Set the size of Arrow batches for what is run on texts from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words (``WORD``); null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def driver_table(spark: SparkSession, rows: list, schema: str, broadcast_rows: int = 100_000) -> DataFrame:
    """A table made on the driver (one row per shard, source or range).  Spark
    takes such a table for large and would shuffle the texts it is joined
    with, so it is marked for broadcast, unless it has too many rows for that."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= broadcast_rows else df


def sum_slices(group: pa.Table) -> pa.Table:
    """For ``groupBy(...).applyInArrow``: one row with the element-wise sum of
    the group's ``counts`` (arrays of one length), the other columns as in the
    first row.  A group has one row per task that counted."""
    total = group.column("counts").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(0)
    return pa.table({c: pa.array([total], pa.list_(pa.int64())) if c == "counts" else group.column(c)[:1] for c in group.column_names})
