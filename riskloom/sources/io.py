"""Readers and writers: CSV/JSON/Parquet with explicit schemas, processed
feature tables, scored output and metrics.

Every reader takes an explicit ``StructType`` (no inference pass over the
data); malformed CSV/JSON records are kept in a corrupt-record column
instead of failing the job, so a caller can split valid rows from rejects.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from riskloom.sources.schemas import CARD_SCHEMA, COMMERCE_SCHEMA, IP_RANGE_SCHEMA, subset

CORRUPT = "_corrupt_record"
DATASET_TYPES = ("fraud", "creditcard")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             corrupt: bool = False) -> DataFrame:
    sch = schema
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if corrupt:
        sch = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(sch).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, corrupt: bool = False) -> DataFrame:
    sch = schema
    reader = spark.read.option("mode", "PERMISSIVE")
    if corrupt:
        sch = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(sch).json(path)


def _with_key(df: DataFrame, key: str = "txn_id") -> DataFrame:
    """Inputs without a key get one; the checkpoint pins the ids so a
    recomputed partition cannot renumber rows."""
    if key in df.columns:
        return df
    from riskloom.session import cut_lineage
    return cut_lineage(df.withColumn(key, F.monotonically_increasing_id()))


def load_commerce(spark: SparkSession, path: str) -> DataFrame:
    """Purchases CSV (header).  ``txn_id`` is read when present, else assigned."""
    header = spark.read.option("header", True).csv(path).columns
    fields = [f for f in COMMERCE_SCHEMA.fields if f.name in header]
    df = read_csv(spark, path, T.StructType(fields))
    return _with_key(df)


def load_card(spark: SparkSession, path: str) -> DataFrame:
    """Card CSV; the label ``Class`` is normalised to ``class``."""
    header = spark.read.option("header", True).csv(path).columns
    names = {("class" if c == "Class" else c): c for c in header}
    fields = [T.StructField(names[f.name], f.dataType) for f in CARD_SCHEMA.fields if f.name in names]
    df = read_csv(spark, path, T.StructType(fields))
    if "Class" in df.columns:
        df = df.withColumnRenamed("Class", "class")
    return _with_key(df)


def load_ip_ranges(spark: SparkSession, path: str | None) -> DataFrame:
    """IP-range CSV.  A missing file is an empty table plus a warning (every
    country then resolves to NULL), not an error.  The short column names
    ``lower_bound_ip``/``upper_bound_ip`` are accepted."""
    empty = spark.createDataFrame([], IP_RANGE_SCHEMA)
    if not path:
        warnings.warn("no IP-range file given; countries will be NULL")
        return empty
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException:
        warnings.warn(f"IP-range file not found: {path}; countries will be NULL")
        return empty
    alias = {"lower_bound_ip": "lower_bound_ip_address", "upper_bound_ip": "upper_bound_ip_address"}
    fields = [T.StructField(c, T.DoubleType() if "bound" in c else T.StringType()) for c in header]
    df = read_csv(spark, path, T.StructType(fields))
    for a, b in alias.items():
        if a in df.columns:
            df = df.withColumnRenamed(a, b)
    # bounds may arrive as floats: truncate to BIGINT
    return df.select(F.col("lower_bound_ip_address").cast("bigint").alias("lower_bound_ip_address"),
                     F.col("upper_bound_ip_address").cast("bigint").alias("upper_bound_ip_address"),
                     F.col("country").cast("string").alias("country"))


def _processed_path(root: str, dataset_type: str) -> str:
    if dataset_type not in DATASET_TYPES:
        raise ValueError(f"Unknown dataset type: {dataset_type}")
    return f"{root.rstrip('/')}/{dataset_type}_processed"


def save_processed(df: DataFrame, dataset_type: str, root: str, fmt: str = "parquet") -> str:
    path = _processed_path(root, dataset_type)
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def load_processed(spark: SparkSession, dataset_type: str, root: str, schema: T.StructType | None = None,
                   fmt: str = "parquet") -> DataFrame:
    path = _processed_path(root, dataset_type)
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV processed data needs an explicit schema")
        return read_csv(spark, path, schema)
    return spark.read.parquet(path)


def write_scores(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = "risk_level") -> str:
    """Input columns plus scores; partitioned by risk band so a reader of one
    band prunes the others."""
    w = df.write.mode("overwrite")
    if partition and partition in df.columns:
        w = w.partitionBy(partition)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_metrics(df: DataFrame, path: str) -> str:
    """Metrics rows (one per dataset/model) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


REQUEST_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("purchase_value", T.DoubleType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("time_since_signup_hours", T.DoubleType()),
])

CARD_REQUEST_SCHEMA = subset(CARD_SCHEMA, [f.name for f in CARD_SCHEMA.fields if f.name != "class"])
