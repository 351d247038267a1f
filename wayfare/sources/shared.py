"""Tables between rounds, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.sources import files

#: Bytes of rows beyond which ``cut_sized`` has a table joined by merging.
MOST_SENT = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is not set and Spark runs on this machine alone, a temporary folder of it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """Write and read again: the lineage ends in files that outlive an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_sized(df: DataFrame, label: str = "table") -> DataFrame:
    """The same; a table whose rows take more than ``MOST_SENT`` is joined by merging.

    Spark takes a table to be as large as its files and sends small ones to all executors, by the driver's memory.  Rows that are much alike have files of a
    thirtieth of their size and less, so that small files are read once and measured.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    taken = files.size(path, spark)
    if taken <= MOST_SENT:
        taken = table.agg(F.sum(16 + sum(_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema)).alias("bytes")).first()[0] or 0
    return table.hint("merge") if taken > MOST_SENT else table


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About what a value takes in a row: arrays by their number of elements, strings by their length."""
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.ArrayType):
        return 24 + F.coalesce(F.size(value), F.lit(0)) * _least_bytes(kind.elementType)
    if isinstance(kind, T.StringType | T.BinaryType):
        return 8 + F.coalesce(F.octet_length(value), F.lit(0))
    return F.lit(8)


def _least_bytes(kind: T.DataType) -> int:
    """The same of an element that is not looked at."""
    if isinstance(kind, T.StructType):
        return 16 + sum(_least_bytes(f.dataType) for f in kind)
    return 24 if isinstance(kind, T.ArrayType) else 8


def drop(table: DataFrame) -> None:
    """Delete the files of a ``cut`` table that nothing reads any more."""
    for folder in {path.rpartition("/")[0] for path in table.inputFiles()}:
        files.delete(folder, table.sparkSession)


def cut_sorted(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """The same as a table in buckets by the keys, sorted: a join on them leaves its rows where they are."""
    spark = df.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"wayfare_{label}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)
