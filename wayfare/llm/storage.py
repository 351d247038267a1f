"""Intermediate tables in the folder that all executors share.

Every operator that needs a table twice writes it as Parquet below
``spark.checkpoint.dir``: files in a shared store survive a lost executor and cut
the lineage.  Only where that setting is absent and Spark runs on this machine alone
(tests) a temporary folder of it is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_BATCH_BYTES = 8 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python are bounded in bytes, not only in rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


class Scratch:
    """Parquet tables of one operator call; each can be dropped when it is used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def write(self, df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
        path = self.path(label)
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def write_sorted(self, df: DataFrame, label: str, key: str | list[str], then: list[str], buckets: int) -> DataFrame:
        """A table in buckets by ``key`` (one column or several), each sorted by key and ``then``: joins on the key of two such tables move no rows."""
        path, name = self.path(label), f"wayfare_{uuid.uuid4().hex}"
        keys = [key] if isinstance(key, str) else key
        df.repartition(buckets, *keys).write.option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).sortBy(*keys, *then).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        if hasattr(df, "_scratch_table"):
            self.spark.sql(f"DROP TABLE IF EXISTS {df._scratch_table}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free_shuffles(self) -> None:
        """Let Spark's cleaner remove shuffle files of plans that are done."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
