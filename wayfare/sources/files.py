"""Single files wherever Spark reads and writes: on this machine, or in a store named by a URI."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(path: str, spark: SparkSession | None):
    spark = spark or SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(path: str, spark: SparkSession | None = None) -> bool:
    fs, place = _place(path, spark)
    return fs.exists(place)


def write_bytes(path: str, data: bytes, spark: SparkSession | None = None) -> None:
    """Replaces the file; folders above it are made."""
    fs, place = _place(path, spark)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def read_bytes(path: str, spark: SparkSession | None = None) -> bytes:
    fs, place = _place(path, spark)
    stream = fs.open(place)
    try:
        return bytes((spark or SparkSession.active())._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def delete(path: str, spark: SparkSession | None = None) -> None:
    fs, place = _place(path, spark)
    fs.delete(place, True)


def size(path: str, spark: SparkSession | None = None) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, place = _place(path, spark)
    return fs.getContentSummary(place).getLength()
