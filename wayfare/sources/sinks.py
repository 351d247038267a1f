"""Output tables and files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.sources import files
from wayfare.sources.shared import cut


def _flat(df: DataFrame) -> DataFrame:
    """CSV carries no lists: they are written as text."""
    return df.select(*[F.concat_ws(",", F.col(f"`{c}`").cast("array<string>")).alias(c) if kind.startswith("array") else F.col(f"`{c}`") for c, kind in df.dtypes])


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "Parquet", mode: str = "overwrite") -> str | None:
    """Write ``folder/name.(parquet|csv|json)``; an empty table gives no file."""
    if df.isEmpty():
        return None
    path = f"{folder.rstrip('/')}/{name}.{fmt.lower()}"
    writer = df.write.mode(mode)
    if fmt == "Parquet":
        writer.option("compression", "snappy").parquet(path)
    elif fmt == "CSV":
        _flat(df).write.mode(mode).option("header", True).csv(path)
    elif fmt == "JSON":
        writer.json(path)
    else:
        raise ValueError(f"unknown saving format {fmt}")
    return path


def append_rows(df: DataFrame, folder: str, name: str, fmt: str = "Parquet") -> str | None:
    """Add rows to a table, such as one for each iteration."""
    return write_table(df.coalesce(1), folder, name, fmt, "append")


def write_json(value, path: str, compress: bool = False) -> None:
    data = json.dumps(value, indent=None if compress else 2).encode()
    if compress:
        import zstandard

        data = zstandard.ZstdCompressor().compress(data)
    files.write_bytes(path, data)


def append_json(value, path: str) -> None:
    """Add to a list in a JSON file."""
    values = json.loads(files.read_bytes(path)) if files.exists(path) else []
    write_json([*values, value], path)


def read_json_file(spark: SparkSession, path: str):
    """JSON from wherever Spark reads; in zstandard if the name says so."""
    data = files.read_bytes(path, spark)
    if path.endswith(".zst"):
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return json.loads(data)


#: Rows of a JSON document that is one file; the driver compresses them one after another and keeps the compressed bytes.
MOST_ROWS_OF_ONE_FILE = 100_000
#: The name of a value in a line that opens its list, with what closes the list before.
OPENING = r'^(?:\{|\],)("[^"\\]*(?:\\.[^"\\]*)*"):\['


def _json_lines(rows: DataFrame, key: str) -> DataFrame:
    """text, in order: lines that are one JSON object together, a list of objects for each value of ``key``.

    A value's first row is found by an aggregate and opens its list, so that no task reads all rows of one value.
    """
    others = [c for c in rows.columns if c != key]
    ordered = [c for c, kind in rows.dtypes if c in others and not kind.startswith(("array", "map", "struct"))]
    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]), {"ignoreNullFields": "false"})
    at = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(ordered)], F.monotonically_increasing_id().alias("place"))
    table = cut(rows.select(named.alias("name"), line.alias("line"), at.alias("at")), "json_lines")
    first = table.groupBy("name").agg(F.min("at").alias("at"))
    least = first.agg(F.min("name")).first()[0]
    opened = table.withColumn("place", F.col("at.place")).join(first.select("at.place", F.lit(True).alias("opens")), "place", "left")
    json_name = F.to_json(F.array("name"))
    opening = F.concat(F.when(F.col("name") == F.lit(least), F.lit("{")).otherwise(F.lit("],")), F.substring(json_name, F.lit(2), F.length(json_name) - 2), F.lit(":["))
    lines = opened.select(F.lit(0).alias("last"), "name", "at", F.concat(F.when(F.col("opens"), opening).otherwise(F.lit(",")), F.col("line")).alias("text"))
    end = rows.sparkSession.range(1).select(F.lit(1).alias("last"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(table.schema["at"].dataType).alias("at"), F.lit("]}").alias("text"))
    return lines.unionByName(end).orderBy("last", "name", "at").select("text")


def write_json_rows(rows: DataFrame, key: str, path: str, most: int = MOST_ROWS_OF_ONE_FILE) -> str | None:
    """One JSON object with a list of objects for each value of ``key`` (null: the name "null"); no rows give no file.

    ``path`` ends in ``.json.zst``.  Up to ``most`` rows it is a file.  Of more rows the tasks write the same JSON into the parts of a folder
    ``.json.gz`` beside it (Spark has no zstandard for text): joined in the order of their names they are the one compressed document.
    Equal rows are written as often as they occur.  The form of an earlier write is replaced.
    """
    folder = path.removesuffix(".json.zst") + ".json.gz"
    n = rows.count()
    for old in (path, folder):
        files.delete(old, rows.sparkSession)
    if not n:
        return None
    lines = _json_lines(rows, key)
    if n > most:
        lines.write.option("compression", "gzip").option("maxRecordsPerFile", 1_000_000).text(folder)
        return folder
    import zstandard

    packer = zstandard.ZstdCompressor().compressobj()
    data = bytearray()
    for row in lines.toLocalIterator():
        data += packer.compress((row.text + "\n").encode())
    files.write_bytes(path, bytes(data + packer.flush()), rows.sparkSession)
    return path


def read_json_rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows of ``write_json_rows``, from either form: ``key`` as text and the fields of ``schema``.

    A part's lines are numbered as they are read; the name of a line is the last one opened in its part, or else the last one of the parts before,
    which is found over one row a part.
    """
    if path.endswith(".zst"):
        import zstandard

        text = zstandard.ZstdDecompressor().decompressobj().decompress(files.read_bytes(path, spark)).decode()
        lines = spark.createDataFrame([(line, "part-0-c0", i) for i, line in enumerate(text.rstrip("\n").split("\n"))], "value string, file string, place bigint")
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"))
    number = F.struct(*[F.regexp_extract("file", pattern, 1).cast("int").alias(name) for name, pattern in (("part", r"^part-(\d+)"), ("piece", r"-c(\d+)"))])
    named = lines.where(F.col("value") != "]}").select(number.alias("part"), "place", "value", F.nullif(F.regexp_extract("value", OPENING, 1), F.lit("")).alias("opened"))
    before = named.groupBy("part").agg(F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("place"))).alias("opened"))
    before = before.select("part", F.last("opened", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = F.last("opened", True).over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    known = named.withColumn("here", here).join(before, "part").withColumn("name", F.coalesce("here", "carried"))
    name = F.from_json(F.concat(F.lit("["), F.col("name"), F.lit("]")), "array<string>")[0]
    skipped = F.when(F.col("opened").isNull(), F.lit(1)).otherwise(F.length(F.regexp_extract("value", OPENING, 0)))
    return known.select(name.alias(key), F.from_json(F.substring("value", skipped + 1, F.length("value")), schema).alias("row")).select(F.col(f"`{key}`"), "row.*")
