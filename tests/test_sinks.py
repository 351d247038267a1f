"""JSON documents of rows: both forms against Python's own reader."""

import glob
import gzip
import json
import os

import pytest

from wayfare.sources import sinks

SCHEMA = "vehicle string, origin bigint, ttf struct<points: array<double>, cst: double>"
FIELDS = "origin bigint, ttf struct<points: array<double>, cst: double>"
ROWS = [("b", i % 90, ([float(i), 0.5], None)) for i in range(300)] + [('a "quoted\\" :[ name', 1, None), (None, None, ([], 2.0)), ("", 5, ([1.5], None)), ("c],", 2, ([], None)), ("c],", 2, ([], None))]


def plain(row):
    return json.dumps(row, sort_keys=True)


def expected():
    found = {}
    for vehicle, origin, ttf in ROWS:
        found.setdefault("null" if vehicle is None else vehicle, []).append(plain({"origin": origin, "ttf": ttf and dict(zip(("points", "cst"), ttf))}))
    return {k: sorted(v) for k, v in found.items()}


def document(path):
    if os.path.isdir(path):
        return json.loads(gzip.decompress(b"".join(open(part, "rb").read() for part in sorted(glob.glob(f"{path}/part-*")))))
    return sinks.read_json_file(None, path)


@pytest.mark.parametrize("most", [0, 10_000])
def test_documents_of_both_forms(spark, tmp_path, most):
    """Quoted, empty and null names, null fields, equal rows, a name with nearly all rows; parts cut anywhere."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = sinks.write_json_rows(spark.createDataFrame(ROWS, SCHEMA).repartition(3), "vehicle", f"{tmp_path}/skims.json.zst", most)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert os.path.isdir(path) == (most == 0)
    if most == 0:
        assert len(glob.glob(f"{path}/part-*")) > 2
    assert {k: sorted(map(plain, v)) for k, v in document(path).items()} == expected()
    back = {}
    for row in sinks.read_json_rows(spark, path, "vehicle", FIELDS).collect():
        value = row.asDict(recursive=True)
        back.setdefault(value.pop("vehicle"), []).append(plain(value))
    assert {k: sorted(v) for k, v in back.items()} == expected()


def test_one_form_at_a_time(spark, tmp_path):
    """A later write replaces the earlier form; no rows leave neither."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    path = f"{tmp_path}/skims.json.zst"
    parts = sinks.write_json_rows(rows, "vehicle", path, 0)
    assert sinks.write_json_rows(rows, "vehicle", path) == path and not os.path.exists(parts)
    assert sinks.write_json_rows(rows, "vehicle", path, 0) == parts and not os.path.exists(path)
    assert sinks.write_json_rows(rows.where("false"), "vehicle", path) is None and not os.path.exists(parts)


def test_rows_of_lists_alone(spark, tmp_path):
    """Nothing but the key and a list: the rows keep their places."""
    rows = spark.createDataFrame([(1, [2.0]), (1, [1.0]), (2, None)], "k int, points array<double>")
    path = sinks.write_json_rows(rows.coalesce(1), "k", f"{tmp_path}/lists.json.zst", 0)
    assert document(path) == {"1": [{"points": [2.0]}, {"points": [1.0]}], "2": [{"points": None}]}
