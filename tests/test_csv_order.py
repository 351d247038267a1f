"""CSV files are read by many tasks, and their rows keep their places."""

import pandas as pd

from wayfare.sources import tables


def test_csv_in_pieces(spark, tmp_path):
    given = list(range(3000))
    (tmp_path / "t.csv").mkdir()
    for part in range(3):  # of unequal length: Spark deals out the longest pieces first
        rows = given[part * 500 : part * 500 + 500] if part < 2 else given[1000:]
        pd.DataFrame({"n": rows, "word": [f"w{k * 7 % 13}" for k in rows]}).to_csv(tmp_path / "t.csv" / f"part-{part}.csv", index=False)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "100b")
    try:
        table = tables.scan(spark, str(tmp_path / "t.csv"))
        assert table.rdd.getNumPartitions() > 3
        assert [r.n for r in table.orderBy("row_index").collect()] == given
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
