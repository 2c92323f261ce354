from pathlib import Path

import pytest
from pyspark.sql import functions as F
from shelfmark.llm import common


def test_written_tables_hold_their_rows_alone_and_are_verified(spark):
    table = common.written(spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1), "test-plain")
    folder = Path(common._written[-1][1].removeprefix("file://"))
    (part,) = folder.iterdir()  # no checksum file, no success mark: each would start processes of its own
    assert part.suffix == ".parquet"
    assert table.agg(F.count("*"), F.sum("id")).first()[:] == (5000, 5000 * 4999 // 2)
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|corrupt"):
        table.agg(F.max("text")).collect()
