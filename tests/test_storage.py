"""Written tables take little room."""

from pathlib import Path

import pyarrow.parquet as pq

from inkprint.storage import stored


def test_stored_tables_are_small(spark):
    df = stored(spark.range(100).selectExpr("id", "repeat(concat('some text ', id), 20) AS text"), "texts")
    files = [Path(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles()]
    codecs = {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in files}
    assert codecs == {"ZSTD"} and df.count() == 100
