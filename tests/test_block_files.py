"""Files of blocks stay small: a reader holds up to 4,096 rows of a file, and here a row is a block."""

import glob

import pyarrow.parquet as pq

from tilework.operators import blocks, boost
from tilework.sources.shared import settle


def test_blocks_in_a_file(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FILE_BYTES", 1, raising=False)  # as few as there may be
    files = []

    def noted(df, label, *more):
        out = settle(df, label, *more)
        found = glob.glob(out._settled_at.removeprefix("file://") + "/*.parquet")
        files.append((label, [pq.ParquetFile(f).metadata.num_rows for f in found]))
        return out

    monkeypatch.setattr(boost, "settle", noted)
    df = spark.range(0, 140_000, 1, 1).selectExpr("double(id % 97) AS a", "double(id % 31) AS y", "CASE id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split")
    rows, *_ = boost.prepare(df, ["a"], "regression", boost.Params(trees=1, depth=1))
    assert rows.selectExpr("sum(n)").first()[0] == 140_000
    sizes = dict(files)
    assert sum(sizes["raw_blocks"]) > 2 * blocks.PIECE and max(sizes["raw_blocks"] + sizes["binned"]) <= blocks.PIECE, files


def test_wide_rows_make_fewer_blocks_a_file():
    assert blocks.blocks_a_file(4) * 4 * 8 * blocks.ROWS <= blocks.FILE_BYTES
    assert blocks.blocks_a_file(4) > blocks.blocks_a_file(8) > blocks.blocks_a_file(1000) == blocks.PIECE
