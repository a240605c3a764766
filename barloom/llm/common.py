"""What the operators share: tables, saved intermediate frames, words of a text, joins with hot keys."""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.ranks import HEAVY_SHARE, join_lookup
from barloom.functions.reuse import scratch_folder

# Fixed value: the white space that ends a word.
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame written once as a table below spark.checkpoint.dir and read back, so that a lost
    executor never makes an earlier pass over the texts run again with another row order."""
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists from about `size` bytes each; `bytes.split` cuts at the same six
    ASCII characters as SPACE."""
    start = 0
    while start < len(data):
        end = min(len(data), start + size)
        if end < len(data):
            cut = SPACE.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end


def utf8(text: str | None) -> bytes:
    return text.encode() if text else b""


def join_unique(rows: DataFrame, unique: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Join rows to a frame with one row per key, whose column `count` says how many rows have it.
    Keys with over a thousandth of all rows, at most a thousand, are matched by broadcast, so no task
    receives all rows of such a key."""
    flagged = unique.withColumn("_heavy", F.col(count) * F.lit(HEAVY_SHARE) > F.lit(total)).drop(count)
    return join_lookup(rows, flagged, [key])
