"""Output shaping for registered queries: chosen columns, doubles rounded for comparison."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from barloom.functions.numeric import rounded


def shape(df: DataFrame, cols: str, digits: int = 4, exact: str = "") -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keep = set(exact.split())
    return df.select(*[
        rounded(c, digits).alias(c)
        if isinstance(kinds[c], T.DoubleType) and c not in keep else F.col(c)
        for c in cols.split()
    ])
