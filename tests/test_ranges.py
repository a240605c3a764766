"""Ranks cut in ranges, and removal of expired day partitions."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.functions import student
from barloom.operators import pools
from barloom.sources import tables
from conftest import make_bars


def test_one_day_is_ranked_over_several_tasks(spark):
    rows = [(f"S{i:05d}", "2024-01-01", None if i % 10 == 0 else float(i % 7)) for i in range(4000)]
    rows += [("S00001", "2024-01-02", 1.0), ("S00002", "2024-01-02", 2.0), ("S00003", None, 5.0)]
    df = spark.createDataFrame(rows, "order_book_id string, date string, composite_score double")
    df = df.withColumn("date", F.col("date").cast("date")).repartition(4)
    got = {(r.order_book_id, str(r.date)): r.day_rank for r in pools.rank_per_date(df).collect()}
    first = sorted((r for r in rows if r[1] == "2024-01-01"), key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0]))
    want = {(r[0], r[1]): k + 1 for k, r in enumerate(first)}
    want |= {("S00002", "2024-01-02"): 1, ("S00001", "2024-01-02"): 2, ("S00003", "None"): 1}
    assert got == want


def test_expired_days_are_deleted(spark, tmp_path):
    bars = make_bars(spark, {"A": [1.0, 2.0, 3.0, 4.0], "B": [5.0, 6.0]})
    tables.save_table(bars, str(tmp_path), "bars", partition_by=["date"])
    assert tables.drop_expired(spark, str(tmp_path), "bars", 1, "2024-01-04") == ["date=2024-01-01", "date=2024-01-02"]
    left = tables.load_table(spark, str(tmp_path), "bars").orderBy("date").collect()
    assert [(r.order_book_id, r.date.day, r.close) for r in left] == [("A", 3, 3.0), ("A", 4, 4.0)]
    tables.save_table(bars, str(tmp_path), "whole")
    with pytest.raises(ValueError):
        tables.drop_expired(spark, str(tmp_path), "whole", 1, "2024-01-04")


def test_p_values_of_very_many_pairs():
    for n in (10**7 - 5, 10**7 + 10, 10**11):
        t = 1.9599639845400545
        assert student.two_sided_p(t / (t * t + n - 2) ** 0.5, n) == pytest.approx(0.05, abs=1e-7)
