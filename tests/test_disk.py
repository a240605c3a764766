"""What the jobs leave on disk while they run: shuffle files, copies, and rows that two tables have alike."""
from __future__ import annotations

import os
import time

import pytest
from conftest import day, make_bars
from pyspark.sql import functions as F

from barloom.functions import reuse
from barloom.operators import indicators, scoring
from barloom.plans import daily, jobs
from barloom.sources import calendar as cal, store, tables

KEYS = ["order_book_id", "date"]
SCORED = [*KEYS, "composite_score", "macd_hist", "year_high", "volume_trend"]


def content(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def bars(spark):
    closes = {f"00000{k}.XSHE": [10.0 + (i * k * 7 % 11) / 4 for i in range(40)] for k in range(1, 6)}
    return make_bars(spark, closes, start="2024-01-10").cache()


@pytest.fixture(scope="module")
def listed(spark, bars):
    return bars.select("order_book_id").distinct().select(
        "order_book_id", F.lit("one").alias("symbol"), F.lit("Active").alias("status"), F.lit("科技").alias("industry"),
        F.lit(1e9).alias("market_cap")).cache()


def full(bars, listed):
    ready = indicators.scorer_inputs(bars.join(listed.select("order_book_id", "industry", "market_cap"), "order_book_id", "left"))
    return scoring.score_bars(ready.withColumn("large_order_ratio", F.lit(None).cast("double")))


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(held.apply(i).getName().startswith("shuffle_") for i in range(held.size()))


def test_shuffle_files_go_with_their_query_and_copies_at_the_end(spark, tmp_path):
    setting, scratch = spark.conf.get(reuse.SHUFFLES_GO, None), list(reuse._SCRATCH)
    with reuse.little_disk(spark) as copied:
        kept = copied(spark.range(100).withColumn("x", F.lit(None).cast("double")))
        before = shuffle_files(spark)
        for k in range(3):
            kept.repartition(5, "id").write.parquet(f"{tmp_path}/{k}")
        assert kept.count() == 100 and kept.dtypes == [("id", "bigint"), ("x", "double")]
        until = time.time() + 20
        while shuffle_files(spark) > before and time.time() < until:
            time.sleep(0.2)
        assert shuffle_files(spark) <= before
        place = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.exists(place)
    assert not os.path.exists(place) and scratch == reuse._SCRATCH and spark.conf.get(reuse.SHUFFLES_GO, None) == setting


def test_scores_hold_the_indicators_files_and_are_made_in_slices(spark, bars, listed, tmp_path, monkeypatch):
    monkeypatch.setattr(daily, "SLICE_ROWS", 60)
    base, days = str(tmp_path), cal.market_days(bars)
    first = bars.where(F.col("date") < "2024-02-10")
    did = daily.update(spark, base, first, listed, days, None, "1", full_days=10**6)
    assert did["scored"] == first.count()
    scores, ind = store.read(spark, base, "scores"), store.read(spark, base, "indicators")
    assert set(scores.inputFiles()) == set(ind.inputFiles()) and len({f.rsplit("/", 2)[0] for f in ind.inputFiles()}) == 1
    assert scores.select("_calculation_timestamp").distinct().count() == 1
    assert "composite_score" not in ind.columns and ind.columns == [c for c in scores.columns if c in ind.columns]
    daily.update(spark, base, bars, listed, days, None, "2", full_days=10**6)
    scores, ind = store.read(spark, base, "scores"), store.read(spark, base, "indicators")
    assert content(scores.select(*SCORED)) == content(full(bars, listed).select(*SCORED))
    assert content(ind) == content(scores.select(*ind.columns)) and set(scores.inputFiles()) == set(ind.inputFiles())
    assert len(store.vacuum(spark, base, "scores")) == 1  # the second run's own rows of the month that it merged
    assert ind.count() == bars.count()


def test_tables_that_share_files_part_where_one_was_cut(spark, tmp_path):
    base = str(tmp_path)
    frame = lambda *rows: spark.createDataFrame([("A", day(d), v, v * 2) for d, v in rows], "order_book_id string, date date, x double, y double")

    def run(stamp, df):
        commit = store.Commit(spark, base, stamp)
        store.write_through(commit, "both", df, views={"part": [*KEYS, "x"]})
        commit.publish()

    def seen(table, column):
        return [r[0] for r in store.read(spark, base, table).orderBy("date").select(column).collect()]

    run("1", frame(("2024-01-05", 1.0), ("2024-01-20", 2.0), ("2024-02-05", 3.0)))
    assert seen("part", "x") == [1.0, 2.0, 3.0] and store.read(spark, base, "part").columns == [*KEYS, "x"]
    commit = store.Commit(spark, base, "2")
    store.drop_before(commit, "both", "2024-01-10")  # one table is cut, the other keeps its rows
    commit.publish()
    assert store.vacuum(spark, base, "both") == []  # still named by the other
    assert seen("both", "x") == [2.0, 3.0] and seen("part", "x") == [1.0, 2.0, 3.0]
    run("3", frame(("2024-01-21", 4.0), ("2024-02-06", 5.0)))
    assert seen("both", "y") == [4.0, 8.0, 6.0, 10.0] and seen("part", "x") == [1.0, 2.0, 4.0, 3.0, 5.0]
    commit = store.Commit(spark, base, "4")
    store.drop_before(commit, "part", "2024-02-01")
    commit.publish()
    run("5", frame(("2024-01-22", 6.0)))
    assert seen("both", "x") == [2.0, 4.0, 6.0, 3.0, 5.0] and seen("part", "x") == [6.0, 3.0, 5.0]
    for table in ("both", "part"):
        store.vacuum(spark, base, table)
    assert seen("both", "x") == [2.0, 4.0, 6.0, 3.0, 5.0] and seen("part", "x") == [6.0, 3.0, 5.0]


def test_the_first_rows_of_a_table_are_written_once(spark, bars, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "materialised", lambda df: pytest.fail("a copy beside the table"))
    commit = store.Commit(spark, str(tmp_path), "1")
    assert store.upsert(commit, "bars", bars) == ["2024-01", "2024-02"]
    assert content(commit.read("bars").select("order_book_id", "date", "close")) == content(bars.select("order_book_id", "date", "close"))
    with pytest.raises(ValueError):
        store.upsert(commit, "others", bars.unionByName(bars.limit(1)))
    assert commit.read("others") is None


def test_an_analysis_saves_in_slices_without_a_copy_of_its_file(spark, bars, tmp_path, monkeypatch):
    source, out = f"{tmp_path}/bars.parquet", f"{tmp_path}/scores.parquet"
    bars.write.parquet(source)
    monkeypatch.setattr(jobs, "SLICE_ROWS", 70)
    with monkeypatch.context() as m:
        m.setattr(jobs, "materialised", lambda df: pytest.fail("a copy of the file"))
        given = jobs.analyse(spark, source, out=out)
    saved = tables.load(spark, out)
    want = content(full(bars, bars.limit(0).select("order_book_id", F.lit("").alias("industry"), F.lit(0.0).alias("market_cap")))
                   .select(*KEYS, "trend_score", "risk_score", "macd_hist"))
    assert content(saved.select(*KEYS, "trend_score", "risk_score", "macd_hist")) == want
    assert content(given.select(*KEYS, "trend_score", "risk_score", "macd_hist")) == want
    assert saved.columns == given.columns and saved.select("_calculation_timestamp").distinct().count() == 1
    assert "_SUCCESS" in os.listdir(out)
    jobs.analyse(spark, f"file:{source}", out=source)  # a file that its scores replace is copied first
    assert content(tables.load(spark, source).select(*KEYS, "trend_score", "risk_score", "macd_hist")) == want
    bad = bars.withColumn("close", F.raise_error(F.lit("bad")).cast("double"))
    with pytest.raises(Exception):
        tables.save_parts([bars, bad], out)
    assert not os.path.exists(out)


def test_a_table_without_days_goes_only_as_a_whole_and_when_asked(spark, bars, tmp_path):
    tables.save_table(bars, str(tmp_path), "whole")
    assert tables.drop_expired(spark, str(tmp_path), "whole", 1, "2024-01-04", whole=True) == []  # its files are newer
    assert tables.drop_expired(spark, str(tmp_path), "whole", 1, "2999-01-01", whole=True) == ["whole"]
