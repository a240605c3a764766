from __future__ import annotations

import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def make_bars(spark, closes: dict[str, list], start: str = "2024-01-01", step: int = 1):
    """Bars with the given closes per symbol; the other prices follow the close."""
    rows = []
    for symbol, values in closes.items():
        for i, c in enumerate(None if v is None else float(v) for v in values):
            d = day(start) + datetime.timedelta(days=i * step)
            h, l = (None, None) if c is None else (c + 1.0, c - 1.0)
            rows.append((symbol, d, c, h, l, c, 100.0 + i, None if c is None else c * 100.0))
    return spark.createDataFrame(
        rows, "order_book_id string, date date, open double, high double, low double, close double, "
              "volume double, amount double")
