"""Small text helpers for the oracle SQL."""
from __future__ import annotations

import re

SYM = "PARTITION BY order_book_id ORDER BY date"


def rnd(cols: str, digits: int = 4) -> str:
    """The columns rounded the way the Spark side reports them."""
    return ", ".join(f"RND{digits}({c}) AS {c}" for c in cols.split())


def full(agg: str, col: str, n: int) -> str:
    """Aggregate over the last n rows, null unless all n inputs are there."""
    w = f"OVER ({SYM} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} = {n} THEN {agg}({col}) {w} END"


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) OVER ({SYM})"


def change(col: str) -> str:
    return f"({col} - {lag(col)}) / nullif({lag(col)}, 0)"


def ewm(col: str, span: int) -> str:
    g = f"pow({1.0 / (1.0 - 2.0 / (span + 1.0))!r}::DOUBLE, r)"
    w = f"OVER ({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"sum({col} * {g}) {w} / sum(CASE WHEN {col} IS NOT NULL THEN {g} END) {w}"


def expand(text: str) -> str:
    """RND4(x) -> x rounded to 4 digits, ties settled upwards, no negative zero."""
    while (m := re.search(r"\bRND(\d)\(", text)) is not None:
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner, d = text[m.end():end - 1], int(m.group(1))
        text = f"{text[:m.start()]}(round(({inner}) + CAST(37e-{d + 4} AS DOUBLE), {d}) + 0.0){text[end:]}"
    return text
