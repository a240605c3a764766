"""Fill-in-middle examples against a plain version, and back."""
from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import infill

TEXTS = [
    (0, "plain words in a row"), (1, None), (2, ""), (3, "with <P> inside"), (4, "ends in <S>"), (5, "<M>"), (6, "x"),
    (7, "Ärger 日本語 🙂 mixed é"), (7, "Ärger 日本語 🙂 mixed é"), (7, "another text of the same id"), (None, "no id at all"),
    (8, "almost <P <S M> <<P << >"), (9, "🙂" * 700), (-5, "negative id"), (2**62, "large id"),
    *[(100 + i, f"text {i} " * (i % 7 + 1) + "<" * (i % 3)) for i in range(60)],
]


def plain_version(doc_id, text, plain_share=10, spm_share=20):
    t = text or ""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in infill.SENTINELS) or h[2] % 100 >= 100 - plain_share:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < spm_share:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows],
                                 "doc_id long, text string, form string, n int, output string").repartition(3)


@pytest.mark.parametrize("shares", [(10, 20), (0, 50), (0, 0), (100, 0)])
def test_examples(spark, shares):
    got = infill.examples(frame(spark, TEXTS), plain_share=shares[0], spm_share=shares[1])
    got = got.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *plain_version(i, t, *shares)) for i, t in TEXTS)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in TEXTS)
    assert infill.examples(frame(spark, TEXTS).where("false")).count() == 0


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 20])
def test_block_seams(size):
    """Texts far above a slice, in blocks that end within and beside code points."""
    texts = [t for _, t in TEXTS if t] + ["aé日🙂" * 300, "", "b"]
    rng = np.random.default_rng(5)
    cuts = np.sort(np.stack([rng.integers(0, len(t) + 1, 2) for t in texts]), axis=1)
    size = max(size, 4)  # a code point has up to four bytes
    got = infill.cut_pieces(pa.array(texts), cuts[:, 0], cuts[:, 1], size)
    want = [[t[:a], t[a:b], t[b:]] for t, (a, b) in zip(texts, cuts.tolist())]
    assert [list(x) for x in zip(*(g.to_pylist() for g in got))] == want
    part = infill.cut_pieces(pa.array(["skipped", *texts])[1:], cuts[:, 0], cuts[:, 1], size)
    assert [p.to_pylist() for p in part] == [g.to_pylist() for g in got]


def test_very_long_text(spark):
    long_text = "wörter " * 400_000
    got = infill.examples(frame(spark, [(3, long_text), (12, "short")])).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *plain_version(i, t)) for i, t in [(3, long_text), (12, "short")])
