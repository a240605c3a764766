"""Merkle proofs against trees built by hand, over many sizes, depths and ragged ends."""
from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root, and for each leaf its (before, after) steps."""
    steps, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for k, p in enumerate(at):
            run = now[p // 8 * 8:p // 8 * 8 + 8]
            steps[k].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
        now = [sha("".join(now[i:i + 8])) for i in range(0, len(now), 8)]
        at = [p // 8 for p in at]
    return now[0], steps


def expected(rows):
    """rows: (doc_id, lang, leaf); the whole result by hand."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(r[1], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([r[2] for r in groups[g]]) for g in langs}
    root, tops = tree([subs[g][0] for g in langs])
    return Counter((r[0], g, r[2], subs[g][0], root, tuple(subs[g][1][k] + tops[n]))
                   for n, g in enumerate(langs) for k, r in enumerate(groups[g]))


def rows_of(sizes):
    out, at = [], 0
    for lang, n in sizes.items():
        out += [(at + 3 * k, lang, sha(f"{lang}{k}")) for k in range(n)]
        at += 1
    return out


CASES = [
    (2, {"a": 1}), (1, {"a": 8}), (4, {"a": 9, "b": 1}), (1, {None: 3, "": 7, "é": 8, "z": 64, "ö": 65}),
    (1, {"a": 73, "b": 513, "c": 100}), (2, {f"l{k}": 1 + k % 3 for k in range(70)}), (2, {"a": 1100}),
]


@pytest.mark.parametrize("depth,sizes", CASES, ids=str)
def test_proofs(spark, depth, sizes):
    rows = rows_of(sizes)
    leaves = spark.createDataFrame([(*r, "x", [1, 2]) for r in rows], "doc_id long, lang string, leaf string, g string, row array<int>")
    found = merkle.with_proofs(leaves.repartition(5), "lang", ["doc_id"], depth=depth).collect()
    got = Counter((r.row.doc_id, r.row.lang, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in found)
    assert got == expected(rows)
    assert all(r.row.g == "x" and r.row.row == [1, 2] for r in found)


def test_no_key_gets_more_than_a_run(spark, monkeypatch):
    """Every exchange of a round brings at most FANOUT rows to a key, and no round has over twice its blocks."""
    seen = []
    real = merkle.saved

    def watched(df, name, *more):
        if name == "round":
            plan = df._jdf.queryExecution().analyzed().toString()
            assert "CollectList" in plan or "collect_list" in plan
        out = real(df, name, *more)
        if name == "round":
            seen.append(out.count())
        return out

    monkeypatch.setattr(merkle, "saved", watched)
    rows = rows_of({"a": 8 * 73 + 5})
    leaves = spark.createDataFrame(rows, "doc_id long, lang string, leaf string")
    assert merkle.with_proofs(leaves, "lang", ["doc_id"], depth=1).count() == len(rows)
    assert seen == [74, 74, 74]  # levels 2, 3 and 4 above 74 blocks of one level


def test_odd_rows(spark):
    docs = [(None, None, "en", 3, "no id"), (None, "s", None, None, None), (1, "s", "en", 2, "Ab"), (1, "s", "en", 2, "Ab"),
            (1, "s", "en", 2, "other"), (5, "", "", -1, ""), (7, "日", "de", 9, "LONG " * 300_000)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars int, text string")
    leaf = merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])

    def by_hand(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    leaves = frame.select("doc_id", "lang", leaf.alias("leaf"))
    want = [(d[0], d[2], by_hand(*d)) for d in docs]
    assert Counter(map(tuple, leaves.collect())) == Counter(want)
    found = merkle.with_proofs(leaves, "lang", ["doc_id"])
    got = Counter((r.row.doc_id, r.row.lang, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in found.collect())
    assert got == expected(want)
    checked = found.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"),
                           (merkle.folded(F.lit(sha("x")), F.col("proof")) == F.col("root")).alias("bad")).collect()
    assert all(r.ok and not r.bad for r in checked)
    assert merkle.with_proofs(leaves.where("false"), "lang", ["doc_id"]).count() == 0


def test_tampering(spark):
    frame = spark.createDataFrame([(i, t) for i in range(40) for t in ("ABz É", None)], "doc_id long, text string")
    import zlib
    for r in frame.select("doc_id", "text", merkle.tampered(F.col("text"), F.col("doc_id")).alias("low")).collect():
        hit = zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        assert r.low == (r.text if r.text is None or not hit else "abz É")
