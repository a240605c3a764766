"""Whole results against plain Python: op2's weights, keys and cuts, op7's fingerprints, op9's covering, the five
pipeline stages row by row, and texts across block seams."""
from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from test_llm import mark, split

from barloom.llm import common, context_tree, encoding, media, mixing, packing, quality_rules, resampling, simhash
from barloom.llm.common import word_blocks


def spark_hash(value, *more):
    """Spark's xxhash64 of a long and further ints."""
    h = 42 if value is None else xxhash.xxh64_intdigest(int(value).to_bytes(8, "little", signed=True), 42)
    for x in more:
        h = xxhash.xxh64_intdigest(int(x).to_bytes(4, "little", signed=True), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


# ---------------------------------------------------------------- op2


def buckets_of(text, buckets):
    tokens = [xxhash.xxh64_intdigest(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    out, mask = [t % buckets for t in tokens], (1 << 64) - 1
    for a, b in zip(tokens, tokens[1:]):
        x = (a * 0x9E3779B97F4A7C15 + b) & mask
        x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & mask
        out.append((x ^ x >> 32) % buckets + buckets)
    return out


def gumbel(i):
    u = ((spark_hash(i, resampling.SEED) >> 11) + 0.5) / (1 << 53)
    return -math.log(-math.log(u))


def weights(rows, labels, target_rows, buckets=resampling.BUCKETS):
    """(id, n_grams, log weight, key) per row, and the held-back ids."""
    good = sorted({i for i, q in labels if q == 1 and i is not None}, key=lambda i: (signed(spark_hash(i)), i))[:target_rows]
    raw, target = Counter(), Counter()
    for i, t in rows:
        own = buckets_of(t, buckets)
        raw.update(own)
        if i in good[::2]:
            target.update(own)
    ratio = {}
    for part in (range(buckets), range(buckets, 2 * buckets)):
        all_raw, all_target = (sum(c[b] for b in part) for c in (raw, target))
        for b in part:
            if all_raw and all_target and raw[b]:
                expected = raw[b] * all_target / all_raw
                ratio[b] = math.log((target[b] + resampling.SHRINK) / (expected + resampling.SHRINK))
    out = []
    for i, t in rows:
        own = buckets_of(t, buckets)
        w = sum(ratio.get(b, 0.0) for b in own)
        out.append((i, len(own), w, w + gumbel(i)))
    return out, good[1::2]


def cut_of(found, held, share=resampling.KEEP_SHARE):
    best = defaultdict(lambda: -math.inf)
    for i, _, _, k in found:
        if i in set(held):
            best[i] = max(best[i], k)
    keys = sorted(best.values())
    return keys[math.floor((1 - share) * len(keys))] if keys else None


@pytest.mark.parametrize("target_rows,k", [(1000, None), (9, None), (1000, 40), (1000, 1), (1000, 0)])
def test_resampling_equals_plain_python(spark, target_rows, k):
    rng = np.random.default_rng(7)
    good = [(i, " ".join(rng.choice(["garden", "river", "stone", "Ärger", "it's"], 30))) for i in range(120)]
    bad = [(1000 + i, " ".join(rng.choice(["buy", "$$$", "###", "now"], 20))) for i in range(60)]
    rows = [*good, *bad, (None, "garden"), (7, None), (8, ""), good[3], good[3]]
    labels = [(i, 1) for i in range(0, 120, 3)] + [(1001, 0), (None, 1), (2, None), (5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    got = resampling.resample(docs, frame, k=k, keep_share=0.9, target_rows=target_rows).select(
        "doc.doc_id", "n_grams", "log_weight", "key", "kept").collect()
    want, held = weights(rows, labels, target_rows)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [x for g in got for x in g[2:4]] == pytest.approx([x for w in want for x in w[2:]], abs=1e-9)
    if k is None:
        cut = cut_of(want, held, 0.9)
    else:
        cut = sorted((w[3] for w in want), reverse=True)[k - 1] if k else math.inf
    assert [g[4] for g in got] == [w[3] >= cut - 1e-9 for w in want]


def test_op2_keeps_the_k_largest_keys(spark, tmp_path):
    rows = [(i, f"garden {i % 7} river {i % 5} stone " * 6 if i % 5 else f"### buy {i % 9} now $$$ " * 6) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 5 > 1)) for i in range(0, 400, 3)]  # a fifth of the good ones is labelled bad
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = resampling.op2_resampling(spark, str(tmp_path)).collect()
    k = round(400 * sum(q for _, q in labels) / len(labels))
    assert len(got) == 400 and k < 300
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in sorted(got, key=lambda r: -r.key)[:k]}


# ---------------------------------------------------------------- op7


def plain_landmarks(samples):
    """Frame by frame and band by band."""
    x = list(samples)
    while len(x) < media.FRAME or (len(x) - media.FRAME) % media.HOP:
        x.append(128)
    window = np.hanning(media.FRAME).astype(np.float32)
    frames = [np.abs(np.fft.rfft((np.array(x[s:s + media.FRAME], np.float32) - 128) * window).astype(np.complex64))
              for s in range(0, len(x) - media.FRAME + 1, media.HOP)]
    best = [[max(range(lo, hi), key=lambda b: (f[b], -b)) for lo, hi in media.BANDS] for f in frames]
    peaks = []
    for t, f in enumerate(frames):
        for band in range(len(media.BANDS)):
            size = f[best[t][band]]
            near = [(u, frames[u][best[u][band]]) for u in range(max(0, t - media.NEAR), min(len(frames), t + media.NEAR + 1)) if u != t]
            if size > 1e-3 and all(size > other if u < t else size >= other for u, other in near):
                peaks.append((t, best[t][band]))
    out = []
    for k, (t, f) in enumerate(peaks):
        for u, g in peaks[k + 1:k + 1 + media.FAN_OUT]:
            out.append(t << 32 | f << 24 | g << 16 | min(u - t, 0xFFFF))
    return sorted(out)


@pytest.mark.parametrize("size", [64, 256, 320, 1000, 6400])
def test_landmarks_equal_a_plain_version(size, monkeypatch):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 256, size).astype(np.uint8).tobytes(), (b"plain words again and " * 400)[:size], bytes(size),
                 bytes([128]) * size):
        want = plain_landmarks(data)
        assert media.landmarks(data).tolist() == want
        with monkeypatch.context() as m:
            m.setattr(media, "BLOCK", 3)  # frames on both sides of a seam
            assert media.landmarks(data).tolist() == want


# ---------------------------------------------------------------- block seams


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_seams_of_words_and_grams(size, monkeypatch):
    text = " ".join(f"Wörter{k % 13} of {k % 7}\n\tx" for k in range(300))
    with monkeypatch.context() as m:
        m.setattr(simhash, "word_blocks", functools.partial(word_blocks, size=size))
        assert simhash.fingerprint(text) == mark(text)
    whole = resampling.ngram_buckets(text, 1 << 15)
    with monkeypatch.context() as m:
        m.setattr(resampling, "BLOCK", size)
        assert Counter(resampling.ngram_buckets(text, 1 << 15).tolist()) == Counter(whole.tolist())
    assert Counter(whole.tolist()) == Counter(buckets_of(text, 1 << 15))
    data = text.encode().lower()
    grams = Counter(int.from_bytes(x, "big") for x in ())
    with monkeypatch.context() as m:
        m.setattr(context_tree, "BLOCK", max(size, 6))
        for block in context_tree._stream(data, 5):
            grams.update(context_tree._grams(block, 5).tolist())
    once = Counter()
    for block in context_tree._stream(data, 5):
        once.update(context_tree._grams(block, 5).tolist())
    assert grams == once and sum(once.values()) == len(data) + 1
    assert [w for b in common.word_blocks(data, size) for w in b] == data.split()


# ---------------------------------------------------------------- op9


def plain_rules(rows, precision=0.97, least=5, longest=3, most_rules=8):
    """Sequential covering over rows (bad, prune, {feature: value})."""
    names = list(quality_rules.FEATURES)
    shares = [(k + 0.5) / quality_rules.CUTS for k in range(quality_rules.CUTS)]
    cuts = {}
    for n in names:
        values = sorted({float(v) for c in (0, 1) for v in np.percentile([f[n] for b, _, f in rows if b == c], [100 * s for s in shares])})
        cuts[n] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    holds = lambda rule, f: all(f[n] > cut if above else f[n] <= cut for n, above, cut in rule)
    rules = []
    while len(rules) < most_rules:
        left = [r for r in rows if not any(holds(rule, r[2]) for rule in rules)]
        rule = ()
        while len(rule) < longest:
            part = [(b, f) for b, prune, f in left if not prune and holds(rule, f)]
            p0, n0 = sum(b for b, _ in part), sum(1 - b for b, _ in part)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for n in names:
                for cut in cuts[n]:
                    for above in (False, True):
                        hit = [b for b, f in part if (f[n] > cut) == above]
                        p = sum(hit)
                        if p:
                            g = p * (math.log2(p / len(hit)) - math.log2(p0 / (p0 + n0)))
                            if g > gain:
                                best, gain = (n, above, cut), g
            if best is None:
                break
            rule += (best,)
        if not rule:
            break
        value = {}
        for k in range(1, len(rule) + 1):
            hit = [b for b, prune, f in left if prune and holds(rule[:k], f)]
            value[k] = ((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, sum(hit), len(hit))
        k = max(value, key=lambda x: (value[x][0], -x))
        if value[k][1] < least or value[k][1] < precision * value[k][2]:
            break
        rules.append(rule[:k])
    return rules


def test_covering_equals_a_plain_version(spark):
    rng = np.random.default_rng(6)
    data = []
    for i in range(900):
        sym, cap, digit = rng.random(3)
        bad = int((sym > 0.7 and cap > 0.4) or digit > 0.92)
        data.append((i, 100, 1000, int(1000 * sym), 0, 0, 10, 90, int(1000 * cap), int(1000 * digit), 0, bad))
    frame = spark.createDataFrame(data, "doc_id long, " + " long, ".join(quality_rules.STATISTICS) + " long, bad int")
    feats = [quality_rules.feature(n).alias(n) for n in quality_rules.FEATURES]
    rows = [(r["bad"], r["prune"], {n: r[n] for n in quality_rules.FEATURES}) for r in frame.select(
        "bad", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("prune"), *feats).collect()]
    assert quality_rules.learn(frame) == plain_rules(rows) == []  # no rule is precise enough on the pruning rows
    got = [tuple((c.feature, c.above, c.cut) for c in rule) for rule in quality_rules.learn(frame, precision=0.8)]
    want = plain_rules(rows, precision=0.8)
    assert len(want) >= 2 and [[x[:2] for x in r] for r in got] == [[x[:2] for x in r] for r in want]
    assert [x[2] for r in got for x in r] == pytest.approx([x[2] for r in want for x in r])


# ---------------------------------------------------------------- the pipeline


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_pipeline_stages_row_by_row(spark, sf):
    import corpus_pipeline as cp

    stages = dict(cp.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    label_rows = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    texts = {r.doc_id: r for r in docs.collect()}

    # 1: the base rule by hand, the learned list on the statistics
    rules = quality_rules.learn_from(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    stats = {r["doc_id"]: r for r in quality_rules.with_statistics(docs).select(
        "doc_id", *quality_rules.STATISTICS, *[quality_rules.feature(n).alias(f"f_{n}") for n in quality_rules.FEATURES]).collect()}
    keep = set()
    for i, s in stats.items():
        fails = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        hit = any(all(s[f"f_{c.feature}"] > c.cut if c.above else s[f"f_{c.feature}"] <= c.cut for c in rule) for rule in rules)
        assert s["n_words"] == len(split(texts[i].text))
        if not fails and not hit:
            keep.add(i)
    first = cp.saved(stages["quality_rules"](spark, docs, sf), "t")
    assert rows_of(first) == Counter((i, texts[i].text) for i in keep) and first.columns == docs.columns

    # 2: weights, keys and the cut
    before = [(r.doc_id, r.text) for r in first.collect()]
    found, held = weights(before, label_rows, resampling.TARGET_ROWS)
    cut = cut_of(found, held)
    second = cp.saved(stages["quality_classifier"](spark, first, sf), "t")
    assert rows_of(second) == Counter((i, texts[i].text) for i, _, _, k in found if cut is None or k >= cut - 1e-9)

    # 3: one row of each component of near fingerprints, that with the smallest id
    ids = sorted(r.doc_id for r in second.collect())
    marks = {i: mark(texts[i].text) for i in ids}
    root = {i: i for i in ids}
    for _ in range(len(ids)):
        changed = False
        for a in ids:
            for b in ids:
                if (marks[a] ^ marks[b]).bit_count() <= 4 and root[b] < root[a]:
                    root[a], changed = root[b], True
        if not changed:
            break
    third = cp.saved(stages["near_duplicates"](spark, second, sf), "t")
    assert rows_of(third) == Counter((i, texts[i].text) for i in set(root.values()))

    # 4: Poisson counts by hand
    left = sorted(set(root.values()))
    size = Counter()
    for i in left:
        size[texts[i].source or ""] += max(1, len((texts[i].text or "").encode()))
    share = {s: n ** mixing.TEMPERATURE for s, n in size.items()}
    want = Counter()
    for i in left:
        s = texts[i].source or ""
        rate = share[s] / sum(share.values()) * sum(size.values()) / size[s]
        u = int(__import__("hashlib").md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:mixing.HEX], 16) / float(1 << 4 * mixing.HEX)
        k, total, p = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        if k:
            want[(i, texts[i].text)] += k
    fourth = cp.saved(stages["mixing"](spark, third, sf), "t")
    assert rows_of(fourth) == want

    # 5: every piece of every document once, sequences without gap or overlap, near the lower bound
    fifth = stages["packing"](spark, fourth, sf).toPandas()
    own = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for (i, t), n in want.items():
        ids = own.ids(t) + (2).to_bytes(4, "little")
        for k, (s, m) in enumerate(packing.cut_points(len(ids) // 4, 1024)):
            pieces[(i, k, s, m, zlib.crc32(ids[4 * s:4 * (s + m)]))] += n
    assert Counter(zip(fifth.doc_id, fifth.piece, fifth.start, fifth.length, fifth.ids_crc32)) == pieces
    for _, g in fifth.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 1024
    assert fifth.sequence_id.nunique() <= math.ceil(fifth.length.sum() / 1024) * 1.01 + 2
