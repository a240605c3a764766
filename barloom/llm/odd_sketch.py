"""MinHash near-duplicates: banded candidates, odd sketches as their filter, a check on the full sets.

A document is the set of its distinct two-word shingles (64-bit hashes). SAMPLES MinHash values in BANDS bands
of ROWS give the bucket keys. For candidate pairs the samples are folded into a parity bitmap, the odd sketch:
every sample flips one bit, so the XOR of two sketches has about two bits for each differing sample, and its
population count estimates high similarities closely. A second odd sketch folds the whole set. Its XOR never has
more bits than the sets have unequal shingles, so a pair whose count is too high for the threshold is no link
for certain. What passes is verified by intersecting the full sets.

Only links that can join two components matter, so pairs of a bucket are never written out in full:
1. `stars`: every member of a bucket is tied to the smallest one;
2. `forest`: where a bucket still holds several components, its members are compared in blocks, those outside
   its largest component with all, and a spanning forest of the most similar pairs is kept;
3. `rest`: the pairs of different components that are left and pass both sketches.
After each step the pairs are verified and the components of the verified links are found. Copies of one set
are one node throughout. Buckets above BLOCK members are dealt out as pairs of blocks, hubs of verification in
parts of PART pairs.

A pair of similarity 0.8 shares no band with a probability of 5e-7, one of 0.85 with 1e-10; the sample sketch
lets a pair of 0.8 go with 3e-7 (five standard deviations). Everything else is exact.

Edge cases: a text with one word is one shingle; null, empty and white-space texts have no shingle and are
linked with nothing, so each is a component of its own; rows that repeat an id with the same text are
repeated in the result, with different texts they are different nodes that may be in different components; rows
with a null id are kept, a component's id is the smallest id that is not null, and such a row is `kept` only if
its component has no id; ties cannot arise, for 100 * |A and B| >= 80 * |A or B| is exact in integers; an empty
table gives no rows; other columns are not read, whatever their names; of a very long text the words are hashed
in blocks, and only its distinct hashes are held.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm.common import join_unique, saved, table, utf8, word_blocks
from barloom.llm.components import connected_components
from barloom.llm.registry import query

BANDS, ROWS = 48, 6
SAMPLES = BANDS * ROWS
SAMPLE_WORDS, SET_WORDS = 16, 64  # 64-bit words of the two sketches
SIGMAS = 5.0
BLOCK = 512  # members of a bucket that a task compares with as many others
PART = 1024  # pairs of one hub that are verified together
MEMO = 1 << 18  # word hashes a task remembers

SIGNED = "doc_id long, text_key long, n long, digest binary, bands binary"
SETS = "node long, n long, marks array<long>, hashes binary"

_RNG = np.random.default_rng(20)
_TIMES = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Hash of a word; forgets all when it holds MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words: _Words, size: int = 1 << 20) -> np.ndarray:
    """Sorted distinct hashes of the two-word shingles."""
    parts, last, n = [], np.zeros(0, np.uint64), 0
    for block in word_blocks(utf8(text).lower(), size):  # bytes.lower changes A-Z alone
        n += len(block)
        own = np.r_[last, np.fromiter(map(words.__getitem__, block), np.uint64, len(block))]
        if len(own) > 1:
            parts.append(np.unique(_mixed(own[:-1] * _MIX + own[1:])))
        last = own[-1:]
    if n == 1:
        return _mixed(last * _ODD)
    return np.zeros(0, np.uint64) if not parts else parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of SAMPLES hash functions over a set that is not empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 64):
        least = np.minimum(least, (low[at:at + 64, None] * _TIMES + _PLUS).min(0))
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _MIX + rows[:, k])
    return key


def odd_sketch(values: np.ndarray, words: int) -> np.ndarray:
    """Parity of the number of values at each bit."""
    bits = 64 * words
    at = (_mixed(values) >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64)
    odd = np.bincount(at, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def marks_of(hashes: np.ndarray) -> np.ndarray:
    """Both odd sketches, that of the numbered samples first."""
    numbered = min_hashes(hashes).astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))
    return np.r_[odd_sketch(numbered, SAMPLE_WORDS), odd_sketch(hashes, SET_WORDS)]


def sample_bound(threshold: int) -> int:
    """Differing bits that the sample sketches of a pair at the threshold do not exceed, by SIGMAS standard
    deviations of the number of differing samples and of the bits they share."""
    bits, share = 64 * SAMPLE_WORDS, threshold / 100
    differ = SAMPLES * (1 - share)
    flips = 2 * differ
    count_var = bits / 4 * (1 - math.exp(-4 * flips / bits)) - flips * math.exp(-4 * flips / bits)
    slope = 2 * math.exp(-2 * flips / bits)
    most = differ + SIGMAS * math.sqrt(SAMPLES * share * (1 - share) + max(count_var, 0) / slope**2)
    return math.ceil(bits / 2 * (1 - math.exp(-4 * most / bits)))


def _packed(hashes: np.ndarray) -> bytes:
    """48 bits of each hash: two sets of 5000 share one by chance with a probability of 1e-7."""
    return np.ascontiguousarray((hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, words = [c.split()[0] for c in SIGNED.split(", ")], _Words()
    for batch in batches:
        n, digests, bands, known = [], [], [], {}
        for text in batch.column(2):
            hashes = shingle_set(text.as_py(), words)
            n.append(len(hashes))
            digests.append(_digest(hashes))
            if digests[-1] not in known:
                known[digests[-1]] = band_keys(min_hashes(hashes)).astype("<u8").tobytes() if len(hashes) else None
            bands.append(known[digests[-1]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(bands, pa.binary())], names=names)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches and sets of candidate texts; a text whose set is not that of its node shares only a key."""
    names, words, seen = [c.split()[0] for c in SETS.split(", ")], _Words(), set()
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    for batch in batches:
        rows = []
        for node, digest, text in zip(*(batch.column(k) for k in range(3))):
            if (key := node.as_py()) in seen:
                continue
            hashes = shingle_set(text.as_py(), words)
            if _digest(hashes) == digest.as_py():
                seen.add(key)
                rows.append((key, len(hashes), marks_of(hashes).view(np.int64), _packed(hashes)))
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches that never end inside a run of equal values in the first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
        cut = int(new[-1]) + 1 if len(new) else 0  # where the last run begins
        if held and any(held[-1].column(k)[-1].as_py() != cols[k][0] for k in range(keys)):
            yield pa.concat_batches(held)
            held = []
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _edges_of(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    cols = [batch.column(k).to_numpy() for k in range(keys)]
    starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    return np.r_[starts, batch.num_rows]


def _pairs_frame(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verify(threshold: int):
    """Rows (hub, part, is_hub, node, n, hashes), the hub first: the nodes that are linked with their hub."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, key = np.zeros(0, np.uint64), None
        for batch in batches:
            a, b = [], []
            hubs, parts, first, nodes = (batch.column(k).to_pylist() for k in range(4))
            for k in range(batch.num_rows):
                own = _unpacked(batch.column(4)[k].as_py())
                if first[k]:
                    hub, key = own, (hubs[k], parts[k])
                elif key == (hubs[k], parts[k]):
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    if 100 * both >= threshold * (len(hub) + len(own) - both):
                        a.append(hubs[k])
                        b.append(nodes[k])
            yield _pairs_frame(a, b)

    return run


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Positions of the pairs of a spanning forest, lightest first, over the parts of the nodes a and b."""
    order = np.argsort(weight, kind="stable")
    label = np.arange(int(part.max()) + 1)
    chosen = []
    while len(order):
        x, y = label[part[a[order]]], label[part[b[order]]]
        order = order[x != y]
        x, y = x[x != y], y[x != y]
        if not len(order):
            break
        _, at = np.unique(np.stack([x, y], 1).ravel(), return_index=True)  # the lightest pair of each label
        for k in np.unique(at // 2).tolist():
            p, q = int(x[k]), int(y[k])
            while label[p] != p:
                p = int(label[p])
            while label[q] != q:
                q = int(label[q])
            if p != q:
                label[max(p, q)] = min(p, q)
                chosen.append(int(order[k]))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return np.asarray(chosen, np.int64)


def _close_pairs(outer: np.ndarray, size: np.ndarray, part: np.ndarray, marks: np.ndarray, threshold: int,
                 bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) and the differing bits of their sample sketches, i an outer row, j another row of a
    different part, whose sizes and sketches allow the threshold."""
    left, right, bits = [], [], []
    for i in np.flatnonzero(outer).tolist():
        near = np.flatnonzero(~outer & (part != part[i]) & (100 * np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i])))
        if not len(near):
            continue
        differ = np.bitwise_count(marks[near, :SAMPLE_WORDS] ^ marks[i, :SAMPLE_WORDS]).sum(1, dtype=np.int64)
        near, differ = near[differ <= bound], differ[differ <= bound]
        unequal = np.bitwise_count(marks[near, SAMPLE_WORDS:] ^ marks[i, SAMPLE_WORDS:]).sum(1, dtype=np.int64)
        ok = (100 + threshold) * unequal <= (100 - threshold) * (size[near] + size[i])
        left.append(np.full(int(ok.sum()), i))
        right.append(near[ok])
        bits.append(differ[ok])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty), np.concatenate(bits or empty)


def _compare(threshold: int, bound: int, spanning: bool):
    """Rows (bucket, i, j, outer, node, component, n, marks) by bucket and blocks: close pairs of different
    components with one node among the outer rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 3):
            cuts = _edges_of(batch, 3)
            is_outer, nodes, comps, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7))
            marks = batch.column(7).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            found_a, found_b = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = np.unique(comps[s:e], return_inverse=True)[1]
                a, b, bits = _close_pairs(is_outer[s:e], size[s:e], part, marks[s:e], threshold, bound)
                if spanning and len(a):
                    keep = forest(a, b, bits, part)
                    a, b = a[keep], b[keep]
                if len(a):
                    own = nodes[s:e]
                    found_a.append(np.minimum(own[a], own[b]))
                    found_b.append(np.maximum(own[a], own[b]))
            empty = [np.zeros(0, np.int64)]
            yield _pairs_frame(np.concatenate(found_a or empty), np.concatenate(found_b or empty))

    return run


class _Search:
    """Nodes of one corpus and what candidate pairs of them need."""

    def __init__(self, docs: DataFrame, threshold: int, doc_id: str, text: str) -> None:
        self.threshold, self.bound = threshold, sample_bound(threshold)
        body = F.col(text)
        source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
        self.rows = saved(source.mapInArrow(_sign, SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
        self.nodes = saved(
            self.rows.where("n > 0").groupBy("digest")
            .agg(F.min("row").alias("node"), F.min(first).alias("x"), F.count("*").alias("rows"))
            .select("digest", "node", F.col("x.doc_id").alias("rep"), "x.text_key", "rows"), "nodes")
        self.members = saved(self._members(), "members")
        self.sets = saved(self._sets(source), "sets")

    def _members(self) -> DataFrame:
        """(bucket, node, first): the buckets with several nodes; `first` is the smallest one."""
        bands = self.rows.select(F.col("row").alias("node"), "bands").join(
            self.nodes.select("node").hint("shuffle_hash"), "node", "left_semi")
        spread = bands.mapInArrow(_spread, "bucket long, node long")
        buckets = saved(spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1"), "buckets")
        return join_unique(spread, buckets, "bucket", "n", self.nodes.count() * BANDS)

    def _sets(self, source: DataFrame) -> DataFrame:
        """Sketches and sets of the nodes that share a bucket. Rows that repeat an id and its text may leave a
        node twice, which changes no component."""
        wanted = self.nodes.join(self.members.select("node").distinct(), "node").select(
            "node", "digest", F.col("rep").alias("_rep"), F.col("text_key").alias("_key"))
        found = source.join(wanted.hint("shuffle_hash"), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_rep")))
        return found.select("node", "digest", "text").mapInArrow(_measure, SETS)

    def stars(self) -> DataFrame:
        """Each member of a bucket with the smallest one, if sizes and sketches allow a link."""
        pairs = self.members.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        narrow = self.sets.select("node", "n", "marks")
        ends = [narrow.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"m_{x}")) for x in "ab"]
        both = pairs.join(ends[0], "a").join(ends[1], "b")

        def differing(start: int, words: int) -> Column:
            x = F.zip_with(F.slice("m_a", start, words), F.slice("m_b", start, words), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
            return F.aggregate(x, F.lit(0), lambda total, one: total + one)

        t = self.threshold
        return both.where(
            (100 * F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b"))
            & (differing(1, SAMPLE_WORDS) <= self.bound)
            & ((100 + t) * differing(SAMPLE_WORDS + 1, SET_WORDS) <= (100 - t) * (F.col("n_a") + F.col("n_b")))
        ).select("a", "b")

    def open_buckets(self, classes: DataFrame) -> DataFrame:
        """(bucket, node, component, outer, size, most): members of buckets with several components; outer are
        those outside the bucket's largest component."""
        named = classes.select(F.col("node"), F.col("component").alias("_c"))
        rows = self.members.select("bucket", "node").join(named.hint("shuffle_hash"), "node", "left").select(
            "bucket", "node", F.coalesce("_c", "node").alias("component"))
        parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("k"))
        alive = parts.groupBy("bucket").agg(
            F.max(F.struct("k", "component")).alias("x"), F.sum("k").alias("size"), F.count("*").alias("parts")).where("parts > 1")
        alive = alive.select("bucket", F.col("x.component").alias("main"), "size", (F.col("size") - F.col("x.k")).alias("others"))
        alive = saved(alive, "open-buckets")
        joined = join_unique(rows, alive.withColumn("_n", F.col("size")), "bucket", "_n", self.members.count())
        return joined.select("bucket", "node", "component", (F.col("component") != F.col("main")).alias("outer"), "size", "others")

    def compared(self, classes: DataFrame, spanning: bool) -> DataFrame:
        """Close pairs of different components: a forest of them in each pair of blocks, or all."""
        rows = saved(self.open_buckets(classes), "open")
        blocks = [F.ceil(F.col(x) / BLOCK).cast("int") for x in ("others", "size")]
        own = [F.pmod(F.xxhash64(F.lit(k), "node", "bucket"), blocks[k]).cast("int") for k in (0, 1)]
        outer = rows.where("outer").select("bucket", own[0].alias("i"), F.explode(F.sequence(F.lit(0), blocks[1] - 1)).alias("j"),
                                           F.lit(True).alias("outer"), "node", "component")
        # an outer row meets the others of its own block once, as outer row
        inner = rows.select("bucket", F.explode(F.sequence(F.lit(0), blocks[0] - 1)).alias("i"), own[1].alias("j"),
                            F.lit(False).alias("outer"), "node", "component")
        dealt = outer.unionByName(inner).join(self.sets.select("node", "n", "marks"), "node")
        dealt = dealt.select(F.col("bucket"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "outer", "node",
                             "component", "n", "marks")
        pairs = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(
            _compare(self.threshold, self.bound, spanning), "a long, b long")
        return pairs.distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar. Every part of a hub gets the hub's set once."""
        pairs = saved(pairs, "pairs")
        parts = F.ceil(F.col("_n") / PART).cast("int")
        degrees = pairs.groupBy("a").agg(F.count("*").alias("_n"))
        large = saved(degrees.where(F.col("_n") > PART), "hubs")
        dealt = pairs.join(large.select("a", parts.alias("_p")), "a", "left").select(
            F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.coalesce("_p", F.lit(1))).cast("int").alias("part"),
            F.lit(False).alias("is_hub"), F.col("b").alias("node"))
        hubs = dealt.select("hub", "part").distinct().select("hub", "part", F.lit(True).alias("is_hub"), F.col("hub").alias("node"))
        rows = dealt.unionByName(hubs).join(self.sets.select("node", "hashes"), "node")
        rows = rows.select("hub", "part", "is_hub", "node", "hashes")
        return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("is_hub").desc()).mapInArrow(
            _verify(self.threshold), "a long, b long")

    def classes(self) -> DataFrame:
        """(node, component) of every node with a link. Later links join components, so only these are contracted."""
        found = saved(connected_components(self.verified(self.stars())), "classes")
        for spanning in (True, False):
            more = saved(self.verified(self.compared(found, spanning)), "links")
            if not more.isEmpty():
                found = saved(_joined(found, more), "classes")
        return found


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after further links between nodes of different classes."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    every = found.unionByName(ends.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    own = every.join(ends, "node", "left_semi")  # the nodes of the new links
    a, b = (own.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
    between = links.join(a, "a").join(b, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).where("a != b").distinct()
    upper = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return every.join(upper, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each band of a node."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
        nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], names=["bucket", "node"])


def near_duplicates(docs: DataFrame, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row; the threshold is a similarity in per cent."""
    search = _Search(docs, threshold, doc_id, text)
    reps = search.nodes.select("node", "rep")
    linked = search.classes().join(reps, "node")
    lowest = linked.groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("_n"))
    named = join_unique(linked, lowest, "component", "_n", search.nodes.count()).select("node", "low")
    nodes = search.nodes.join(named, "node", "left").select("digest", F.coalesce("low", "rep").alias("component_id"), "rows")
    narrow = search.rows.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    full = join_unique(narrow.where("n_shingles > 0"), nodes, "digest", "rows", search.rows.count())
    alone = narrow.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = full.unionByName(alone.select(*full.columns))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM d
), classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s))::BIGINT AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), items AS (
  SELECT rep, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.rep AS a, b.rep AS b
  FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, low) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT w.b, r.low FROM reach r JOIN ways w ON w.a = r.node WHERE r.low < w.b
), component AS (
  SELECT node, min(low) AS low FROM reach GROUP BY node
)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(k.low, t.doc_id) AS component_id,
  t.doc_id = coalesce(k.low, t.doc_id) AS kept
FROM sets t LEFT JOIN classes c ON c.s = list_sort(t.s) LEFT JOIN component k ON k.node = c.rep
"""


@query("op12_odd_sketch", ORACLE)
def op12_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
