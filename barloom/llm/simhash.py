"""SimHash near-duplicates by an inverted index over the byte positions of fingerprints.

Two 64-bit fingerprints with at most `radius` differing bits have at least 8 - radius equal bytes at equal
positions. A single byte of a position is too common a term (1/256 of all rows), so a posting list is
keyed by `terms` (position, byte) terms together: of the first 8 - (8 - radius) + terms positions any pair
that reaches the minimum shares at least `terms`. Inside a list the shared positional bytes of each pair are
tallied first, pairs below the minimum are dropped, and only the others are verified by their differing bits.
`PairCounts` tells how many pairs each step sees.

Only distinct fingerprints are indexed. A task reads its posting lists in key order and holds one list at a
time; it returns for each linked set in a list a star to its smallest member, not its pairs, which is all
that components need. Lists with over LIST fingerprints are dealt out as pairs of blocks of that size, whatever
the size of the index.

Edge cases: null, empty and white-space texts have fingerprint zero and are linked with each other like any
other; a text with fewer words than a shingle is one shingle; a bit that is set in exactly half of the hashes is
zero; repeated rows are returned as often as they come; very long texts are hashed in blocks; an empty table gives
no rows; rows with a null id are kept, and a component's id is the smallest id that is not null; other columns are
not read by `near_duplicates` and come back unchanged from `without_near_copies`, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm.common import join_unique, saved, table, utf8, word_blocks
from barloom.llm.components import connected_components
from barloom.llm.registry import query

SEED = 42
BITS = 64
LIST = 4096  # fingerprints in a posting list, or in a block of a longer one
HOT_ROWS = 1 << 16  # as many longer lists are matched by broadcast; more are joined by shuffle


class PairCounts:
    """Pairs compared by the index, left by the byte count, and verified, over all tasks."""

    def __init__(self, spark: SparkSession) -> None:
        self.compared, self.counted, self.verified = (spark.sparkContext.accumulator(0) for _ in range(3))


def _add_shingles(votes: np.ndarray, words: list[bytes], size: int) -> int:
    n = len(words) - size + 1
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    begins = (ends - lens)[:n].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(begins, ends[size - 1:].tolist())], "<u8")
    votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return n


def fingerprint(text: str | None, size: int = 4) -> int:
    votes, n, carry = np.zeros(BITS, np.int64), 0, []
    for block in word_blocks(utf8(text).lower()):  # bytes.lower changes A-Z alone
        words = carry + block
        if len(words) >= size:
            n += _add_shingles(votes, words, size)
            carry = words[len(words) - size + 1:]
        else:
            carry = words
    if n == 0 and carry:
        n = _add_shingles(votes, carry, len(carry))
    return int((1 << np.flatnonzero(2 * votes > n).astype(object)).sum()) if n else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, key: Column | None = None) -> DataFrame:
    """doc_id, the fingerprint `mark` as a signed long, and `key` for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), size) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks.view(np.int64))],
                                             names=["doc_id", "key", "mark"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.lit(0).cast("long") if key is None else key).alias("key"),
                       F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, mark long")


def _postings(radius: int, terms: int) -> list[tuple[int, ...]]:
    return list(combinations(range(radius + terms), terms))


def _linked(keys: np.ndarray, sides: np.ndarray, marks: np.ndarray, reps: np.ndarray, combos: np.ndarray,
            first: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Stars of the linked sets in runs of equal keys, and the pairs seen by each step. Rows are compared at
    distance 1, 2, ... up to the longest run, so that all lists of a batch are worked on together in linear memory."""
    n, seen = len(keys), [0, 0, 0]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.repeat(np.r_[at[1:], n], np.diff(np.r_[at, n]))
    root = np.arange(n)
    live, step = np.flatnonzero(last - np.arange(n) > 1), 1
    while len(live):
        other = live + step
        apart = (sides[live] != sides[other]) | (sides[live] == 0)
        i, j = live[apart], other[apart]
        x = marks[i] ^ marks[j]
        equal = x.view(np.uint8).reshape(-1, 8) == 0
        enough = np.flatnonzero(equal.sum(1) >= 8 - radius)  # the tally of shared positional bytes
        near = enough[np.bitwise_count(x[enough]) <= radius]
        shared = np.packbits(equal[near], axis=1, bitorder="little")[:, 0]
        ok = near[first[shared] == combos[i[near]]]  # each pair counts in one list
        seen = [seen[0] + len(i), seen[1] + len(enough), seen[2] + len(near)]
        for a, b in zip(i[ok].tolist(), j[ok].tolist()):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                if reps[a] > reps[b]:
                    a, b = b, a
                root[b] = a
        step += 1
        live = live[last[live] - live > step]
    while not np.array_equal(root, root[root]):
        root = root[root]
    out = root != np.arange(n)
    return reps[out], reps[root[out]], tuple(seen)


def _match_lists(radius: int, postings: list[tuple[int, ...]], pairs: PairCounts | None):
    counters = (pairs.compared, pairs.counted, pairs.verified) if pairs else ()
    first = np.full(256, -1, np.int64)
    for mask in range(256):
        first[mask] = next((k for k, c in enumerate(postings) if all(mask >> p & 1 for p in c)), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(part: list[np.ndarray]) -> pa.RecordBatch:
            a, b, seen = _linked(part[0], part[1], part[2].view(np.uint64), part[3], part[4], first, radius)
            for counter, k in zip(counters, seen):
                counter.add(k)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if not len(new[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on in the next batch
            if cut:
                yield work([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield work(held)

    return run


def near_links(marks: DataFrame, radius: int = 4, terms: int = 3, pairs: PairCounts | None = None) -> DataFrame:
    """Edges (a, b) between the `rep` ids of distinct fingerprints (`mark`, `rep`) that connect exactly
    what links of at most `radius` differing bits connect. The minimum 8 - radius must be at least
    `terms`; above about 1e9 fingerprints four terms keep the lists short."""
    postings = _postings(radius, terms)
    byte = [F.shiftrightunsigned("mark", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = []
    for k, combo in enumerate(postings):
        key = F.lit(k).cast("long")
        for p in combo:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    index = marks.select("mark", "rep", F.posexplode(F.array(*keys)).alias("combo", "key"))
    counts = index.groupBy("key").agg(F.count("*").alias("n"))
    hot = saved(counts.where(F.col("n") > LIST), "hot-lists")
    small = hot.limit(HOT_ROWS + 1).count() <= HOT_ROWS
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(0)) / LIST).cast("int")
    rows = index.join(F.broadcast(hot) if small else hot, "key", "left").withColumn("blocks", F.when(F.col("n").isNull(), 1).otherwise(blocks))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # side 0: one block, compared with itself; sides 1 and 2: two blocks, compared with each other only
    rows = rows.select(
        F.col("key"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2)).alias("side"),
        "mark", "rep", F.col("combo").cast("long").alias("combo"))
    group = F.when((F.col("low") == 0) & (F.col("high") == 0), F.col("key")).otherwise(F.xxhash64("key", "low", "high"))
    dealt = rows.select(group.alias("list"), F.col("side").cast("long").alias("side"), "mark", "rep", "combo")
    return dealt.repartition("list").sortWithinPartitions("list", "rep").mapInArrow(
        _match_lists(radius, postings, pairs), "a long, b long")


def _classes(rows: DataFrame, radius: int, pairs: PairCounts | None = None) -> DataFrame:
    """(mark, n, component, component_id) per distinct fingerprint: its rows, the mark that names its component,
    and the smallest id in it."""
    marks = saved(rows.groupBy("mark").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "marks")
    links = connected_components(near_links(marks.select("mark", F.col("mark").alias("rep")), radius, pairs=pairs))
    named = marks.join(links, marks["mark"] == links["node"], "left").select(
        "mark", "n", "low", F.coalesce("component", "mark").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("_n"))
    return join_unique(named, least, "component", "_n", marks.count()).select("mark", "n", "component", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, doc_id: str = "doc_id", text: str = "text", size: int = 4,
                    pairs: PairCounts | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row."""
    rows = saved(fingerprints(docs, doc_id, text, size), "fingerprints")
    out = join_unique(rows, _classes(rows, radius, pairs), "mark", "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, radius: int = 4, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """The rows, exactly one of each component: that with the smallest id, one with an id before one without, then
    the smallest text key. A row is named by its id and the hash of its text; of rows with the same name the one
    with the smallest hash of all columns stays."""
    key, body = F.col(doc_id).cast("long"), F.xxhash64(F.col(text))
    rows = saved(fingerprints(docs, doc_id, text, size, key=body), "fingerprints")
    classes = saved(_classes(rows, radius).select("mark", "n", "component"), "classes")
    named = join_unique(rows, classes, "mark", "n", rows.count()).select("doc_id", "key", "component")
    names = saved(named.groupBy("doc_id", "key").agg(F.min("component").alias("component"), F.count("*").alias("same")), "names")
    stays = names.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    gone = names.join(stays.select("x"), first == F.col("x"), "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), key.alias("id"), body.alias("key"))
    out = whole.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    if not names.where("same > 1").isEmpty():
        out = out.groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
