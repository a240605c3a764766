"""Best-fit packing of token sequences by hierarchical residual packing.

Every scan task encodes its documents, cuts those above the capacity into pieces, and packs its pieces
best-fit decreasing. Bins that are nearly full are done. The others are items of further best-fit rounds in a
tree: in a round FAN_IN neighbouring groups become one, whose open bins are packed into each other; bins that
are nearly full then are done, and the items of all others go on to the next round, until one group is left.

A group is solved on its number of items of each fill (at most one row a fill and child), so no task and
not the driver holds the bins themselves. A solution is a short list of rules for ranges of equal fills, and of
the ranges of items that go on. In the end the open bins of each scan task, with the solutions of the groups
above it, follow the rules from round to round. Only (bin, fill) rows move, never tokens.

Edge cases: a null or empty text is a document of the end token alone; repeated rows and repeated ids are
packed as often as they come; an empty table gives no rows; a document longer than the capacity becomes
full pieces with the shorter piece first; pieces of equal length go in the order of the scan; other columns are ignored.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.common import saved, table
from barloom.llm.encoding import encoder
from barloom.llm.registry import query

CAPACITY = 1024
NEARLY_FULL = 1016  # a bin with this fill or more is not looked at again
BUFFER = 1 << 18  # pieces packed at a time in a task
FAN_IN = 8  # groups that become one in a round

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place int, fill int, task int"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and place of each item, and the fill of each bin. Equal sizes go in the
    given order. Open bins are kept by what is left in them, with a bit for each amount in use, so an
    item costs one bit search, whatever the number of bins."""
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fills = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = used >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                used &= ~(1 << left)
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += size
        left -= size
        if left:
            stacks[left].append(b)
            used |= 1 << left
    return bins, places, np.asarray(fills, np.int32)


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; the first may be shorter, the others are full."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return [(s, (starts + [length])[k + 1] - s) for k, s in enumerate(starts)]


def _pack_local(path: str, end_id: int, capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        made = 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, rows
            doc, piece, start, length, crc = zip(*rows)
            sizes = np.asarray(length, np.int64)
            bins, places, fills = best_fit(sizes, capacity)
            # at most 2**20 bins from each of 2**20 flushes in each of 2**22 tasks
            out = pa.RecordBatch.from_arrays([
                pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(sizes), pa.array(crc, pa.int64()),
                pa.array((task << 40) + made + bins), pa.array(places), pa.array(fills[bins]),
                pa.array(np.full(len(sizes), task, np.int32)),
            ], names=[f.split()[0] for f in PIECES.split(", ")])
            made += len(fills)
            rows = []
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(enc.ids(text.as_py()) + end)
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
                    if len(rows) >= BUFFER:
                        yield flush()
        if rows:
            yield flush()

    return pack


def solve(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Best-fit decreasing of `counts[fill]` items of each fill, as rows (fill, first item, first bin, items a bin,
    place): from its first item on, up to the next rule of the fill, each `items a bin` items go to the next bin,
    one behind the other from `place`. The smallest space that takes an item takes further equal ones until it
    is too small, so all bins with the same space left are dealt with at once. Second, the bins that are not full
    as ranges (first bin, bins, fill)."""
    spaces: dict[int, list[tuple[int, int]]] = {}  # what is left: ranges (first bin, bins)
    rules, bins = [], 0
    for fill in sorted(counts, reverse=True):
        item, waiting = 0, counts[fill]
        while waiting:
            left = min((x for x in spaces if x >= fill), default=None)
            if left is None:
                left, first, n = capacity, bins, -(-waiting // (capacity // fill))
                bins += n
            else:
                first, n = spaces[left].pop()
                if not spaces[left]:
                    del spaces[left]
            each = left // fill
            whole = min(n, waiting // each)
            for at, many, per in ((first, whole, each), (first + whole, int(whole < n), min(waiting - whole * each, each))):
                if many and per:
                    rules.append((fill, item, at, per, capacity - left))
                    item, waiting = item + many * per, waiting - many * per
                    if left - per * fill:
                        spaces.setdefault(left - per * fill, []).append((at, many))
                    first, n = at + many, n - many
            if n:
                spaces.setdefault(left, []).append((first, n))
    ranges = [(first, n, capacity - left) for left, held in spaces.items() for first, n in held if left < capacity]
    return np.asarray(rules, np.int64).reshape(-1, 5), ranges


def merge_rules(counts: dict[int, int], capacity: int) -> np.ndarray:
    return solve(counts, capacity)[0]


SOLVED = "group long, bases binary, rules binary, parts binary, fills array<int>, counts array<long>"


def item_parts(rules: np.ndarray, counts: dict[int, int], ranges: list[tuple[int, int, int]], full: int) -> tuple[list[tuple], dict[int, int]]:
    """Which items are in a bin with at least `full`: rows (fill, first item, goes on, rank), each for the items up to
    the next row of the fill. Those that go on are numbered anew from `rank`. Second, their number for each fill."""
    still = sorted((first, first + n) for first, n, held in ranges if held < full)
    starts = [s for s, _ in still]
    parts, left = [], {}
    for k, (fill, begin, first, each, _) in enumerate(rules.tolist()):
        end = rules[k + 1, 1] if k + 1 < len(rules) and rules[k + 1, 0] == fill else counts[fill]
        at, last = begin, first - (begin - int(end)) // each  # bins from first up to last
        for s, e in still[max(bisect_right(starts, first) - 1, 0):bisect_left(starts, last)]:
            a, b = begin + (max(s, first) - first) * each, min(int(end), begin + (min(e, last) - first) * each)
            if a < b:
                if at < a:
                    parts.append((fill, at, 0, 0))
                parts.append((fill, a, 1, left.get(fill, 0)))
                left[fill] = left.get(fill, 0) + b - a
                at = b
        if at < end:
            parts.append((fill, at, 0, 0))
    return parts, left


def _solve_group(capacity: int, full: int):
    """The open bins of a group's children, (group, child, fill, n), packed into each other."""
    def run(table: pa.Table) -> pa.Table:
        group, child, fill, n = (table.column(k).to_numpy().astype(np.int64) for k in range(4))
        order = np.lexsort((child, fill))
        child, fill, n = child[order], fill[order], n[order]
        firsts = np.r_[True, fill[1:] != fill[:-1]]
        starts = np.cumsum(n) - n
        bases = starts - np.maximum.accumulate(np.where(firsts, starts, 0))  # items of the fill in the children before
        counts = {int(f): int(k) for f, k in zip(fill[firsts], np.add.reduceat(n, np.flatnonzero(firsts)))}
        rules, ranges = solve(counts, capacity)
        parts, left = item_parts(rules, counts, ranges, full)
        blobs = [np.asarray(x, "<i8").tobytes() for x in (np.stack([child, fill, bases], 1), rules, parts)]
        return pa.table([
            pa.array(group[:1]), *[pa.array([x], pa.binary()) for x in blobs],
            pa.array([list(left)], pa.list_(pa.int32())), pa.array([list(left.values())], pa.list_(pa.int64())),
        ], names=[f.split()[0] for f in SOLVED.split(", ")])

    return run


def _rounds(per_task: DataFrame, capacity: int, full: int) -> list[DataFrame]:
    """The solutions of the groups of each round; in the last one every bin is done."""
    fills = per_task.select(F.col("task").cast("long").alias("child"), "fill", "n")
    top = per_task.agg(F.max("task")).first()[0]
    rounds: list[DataFrame] = []
    while top is not None and (not rounds or top):
        group = F.floor(F.col("child") / F.lit(FAN_IN)).alias("group")
        solve_all = _solve_group(capacity, full if top >= FAN_IN else 0)
        solved = saved(fills.select(group, "child", "fill", "n").groupBy("group").applyInArrow(solve_all, SOLVED), "round")
        rounds.append(solved)
        fills = solved.select(F.col("group").alias("child"), F.explode(F.arrays_zip("fills", "counts")).alias("x")).select(
            "child", F.col("x.fills").alias("fill"), F.col("x.counts").alias("n"))
        top //= FAN_IN
    return rounds


def _follow(bins: pa.Table, chain: pa.Table) -> pa.Table:
    """Where the open bins (task, bin, fill) of a scan task go by the solutions above it, (task, round, group, bases,
    rules, parts): the bin that each ends in, and its place there."""
    ids, fill = bins.column("bin").to_numpy(), bins.column("fill").to_numpy().astype(np.int64)
    into, shift, item = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.empty(len(ids), np.int64)
    order = np.lexsort((ids, fill))
    item[order] = np.arange(len(ids)) - np.searchsorted(fill[order], fill[order])
    child, live = int(bins.column("task")[0].as_py()) if len(ids) else 0, np.arange(len(ids))

    def of(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row that each item falls under; rows start at (fill, first item)."""
        by = np.argsort(rows[:, 0] << 48 | rows[:, 1])
        return rows[by[np.searchsorted((rows[:, 0] << 48 | rows[:, 1])[by], fill[live] << 48 | at, "right") - 1]].T

    for step in sorted(chain.to_pylist(), key=lambda x: x["round"]):
        if not len(live):
            break
        bases, rules, parts = (np.frombuffer(step[c], "<i8").reshape(-1, k) for c, k in (("bases", 3), ("rules", 5), ("parts", 4)))
        own = bases[bases[:, 0] == child]  # ordered by fill
        at = item[live] + own[np.searchsorted(own[:, 1], fill[live]), 2]
        _, begin, first, each, place = of(rules, at)
        _, since, goes_on, rank = of(parts, at)
        done = goes_on == 0
        number = first + (at - begin) // each
        # merged bins have negative numbers: up to 2**36 bins in 2**21 groups of a round
        into[live[done]] = -1 - (step["round"] << 57 | step["group"] << 36 | number[done])
        shift[live[done]] = (place + (at - begin) % each * fill[live])[done]
        item[live[~done]] = (rank + at - since)[~done]
        live, child = live[~done], step["group"]
    return pa.table([bins.column("bin"), pa.array(into), pa.array(shift)], names=["bin", "into", "shift"])


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY,
                   nearly_full: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence that holds each and its place there."""
    full = nearly_full if nearly_full is not None else max(1, capacity * NEARLY_FULL // CAPACITY)
    pieces = saved(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .mapInArrow(_pack_local(tokenizer_path, end_id, capacity), PIECES), "pieces")
    still = saved(pieces.where((F.col("fill") < full) & (F.col("place") == 0)).select("bin", "fill", "task"), "open")
    per_task = saved(still.groupBy("task", "fill").agg(F.count("*").alias("n")), "fills")
    chain = None
    for r, solved in enumerate(_rounds(per_task, capacity, full)):
        above = per_task.select("task").distinct().withColumn("group", F.floor(F.col("task") / F.lit(FAN_IN ** (r + 1))))
        own = above.join(solved, "group").select("task", F.lit(r).alias("round"), "group", "bases", "rules", "parts")
        chain = own if chain is None else chain.unionByName(own)
    out = pieces.withColumn("into", F.lit(None).cast("long")).withColumn("shift", F.lit(0).cast("long"))
    if chain is not None:
        moved = still.groupBy("task").cogroup(chain.groupBy("task")).applyInArrow(_follow, "bin long, into long, shift long")
        out = pieces.join(moved, "bin", "left")
    out = out.withColumn("bin", F.coalesce("into", "bin")).withColumn("place", F.col("place") + F.coalesce("shift", F.lit(0)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"),
                      F.col("place").cast("long").alias("offset"))


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
