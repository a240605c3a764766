"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions; each decision has a context tree over the bytes before it. Every
node holds a Krichevsky-Trofimov estimate from the training counts, and a node's probability is half its
own estimate and half the product of its children's, so all depths are mixed by how well they explain
the training bytes. A text's score is the sum of log10 of the predictive mixture over its bytes and one
end mark; code length per byte follows from it.

All counts cover all training texts and every context seen in them is a node, whatever its count. Keys hold the
context with its nearest byte highest, then the byte, so in key order every subtree is one range. Tasks take
whole subtrees below the contexts of UPPER bytes, one after the other; what is above them (at most 256**UPPER
contexts) is put together on the driver from their sums and broadcast. Each distinct (context, byte) of the
scored texts gets its prediction in a table. The most frequent,
FREQUENT_GRAMS at most, are broadcast; the others are counted per text and joined, with equal values either way: predictions
are whole multiples of 1 / FIXED, so sums depend on no order.

The unigram base is exact: words with at least 1/131072 of all tokens (at most that many) are broadcast,
the other words of each text are joined with their counts.

Edge cases: null, empty and white-space texts have one token (the end) and one coded end mark; equal texts
get equal values; repeated rows are scored as often as they come; without training rows all counts are
zero and every byte costs 2.4 digits; an empty table gives no rows; very long texts are read in blocks.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.common import saved, table, utf8, word_blocks
from barloom.llm.registry import query

DEPTH = 5
UPPER = 2  # bytes of the contexts kept together on the driver
DEEPEST = 6  # eight bits a byte and one byte more than the depth in a signed long
FREQUENT_GRAMS = 1 << 21
FIXED = 1 << 30  # a text of 2**31 bytes stays within a long
SUBTREES = 1 << 17  # grams of whole subtrees a task works on at a time, or one subtree
FREQUENT = 1 << 17
LONGEST_FREQUENT = 64  # bytes; longer words are joined, so the broadcast words are bounded in bytes too
MARK = 0xFF  # never a byte of UTF-8: before the first byte of a text and after its last
BLOCK = 1 << 21
SCORED = 1 << 19  # positions of several texts scored at a time
ROWS = 512  # texts a task holds as Python strings, and their rare words
KEPT_WORDS = 1 << 19

END = b""  # the end token; no word is empty


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 == 2


def held_out(doc_id: str):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _stream(data: bytes, depth: int) -> Iterator[np.ndarray]:
    """Blocks of a marked text, each with the `depth` bytes before its first coded byte in front."""
    whole = np.frombuffer(bytes([MARK]) * depth + data + bytes([MARK]), np.uint8)
    for start in range(depth, len(whole), BLOCK):
        yield whole[start - depth:start + BLOCK]


def _grams(block: np.ndarray, depth: int) -> np.ndarray:
    """For each coded byte the bytes before it, the nearest highest, and itself last in one long."""
    n = len(block) - depth
    out = np.zeros(n, np.int64)
    for k in [*range(depth - 1, -1, -1), depth]:
        out = out << 8 | block[k:k + n]
    return out


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys, counts = list(words), list(words.values())
            words.clear()
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), none, pa.array(counts, pa.int64()), none],
                                              names=["word", "gram", "n", "unseen"])

        def grams(held: bool) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(parts[held]), return_counts=True)
            parts[held], size[held] = [], 0
            n, none = pa.array(counts.astype(np.int64)), pa.array(np.zeros(len(keys), np.int64))
            return pa.RecordBatch.from_arrays([
                pa.nulls(len(keys), pa.binary()), pa.array(keys), *([none, n] if held else [n, none])],
                names=["word", "gram", "n", "unseen"])

        parts, size = {False: [], True: []}, {False: 0, True: 0}
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = utf8(text).lower()
                if not held:
                    for block in word_blocks(data):
                        words.update(block)
                        if len(words) > KEPT_WORDS:
                            yield flush()
                    words[END] += 1
                for block in _stream(data, depth):
                    parts[held].append(_grams(block, depth))
                    size[held] += len(parts[held][-1])
                    if size[held] >= BLOCK:
                        yield grams(held)
        for held in parts:
            if parts[held]:
                yield grams(held)
        if words:
            yield flush()

    return run


def count_texts(docs: DataFrame, depth: int, doc_id: str, text: str) -> DataFrame:
    """In one pass the counts of the words of all training texts, and of the byte (depth + 1)-grams of all
    texts: `n` in training texts, `unseen` in the others."""
    rows = docs.select(F.col(text).alias("text"), held_out(doc_id).alias("held"))
    return rows.mapInArrow(_count(depth), "word binary, gram long, n long, unseen long").groupBy("word", "gram").agg(
        F.sum("n").alias("n"), F.sum("unseen").alias("unseen"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; error below 1e-13 relative for x >= 0.5."""
    low, y = np.ones_like(x), x + 8
    for k in range(8):
        low = low * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 binary nodes (heap order, from 1) of each row of 256 byte counts."""
    heap = np.zeros((len(counts), 512))
    heap[:, 256:] = counts
    for level in range(7, -1, -1):
        at = np.arange(1 << level, 2 << level)
        heap[:, at] = heap[:, 2 * at] + heap[:, 2 * at + 1]
    at = np.arange(1, 256)
    return heap[:, 2 * at], heap[:, 2 * at + 1]


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


def _next(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


@dataclass(frozen=True)
class ContextTree:
    """A tree in one process, for what is small. `child[node, byte]` is the node one byte further back, or 0; node 1 is the root. `log10p[node]`
    holds the byte predictions where a lookup ends."""

    depth: int
    child: np.ndarray
    log10p: np.ndarray

    def score(self, data: bytes) -> float:
        total = 0.0
        for block in _stream(data, self.depth):
            n = len(block) - self.depth
            now = np.ones(n, np.int32)
            last = now
            for back in range(1, self.depth + 1):
                now = self.child[now, block[self.depth - back:self.depth - back + n]]
                last = np.where(now > 0, now, last)
            total += float(self.log10p[last, block[self.depth:]].sum(dtype=np.float64))
        return total


def weigh(levels: list[tuple[np.ndarray, np.ndarray]]) -> ContextTree:
    """The tree from, per depth, sorted contexts (nearest byte lowest) and their byte counts."""
    depth = len(levels) - 1
    bases = np.cumsum([1] + [len(c) for c, _ in levels])
    child = np.zeros((bases[-1], 256), np.int32)
    log10p = np.zeros((bases[-1], 256), np.float32)
    parents: list[np.ndarray] = [np.zeros(0, np.int64)]
    for d in range(1, depth + 1):
        contexts, above = levels[d][0], levels[d - 1][0]
        up = np.searchsorted(above, contexts & ((1 << 8 * (d - 1)) - 1))
        parents.append(up)
        child[bases[d - 1] + up, (contexts >> 8 * (d - 1)) & 255] = bases[d] + np.arange(len(contexts))

    weights, below = [None] * (depth + 1), None
    for d in range(depth, -1, -1):
        counts = levels[d][1]
        own = _kt(*_decisions(counts))
        total = own
        weight = np.ones_like(own, dtype=np.float32)
        if d < depth and len(levels[d + 1][0]):
            up = parents[d + 1]
            kept, product = np.zeros_like(counts), np.zeros_like(own)
            np.add.at(kept, up, levels[d + 1][1])
            np.add.at(product, up, below)
            inner = np.zeros(len(counts), bool)
            inner[up] = True
            product += _kt(*_decisions(counts - kept))
            mixed = np.logaddexp(own, product) - math.log(2)
            total = np.where(inner[:, None], mixed, own)
            weight = np.where(inner[:, None], np.exp(own - math.log(2) - mixed), 1).astype(np.float32)
        weights[d], below = weight, total

    paid, rest = np.zeros((1, 255)), np.ones((1, 255))
    for d in range(depth + 1):
        counts = levels[d][1]
        if d:
            paid, rest = paid[parents[d]], rest[parents[d]]
        own = _next(*_decisions(counts))
        paid = paid + rest * weights[d] * own
        rest = rest * (1.0 - weights[d])
        kept = np.zeros_like(counts)
        if d < depth:
            np.add.at(kept, parents[d + 1], levels[d + 1][1])
        one = paid + rest * _next(*_decisions(counts - kept))
        table_ = np.zeros((len(counts), 256))
        symbols = np.arange(256)
        for bit in range(8):
            node = (256 + symbols) >> (8 - bit)
            is_one = (symbols >> (7 - bit) & 1).astype(bool)
            p = one[:, node - 1]
            table_ += np.log10(np.where(is_one, p, 1 - p))
        log10p[bases[d]:bases[d + 1]] = table_
    return ContextTree(depth, child, log10p)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal sorted keys, and the run of each key."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _cells(grams: np.ndarray, counts: np.ndarray, d: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of `d` bytes with each byte after them, sorted, and their counts."""
    keys = grams >> 8 * (depth + 1 - d) << 8 | grams & 255
    order = np.argsort(keys, kind="stable")
    starts, _ = _runs(keys[order])
    return keys[order][starts], np.add.reduceat(counts[order], starts)


def _parent(keys: np.ndarray, bit: int) -> np.ndarray:
    """Keys (context, `bit` decided bits) of the same decision one byte less deep."""
    return keys >> bit + 8 << bit | keys & (1 << bit) - 1


class _Decision:
    """One depth's nodes of the decision `bit`, from sorted (context, byte) cells."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, bit: int):
        starts, self.of_cell = _runs(cells >> 8 - bit)
        self.keys = (cells >> 8 - bit)[starts]
        one = cells >> 7 - bit & 1
        self.ones = np.add.reduceat(counts * one, starts).astype(float)
        self.zeros = np.add.reduceat(counts * (1 - one), starts).astype(float)


def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log of the block probability, and the posterior weight of the node's own estimate."""
    own = _kt(zeros, ones)
    if below is None:
        return own, np.ones_like(own)
    total = np.logaddexp(own, below) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


def _climb(levels: list[_Decision], bit: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of levels from shallow to leaves: the log block probabilities of the first, the weights and parents of all."""
    weights, ups, below = [], [], None
    for k in range(len(levels) - 1, -1, -1):
        total, weight = _mixed(levels[k].zeros, levels[k].ones, below)
        weights.append(weight)
        if k:
            ups.append(np.searchsorted(levels[k - 1].keys, _parent(levels[k].keys, bit)))
            below = np.bincount(ups[-1], total, len(levels[k - 1].keys))
    return total, weights[::-1], ups[::-1]


def _subtrees(work, top: int):
    """Runs `work` on sorted grams and their counts, a few whole subtrees of contexts (gram >> top) at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            grams, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(grams):
                continue
            edge = int(np.searchsorted(grams, grams[-1] >> top << top))
            if size and size + edge >= SUBTREES and (edge or held[-1][0][-1] >> top != grams[0] >> top):
                held.append((grams[:edge], counts[:edge]))
                yield work(*map(np.concatenate, zip(*held)))
                held, size, grams, counts = [], 0, grams[edge:], counts[edge:]
            held.append((grams, counts))
            size += len(grams)
        if held:
            yield work(*map(np.concatenate, zip(*held)))

    return run


def _upper_sums(depth: int):
    """Per decision of the contexts of UPPER bytes: zeros, ones, and the log probabilities of what is below."""
    def work(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        levels, out = [_cells(grams, counts, d, depth) for d in range(UPPER + 1, depth + 1)], []
        for bit in range(8):
            made = [_Decision(*cells, bit) for cells in levels]
            total = _climb(made, bit)[0]
            keys, at = np.unique(_parent(made[0].keys, bit), return_inverse=True)
            names = keys >> bit << 8 | 1 << bit | keys & (1 << bit) - 1
            out.append((names, *(np.bincount(at, x) for x in (made[0].zeros, made[0].ones, total))))
        names, zeros, ones, below = map(np.concatenate, zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (names, zeros, ones, below)], names=["node", "zeros", "ones", "below"])

    return _subtrees(work, 8 * (depth - UPPER))


def _upper(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the sorted nodes (context of UPPER bytes, decision) what their path has paid, and what is left."""
    levels, ups = [(zeros, ones, *_mixed(zeros, ones, below))], []
    names = nodes
    for _ in range(UPPER):
        above = names >> 16 << 8 | names & 255
        names, up = np.unique(above, return_inverse=True)
        z, o, t = (np.bincount(up, x, len(names)) for x in levels[-1][:3])
        levels.append((z, o, *_mixed(z, o, t)))
        ups.append(up)
    paid, rest = np.zeros(len(names)), np.ones(len(names))
    for k in range(UPPER, -1, -1):
        z, o, _, weight = levels[k]
        if k < UPPER:
            paid, rest = paid[ups[k]], rest[ups[k]]
        paid, rest = paid + rest * weight * _next(z, o), rest * (1 - weight)
    return nodes, paid, rest


def _predict(depth: int, upper):
    """The log10 prediction, as a multiple of 1 / FIXED, of each gram's last byte after the others."""
    def work(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        nodes, top_paid, top_rest = upper.value
        levels = [_cells(grams, counts, d, depth) for d in range(UPPER + 1, depth + 1)]
        log10p = np.zeros(len(grams))
        for bit in range(8):
            made = [_Decision(*cells, bit) for cells in levels]
            _, weights, ups = _climb(made, bit)
            keys = _parent(made[0].keys, bit)
            at = np.searchsorted(nodes, keys >> bit << 8 | 1 << bit | keys & (1 << bit) - 1)
            paid, rest = top_paid[at], top_rest[at]
            for k, level in enumerate(made):
                if k:
                    paid, rest = paid[ups[k - 1]], rest[ups[k - 1]]
                paid, rest = paid + rest * weights[k] * _next(level.zeros, level.ones), rest * (1 - weights[k])
            one = paid[made[-1].of_cell]
            log10p += np.log10(np.where(grams >> 7 - bit & 1, one, 1 - one))
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.rint(log10p * FIXED).astype(np.int64))], names=["gram", "log10p"])

    return _subtrees(work, 8 * (depth - UPPER))


def predictions(grams: DataFrame, depth: int) -> DataFrame:
    """gram, log10p (times FIXED) for each of the distinct grams with their training counts `n`."""
    # a subtree hangs below a context of UPPER + 1 bytes
    dealt = grams.select("gram", "n").repartition(F.shiftright("gram", 8 * (depth - UPPER))).sortWithinPartitions("gram")
    sums = dealt.mapInArrow(_upper_sums(depth), "node long, zeros double, ones double, below double")
    found = sums.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    columns = [found.column(c).to_numpy() for c in ("node", "zeros", "ones", "below")]
    order = np.argsort(columns[0])
    upper = grams.sparkSession.sparkContext.broadcast(_upper(*(c[order] for c in columns)))
    return dealt.mapInArrow(_predict(depth, upper), "gram long, log10p long")


def _score(depth: int, likely, frequent, missing: float):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("hits", pa.int64()), ("base", pa.float64()),
                        ("score", pa.int64()), ("word", pa.binary()), ("gram", pa.int64())])

    def rows_of(**columns) -> pa.RecordBatch:
        size = len(columns["row"])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (keys, values), known = likely.value, frequent.value
        row = TaskContext.get().partitionId() << 40
        parts, owners, size = [], [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            """Sums of the frequent grams of each held block, and counts of its other grams."""
            nonlocal parts, owners, size
            lengths = [len(p) for p in parts]
            grams, at = np.unique(np.concatenate(parts), return_inverse=True)
            place = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
            hit = keys[place] == grams if len(keys) else np.zeros(len(grams), bool)
            value = np.where(hit, values[place], 0) if len(keys) else np.zeros(len(grams), np.int64)
            yield rows_of(row=owners, score=np.add.reduceat(value[at], np.cumsum([0, *lengths[:-1]])))
            rare = np.flatnonzero(~hit[at])
            if len(rare):
                pairs, n = np.unique(np.repeat(np.arange(len(parts)), lengths)[rare] << 32 | at[rare], return_counts=True)
                yield rows_of(row=np.asarray(owners)[pairs >> 32], n=n, gram=grams[pairs & (1 << 32) - 1])
            parts, owners, size = [], [], 0

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out, rare_row, rare_word, rare_n = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = utf8(text).lower()
                words: Counter = Counter()
                for block in word_blocks(data):
                    words.update(block)
                words[END] += 1
                base, hits = 0.0, 0
                for word, n in words.items():
                    p = known.get(word)
                    if p is None:
                        rare_row.append(row)
                        rare_word.append(word)
                        rare_n.append(n)
                    else:
                        base += n * p
                        hits += n
                out.append((row, doc, sum(words.values()), hits, base))
                for block in _stream(data, depth):
                    parts.append(_grams(block, depth))
                    owners.append(row)
                    size += len(parts[-1])
                    if size >= SCORED:
                        yield from scored()
                row += 1
            if out:
                r, doc, tokens, hits, base = zip(*out)
                yield rows_of(row=r, doc_id=doc, n=tokens, hits=hits, base=base)
            if rare_row:
                yield rows_of(row=rare_row, n=rare_n, word=rare_word)
        if parts:
            yield from scored()

    return run


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not UPPER < depth <= DEEPEST:
        raise ValueError(f"the depth is above {UPPER} and at most {DEEPEST}")
    counts = saved(count_texts(docs, depth, "doc_id", "text"), "counts")
    words = counts.where(F.col("word").isNotNull()).select("word", "n")
    grams = counts.where(F.col("gram").isNotNull()).select("gram", "n", "unseen")
    predicted = saved(predictions(grams, depth), "predictions")
    # a gram may be frequent among the scored texts without any count in training
    often_read = F.floor(4 * F.log2(F.col("n") + F.col("unseen"))).cast("int")
    least, room = 1 << 8, FREQUENT_GRAMS
    for r in grams.groupBy(often_read.alias("often")).count().orderBy(F.desc("often")).collect():  # <= 4 * 63 + 1 rows
        room -= r["count"]
        if room < 0:
            break
        least = r["often"]
    likely = predicted.join(grams.where(often_read >= least).select("gram"), "gram", "left_semi").toArrow()  # <= FREQUENT_GRAMS rows
    keys = likely.column("gram").to_numpy()
    order = np.argsort(keys)
    likely = spark.sparkContext.broadcast((keys[order], likely.column("log10p").to_numpy()[order]))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = (F.col("n") * FREQUENT >= n) & (F.octet_length("word") <= LONGEST_FREQUENT)
    below = math.log10(n + v + 1)
    frequent = {bytes(w): math.log10(c + 1) - below for w, c in words.where(often).collect()}  # <= FREQUENT rows
    known = spark.sparkContext.broadcast(frequent)
    parts = saved(docs.mapInArrow(
        _score(depth, likely, known, -below),
        "row long, doc_id long, n long, hits long, base double, score long, word binary, gram long"), "scored")
    rare = parts.where(F.col("word").isNotNull()).select("row", "word", "n")
    seen = words.where(~often).select("word", F.col("n").alias("c"))
    rare = rare.join(seen, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_hits"),
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(below))).alias("_base"))
    others = parts.where(F.col("gram").isNotNull()).select("row", "gram", "n").join(predicted, "gram")
    sums = parts.where(F.col("score").isNotNull()).select("row", "score").unionByName(
        others.select("row", (F.col("n") * F.col("log10p")).alias("score"))).groupBy("row").agg(F.sum("score").alias("_score"))
    rows = parts.where(F.col("hits").isNotNull()).drop("word", "gram", "score").join(rare, "row", "left").join(sums, "row")
    return rows.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("hits") + F.coalesce("_hits", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), (F.col("_score") / F.lit(float(FIXED))).alias("score"))


@query("op8_context_tree")
def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
