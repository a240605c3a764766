"""Quality classifier by importance resampling.

Words and word pairs are hashed into buckets. Two multinomial models over the buckets are counted: one over
all documents (raw), one over labelled good documents (target). A document's log weight is the sum of log
ratios of its n-grams; its key adds Gumbel noise from a hash of its id, and the documents with the largest
keys are the sample. With `k` given, these are the k largest keys. Otherwise k is the smallest number that
keeps `keep_share` of labelled good documents that the target model has not seen, so the cut follows the
data: where nearly all rows are good, nearly all are kept.

The target model is fitted on at most `target_rows` labelled rows (smallest hashes of their ids), half of them for the
model and half for the cut; the raw model counts all documents. Ratios shrink to one where the target
model expects few n-grams. What is broadcast is one number a bucket and one bit a target row.

Edge cases: null and empty texts have no n-grams and log weight 0; a text's words are read in blocks; equal
rows get equal keys and are kept or rejected together, also at the k-th place; without labelled good rows
every row is kept; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.ranks import cumulative_counts
from barloom.llm.common import saved, table
from barloom.llm.registry import query

BUCKETS = 1 << 15  # for words, and as many for word pairs
TARGET_ROWS = 20_000
KEEP_SHARE = 0.999
SHRINK = 20.0  # n-grams of prior belief, at ratio one, a bucket
SEED = 11
MEMO_ENTRIES = 500_000
BLOCK = 1 << 20

TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode())
        return h


_HASHES = _Hashes()


def _blocks(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        end = min(len(text), start + BLOCK)
        if end < len(text):
            cut = re.compile(r"\s").search(text, end)
            end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def ngram_buckets(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of all words and symbol runs, and of all pairs of neighbours (upper half)."""
    parts, last = [], np.zeros(0, np.uint64)
    for block in _blocks(text or ""):
        h = np.array([_HASHES[t] for t in TOKEN.findall(block)], np.uint64)
        parts.append(h % np.uint64(buckets))
        line = np.concatenate([last, h])
        x = line[:-1] * np.uint64(0x9E3779B97F4A7C15) + line[1:]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        parts.append(x % np.uint64(buckets) + np.uint64(buckets))
        last = line[-1:]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _count(targets, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = targets.value
        raw, target = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = ngram_buckets(text, buckets)
                if len(own) > buckets:
                    raw += np.bincount(own, minlength=2 * buckets)
                else:
                    np.add.at(raw, own, 1)
                if doc in fit:
                    np.add.at(target, own, 1)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])],
                                         names=["bucket", "raw", "target"])

    return run


def _weigh(ratios, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_ratio = ratios.value
        for batch in batches:
            own = [ngram_buckets(t, buckets) for t in batch.column(0).field("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array([len(x) for x in own], pa.int64()),
                pa.array([float(log_ratio[x].sum()) for x in own], pa.float64())], names=["doc", "n_grams", "log_weight"])

    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the id: the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, log of target share over raw share, shrunk by SHRINK n-grams at ratio one; words
    and pairs are two models."""
    out = np.zeros(len(raw))
    half = len(raw) // 2
    for part in (slice(0, half), slice(half, None)):
        if raw[part].sum() and target[part].sum():
            expected = raw[part] * (target[part].sum() / raw[part].sum())
            out[part] = np.log((target[part] + SHRINK) / (expected + SHRINK))
    return out


class Classifier:
    """Both models, fitted on all rows of `docs` and a bounded number of labelled rows."""

    def __init__(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 quality: str = "quality", target_rows: int = TARGET_ROWS, buckets: int = BUCKETS) -> None:
        self.doc_id, self.text, self.buckets = doc_id, text, buckets
        spark = docs.sparkSession
        good = labels.where(F.col(quality) == 1).select(F.col(doc_id).cast("long").alias("id")).where("id is not null").distinct()
        chosen = [r[0] for r in good.orderBy(F.xxhash64("id"), "id").limit(target_rows).collect()]
        fit, self.held_back = set(chosen[::2]), chosen[1::2]
        rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        counts = rows.mapInArrow(_count(spark.sparkContext.broadcast(fit), buckets), "bucket long, raw long, target long")
        found = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # <= 2 * buckets
        raw, target = np.zeros(2 * buckets), np.zeros(2 * buckets)
        at = found.column("bucket").to_numpy()
        raw[at], target[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
        self.ratios = spark.sparkContext.broadcast(log_ratios(raw, target))

    def weighted(self, docs: DataFrame) -> DataFrame:
        """Each row as a struct `doc`, with n_grams, log_weight and key."""
        text = F.struct(F.col(self.text).alias("text")).alias("words")
        rows = docs.select(text, F.struct(*docs.columns).alias("doc"))
        schema = docs.select(F.struct(*docs.columns).alias("doc")).schema.add("n_grams", "long").add("log_weight", "double")
        out = rows.mapInArrow(_weigh(self.ratios, self.buckets), schema)
        return out.withColumn("key", F.col("log_weight") + gumbel(F.col("doc").getField(self.doc_id).cast("long")))

    def cut(self, docs: DataFrame, keep_share: float) -> float | None:
        """The key that all but 1 - keep_share of the held-back good documents reach."""
        ids = docs.sparkSession.createDataFrame([(i,) for i in self.held_back], "id long")  # <= target_rows / 2
        own = docs.select(F.col(self.doc_id).alias("doc_id"), F.col(self.text).alias("text"))  # no other name may clash
        own = own.join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("id")).select(
            F.col("doc_id").alias(self.doc_id), F.col("text").alias(self.text))
        best = self.weighted(own).groupBy(F.col("doc").getField(self.doc_id).alias("id")).agg(F.max("key").alias("key"))
        keys = sorted(r["key"] for r in best.collect())
        return keys[int(math.floor((1 - keep_share) * len(keys)))] if keys else None


def top_key(keys: DataFrame, k: int) -> float | None:
    """The k-th largest key, by exact ranks without a single-task sort."""
    ranks = cumulative_counts(keys, "key")
    return ranks.where(F.col("total") - F.col("below") - F.col("n") < k).agg(F.min("key")).first()[0]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, keep_share: float = KEEP_SHARE, **kwargs) -> DataFrame:
    """Each row as a struct `doc`, with n_grams, log_weight, key and kept."""
    model = Classifier(docs, labels, **kwargs)
    scored = model.weighted(docs)
    if k is None:
        cut = model.cut(docs, keep_share)
        return scored.withColumn("kept", F.lit(True) if cut is None else F.col("key") >= cut)
    scored = saved(scored, "weights")
    cut = top_key(scored, k) if k > 0 else None
    return scored.withColumn("kept", F.lit(False) if cut is None else F.col("key") >= cut)


def sample_size(docs: DataFrame, labels: DataFrame, quality: str = "quality") -> int:
    """As many rows as the labels let expect to be good: their share of good rows times the rows; all without labels."""
    share = labels.agg(F.avg((F.col(quality) == 1).cast("double"))).first()[0]
    return round(docs.count() * (1.0 if share is None else share))


@query("op2_resampling")
def op2_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample is the k rows with the largest keys."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = resample(docs, labels, k=sample_size(docs, labels))
    return found.select("doc.doc_id", "n_grams", "log_weight", "key", "kept")
