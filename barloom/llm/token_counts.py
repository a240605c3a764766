"""Token counts from a digest cache.

A cache row is (content digest, tokenizer digest, bytes, tokens). Documents are matched with the cache by
digest; only distinct contents that it lacks are encoded, and their counts are appended to it. The content
is normalised only so far as counts allow: a null text is the empty text.

Edge cases: null and empty texts have 0 bytes and 0 tokens; equal texts are encoded once, wherever they
lie; repeated rows are returned as often as they come; an empty table gives no rows; other columns are
ignored. A null id is returned as null. A digest that the cache holds more than once counts once.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.reuse import scratch_folder
from barloom.llm.common import join_unique, saved, table
from barloom.llm.encoding import encoder, tokenizer_version
from barloom.llm.registry import query

CACHE = "digest binary, tokenizer string, n_bytes long, n_tokens long"


def _new_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the first row of each digest in this task; what is held is one digest per row."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column("digest").to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _encode_with(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in _new_rows(batches):
            sizes, tokens = [], []
            for text in batch.column("text"):  # one text at a time in Python's memory
                t = text.as_py()
                sizes.append(len(t.encode()))
                tokens.append(enc.count(t))
            yield pa.RecordBatch.from_arrays([
                batch.column("digest").cast(pa.binary()), pa.array([version] * len(sizes), pa.string()),
                pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
            ], names=["digest", "tokenizer", "n_bytes", "n_tokens"])

    return encode


def content_digest(text: str = "text"):
    """SHA-256 of the normalised content."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def extend_cache(docs: DataFrame, cache_path: str, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Append the counts of all contents that the cache at `cache_path` lacks; return its rows for this
    tokenizer. Texts are shuffled once, after copies within a task have been dropped, so a content that
    fills a third of the table sends one row a task. The append is one atomic job of Spark's writer."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)  # so that it exists
    known = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)
    contents = docs.select(content_digest(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = "digest binary, text string"
    misses = (
        contents.mapInArrow(_new_rows, kind)
        .join(known.select("digest"), "digest", "left_anti")
        .repartition(F.col("digest"))
        .mapInArrow(_encode_with(tokenizer_path, version), CACHE)
    )
    misses.write.mode("append").parquet(cache_path)
    return spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str, doc_id: str = "doc_id",
                 text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit per row of `docs`."""
    cache = extend_cache(docs, cache_path, tokenizer_path, text)
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), content_digest(text).alias("digest")), "digests")
    sizes = rows.groupBy("digest").agg(F.count("*").alias("_rows"))
    # two jobs that miss the same content side by side both append it
    once = cache.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))
    counts = once.join(sizes, "digest")
    out = join_unique(rows, counts, "digest", "_rows", rows.count())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for all documents, with a new cache in the shared folder."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), scratch_folder(spark, "token-cache"),
                        public_tokenizers.path("byte_bpe_50k.json"))
