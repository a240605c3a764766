"""Fill-in-middle examples as a pipeline of pyarrow.compute calls.

A text of n code points is cut at two places drawn from the hash of its id; the pieces are written with
sentinels as plain text, `<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm).

Per slice of a batch the texts become list arrays of units (code points), are flattened with the indices of
their parents, get their ordinal in the text, and for each role (prefix, middle, suffix) are filtered, put
back into lists and joined. No text is visited by a Python loop: units are offsets into the batch's own
buffer. A slice holds about SLICE bytes; a longer text is worked off in blocks of that size, which are rows of
the same list arrays, and whose pieces are joined in the end, so that memory for units is bounded.

Restoring is its inverse in built-in expressions: a cut text holds no sentinel, and none can arise where a
piece touches one (a sentinel has `<` only in front and `>` only at its end), so the first occurrences are
the right ones.

Edge cases: null and empty texts are plain and empty; texts with a sentinel are plain; a null id is hashed as
an empty one; rows that repeat an id repeat their cuts if their texts are equally long; an empty table gives
no rows; other columns of the table, whatever their names, are not read. `middle` is empty where both cuts
are equal.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm.common import table
from barloom.llm.registry import query

SLICE = 1 << 20  # bytes of text whose units are held at once
SENTINELS = ("<P>", "<S>", "<M>")

EXAMPLES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of an id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and the bytes behind them, without a copy."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = texts.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _blocks(offsets: np.ndarray, data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of blocks with about `size` bytes in all: the text each block is of, and where blocks begin and
    the last one ends. Only a text above `size` has several blocks, cut before a code point."""
    owner, begin, held = [], [], 0
    for k in range(len(offsets) - 1):
        at, end = int(offsets[k]), int(offsets[k + 1])
        while True:
            if held and held + min(end - at, size) > size:
                yield np.asarray(owner), np.asarray([*begin, at])
                owner, begin, held = [], [], 0
            stop = min(end, at + size)
            while stop < end and data[stop] & 0xC0 == 0x80:
                stop -= 1
            owner.append(k)
            begin.append(at)
            held += stop - at
            at = stop
            if at >= end:
                break
    if owner:
        yield np.asarray(owner), np.asarray([*begin, int(offsets[-1])])


def _units(data: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    """One list of code points per block."""
    part = data[edges[0]:edges[-1]]
    starts = np.flatnonzero((part & 0xC0) != 0x80).astype(np.int32)
    offsets = np.append(starts, np.int32(len(part)))
    values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(part))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, edges - edges[0]).astype(np.int32)), values)


def _rebuilt(values: pa.Array, parents: pa.Array, keep: pa.Array, rows: int) -> pa.Array:
    """The kept units joined into one string for each of `rows` lists."""
    kept = pc.filter(parents, keep)
    counts = np.bincount(kept.to_numpy(), minlength=rows)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pc.filter(values, keep))
    return pc.binary_join(lists, "")


def cut_pieces(texts: pa.StringArray, low: np.ndarray, high: np.ndarray, size: int = SLICE) -> list[pa.Array]:
    """Units before `low`, from `low` to `high`, and from `high` on, of each text."""
    offsets, data = _bytes(texts)
    pieces: list[list[pa.Array]] = [[], [], []]
    owners: list[np.ndarray] = []
    last, seen = -1, 0  # the text of the previous block and how many of its units came before
    for owner, edges in _blocks(offsets, data, size):
        lists = _units(data, edges)
        lens = lists.value_lengths().to_numpy()
        before = np.r_[0, np.cumsum(lens)[:-1]]  # units of the slice in front of a block
        base = np.where(owner == last, seen, 0)  # only the first block can go on with the previous text
        values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
        ordinal = pc.subtract(pa.array(np.arange(len(values))), pc.take(pa.array(before - base), parents))
        in_front = pc.less(ordinal, pc.take(pa.array(low[owner]), parents))
        behind = pc.greater_equal(ordinal, pc.take(pa.array(high[owner]), parents))
        for k, keep in enumerate((in_front, pc.invert(pc.or_(in_front, behind)), behind)):
            pieces[k].append(_rebuilt(values, parents, keep, len(owner)))
        owners.append(owner)
        last, seen = int(owner[-1]), int(lens[-1] + base[-1])
    if not owners:
        return [pa.array([], pa.string())] * 3
    blocks = np.bincount(np.concatenate(owners), minlength=len(texts))
    edges = pa.array(np.r_[0, np.cumsum(blocks)].astype(np.int32))
    return [pc.binary_join(pa.ListArray.from_arrays(edges, pa.concat_arrays(p)), "") for p in pieces]


def examples_of(texts: pa.StringArray, h: list[np.ndarray], plain_share: int, spm_share: int,
                size: int = SLICE) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of non-null texts."""
    n = pc.utf8_length(texts).to_numpy().astype(np.int64)
    plain = (n == 0) | (h[2] % 100 >= 100 - plain_share)
    for mark in SENTINELS:
        plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    spm = h[3] % 100 < spm_share
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(spm), "spm", "psm"))
    cut = np.flatnonzero(~plain)
    prefix, middle, suffix = cut_pieces(texts.take(pa.array(cut)), low[cut], high[cut], size)
    front, back = pc.binary_join_element_wise("<P>", prefix, ""), pc.binary_join_element_wise("<S>", suffix, "")
    swapped = pa.array(spm[cut])
    made = pc.binary_join_element_wise(
        pc.if_else(swapped, back, front), pc.if_else(swapped, front, back), "<M>", middle, "")
    output = pc.replace_with_mask(texts, pa.array(~plain), made)
    chars = [pa.array(x, pa.int64(), mask=plain) for x in (low, high - low)]
    return [pa.array(n), form, *chars, output]


def examples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plain_share: int = 10,
             spm_share: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for each row. The shares are per cent: of all
    texts that stay plain beside those that must, and of the cut ones that are spm."""
    names = [c.split()[0] for c in EXAMPLES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(k).to_numpy() for k in range(2, 6)]
            made = examples_of(batch.column(1), h, plain_share, spm_share)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    key = F.col(doc_id).cast("long")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       *[h.alias(f"h{k}") for k, h in enumerate(draws(key))])
    return rows.mapInArrow(run, EXAMPLES)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: pieces between the first sentinels, in the order of the form."""
    marks = F.when(form == "spm", F.lit("<P>")).otherwise(F.lit("<S>"))  # between the first two pieces
    body = F.substr(output, F.lit(4))
    first = F.when(form == "spm", F.substring_index(body, "<P>", 1)).otherwise(F.substring_index(body, "<S>", 1))
    rest = F.substr(body, F.length(first) + F.length(marks) + F.lit(1))
    second = F.substring_index(rest, "<M>", 1)
    middle = F.substr(rest, F.length(second) + F.lit(4))
    return (F.when(form == "plain", output).when(form == "spm", F.concat(second, middle, first))
            .otherwise(F.concat(first, middle, second)))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS x
  FROM documents
), h AS (
  SELECT doc_id, t, n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
    ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4
  FROM d
), cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), pieces AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""


@query("op13_infill", ORACLE)
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = examples(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
