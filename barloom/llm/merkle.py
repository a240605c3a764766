"""Merkle manifest of a dataset by a butterfly exchange.

Each row is a leaf; leaves of a group (a language) ascend by id, and every FANOUT consecutive nodes become one
until one is left, the subroot; the subroots in order of their group become the root the same way.

Leaves are cut into aligned blocks of FANOUT^depth, one row of a block table each. A block works out its own
subtree; then blocks exchange roots in rounds. In round r a block meets those of its FANOUT partners whose number
differs in digit r alone, so no key ever has more than FANOUT rows; all of them hash the same ancestor
redundantly, and each notes its siblings. After the last round every block knows its path to the subroot and no
pass back down is needed. In a last subtree with missing blocks, those that exist stand in for the missing ones.
The groups' subroots go through the same steps as one more tree.

A proof is an array of (before, after), one for each level: the hex digests of the run's other nodes, joined.
`folded` recomputes a root from any leaf and a proof in one expression. Everything is built-in functions.

Edge cases: nulls are hashed as `-`; a null id comes first and is never chosen for tampering by its checksum; a
null group comes before all others, an empty one next; rows that repeat an id are ordered by their leaf, equal
leaves in any order (their proofs differ only by place); an empty table gives no rows; a single row is its own
subroot and root with an empty proof; very long texts are hashed in the scan and go no further; other columns
are carried as they are in a struct and cannot clash.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.llm.common import saved, table
from barloom.llm.registry import query

FANOUT = 8
DEPTH = 4  # levels within a block: 4096 leaves
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value, for all values of a row."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def levels(n: Column) -> Column:
    """Levels above n leaves until one node is left."""
    return sum((F.when(n > F.lit(FANOUT**k), 1).otherwise(0) for k in range(21)), F.lit(0))


def _joined(nodes: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(nodes, (first + F.lit(1)).cast("int"), count.cast("int")), "")


def _above(nodes: Column) -> Column:
    """The next level within a block."""
    runs = F.sequence(F.lit(0), (F.ceil(F.size(nodes) / F.lit(FANOUT)) - F.lit(1)).cast("int"))
    return F.transform(runs, lambda k: F.sha2(_joined(nodes, k * FANOUT, F.lit(FANOUT)).cast("binary"), 256))


def _numbered(leaves: DataFrame) -> DataFrame:
    """(g, n, pos, leaf, row): the place of each leaf in its group. The rows are sorted in ranges, and a range
    adds the numbers of the ranges before it."""
    order = [F.col("g").asc(), *[F.col(f"order.{c}").asc_nulls_first() for c in leaves.schema["order"].dataType.names],
             F.col("leaf").asc()]
    leaves = saved(leaves, "digests")  # the range shuffle samples its input first
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(ranged.drop("order").withColumn("at", F.monotonically_increasing_id()), "leaves")
    task = F.shiftright("at", 33).alias("task")
    held = placed.groupBy("g", task).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    before = Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        F.col("g"), "task", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("k").over(Window.partitionBy("g")).alias("n"))
    rows = placed.withColumn("task", task).join(starts, ["g", "task"])
    return rows.select("g", "n", (F.col("at") + F.col("shift")).alias("pos"), "leaf", "row")


def _blocks(leaves: DataFrame, depth: int) -> DataFrame:
    """One row a block: its leaves in order, its levels in the group's tree, and its root."""
    size = FANOUT**depth
    rows = _numbered(leaves).withColumn("block", F.floor(F.col("pos") / F.lit(size)))
    grouped = rows.groupBy("g", "n", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", "row"))).alias("leaves"))
    found = grouped.withColumn("levels", levels(F.col("n"))).withColumn("l0", F.col("leaves.leaf"))
    for k in range(depth):
        above = _above(F.col(f"l{k}"))
        found = found.withColumn(f"l{k + 1}", F.when(F.col("levels") > k, above).otherwise(F.col(f"l{k}")))
    return saved(found.withColumn("h", F.element_at(f"l{depth}", 1)).drop("l0"), "blocks")


def _exchanged(blocks: DataFrame, depth: int) -> DataFrame:
    """(g, block, h, upper): the group's subroot and the siblings above the block, in every block."""
    state = blocks.select("g", "n", "block", "levels", "h", F.array().cast(STEPS).alias("upper"))
    top = state.agg(F.max("levels")).first()[0] or 0
    for r in range(top - depth):
        apart = FANOUT**r
        number = F.ceil(F.col("n") / F.lit(FANOUT**depth))  # blocks of the group
        child, offset = F.floor(F.col("block") / F.lit(apart)), F.col("block") % F.lit(apart)
        last = F.floor((number - F.lit(1)) / F.lit(apart))  # the last subtree; it may lack blocks
        there = number - last * F.lit(apart)
        guests = F.sequence(offset, F.lit(apart - 1).cast("long"), there)  # its own offset first
        alone = F.array(offset)
        dealt = state.where(F.col("levels") > F.lit(depth + r)).select(
            "*", child.alias("child"), F.posexplode(F.when(child == last, guests).otherwise(alone)).alias("copy", "offset"))
        meet = Window.partitionBy("g", F.floor(F.col("child") / F.lit(FANOUT)), "offset")
        met = dealt.withColumn("met", F.sort_array(F.collect_list(F.struct("child", "h")).over(meet))).where("copy = 0")
        hashes = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: x["h"]), "")
        step = F.struct(hashes(lambda x: x["child"] < F.col("child")).alias("before"),
                        hashes(lambda x: x["child"] > F.col("child")).alias("after"))
        moved = met.select("g", "n", "block", "levels", F.sha2(F.array_join("met.h", "").cast("binary"), 256).alias("h"),
                           F.concat("upper", F.array(step)).alias("upper"))
        state = saved(moved.unionByName(state.where(F.col("levels") <= F.lit(depth + r))), "round")
    return state.select("g", "block", "h", "upper")


def _proofs(blocks: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """(row, leaf, proof and the other columns of paths) for each leaf; paths has (g, block, upper)."""
    more = [c for c in paths.columns if c not in ("g", "block", "upper")]
    joined = blocks.drop("h", "n").join(paths.hint("shuffle_hash"), ["g", "block"]).withColumn("l0", F.col("leaves.leaf"))

    def steps(j: Column) -> Column:
        parts = []
        for k in range(depth):
            here, run = F.floor(j / F.lit(FANOUT**k)), F.floor(j / F.lit(FANOUT**(k + 1))) * F.lit(FANOUT)
            parts.append(F.when(F.col("levels") > k, F.array(F.struct(
                _joined(F.col(f"l{k}"), run, here - run).alias("before"),
                _joined(F.col(f"l{k}"), here + F.lit(1), run + F.lit(FANOUT - 1) - here).alias("after"))))
                .otherwise(F.array().cast(STEPS)))
        return F.concat(*parts, F.col("upper"))

    found = F.transform("leaves", lambda x, j: F.struct(x["row"].alias("row"), x["leaf"].alias("leaf"), steps(j).alias("proof")))
    return joined.select(F.explode(found).alias("x"), *more).select("x.row", "x.leaf", "x.proof", *more)


def with_proofs(leaves: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf", depth: int = DEPTH) -> DataFrame:
    """(row, leaf, subroot, root, proof): `row` is a struct of all columns of `leaves`, which holds a digest per row
    in column `leaf`, in groups of the string column `group`, ordered by `order` within it."""
    key = F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0"))  # a null group comes first
    nodes = leaves.select(key.alias("g"), F.struct(*order).alias("order"), F.col(leaf).alias("leaf"),
                          F.struct(*[F.col(c) for c in leaves.columns]).alias("row"))
    blocks = _blocks(nodes, depth)
    paths = saved(_exchanged(blocks, depth), "paths")
    subroots = paths.where("block = 0").select(
        F.lit("").alias("g"), F.struct("g").alias("order"), F.col("h").alias("leaf"), F.struct("g").alias("row"))
    tops = _blocks(subroots, depth)
    upper = _proofs(tops, _exchanged(tops, depth).withColumnRenamed("h", "root"), depth)
    upper = upper.select(F.col("row.g").alias("g"), F.col("proof").alias("_top"), "root")
    whole = paths.join(upper, "g").select(
        "g", "block", F.col("h").alias("subroot"), "root", F.concat("upper", "_top").alias("upper"))
    return _proofs(blocks, whole, depth).select("row", "leaf", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda at, step: digest(step["before"], at, step["after"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, joined."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


ORACLE = """
WITH RECURSIVE base AS (
  SELECT doc_id, lang, source, n_chars, text,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           list_filter(regexp_split_to_array(doc_id::VARCHAR, ''), lambda s: s <> ''), lambda s: unicode(s)::BIGINT)),
         lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))),
       4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low
  FROM documents
), fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(low) || ':' || low, '-') AS bad
  FROM base
), leaves AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256(head || body) AS leaf, sha256(head || bad) AS tampered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM fields
), nodes(g, lvl, idx, h) AS (
  SELECT g, 0, pos, leaf FROM leaves
  UNION ALL
  SELECT g, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM nodes) WHERE c > 1 GROUP BY g, lvl, idx // 8
), subroots AS (
  SELECT g, arg_max(h, lvl) AS h, row_number() OVER (ORDER BY g) - 1 AS pos FROM nodes GROUP BY g
), tops(lvl, idx, h) AS (
  SELECT 0, pos, h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY lvl, idx // 8
), every AS (
  SELECT g, lvl, idx, h FROM nodes UNION ALL SELECT '', lvl, idx, h FROM tops
), steps AS (
  SELECT g, lvl, idx, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after,
    lvl = max(lvl) OVER (PARTITION BY g) AS is_top
  FROM every WINDOW r AS (PARTITION BY g, lvl, idx // 8 ORDER BY idx)
), walk(doc_id, home, g, lvl, idx, proof, folded) AS (
  SELECT doc_id, g, g, 0, pos, '', tampered FROM leaves
  UNION ALL
  SELECT w.doc_id, w.home, CASE WHEN s.is_top THEN '' ELSE w.g END, CASE WHEN s.is_top THEN 0 ELSE w.lvl + 1 END,
    CASE WHEN s.is_top THEN r.pos ELSE w.idx // 8 END,
    CASE WHEN s.is_top THEN w.proof ELSE w.proof || s.before || s.after END,
    CASE WHEN s.is_top THEN w.folded ELSE sha256(s.before || w.folded || s.after) END
  FROM walk w JOIN steps s ON s.g = w.g AND s.lvl = w.lvl AND s.idx = w.idx JOIN subroots r ON r.g = w.home
  WHERE NOT (w.g = '' AND s.is_top)
), ends AS (
  SELECT w.doc_id, w.proof, w.folded, t.h AS root
  FROM walk w JOIN (SELECT h, lvl FROM tops ORDER BY lvl DESC LIMIT 1) t ON w.g = '' AND w.lvl = t.lvl
)
SELECT l.doc_id, l.leaf, r.h AS subroot, e.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
  e.folded = e.root AS verified
FROM leaves l JOIN subroots r ON r.g = l.g JOIN ends e ON e.doc_id = l.doc_id
"""


def tampered(text: Column, doc_id: Column) -> Column:
    """A-Z in lower case where 3 divides the checksum of the id."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % F.lit(3) == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(hit, F.translate(text, upper, upper.lower())).otherwise(text)


@query("op11_merkle", ORACLE)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(
        "doc_id", "lang", leaf_digest([*head, F.col("text")]).alias("leaf"),
        leaf_digest([*head, tampered(F.col("text"), F.col("doc_id"))]).alias("tampered"))
    found = with_proofs(leaves, "lang", ["doc_id"])
    back = folded(F.col("row.tampered"), F.col("proof"))
    out = found.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root",
                       F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
