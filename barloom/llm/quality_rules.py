"""Quality rules as a learned decision list.

Text statistics are built-in expressions over whole texts. The list is learned from labelled statistics by
sequential covering: a rule grows condition by condition (statistic above or at most a threshold) by FOIL's
gain on two thirds of the labelled rows, is pruned from its end on the last third, and is taken if enough
of what it covers there is bad; covered rows go, and the next rule grows. The result is an ordered Spark
conditional expression: the first rule that holds rejects.

The list is fitted on at most `sample` labelled rows, those with the smallest hashes of their ids; all
statistics and verdicts are computed for every row.

Edge cases: null, empty and white-space texts have no words and fail the base rule; without labelled rows of
both kinds no rule is learned and only the base rule rejects; repeated rows are judged alike; rows with a
null label or id are not learned from; an empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm.common import saved, table
from barloom.llm.registry import query

WHITE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
PLACE_BITS = 21
SAMPLE = 50_000
CUTS = 24  # thresholds tried per statistic

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
              "n_capitals", "n_digits", "n_shouts")

# What conditions are about: a statistic, or its share of another.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "repeat_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"),
    "capital_share": ("n_capitals", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "shout_share": ("n_shouts", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    value, of = FEATURES[name]
    return F.col(value).cast("double") / (F.greatest(F.col(of), F.lit(1)) if of else F.lit(1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _covered(places: Column) -> Column:
    """Words under windows of three that start at the given ascending places."""
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(places, start, lambda a, x: F.struct(
        x.alias("last"), (a["sum"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("sum")), lambda a: a["sum"])


def _repeat_words(words: Column, place_bits: int = PLACE_BITS) -> Column:
    """Words in three-word windows that the text holds twice or more. Windows are sorted as longs of 43
    hash bits and the place; where two different windows share those bits, or a text has 2**21 words, the
    full 64-bit hashes are sorted with their places instead."""
    mask = F.lit((1 << place_bits) - 1).cast("long")

    def exact(keys: Column) -> Column:
        pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.cast("long").alias("i"))))
        again = _let(pairs, lambda p: F.filter(p, lambda x, i: (
            F.get(p, i - 1)["k"].eqNullSafe(x["k"]) | F.get(p, i + 1)["k"].eqNullSafe(x["k"]))))
        return _covered(F.sort_array(F.transform(again, lambda x: x["i"])))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftrightunsigned(a.bitwiseXOR(b), place_bits) == 0, F.lit(False))

    def fast(keys: Column) -> Column:
        packed = F.sort_array(F.transform(keys, lambda k, i: k.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
        again = _let(packed, lambda p: F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1))))

        def checked(p: Column) -> Column:
            mixed = F.exists(F.transform(p, lambda x, i: same(x, F.get(p, i - 1)) & (
                F.get(keys, x.bitwiseAND(mask).cast("int")) != F.get(keys, F.get(p, i - 1).bitwiseAND(mask).cast("int")))),
                lambda x: F.coalesce(x, F.lit(False)))
            places = F.sort_array(F.transform(p, lambda x: x.bitwiseAND(mask)))
            return F.when(F.size(p) == 0, F.lit(0).cast("long")).when(mixed, exact(keys)).otherwise(_covered(places))

        return _let(again, checked)

    keys = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                       lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    counted = _let(keys, lambda k: F.when(F.size(words) >= 1 << min(place_bits, 30), exact(k)).otherwise(fast(k)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(counted)


def statistics(text: str = "text") -> Column:
    """A struct of counts over the whole text, all long."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(whole, F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")

    def count(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern)).cast("long")

    return _let(words, lambda w: _let(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        count("[A-Z]").alias("n_capitals"), count("[0-9]").alias("n_digits"), count("[!?]").alias("n_shouts"))))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the statistics as columns. A generator keeps the optimiser from computing the
    struct once for each use. Names that clash with the frame's own get the statistics' values."""
    rest = [c for c in docs.columns if c not in STATISTICS]
    taken = {c.lower() for c in docs.columns}
    own = next(f"_s{k}" for k in range(len(taken) + 1) if f"_s{k}" not in taken)
    made = docs.withColumn(own, F.explode(F.array(statistics(text))))
    return made.select(*rest, *[F.col(own).getField(n).alias(n) for n in STATISTICS])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, value: Column) -> Column:
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(F.col(f"f_{c.feature}"))
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]], longest: int) -> Rule:
    """Conditions by FOIL's gain; one grouped count over all statistics and cuts for each."""
    names = list(cuts)
    bins = F.array(*[F.struct(F.lit(k).alias("f"), _bin(n, cuts[n]).alias("b")) for k, n in enumerate(names)])
    rule: Rule = ()
    while len(rule) < longest:
        found = (rows.where(_holds(rule)).select("bad", F.explode(bins).alias("x"))
                 .groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())  # <= statistics x cuts
        counts = {(r["f"], r["b"]): (r["p"], r["n"]) for r in found}
        p0 = sum(p for (f, _), (p, _) in counts.items() if f == 0)
        n0 = sum(n for (f, _), (_, n) in counts.items() if f == 0)
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            p = n = 0
            for b, cut in enumerate(cuts[name]):
                dp, dn = counts.get((k, b), (0, 0))
                p, n = p + dp, n + dn
                for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                    if q:
                        g = q * (math.log2(q / (q + m)) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(name, above, cut), g
        if best is None:
            break
        rule += (best,)
    return rule


def _bin(name: str, cuts: list[float]) -> Column:
    """Number of the first cut that is not below the value."""
    out = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        out = F.when(F.col(f"f_{name}") <= cuts[k], F.lit(k)).otherwise(out)
    return out


def learn(labelled: DataFrame, bad: str = "bad", precision: float = 0.97, least: int = 5, longest: int = 3,
          most_rules: int = 8) -> list[Rule]:
    """The rules, in order. `labelled` has the statistics and a column `bad` (1 or 0) and is bounded."""
    feats = [feature(n).alias(f"f_{n}") for n in FEATURES]
    key = [c for c in ("doc_id",) if c in labelled.columns]
    prune = F.pmod(F.xxhash64(*(key or labelled.columns), F.lit(7)), F.lit(3)) == 0
    rows = saved(labelled.select(F.col(bad).cast("int").alias("bad"), prune.alias("prune"), *feats), "labelled")
    shares = [(k + 0.5) / CUTS for k in range(CUTS)]
    found = rows.groupBy("bad").agg(*[F.percentile(f"f_{n}", F.array(*map(F.lit, shares))).alias(n) for n in FEATURES]).collect()
    if len(found) < 2:
        return []
    values = {n: sorted({float(v) for r in found for v in r[n]}) for n in FEATURES}
    cuts = {n: [(a + b) / 2 for a, b in zip(v, v[1:])] for n, v in values.items()}  # half-way, for a margin
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows
        for r in rules:
            left = left.where(~_holds(r))
        rule = _grow(left.where(~F.col("prune")), cuts, longest)
        if not rule:
            break
        tests = [F.sum(F.when(_holds(rule[:k]), v)).alias(f"{w}{k}") for k in range(1, len(rule) + 1)
                 for w, v in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
        hits = left.where("prune").agg(*tests).first()
        worth = {k: ((hits[f"p{k}"] or 0), (hits[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)}
        value = {k: (p - n) / (p + n) if p + n else -1.0 for k, (p, n) in worth.items()}
        k = max(value, key=lambda x: (value[x], -x))
        p, n = worth[k]
        if p < least or p < precision * (p + n):
            break
        rules.append(rule[:k])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for rows to keep: an ordered conditional over the statistics columns."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        hold = F.lit(True)
        for c in rule:
            hold = hold & c.column(feature(c.feature))
        out = out.when(hold, F.lit(False))
    return out.otherwise(F.lit(True))


def learn_from(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
               quality: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules from the labelled rows of `docs` that pass the base rule; only those texts are read."""
    known = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        (1 - F.max(quality)).alias("bad"))
    chosen = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")  # at most `sample` ids
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    stats = saved(with_statistics(own).drop("text"), "statistics")
    return learn(stats.where(~base_failed()))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows with their statistics, base_failed and kept, which replace columns of these names."""
    rules = learn_from(docs, labels, doc_id, text, sample=sample)
    return with_statistics(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def kept_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are kept, as they came, whatever the names of their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("text"))
    rules = learn_from(docs, labels, doc_id, text)
    return with_statistics(rows).where(verdict(rules)).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
