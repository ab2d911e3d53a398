"""Operator 1, quality rules: a bitmask ledger made with DataFrame functions only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long, ``fail_bits``, whose bit
i is set if rule i failed. A policy is a named mask over those bits, so that a new policy, or an ablation that leaves
one rule out, is a bitwise operation on the ledger and never reads a text again.

Defined results: a null text counts as an empty one, which has no words and fails ``too_short``. Repeated rows are
judged each for itself. An empty table gives an empty ledger. Other columns of the input are not carried along, so names
that clash do no harm. Long texts need no limit: the work on a text of n words is n log n. Windows of words are compared
as 64-bit hashes, which are not looked up again: exact but for a collision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, let

#: Rules by bit: a name and when a document fails. Ratios are compared as whole numbers, so that no rounding matters.
RULES: list[tuple[str, str]] = [
    ("too_short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_ratio", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("shouting", "10 * n_caps > 4 * word_chars"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
BASE = ("too_short", "repeated_windows")
WINDOW = 3


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", (*BASE, "symbol_ratio", "duplicate_lines")),
    "v2": Policy("v2", tuple(name for name, _ in RULES)),
}


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1), p + WINDOW) - p))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(grams: Column) -> Column:
        same = lambda s, k, at: F.coalesce(F.get(s, at)["g"] == F.get(s, k)["g"], F.lit(False))
        starts = let(F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i")))), lambda s: F.array_sort(F.transform(F.filter(s, lambda e, k: same(s, k, k - 1) | same(s, k, k + 1)), lambda e: e["i"])))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(starts, covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    return let(words, lambda w: F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(windows(w), repeated)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` of each document. No shuffle, no Python."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = lambda t: F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    measures = lambda t: F.struct(
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"))).alias("w"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_caps"),
        let(lines(t), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("u"))).alias("l"),
    )
    m = docs.select(F.col(id_col).alias("doc_id"), let(text, measures).alias("m")).select(
        "doc_id", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.n_caps", F.col("m.l.n").alias("n_lines"), (F.col("m.l.n") - F.col("m.l.u")).alias("n_dup_lines"), "m.w.n_repeat_words"
    )
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``policy`` to a ledger."""
    fails = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return book.select("*", fails(POLICIES["base"].mask).alias("base_failed"), (~fails(POLICIES["base"].mask | policy.mask)).alias("kept"), F.lit(policy.version).alias("policy"))


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: how many fail it, fail nothing else, and are kept without it.

    One aggregation to a row for each pattern of bits (at most 2^rules), then bitwise operations on these few rows.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in policy.rules)))
    sum_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return (
        patterns.select("n", masked.alias("bits"), rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(sum_if(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), sum_if(F.col("bits") == F.col("r.bit")).alias("n_only"), sum_if(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"))
    )


def quality(docs: DataFrame, policy: str = "v2") -> DataFrame:
    return apply_policy(ledger(docs), POLICIES[policy])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_caps", "n_lines", "fail_bits")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
s AS (SELECT *, [w for w in string_split_regex(t, '[\x20\x09-\x0D]+') if w <> ''] AS w,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM s WHERE len(w) >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c >= 2) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_caps, len(l)::BIGINT AS n_lines
      FROM s LEFT JOIN r USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 10 * n_caps > 4 * word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
       n_caps, n_lines, fail_bits FROM b
"""
