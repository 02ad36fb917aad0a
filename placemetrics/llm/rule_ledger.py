"""Quality rules as a bitmask ledger: every rule is evaluated once, policies come later.

The ledger holds, for each document, the measurements and one bit for each failed
rule.  A policy is a named, versioned set of rules; applying one, or asking what a
rule changes, reads the bits only.

Null and empty texts have no words and fail ``few_words``; null ids and repeated rows
are rows like others; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.llm.common import SEPARATORS

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"

#: Rule name -> condition under which a document fails; a rule's place is its bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
}
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """The rules whose failure drops a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(rule) for rule in self.rules)


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


POLICIES = {
    policy.version: policy
    for policy in (
        Policy("base-1", BASE_RULES),
        Policy("web-1", BASE_RULES + ("symbols", "repeated_lines", "short_words", "long_words", "capitals")),
    )
}


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document with the measurements that the rules need.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Repeats are found inside the row: windows of
    three words are sorted by hash, equal neighbours name repeated windows, and the
    distances between their starts count the words they cover.
    """
    def without(column: Column, characters: str) -> Column:
        return F.translate(column, characters, "")

    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *[F.col(name).alias(f"_keep_{k}") for k, name in enumerate(keep)],
        body.alias("_text"),
        F.filter(F.split(body, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: without(x, SEPARATORS) != "").alias("_lines"),
    )
    words = F.col("_words")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")),
    )
    empty = F.expr("cast(array() as array<struct<h: bigint, at: int>>)")
    counted = split.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(without(F.col("_text"), SEPARATORS)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(without(F.col("_text"), CAPITALS))).cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) >= 3, F.array_sort(windows)).otherwise(empty).alias("_windows"),
    ).drop("_text", "_words", "_lines")
    w = F.col("_windows")
    repeated = F.filter(
        w, lambda x, k: (x["h"] == F.get(w, k - 1)["h"]) | (x["h"] == F.get(w, k + 1)["h"]))
    starts = counted.withColumn("_starts", F.array_sort(F.transform(repeated, lambda x: x["at"]))).drop("_windows")
    s = F.col("_starts")
    steps = F.transform(s, lambda at, k: F.coalesce(F.least(F.lit(3), at - F.get(s, k - 1)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)
    return starts.select(
        *[F.col(f"_keep_{k}").alias(name) for k, name in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "n_capitals")


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``failures``: bit k is set if rule k of RULES fails."""
    bits = [F.when(F.expr(condition), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long") for rule, condition in RULES.items()]
    total = bits[0]
    for one in bits[1:]:
        total = total.bitwiseOR(one)
    return measured(docs, text, keep).withColumn("failures", total)


def fails(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(table: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``policy`` and ``kept``."""
    return table.withColumns({"policy": F.lit(policy.version), "kept": ~fails(policy)})


def ablations(table: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents failing it, and those that only it drops."""
    mask = F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")).alias("mask")
    patterns = table.groupBy(mask).agg(F.count("*").alias("n"))  # one row per set of failed rules
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in policy.rules]))
    return (
        patterns.select("mask", "n", one.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.bit_or("mask").alias("failed_together"),
        )
    )


def op10_rule_ledger(spark, folder: str) -> DataFrame:
    from placemetrics.llm.common import documents

    judged = apply_policy(ledger(documents(spark, folder)), POLICIES["web-1"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails(POLICIES["base-1"]).alias("base_failed"), "kept", "n_lines", "n_capitals", "failures", "policy")


def rule_ablations(spark, folder: str) -> DataFrame:
    """For every policy and each of its rules: documents failing the rule, and those kept without it.

    The ledger is written once; every policy reads its bits.
    """
    from placemetrics.llm.common import documents, stored

    bits = stored(ledger(documents(spark, folder)).select("failures"), "ledger")
    reports = [ablations(bits, policy).withColumn("policy", F.lit(policy.version)) for policy in POLICIES.values()]
    return reduce(DataFrame.unionByName, reports)


_ANY = "[\\x20\\x09-\\x0D]"
_LEDGER_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{_ANY}+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_ANY}+', '', 'g') <> '') AS lines FROM d),
m AS (SELECT r, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_ANY}+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')))::BIGINT AS n_capitals,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM s),
w AS (SELECT r, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM s),
t AS (SELECT r, i, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
x AS (SELECT r, count(DISTINCT j)::BIGINT AS n_repeat_words
      FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n >= 2) GROUP BY r),
a AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN x USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 64 ELSE 0 END)::BIGINT AS failures FROM a)
"""
OP10_SQL = _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
       failures = 0 AS kept, n_lines, n_capitals, failures, 'web-1' AS policy FROM f
"""
ABLATIONS_SQL = _LEDGER_SQL + """,
p AS (SELECT policy, mask, rule, bit FROM (VALUES {policies}) AS v(policy, mask, rule, bit)),
b AS (SELECT policy, rule, bit, failures & mask AS failed FROM f CROSS JOIN p)
SELECT policy, rule, count(*) FILTER (failed & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (failed = bit)::BIGINT AS n_only_this,
       bit_or(failed)::BIGINT AS failed_together FROM b GROUP BY policy, rule
""".format(policies=", ".join(
    f"('{p.version}', {p.mask}::BIGINT, '{r}', {bit(r)}::BIGINT)" for p in POLICIES.values() for r in p.rules))
