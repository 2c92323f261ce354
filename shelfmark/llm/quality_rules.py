"""Quality rules: a ledger of measurements and one failure bit per rule, policies over the bits, ablations of rules.

Every rule is evaluated once, into ``rule_bits``. A policy is a versioned mask over the bits, so that a change of policy or
the question "what would this rule alone cost" reads the ledger and never the texts. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents

#: A repeated passage is a window of so many words that the text holds at least twice.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measurements, in integers so that no rounding decides; null counts as not failed."""

    bit: int
    name: str
    fails: str


#: Rules 0 and 1 are the base of the contract. The numbers are parameters, set from public practice for web text.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_passages", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << r.bit for r in rules if r.name in self.rules)


POLICIES = {
    1: Policy(1, ("few_words", "repeated_passages")),
    2: Policy(2, ("few_words", "repeated_passages", "symbols", "repeated_lines", "short_words", "long_words")),
}
BASE, CURRENT = POLICIES[1], POLICIES[2]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long).

    Words are runs of other characters than space and U+0009 to U+000D. n_dup_lines counts the lines with a word that equal
    an earlier line; n_lines the lines with a word. n_repeat_words counts the words inside windows of 8 words that the
    text holds twice or more, the first one included. Null and empty texts: all zero. The whole text is read; one row's
    arrays take memory in proportion to its text. Columns of the input that have one of these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_words": F.array_remove(F.split(body, SPACES), ""), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(body, SPACES, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda word: F.xxhash64(word)),
        }
    )
    # One 64-bit hash for each window, by its first word's position.
    windows = F.when(
        F.size("_hashes") >= WINDOW,
        F.transform(F.slice("_hashes", F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *(F.get("_hashes", i + k) for k in range(1, WINDOW)))),
    )
    out = out.withColumn("_windows", windows)
    # Few texts repeat a window: only those pay for sorting. Sorted by (hash, position), a window is repeated if a neighbour has its hash.
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(some, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_sorted", lambda w, k: F.get("_sorted", k - 1)["h"].eqNullSafe(w["h"]) | F.get("_sorted", k + 1)["h"].eqNullSafe(w["h"]))
    out = out.withColumn("_starts", F.array_sort(F.transform(twice, lambda w: w["i"])))
    covered = F.aggregate(F.transform("_starts", lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - at, F.lit(WINDOW)))), F.lit(0), lambda total, n: total + n)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_words", "_lines", "_hashes", "_windows", "_sorted", "_starts")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``rule_bits`` (long): bit b is set if the rule with that bit fails."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text).withColumn("rule_bits", bits)


def failed(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("rule_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def ablations(entries: DataFrame, policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy, over a ledger: how many rows it fails, and how many fail by it alone (kept without it).

    One partial aggregation; the exchange carries one row a task. Also ``any_bits``/``all_bits``: the rules that some row, or every row, fails.
    An empty ledger gives zero counts and null bits.
    """
    mask = policy.mask(rules)
    used = [r for r in rules if mask >> r.bit & 1]
    held = F.col("rule_bits").bitwiseAND(F.lit(mask).cast("long"))
    counts = entries.agg(
        F.count("*").alias("n"),
        F.bit_or(held).alias("any_bits"),
        F.bit_and(held).alias("all_bits"),
        *(F.count_if(held.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"f{r.bit}") for r in used),
        *(F.count_if(held == 1 << r.bit).alias(f"o{r.bit}") for r in used),
    )
    each = F.array(*(F.struct(F.lit(policy.version).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("failed"), F.col(f"o{r.bit}").alias("only_this")) for r in used))
    return counts.select("n", "any_bits", "all_bits", F.inline(each))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(documents(spark, sf_dir).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = failed(BASE)
    return entries.select("doc_id", *names, base.alias("base_failed"), (~base & ~failed(CURRENT)).alias("kept"), "rule_bits")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT k, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), windows AS (
  SELECT k, i, array_to_string(words[i:i + 7], ' ') AS w FROM split, unnest(range(1, len(words) - 6)) AS t(i) WHERE len(words) >= 8
), twice AS (
  SELECT k, unnest(list(i)) AS i FROM windows GROUP BY k, w HAVING count(*) > 1
), spans AS (
  SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS n FROM twice
), repeated AS (
  SELECT k, sum(n) AS n FROM spans GROUP BY k
), m AS (
  SELECT s.k, doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeated r ON s.k = r.k
), b AS (
  SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT)
    + 4 * CAST(10 * n_symbols > 3 * n_words AS BIGINT) + 8 * CAST(n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines AS BIGINT)
    + 16 * CAST(n_words > 0 AND word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 20 * n_words AS BIGINT) AS rule_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (rule_bits & 3) <> 0 AS base_failed, rule_bits = 0 AS kept, rule_bits FROM b
"""
