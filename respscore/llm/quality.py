"""Quality rules as a bitmask ledger (operator 4), DataFrame functions only.

``ledger`` measures every text once and stores, beside the measurements, one
bit per rule that the text fails.  A policy is a versioned mask over those
bits: applying one, comparing two, or asking what a rule alone decides
(``ablations``) reads the narrow ledger and never the texts again.

Defined results: a null or empty text has no words, lines or symbols and
fails ``few_words``; repeated rows are judged alike; an empty table gives an
empty ledger; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, table, with_struct

# Fixed values of the contract: the symbols, and what fails a text before any policy.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50


@dataclass(frozen=True)
class Rule:
    """One rule: its bit in the ledger and the SQL condition on the measurements that fails a text."""
    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", f"n_words < {MIN_WORDS}"),
    Rule(1, "repeated_windows", f"100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words"),
    Rule(2, "long_words", "word_chars > 15 * n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "2 * n_dup_lines > n_lines"),
)
BASE = ("few_words", "repeated_windows")

# Policies by version: the rules that reject.  Bits of rules outside a policy are still in the ledger.
POLICIES = {
    1: BASE,
    2: BASE + ("long_words", "short_words", "symbols", "repeated_lines"),
}
CURRENT = 2

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(version: int) -> int:
    """The bits of the rules that a policy holds."""
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[version])


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.  Windows are sorted by a
    64-bit hash, then by their words, so equal ones are neighbours: exact, n log n in the text."""
    n = F.size(words)
    window = lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
        F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))
    windows = F.transform(F.sequence(F.lit(0), n - 3), window)

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(n < 3, F.lit(0)).otherwise(let(F.sort_array(windows), covered))


def measures(text: Column) -> Column:
    """Struct of MEASURES (all BIGINT) of one text."""
    text = F.coalesce(text, F.lit(""))
    of_words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).alias("n"),
        F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("chars"),
        _repeat_words(w).alias("rep")))
    of_lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    symbols = F.regexp_count(text, F.lit(SYMBOLS))
    return let(F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("s")), lambda m: F.struct(
        m["w"]["n"].cast("bigint").alias("n_words"), m["w"]["chars"].alias("word_chars"), m["s"].cast("bigint").alias("n_symbols"),
        m["l"]["n"].cast("bigint").alias("n_lines"), m["l"]["dup"].cast("bigint").alias("n_dup_lines"),
        m["w"]["rep"].cast("bigint").alias("n_repeat_words")))


def failed_bits() -> Column:
    """Bit mask of all failed rules, from the measurement columns."""
    bits = F.lit(0).cast("bigint")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` columns (default ``doc_id``), MEASURES and
    ``failed_bits``.  One pass over the texts, no shuffle."""
    narrow = docs.select(*[F.col(c) for c in carry or ["doc_id"]], F.col(text).alias("_text"))
    out = with_struct(narrow, measures(F.col("_text"))).drop("_text")
    return out.withColumn("failed_bits", failed_bits())


def passes(version: int = CURRENT) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(version)).cast("bigint")) == 0


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """What each rule of a policy decides: ``n_failed`` texts that fail it, and ``n_alone`` that
    would pass without it.  Bit masks are counted first (at most 2^rules groups, summed in each
    task), then read once per rule."""
    m = mask(version)
    masks = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("bigint")).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("_b"))
                      for r in RULES if r.name in POLICIES[version]])
    each = masks.select("_m", "_n", F.inline(rules))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("_m").bitwiseAND(F.col("_b")) != 0, F.col("_n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("_m") == F.col("_b"), F.col("_n")).otherwise(0)).alias("n_alone"))


def compare_policies(rows: DataFrame, old: int, new: int) -> DataFrame:
    """Texts by what two versions say of them: ``kept_old``, ``kept_new``, ``n``."""
    return rows.groupBy(passes(old).alias("kept_old"), passes(new).alias("kept_new")).agg(F.count(F.lit(1)).alias("n"))


def keep_passing(docs: DataFrame, text: str = "text", version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass a policy, with the columns of ``docs``.  Measured in place."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    judged = with_struct(packed, measures(F.col("_row")[text])).withColumn("failed_bits", failed_bits())
    return judged.where(passes(version)).select("_row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    base = mask(1)
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = F.col("failed_bits").bitwiseAND(F.lit(base).cast("bigint")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & passes(CURRENT)).alias("kept"),
                       "failed_bits", F.lit(CURRENT).alias("policy_version"))


_SYMBOL_SQL = "[#*$%&|<>]"
OP4_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM t),
occ AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM occ),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win) WHERE k >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '{_SYMBOL_SQL}'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, ({' + '.join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {mask(1)}) <> 0 AS base_failed,
       (failed_bits & {mask(1)}) = 0 AND (failed_bits & {mask(CURRENT)}) = 0 AS kept, failed_bits, {CURRENT} AS policy_version
FROM b
"""
