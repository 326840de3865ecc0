"""Quality rules: every rule is evaluated once per document into a ledger of measurements and
failure bits; versioned policies and ablations only read the ledger's bits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words")
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements is true."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a changed rule gets a new one, so that old ledgers stay readable.
RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "5 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 25 * n_words"),
    Rule(5, "duplicate_lines", "n_dup_lines >= 2 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "few_different_words", "n_words >= 50 and 20 * n_unique_words < n_words"),
)

#: A policy is the set of bits that reject a document.
POLICIES = {"base": ("too_few_words", "repeated_windows"), "v1": tuple(r.name for r in RULES)}


def policy_mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(128)) + bytes(range(0xC0, 256))))
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    seen, lines, again = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    repeat = 0
    if n >= 6:
        grams = common.hash_grams(common.hash_words(words), 5)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if same.any():
            at = np.zeros(n + 1, np.int64)
            hit = np.zeros(len(grams), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            np.add.at(at, np.flatnonzero(hit), 1)
            at[5:] -= np.r_[hit, False].astype(np.int64)[: n - 4]
            repeat = int((np.cumsum(at[:n]) > 0).sum())
    return n, chars, symbols, again, repeat, lines, len(set(words))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements): words `[^\\x20\\x09-\\x0D]+` of whole texts. Null and empty texts measure 0
    everywhere; repeated rows are measured each; other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_measure(t) for t in common.text_or_empty(batch.column(1))]
        columns = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["id", *MEASURES])

    return common.map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), kernel, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bitmask ledger: (id, measurements, failed long). Bit b of failed is rule b's failure."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measure(df, id_col, text_col).withColumn("failed", mask)


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Add kept: none of the policy's bits is set."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per rule of the policy: documents that fail it, that fail it alone (so would come back
    without it), and the documents kept when the rule is left out. One pass of bitwise sums."""
    mask = policy_mask(policy)
    rules = [r for r in RULES if mask >> r.bit & 1]
    held = F.col("failed").bitwiseAND(F.lit(mask))
    one = led.agg(
        F.count("*").alias("n"),
        F.count_if(held == 0).alias("kept"),
        *[F.count_if(held.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}") for r in rules],
        *[F.count_if(held == (1 << r.bit)).alias(f"a{r.bit}") for r in rules],
    )
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("failed"), F.col(f"a{r.bit}").alias("failed_alone"), (F.col("kept") + F.col(f"a{r.bit}")).alias("kept_without")) for r in rules])
    return one.select(F.inline(each))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v1. Null and empty texts measure 0 and fail the base rules (fewer than ten
    words); repeated rows are judged each; the rules know no ties; an empty table gives no rows."""
    led = apply_policy(ledger(common.table(spark, sf_dir, "documents")))
    return led.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(policy_mask("base"))) != 0).alias("base_failed"), "kept", F.col("failed").alias("failed_rules"),
    )


def _sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
u AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM u),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE len(gram) = 5),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM h, generate_series(0, 4) AS s(k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
ll AS (SELECT rid, sum(n - 1)::BIGINT AS n_dup_lines, sum(n)::BIGINT AS n_lines FROM l GROUP BY rid),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words,
       length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
       coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_distinct(w))::BIGINT AS n_unique_words
      FROM w LEFT JOIN r USING (rid) LEFT JOIN ll USING (rid)),
f AS (SELECT *, ({bits})::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_rules & {policy_mask("base")} <> 0 AS base_failed, failed_rules & {policy_mask("v1")} = 0 AS kept, failed_rules
FROM f"""


ORACLE_SQL = _sql()
