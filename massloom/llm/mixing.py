"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised; the exponent is the flattest one that
meets a target entropy and a limit on repetition. The weights are then realised as blocks of a fixed
token budget: every source has a share of each block, filled from its own permutations, one per epoch.
No document is left out: the source that is repeated least is used exactly once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1_000_000
#: Rows of a source that one task orders at a time, on average.
BUCKET_ROWS = 10_000
_NULL = "\x00null"


def source_totals(docs: DataFrame) -> DataFrame:
    """(source, rows, tokens): words of whole texts; a null source is a source of its own."""
    return docs.select(_source().alias("source"), _tokens().alias("t")).groupBy("source").agg(F.count("*").alias("rows"), F.sum("t").alias("tokens"))


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(_NULL))


def _tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Temperature:
    exponent: float
    norm: float  # sum of powered shares
    total: int  # tokens of all sources
    largest: float  # largest share

    def repeats(self, tokens: Column) -> Column:
        """How often a source of that many tokens is passed over; 1 for the largest, and where there are none."""
        share = tokens / F.lit(float(max(1, self.total)))
        return F.when(tokens > 0, F.greatest(F.lit(1.0), F.pow(share / F.lit(self.largest), F.lit(self.exponent - 1.0)))).otherwise(F.lit(1.0))

    def weight(self, tokens: Column) -> Column:
        return F.when(tokens > 0, F.pow(tokens / F.lit(float(max(1, self.total))), F.lit(self.exponent)) / F.lit(self.norm)).otherwise(F.lit(0.0))


def temperature(totals: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None) -> Temperature:
    """The least exponent in [0, 1] whose weights have at most the target entropy (nats; none: any) and
    repeat no source more than max_repeats times. Entropy and repetition fall as the exponent grows, so
    it is bisected; each round sends a few sums to the driver, whatever the number of sources."""
    some = totals.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    n, total, low, high = some.agg(F.count("*"), F.sum("t"), F.min("t"), F.max("t")).first()
    if not n:
        return Temperature(1.0, 1.0, 0, 1.0)
    p = F.col("t") / F.lit(total)

    def measured(exponents: list[float]) -> list[tuple[float, float]]:
        power = [F.pow(p, F.lit(a)) for a in exponents]
        row = some.agg(*[F.sum(x) for x in power], *[F.sum(x * F.log(p)) for x in power]).first()
        k = len(exponents)
        return [(row[i], math.log(row[i]) - exponents[i] * row[k + i] / row[i]) for i in range(k)]

    spread = math.log(high / low)
    left, right = 0.0, 1.0
    for _ in range(40):  # repetition: closed form of each step
        mid = (left + right) / 2
        left, right = (left, mid) if math.exp((1 - mid) * spread) <= max_repeats else (mid, right)
    exponent = right if math.exp(spread) > max_repeats else 0.0
    if entropy is not None:
        left, right = exponent, 1.0
        if measured([left])[0][1] > entropy:
            for _ in range(4):  # sixteen bisections, four at a time
                steps = [left + (right - left) * i / 16 for i in range(17)]
                above = [h > entropy for _, h in measured(steps)]
                cut = max([i for i, a in enumerate(above) if a], default=0)
                left, right = steps[cut], steps[min(cut + 1, 16)]
            exponent = right
    return Temperature(exponent, measured([exponent])[0][0], int(total), high / total)


def _key(seed: int, epoch: Column) -> Column:
    """A row's place in its source's permutation of an epoch; equal rows share it."""
    return F.xxhash64(F.lit(seed), epoch, F.col("doc_id"), F.col("text_hash"))


def plan(docs: DataFrame, temp: Temperature, totals: DataFrame, seed: int = 11, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per copy of a document: doc_id, source, tokens, epoch, block, weight, repeats, key.

    A source's copies follow each other in epochs, each a permutation of its own; the last epoch ends when
    the source's budget is met (the copy that crosses it is in). A source's token position divided by its
    share of a block gives the block. Prefix sums run over buckets of the permutation, so no task holds a
    source. totals should be written; docs' other columns are ignored.
    """
    base = docs.select("doc_id", _source().alias("source"), _tokens().alias("tokens"), F.xxhash64("text").alias("text_hash"))
    per = totals.select("source", F.col("tokens").alias("all"), "rows", F.col("rows").alias("n"), temp.repeats(F.col("tokens")).alias("repeats"), temp.weight(F.col("tokens")).alias("weight"))
    epochs = F.ceil(F.col("repeats") - F.lit(1e-9)).cast("int")
    copies = common.join_counted(base, per, "source", "n").withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    copies = copies.withColumn("key", _key(seed, F.col("epoch")))
    unit = F.shiftrightunsigned("key", 11).cast("double") / F.lit(float(1 << 53))
    copies = common.materialize(copies.withColumn("bucket", F.floor(unit * F.ceil(F.col("rows") / BUCKET_ROWS))))
    # negative keys come after the others as unsigned numbers do
    order = [F.shiftrightunsigned("key", 1), "key", "doc_id"]
    inside = F.sum("tokens").over(Window.partitionBy("source", "epoch", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = copies.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sums = sums.select("source", "epoch", "bucket", before.alias("before"))
    placed = copies.withColumn("at", inside - F.col("tokens")).join(sums, ["source", "epoch", "bucket"])
    placed = placed.withColumn("at", F.col("at") + F.col("before") + F.col("epoch") * F.col("all"))
    budget = F.round(F.col("repeats") * F.col("all"))
    placed = placed.where((F.col("epoch") == 0) | (F.col("at") < budget))
    share = F.greatest(F.col("weight") * F.lit(float(block_tokens)), F.lit(1.0))
    return placed.select("doc_id", "source", "tokens", "epoch", F.floor(F.col("at") / share).alias("block"), "weight", "repeats", "key", "text_hash")


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, seed: int = 11) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it, with docs' own columns,
    whatever their names.

    Whole epochs repeat every row; of the last epoch a source takes the rows up to one key, so the texts are
    not moved, only a row per source. Null sources are a source; null and empty texts have no tokens and are
    taken once per whole epoch; equal rows share their fate; an empty table stays empty.
    """
    source, last_key, whole_, copy = (common.unused(docs, c) for c in ("mix_source", "mix_last", "mix_whole", "mix_copy"))
    totals = common.materialize(source_totals(docs))
    temp = temperature(totals, max_repeats, entropy)
    whole = F.floor(F.col("repeats") + F.lit(1e-9)).cast("int")
    planned = plan(docs, temp, totals, seed)
    last = planned.where(F.col("epoch") == whole).groupBy("source").agg(F.max(F.shiftrightunsigned("key", 1)).alias(last_key))
    per = totals.select("source", whole_of(temp).alias(whole_), "rows").join(last, "source", "left")
    per = common.materialize(per.select(F.col("source").alias(source), whole_, last_key, F.col("rows").alias(copy)))
    key = F.xxhash64(F.lit(seed), F.col(whole_), F.col("doc_id"), F.xxhash64("text"))
    take = F.col(whole_) + F.when(F.shiftrightunsigned(key, 1) <= F.col(last_key), 1).otherwise(0)
    joined = common.join_counted(docs.withColumn(source, _source()), per, source, copy)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), take))).select(*common.columns(docs))


def whole_of(temp: Temperature) -> Column:
    return F.floor(temp.repeats(F.col("tokens")) + F.lit(1e-9)).cast("int")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy that the mixture takes, with its block; inside a block the order is that of block_key."""
    docs = common.table(spark, sf_dir, "documents")
    totals = common.materialize(source_totals(docs))
    out = plan(docs, temperature(totals), totals)
    return out.select("doc_id", F.nullif("source", F.lit(_NULL)).alias("source"), "tokens", "epoch", "block", F.xxhash64(F.lit(23), "block", "key").alias("block_key"))
