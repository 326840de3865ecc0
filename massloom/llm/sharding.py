"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The counts that go from each partition to each shard are drawn exactly (multivariate
hypergeometric with the shard sizes as column sums), every partition permutes its own rows and
deals them out by its counts, the rows are exchanged, and each shard permutes what it got.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Partitions of the matrix; it is broadcast, at most MAX_PARTITIONS x shards x 8 bytes.
MAX_PARTITIONS = 65_536


def communication_matrix(rows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Counts [partition, shard] with row sums `rows` and column sums `sizes`, as a uniform
    permutation of all rows would give them."""
    draw = np.random.default_rng(seed)
    left, out = sizes.astype(np.int64).copy(), np.zeros((len(rows), len(sizes)), np.int64)
    for p, n in enumerate(rows):
        rest = int(left.sum())
        for s in range(len(sizes) - 1):  # conditional draws: hypergeometric, shard by shard
            if not n:
                break
            rest -= int(left[s])
            k = _hypergeometric(draw, int(left[s]), rest, int(n))
            out[p, s] = k
            n -= k
        out[p, -1] += n
        left -= out[p]
    return out


#: Totals below which numpy draws; beyond, the law is summed around its mode.
NUMPY_LIMIT = 1_000_000_000


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    if good + bad < NUMPY_LIMIT:
        return int(draw.hypergeometric(good, bad, n))
    return _by_inversion(draw, good, bad, n)


def _by_inversion(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An urn of any size, by inversion: the law's weights follow from the mode by the ratios of neighbours, over twelve
    standard deviations to both sides (what lies beyond is less than 1e-30, far below a random number's last digit)."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    sd = (n * (good / total) * (bad / total) * max(total - n, 1) / max(total - 1, 1)) ** 0.5
    low, high = max(low, mode - int(12 * sd) - 12), min(high, mode + int(12 * sd) + 12)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(float(bad - n) + k + 1)
    weight = np.r_[0.0, np.cumsum(steps)]
    sums = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(sums, draw.random() * sums[-1], side="right"))


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 in each shard): a uniform random
    permutation of all rows cut into shards whose row counts differ by at most one.

    Every row counts, whatever its values (nulls, empty texts, ties, repeated rows); an empty table gives no rows.
    Columns of df may have any names; where df has a shard or slot itself, the added one is _shard or _slot. df is written
    once to the shared folder with row numbers, so repeated tasks deal the same rows to the same shards.
    """
    n_in = df.rdd.getNumPartitions()
    if n_in > MAX_PARTITIONS:
        df = df.coalesce(MAX_PARTITIONS)
    out_names = [*df.columns, common.unused(df, "shard"), common.unused(df, "slot")]
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    row_, key_, shard_, piece_, range_, shift_ = "row_number", "shuffle_key", "shard", "piece", "range_number", "shift"
    held = common.materialize(df.withColumn(row_, F.monotonically_increasing_id()))
    part = F.shiftright(row_, 33)
    counts = dict(held.groupBy(part.alias("p")).count().collect())  # one number per partition
    ids = sorted(counts)
    rows = np.array([counts[p] for p in ids], np.int64)
    total = int(rows.sum())
    sizes = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    matrix = dict(zip(ids, communication_matrix(rows, sizes, seed), strict=True))
    sent = df.sparkSession.sparkContext.broadcast((counts, matrix))
    at_row = len(held.columns) - 1

    def deal(batches):
        last, shard_of, key_of = None, None, None
        for batch in batches:
            row = batch.column(at_row).to_numpy()
            p_of, at = row >> 33, row & ((1 << 33) - 1)
            shard, key = np.empty(len(row), np.int32), np.empty(len(row), np.int64)
            for p in np.unique(p_of):
                if p != last:  # the local permutation depends on seed and partition only
                    n, to = sent.value[0][int(p)], sent.value[1][int(p)]
                    draw = np.random.default_rng([seed, int(p)])
                    shard_of = np.repeat(np.arange(shards, dtype=np.int32), to)[draw.permutation(n)]
                    key_of, last = draw.integers(-(1 << 63), (1 << 63) - 1, n), p
                here = p_of == p
                shard[here], key[here] = shard_of[at[here]], key_of[at[here]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(key)], [*batch.schema.names, shard_, key_])

    dealt = held.mapInArrow(deal, T.StructType([*held.schema.fields, T.StructField(shard_, T.IntegerType()), T.StructField(key_, T.LongType())]))
    # exchange; the second permutation is the order of the random keys inside each shard. Ranges of
    # (shard, key) split a shard over tasks; offsets of the ranges make its slots gapless.
    n_out = max(shards, min(n_in, MAX_PARTITIONS))
    ranged = dealt.repartitionByRange(n_out, shard_, key_).sortWithinPartitions(shard_, key_, row_)
    ranged = common.materialize(ranged.withColumn(range_, F.monotonically_increasing_id()))
    piece = F.shiftright(range_, 33)
    first = ranged.groupBy(shard_, piece.alias("p")).agg(F.count("*").alias("n"), F.min(range_).alias("first"))
    offsets, have = [], [0] * shards
    for s, p, n, low in sorted(first.collect()):  # ranges and shards, not rows
        offsets.append((s, p, have[s] - low))
        have[s] += n
    shift = pa.table({k: pa.array([x[i] for x in offsets], t) for i, (k, t) in enumerate(((shard_, pa.int32()), (piece_, pa.int64()), (shift_, pa.int64())))})
    # at most MAX_PARTITIONS ranges and as many more as there are shards: small enough to broadcast
    shift = F.broadcast(df.sparkSession.createDataFrame(shift))
    out = ranged.withColumn(piece_, piece).join(shift, [shard_, piece_])
    return out.select(*df.columns, shard_, F.col(shift_) + F.col(range_)).toDF(*out_names)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: shard sizes at most one apart. Null texts have size 1 and the checksum of no bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
