"""Operators on rows in m/z order. A global order is cut into blocks of about as many rows each, at quantiles of the
data; rows near a block's edge are also sent to the blocks that their halo reaches, so windows run per block and no task
holds the whole order. The halo must be at least as wide as the widest gap that can change a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import split_wide
from .settle import settle
from .tolerance import PPM

#: Rows of a block, about, and blocks at most.
BLOCK_ROWS, MAX_BLOCKS = 20_000, 512
FAR = 999_999.0


def _edges(df: DataFrame, on: str) -> list[float]:
    """Inner edges of blocks of about BLOCK_ROWS rows: quantiles from one pass, at most MAX_BLOCKS numbers."""
    shares = [k / MAX_BLOCKS for k in range(1, MAX_BLOCKS)]
    n, at = df.agg(F.count(on), F.percentile_approx(F.col(on).cast("double"), shares, 4 * MAX_BLOCKS)).first()
    blocks = min(MAX_BLOCKS, max(1, n // BLOCK_ROWS))
    return sorted({at[k * MAX_BLOCKS // blocks - 1] for k in range(1, blocks)}) if at else []


def _block_of(df: DataFrame, edges: list[float], columns: dict[str, Column]) -> DataFrame:
    """df with the block numbers of values: how many edges are at or below each."""
    if not edges:
        return df.withColumns({name: F.lit(0) for name in columns})
    at = [f"__at{i}" for i in range(len(columns))]
    held = df.withColumns({c: v.cast("double") for c, v in zip(at, columns.values(), strict=True)})
    cut = Bucketizer(splitsArray=[[-float("inf"), *edges, float("inf")]] * len(at), inputCols=at, outputCols=list(columns), handleInvalid="keep")
    return cut.transform(held).drop(*at).withColumns({name: F.col(name).cast("int") for name in columns})


def blocked(df: DataFrame, on: str, halo: Column | float) -> DataFrame:
    """df with __block and __own: every row once in its own block and again wherever its halo reaches."""
    v = F.col(on)
    halo = halo if isinstance(halo, Column) else F.lit(float(halo))
    rows = df.where(v.isNotNull())
    rows = _block_of(rows, _edges(rows, on), {"__mine": v, "__low": v - halo, "__high": v + halo})
    rows = rows.withColumn("__block", F.explode(F.sequence("__low", "__high")))
    return rows.withColumn("__own", F.col("__block") == F.col("__mine")).drop("__mine", "__low", "__high")


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(F.col("id").cast("long").alias("id"), F.col("mz").cast("double").alias("mz"), F.lit(1).alias("origin")).union(b.select(F.col("id").cast("long"), F.col("mz").cast("double"), F.lit(2)))


def _adjacent(a: DataFrame, b: DataFrame, ppm: float) -> DataFrame:
    """The union of two lists in order, with each row's neighbours."""
    rows = blocked(_union(a, b), "mz", F.col("mz") * 4 * ppm * PPM + 1e-9)
    w = Window.partitionBy("__block").orderBy("mz", "origin", "id")
    before = [F.lag(c).over(w).alias(f"p_{c}") for c in ("mz", "origin", "id")]
    return rows.select("*", *before, F.coalesce(F.lead("mz").over(w), F.lit(FAR)).alias("n_mz")).where("__own")


def _oriented() -> list[Column]:
    first = F.col("origin") == 1
    id1, id2 = F.when(first, F.col("id")).otherwise(F.col("p_id")), F.when(first, F.col("p_id")).otherwise(F.col("id"))
    m1, m2 = F.when(first, F.col("mz")).otherwise(F.col("p_mz")), F.when(first, F.col("p_mz")).otherwise(F.col("mz"))
    return [id1.alias("id1"), id2.alias("id2"), ((m2 - m1) / F.col("mz")).alias("ratio")]


def unambiguous_match(a: DataFrame, b: DataFrame, ppm: float = 5.0) -> DataFrame:
    """(id1, id2, ratio) for lists (id, mz): a row matches the one before it if they are of different lists, nearer
    than ppm, and the next row is farther than ppm; only the right neighbour is looked at."""
    tol = F.col("mz") * ppm * PPM
    return _adjacent(a, b, ppm).where((F.col("origin") != F.col("p_origin")) & (F.col("mz") - F.col("p_mz") < tol) & (F.col("n_mz") - F.col("mz") > tol)).select(*_oriented())


def match_with_correction(a: DataFrame, b: DataFrame, ppm: float = 5.0, correction_ppm: float = 1.0) -> tuple[DataFrame, float]:
    """unambiguous_match, run again on b's m/z divided by 1 + mean ratio where that ratio is beyond
    correction_ppm in either direction; also returns the ratio (0 where there was no correction)."""
    pairs = unambiguous_match(a, b, ppm)
    ratio = pairs.agg(F.avg("ratio")).first()[0] or 0.0
    if abs(ratio) <= correction_ppm * PPM:
        return pairs, 0.0
    return unambiguous_match(a, b.withColumn("mz", F.col("mz") / (1 + ratio)), ppm), ratio


def best_adjacent_match(a: DataFrame, b: DataFrame, ppm: float = 5.0) -> DataFrame:
    """(id1, id2, ratio): adjacent rows of different lists nearer than ppm; of consecutive pairs that share a
    row only the nearer stays (the earlier on ties). Chains of sharing pairs are short (within ppm of each
    other link by link) and go to one kernel call each."""
    tol = F.col("mz") * ppm * PPM
    rows = blocked(_union(a, b), "mz", F.col("mz") * 4 * ppm * PPM + 1e-9)
    w = Window.partitionBy("__block").orderBy("mz", "origin", "id")
    rows = rows.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("mz", "origin", "id")]).where("__own")
    near = rows.where((F.col("origin") != F.col("p_origin")) & (F.col("mz") - F.col("p_mz") < tol))
    near = settle(near.withColumn("gap", F.col("mz") - F.col("p_mz")).select("mz", "p_mz", "gap", *_oriented()))
    chained = gap_sessions(near, [], "mz", lambda v, p: v - p >= p * 4 * ppm * PPM, ["mz", "id1", "id2"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for row in pdf.sort_values(["mz", "id1", "id2"]).itertuples(index=False):
            if kept and (kept[-1].id1 == row.id1 or kept[-1].id2 == row.id2):
                if row.gap < kept[-1].gap:
                    kept[-1] = row
            else:
                kept.append(row)
        return pd.DataFrame([(r.id1, r.id2, r.ratio) for r in kept], columns=["id1", "id2", "ratio"])

    return chained.groupBy("session").applyInPandas(fold, "id1 long, id2 long, ratio double")


def gap_sessions(df: DataFrame, keys: list[str], on: str, breaks, order: list[str] | None = None) -> DataFrame:
    """Add session: rows of a key in order of `on` are cut where breaks(value, value before) holds; a session's
    value is that of its first row.

    Works block by block: each block finds its last cut, cuts are carried over blocks through one row per
    block (and key), and rows before a block's first cut take the carried one.
    """
    order = order or [on]
    part = df.where(F.col(on).isNotNull())
    part = _block_of(part, _edges(part, on), {"__block": F.col(on)})
    w = Window.partitionBy(*keys, "__block").orderBy(*order)
    ends = part.groupBy(*keys, "__block").agg(F.max(on).alias("__end"))
    line = Window.partitionBy(*keys).orderBy("__block") if keys else Window.orderBy("__block")
    ends = ends.select(*keys, "__block", F.lag("__end").over(line).alias("__before"))
    rows = part.join(ends, [*keys, "__block"])
    last = F.coalesce(F.lag(on).over(w), F.col("__before"))
    rows = rows.withColumn("__cut", F.when(last.isNull() | breaks(F.col(on), last), F.col(on)))
    cuts = rows.groupBy(*keys, "__block").agg(F.max("__cut").alias("__c"))
    carried = cuts.select(*keys, "__block", F.last("__c", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    so_far = F.max("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__so", so_far).join(carried, [*keys, "__block"])
    return out.select(*df.columns, F.coalesce("__so", "__carried").alias("session"))


def close_pairs(df: DataFrame, id_col: str, mz_col: str, ppm: float = 5.0) -> DataFrame:
    """(id, previous id, gap) of neighbours nearer than ppm."""
    rows = blocked(df.select(F.col(id_col).alias("id"), F.col(mz_col).alias("mz")), "mz", F.col("mz") * 2 * ppm * PPM)
    w = Window.partitionBy("__block").orderBy("mz", "id")
    rows = rows.select("id", "mz", "__own", F.lag("id").over(w).alias("id_before"), (F.col("mz") - F.lag("mz").over(w)).alias("gap"))
    return rows.where(F.col("__own") & (F.col("gap") < F.col("mz") * ppm * PPM)).select("id", "id_before", "gap")


def selectivity(df: DataFrame, id_col: str, mz_col: str, std_ppm: float = 5.0) -> DataFrame:
    """(id, mz, selectivity): the product over up to two neighbours on each side of 1 beyond 100 ppm, 0 under 0.1 ppm,
    else 1 - exp(-d / std_ppm), d in ppm of the lower value; a second neighbour's d is the sum of both steps."""
    base = df.select(F.col(id_col).alias("id"), F.col(mz_col).cast("double").alias("mz"))
    rows = blocked(base, "mz", F.col("mz") * 250 * PPM)
    w = Window.partitionBy("__block").orderBy("mz", "id")
    step = (F.col("mz") - F.lag("mz").over(w)) / F.lag("mz").over(w) * 1e6
    rows = rows.withColumn("d1", step)
    rows = rows.select("*", F.lag("d1").over(w).alias("d2"), F.lead("d1").over(w).alias("u1"), F.lead("d1", 2).over(w).alias("u2"))
    sel = lambda d: F.when(d.isNull() | (d > 100), 1.0).when(d < 0.1, 0.0).otherwise(1 - F.exp(-d / std_ppm))
    c = F.col
    product = sel(c("d1")) * sel(c("d1") + c("d2")) * sel(c("u1")) * sel(c("u1") + c("u2"))
    return rows.where("__own").select("id", "mz", product.alias("selectivity"))


def largest_gap_split(df: DataFrame, keys: list[str], mz_col: str, order: list[str]) -> DataFrame:
    """Add side (0 or 1): each key's rows cut at their single largest gap, the first one on ties."""
    w = Window.partitionBy(*keys).orderBy(mz_col, *order)
    rows = df.withColumn("__gap", F.col(mz_col) - F.lag(mz_col).over(w)).withColumn("__at", F.row_number().over(w))
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col("__gap"), (-F.col("__at")).alias("n"))).alias("x"))
    out = rows.join(best, keys)
    side = F.when(F.col("x.__gap").isNotNull() & (F.col("__at") >= -F.col("x.n")), 1).otherwise(0)
    return out.withColumn("side", side).select(*df.columns, "side")


def centroid_grid(tracks: DataFrame, ppm: float = 5.0) -> DataFrame:
    """(sample_id, track_id, mz, session, part, grid_mz) for tracks of all samples: sessions cut at gaps of ppm or more;
    sessions wider than twice the tolerance are split at density seeds; a group's m/z is its median. Narrow
    sessions stay in built-in operators."""
    cut = gap_sessions(tracks.select("sample_id", "track_id", "mz"), [], "mz", lambda v, p: v - p >= p * ppm * PPM, ["mz", "sample_id", "track_id"])
    w = Window.partitionBy("session")
    low, high = F.min("mz").over(w), F.max("mz").over(w)
    cut = settle(cut.withColumn("wide", high - low >= 2 * ppm * PPM * low).withColumn("grid_mz", F.median("mz").over(w)))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mz", "sample_id", "track_id"])
        pdf["part"] = split_wide(pdf.mz.to_numpy(), pdf.mz.iloc[0] * ppm * PPM).astype(np.int64)
        pdf["grid_mz"] = pdf.groupby("part").mz.transform("median")
        return pdf

    cols = ["sample_id", "track_id", "mz", "session"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*cols).schema) + ", part long, grid_mz double"
    wide = cut.where("wide").select(*cols).groupBy("session").applyInPandas(split, schema)
    return cut.where("not wide").select(*cols, F.lit(0).cast("long").alias("part"), "grid_mz").union(wide)
