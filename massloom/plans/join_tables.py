"""Joining feature tables of several studies: a common mass grid, aligned times, Gaussian tracks rebuilt from the
features, peaks found once on their sums, and members mapped back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import adjacency as A
from ..operators.features import joined_features
from ..operators.settle import settle


def simulated(features: DataFrame, low: int, high: int, step: float = 1.0) -> DataFrame:
    """(track, x, total): sums of Gaussians of given area, middle and width s on an even grid."""
    n = round((high - low) / step)
    g = features.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n))))
    at = F.col("x") * step + low - F.col("middle")
    y = F.col("area") / F.sqrt(2 * F.pi() * F.col("s") * F.col("s")) * F.exp(-at * at / (2 * F.col("s") * F.col("s")))
    return g.groupBy("track", "x").agg(F.sum(y).alias("total"))


def operational_tracks(features: DataFrame, ppm: float = 5.0) -> DataFrame:
    """Add op_track: tracks of all tables whose m/z chain within ppm are one."""
    return A.gap_sessions(features, [], "mz", lambda v, p: v - p >= p * ppm * 1e-6, ["mz", "table", "feature_id"]).withColumnRenamed("session", "op_track")


def aligned_times(features: DataFrame, anchors: DataFrame, frac: float = 0.2, it: int = 2) -> DataFrame:
    """Add ref_rtime: anchors(table, rtime, ref_rtime) smoothed per table, interpolated and carried on along their ends. Tables without
    anchors (the reference) keep their times. One call per table: features of a table are bounded by its size."""
    cols = features.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema) + ", ref_rtime double"

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[cols].copy()
        if len(right) < 3:
            left["ref_rtime"] = left.rtime.astype(float)
        else:
            x, y = K.lowess(right.ref_rtime, right.rtime, max(frac, 3 / len(right)), it)
            left["ref_rtime"] = K.interpolate(left.rtime, x, y)
        return left

    return features.groupBy("table").cogroup(anchors.groupBy("table")).applyInPandas(run, kinds)


def consolidated(features: DataFrame, step: float = 0.1, sigma_share: float = 0.33) -> DataFrame:
    """(op_track, composite, rtime, left, right, table, feature_id): peaks of each operational track's summed Gaussians, with the features whose
    times lie strictly between a peak's bases. features(op_track, table, feature_id, ref_rtime, left, right, peak_area)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = np.maximum(np.maximum(pdf.right - pdf.ref_rtime, pdf.ref_rtime - pdf.left).to_numpy(float), step)
        s, mid, area = sigma_share * width, pdf.ref_rtime.to_numpy(float), pdf.peak_area.to_numpy(float)
        lo, hi = pdf.left.min(), pdf.right.max()
        pad = max(0.2 * (hi - lo), 10)
        at = np.arange(lo - pad, hi + pad, step)
        y = np.zeros(len(at))
        for m, w, a in zip(mid, s, area, strict=True):
            y += K.gaussian(at, a / np.sqrt(2 * np.pi * w * w), m, w)
        y = y / y.max() * 1e8 if y.max() > 0 else y
        got = K.find_peaks(y, height=0.001 * y.max(), prominence=0.01 * y.max(), distance=max(1, int(1 / step)))
        rows = []
        for n, (p, left, right) in enumerate(zip(got["peaks"], got["left_bases"], got["right_bases"], strict=True)):
            inside = pdf[(pdf.ref_rtime > at[left]) & (pdf.ref_rtime < at[right])]
            rows += [(pdf.op_track.iloc[0], n, at[p], at[left], at[right], r.table, r.feature_id) for r in inside.itertuples()]
        return pd.DataFrame(rows, columns=["op_track", "composite", "rtime", "left", "right", "table", "feature_id"])

    kinds = {f.name: f.dataType.simpleString() for f in features.schema}
    return features.groupBy("op_track").applyInPandas(run, f"op_track double, composite int, rtime double, left double, right double, table {kinds['table']}, feature_id {kinds['feature_id']}")


def join_tables(features: DataFrame, areas: DataFrame, anchors: DataFrame, ppm: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(composite features, areas by composite and sample, features left over) of several tables.

    features(table, feature_id, mz, rtime, left, right, peak_area, snr, goodness_fitting, cSelectivity, detection_counts); areas(table, feature_id,
    sample_id, area); anchors(table, rtime, ref_rtime). Several features of a table in one composite are summed."""
    timed = settle(aligned_times(operational_tracks(features, ppm), anchors))
    mapped = consolidated(timed.select("op_track", "table", "feature_id", "ref_rtime", "left", "right", "peak_area")).withColumn("composite_id", F.format_string("%.6f_%03d", "op_track", "composite"))
    # a feature between the bases of two peaks belongs to the nearer one
    near = mapped.join(timed.select("table", "feature_id", "ref_rtime"), ["table", "feature_id"])
    mapped = settle(near.groupBy("table", "feature_id").agg(F.min_by("composite_id", F.struct(F.abs(F.col("rtime") - F.col("ref_rtime")), "composite_id")).alias("composite_id")))
    out = joined_features(mapped.join(features, ["table", "feature_id"]))
    matrix = mapped.join(areas, ["table", "feature_id"]).groupBy("composite_id", "table", "sample_id").agg(F.sum("area").alias("area"))
    return out, matrix, features.join(mapped, ["table", "feature_id"], "left_anti")


def merge_by_time(features: DataFrame, ppm: float = 4.0, rt: float = 15.0) -> DataFrame:
    """Add merged: features(table, feature_id, mz, rtime) of one mass (within ppm) binned by the running median of their times; the tolerance is
    at most a table's least gap less one, so features of a table stay apart."""
    massed = A.gap_sessions(features, [], "mz", lambda v, p: v - p >= p * ppm * 1e-6, ["mz", "table", "feature_id"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in massed.schema) + ", merged string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rtime", "table", "feature_id"])
        gaps = pdf.sort_values(["table", "rtime"]).groupby("table").rtime.diff().dropna()
        tol = min(rt, max(gaps.min() - 1, 0)) if len(gaps) else rt
        pdf["merged"] = [f"{pdf.session.iloc[0]:.6f}_{b}" for b in K.bin_by_median(pdf.rtime.to_numpy(float), lambda _: tol)]
        return pdf

    return massed.groupBy("session").applyInPandas(run, kinds).drop("session")
