"""From data points to mass tracks and composite tracks, in long form.

points(sample_id, scan, mz, intensity) -> track_points(sample_id, track, scan, intensity) and
tracks(sample_id, track, mz); arrays are built only where a kernel asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tolerance import PPM

BIN = 1000  # bins per unit of m/z


def intensity_filter(points: DataFrame, threshold: float) -> DataFrame:
    """Intensities cut to integers, strictly above the threshold."""
    return points.withColumn("intensity", F.col("intensity").cast("bigint")).where(F.col("intensity") > threshold)


def mz_bins(points: DataFrame, min_points: int = 1) -> DataFrame:
    """(sample_id, bin, n) of 0.001 bins with at least min_points points."""
    return points.groupBy("sample_id", F.floor(F.col("mz") * BIN).alias("bin")).agg(F.count("*").alias("n")).where(F.col("n") >= min_points)


def bin_groups(bins: DataFrame, ppm: float = 5.0) -> DataFrame:
    """Add grp: the first bin of a run of bins that are next to each other or nearer than ppm of the bin number.
    A sample has few bins whatever its points, so a window per sample is bounded."""
    w = Window.partitionBy("sample_id").orderBy("bin")
    step = F.col("bin") - F.lag("bin").over(w)
    starts = F.when(step.isNull() | ~((step == 1) | (step < ppm * PPM * F.col("bin"))), F.col("bin"))
    return bins.withColumn("grp", F.last(starts, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def consecutive_scans(points: DataFrame, keys: list[str], min_timepoints: int = 5) -> DataFrame:
    """Keys whose points have min_timepoints scans (repeats included) within min_timepoints + 1, or at least four
    times as many points; larger groups pass unchecked."""
    w = Window.partitionBy(*keys).orderBy("scan")
    span = F.col("scan") - F.lag("scan", min_timepoints - 1).over(w)
    return points.select(*keys, span.alias("span")).groupBy(*keys).agg(F.count("*").alias("n"), F.min("span").alias("least")).where((F.col("least") <= min_timepoints + 1) | (F.col("n") >= 4 * min_timepoints))


def track_groups(points: DataFrame, ppm: float = 5.0, min_points: int = 5, min_height: float = 1000, min_timepoints: int = 5) -> DataFrame:
    """Points with grp, of groups of bins that are high enough and have consecutive scans."""
    groups = bin_groups(mz_bins(points, min_points), ppm)
    held = points.withColumn("bin", F.floor(F.col("mz") * BIN)).join(groups.select("sample_id", "bin", "grp"), ["sample_id", "bin"])
    high = held.groupBy("sample_id", "grp").agg(F.max("intensity").alias("top")).where(F.col("top") >= min_height)
    good = consecutive_scans(held, ["sample_id", "grp"], min_timepoints).join(high, ["sample_id", "grp"]).select("sample_id", "grp")
    return held.join(good, ["sample_id", "grp"])


def consensus(grouped: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, mz): half the median m/z and half that of the first most intense point in the given order."""
    first = F.max_by("mz", F.struct("intensity", *[(-F.col(c)).alias(f"n_{c}") for c in order]))
    return grouped.groupBy(*keys).agg((0.5 * (F.median("mz") + first)).alias("mz"))


def scan_maxima(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scan, intensity): the most intense point of each scan."""
    return grouped.groupBy(*keys, "scan").agg(F.max("intensity").alias("intensity"))


def dense(track_points: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, intensity array): zero-filled over scans 0..length-1, for kernels."""
    m = F.map_from_entries(F.collect_list(F.struct("scan", "intensity")))
    got = track_points.where(F.col("scan").between(0, length - 1)).groupBy(*keys).agg(m.alias("m"))
    return got.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda s: F.coalesce(F.element_at("m", s), F.lit(0).cast("bigint"))).alias("intensity"))


def sparse(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scan, intensity) of the non-zero points of intensity arrays."""
    return tracks.select(*keys, F.posexplode("intensity").alias("scan", "intensity")).where("intensity <> 0")


def composite(track_points: DataFrame, grid_key: str = "grid_id") -> DataFrame:
    """(grid, scan, intensity): sums over samples of tracks on the reference's scans."""
    return track_points.groupBy(grid_key, "scan").agg(F.sum("intensity").alias("intensity"))


def remap(track_points: DataFrame, rt_map: DataFrame, length: int, keys: list[str], strict: bool = False) -> DataFrame:
    """Tracks moved by rt_map(sample_id, scan, ref_scan), which has changed scans only. On a target scan the
    value of the last scan that maps to it stands, and the track's own value where none does; moved values also stay at
    their old scans (signal is repeated) unless strict. Targets out of range are left out."""
    moves = rt_map.where(F.col("ref_scan").between(0, length - 1) & (F.col("scan") != F.col("ref_scan")))
    # of all scans that map to a target the last one counts, whatever the track has there
    last = moves.groupBy("sample_id", "ref_scan").agg(F.max("scan").alias("scan"))
    moved = track_points.join(last, ["sample_id", "scan"]).select(*keys, F.col("ref_scan").alias("scan"), "intensity")
    stay = track_points.join(last.select("sample_id", F.col("ref_scan").alias("scan")), ["sample_id", "scan"], "left_anti")
    if strict:
        stay = stay.join(moves.select("sample_id", "scan").distinct(), ["sample_id", "scan"], "left_anti")
    return moved.unionByName(stay.select(*keys, "scan", "intensity")).where(F.col("scan") < length)


def merge_tracks(track_points: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of tracks that fall on one key, scan by scan."""
    return track_points.groupBy(*keys, "scan").agg(F.sum("intensity").alias("intensity"))


def extracted_ion(points: DataFrame, mz: float, ppm: float) -> DataFrame:
    """(sample_id, scan, intensity): sums within ppm of one m/z, bounds included."""
    return points.where(F.abs(F.col("mz") - mz) <= mz * ppm * PPM).groupBy("sample_id", "scan").agg(F.sum("intensity").alias("intensity"))


def region(points: DataFrame, scans: tuple[int, int], mzs: tuple[float, float]) -> DataFrame:
    """Points strictly inside a rectangle; both bounds reach the scan as pushed filters."""
    return points.where((F.col("scan") > scans[0]) & (F.col("scan") < scans[1]) & (F.col("mz") > mzs[0]) & (F.col("mz") < mzs[1]))


def apexes(track_points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, apex): the first scan of a track's greatest intensity."""
    return track_points.groupBy(*keys).agg(F.max_by("scan", F.struct("intensity", (-F.col("scan")).alias("n"))).alias("apex"))


def time_axis(scans: DataFrame, length: int) -> DataFrame:
    """(scan, rtime) for scans 0..length-1 of one sample: missing ones inside by linear interpolation between known
    neighbours, those outside along the nearest two known points."""
    from ..functions.kernels import interpolate

    def fill(pdf):
        import pandas as pd

        at = range(length)
        return pd.DataFrame({"scan": at, "rtime": interpolate(list(at), pdf.scan, pdf.rtime) if len(pdf) else [0.0] * length})

    return scans.select("scan", F.col("rtime").cast("double").alias("rtime")).groupBy(F.lit(1)).applyInPandas(fill, "scan int, rtime double")


def exact_mean(x: Column, digits: int) -> Column:
    """The mean of a group rounded half up, from an exact decimal sum where values are below 10^16 (12 digits behind the point are
    kept): sums of doubles depend on the order of rows, and means of short decimals often lie just between two rounded values."""
    exact = F.when(F.abs(x) < 1e16, x).try_cast("decimal(28,12)")
    return F.when(F.count(exact) == F.count(x), F.round(F.sum(exact) / F.count(exact), digits).cast("double")).otherwise(F.round(F.avg(x), digits))


def log2_or_null(x: Column) -> Column:
    return F.log2(F.nullif(x, F.lit(0)))
