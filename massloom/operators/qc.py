"""Quality control of runs: chromatograms, counts, spike-ins, file statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tolerance import band_join

#: Default spike-in masses (name, m/z) are a parameter: spikes(name, target_mz).


def total_ion(points: DataFrame) -> DataFrame:
    return points.groupBy("sample_id", "scan").agg(F.sum("intensity").alias("tic"))


def base_peak_chromatogram(points: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """(sample_id, scan, bpc); with scans(sample_id, scan) empty scans are 0."""
    top = points.groupBy("sample_id", "scan").agg(F.max("intensity").alias("bpc"))
    return top if scans is None else scans.select("sample_id", "scan").distinct().join(top, ["sample_id", "scan"], "left").withColumn("bpc", F.coalesce("bpc", F.lit(0).cast("bigint")))


def scan_summary(points: DataFrame) -> DataFrame:
    """(sample_id, scan, n_peaks, median_log10)."""
    return points.where("intensity > 0").groupBy("sample_id", "scan").agg(F.count("*").alias("n_peaks"), F.median(F.log10("intensity")).alias("median_log10"))


def spike_in(points: DataFrame, spikes: DataFrame, half_width: float = 0.003, threshold: float = 10_000) -> DataFrame:
    """(name, sample_id, max_intensity, mean_ppm) of points strictly inside a target's window and above the threshold; targets
    not found in a sample have no row there."""
    near = band_join(points.where(F.col("intensity") > threshold), spikes, "mz", "target_mz", F.lit(half_width), 0.01)
    return near.groupBy("name", "sample_id").agg(F.max("intensity").alias("max_intensity"), F.avg((F.col("mz") - F.col("target_mz")) / F.col("target_mz") * 1e6).alias("mean_ppm"))


def file_statistics(spectra: DataFrame, points: DataFrame) -> DataFrame:
    """(sample_id, n_ms1, n_ms2, polarity, max_rtime, mz_min, mz_median, mz_max)."""
    s = spectra.groupBy("sample_id").agg(F.count_if(F.col("ms_level") == 1).alias("n_ms1"), F.count_if(F.col("ms_level") == 2).alias("n_ms2"), F.sort_array(F.collect_set("polarity")).alias("p"), F.max("rtime").alias("max_rtime"))
    s = s.withColumn("polarity", F.when(F.size("p") > 1, "mixed").otherwise(F.element_at(F.col("p"), F.when(F.size("p") > 0, 1)))).drop("p")
    m = points.groupBy("sample_id").agg(F.min("mz").alias("mz_min"), F.median("mz").alias("mz_median"), F.max("mz").alias("mz_max"))
    return s.join(m, "sample_id", "left")


def ionization_mode(spectra: DataFrame, limit: int = 50) -> DataFrame:
    """(sample_id, mode): pos, neg or mixed over the first spectra of each file."""
    return spectra.where(F.col("spectrum") < limit).groupBy("sample_id").agg(F.collect_set("polarity").alias("p")).select("sample_id", F.when(F.size("p") > 1, "mixed").otherwise(F.element_at("p", 1)).alias("mode"))


def auto_height(landmarks: DataFrame, floor: float) -> DataFrame:
    """One row: half the median over files of the least landmark height, at least `floor`."""
    per = landmarks.groupBy("sample_id").agg(F.min("height").alias("h"))
    return per.agg(F.greatest(F.floor(0.5 * F.median("h")), F.lit(int(floor))).alias("min_peak_height"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins over [low, high], the top bound in the last bin."""
    b = F.least(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return df.where(F.col(column).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
