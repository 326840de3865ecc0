"""Fragment spectra (MS2) beside full scans: attached to tracks, rolled up over files, matched back to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spectra import top_peaks
from .tolerance import PPM, band_join, ppm_join


def attach_to_tracks(tracks: DataFrame, spectra: DataFrame, ppm: float = 5.0, reports: dict[str, Column] | None = None) -> DataFrame:
    """tracks(track_id, mz) with spec_ids, all spectra(spec_id, precursor_mz) within ppm of the track's m/z in order of id; a
    spectrum may join several tracks, a track without any has an empty list. Tracks of one m/z share a list, built once; with
    `reports`, expressions over spec_ids, they hold those instead of it."""
    masses = tracks.select(F.col("mz").alias("track_mz")).distinct()
    near = ppm_join(spectra.select("spec_id", "precursor_mz"), masses, "precursor_mz", "track_mz", ppm)
    held = near.groupBy("track_mz").agg(F.sort_array(F.collect_list("spec_id")).alias("spec_ids"))
    listed = F.coalesce("spec_ids", F.array().cast(held.schema["spec_ids"].dataType))
    columns = reports or {"spec_ids": F.col("spec_ids")}
    of = masses.join(held, "track_mz", "left").withColumn("spec_ids", listed).select("track_mz", *[c.alias(name) for name, c in columns.items()])
    return tracks.join(of, F.col("mz").eqNullSafe(F.col("track_mz"))).drop("track_mz")


def by_compound(matches: DataFrame) -> DataFrame:
    """(inchikey, name, n, spectra) from matches(inchikey, name, spec_id, mz, rtime, score, n_matched): the matched spectra of
    each compound, best score first."""
    row = F.struct((-F.col("score")).alias("order"), "spec_id", "mz", "rtime", "score", "n_matched")
    got = matches.groupBy("inchikey").agg(F.min("name").alias("name"), F.count("*").alias("n"), F.sort_array(F.collect_list(row)).alias("s"))
    return got.select("inchikey", "name", "n", F.transform("s", lambda x: x.dropFields("order")).alias("spectra"))


def best_entries(matches: DataFrame, key: str, score: str, order: list[str | Column]) -> DataFrame:
    """Of repeated library entries the row of the best score, the first in `order` on ties."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), *order)
    return matches.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def scan_peak(matches: DataFrame, points: DataFrame, ppm: float = 5.0, rt: float = 1.0) -> DataFrame:
    """(inchikey, sample_id, spec_id, mz, peak_mz, intensity): for each compound and sample the spectrum of the best score,
    and the most intense of points(sample_id, rtime, mz, intensity) within ppm of its m/z and rt of its time (inclusive);
    the last in time on ties; null where there is none. matches(inchikey, sample_id, spec_id, mz, rtime, score)."""
    w = Window.partitionBy("inchikey", "sample_id").orderBy(F.col("score").desc(), "spec_id")
    best = matches.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select("inchikey", F.col("sample_id").alias("sample"), "spec_id", "mz", F.col("rtime").alias("spec_rt"))
    p = points.select("sample_id", F.col("rtime").alias("peak_rt"), F.col("mz").alias("peak_mz"), "intensity")
    near = band_join(p, best, "peak_mz", "mz", F.col("mz") * ppm * PPM, 0.01).where((F.col("sample") == F.col("sample_id")) & (F.abs(F.col("peak_rt") - F.col("spec_rt")) <= rt))
    top = near.groupBy("inchikey", "sample").agg(F.max(F.struct("intensity", "peak_rt", "peak_mz")).alias("x"))
    return best.join(top, ["inchikey", "sample"], "left").select("inchikey", F.col("sample").alias("sample_id"), "spec_id", "mz", F.col("x.peak_mz").alias("peak_mz"), F.col("x.intensity").alias("intensity"))


def rollup(matched: DataFrame, n: int = 20) -> DataFrame:
    """(feature_id, spec_id, n_spectra, peaks) over files: the spectrum of the greatest total (least id on ties) cut to its n
    greatest peaks, and the sum of the files' counts. matched(feature_id, spec_id, n_spectra, peaks), a row per file."""
    total = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"])
    best = F.min_by(F.struct("spec_id", "peaks"), F.struct((-total).alias("t"), "spec_id"))
    got = matched.groupBy("feature_id").agg(best.alias("x"), F.sum("n_spectra").alias("n_spectra"))
    return got.select("feature_id", F.col("x.spec_id").alias("spec_id"), "n_spectra", top_peaks(F.col("x.peaks"), n).alias("peaks"))
