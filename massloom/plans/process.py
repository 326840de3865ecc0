"""Workflows as chains of DataFrames: points to feature table, and annotation of a feature table.

Points stay in long form; arrays are made only for the peak kernel, once per composite track. Tracks are used
twice (composite and areas), so they are checkpointed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import unique_apex
from ..operators import adjacency as A
from ..operators import features as X
from ..operators import library as L
from ..operators import peaks as P
from ..operators import spectra as S
from ..operators import tolerance as T
from ..operators import tracks as R
from ..operators.fragments import attach_to_tracks, best_entries
from ..operators.settle import settle
from ..params import Parameters
from .align import align_samples


@dataclass
class Processed:
    tracks: DataFrame  # sample_id, grp, mz, grid_id, grid_mz
    rt_map: DataFrame  # sample_id, scan, ref_scan
    composite: DataFrame  # grid_id, scan, intensity
    features: DataFrame
    areas: DataFrame  # feature_id, sample_id, area
    samples: list[str]

    def table(self) -> DataFrame:
        full = self.features.join(X.detection_counts(self.areas), "feature_id", "left").na.fill(0, ["detection_counts"])
        return full.join(X.feature_table(self.areas, self.samples), "feature_id", "left").na.fill(0, self.samples)

    def preferred(self) -> DataFrame:
        return X.preferred(self.table())


def extract_tracks(points: DataFrame, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """(track_points, tracks) of all samples at once."""
    grouped = R.track_groups(R.intensity_filter(points, p.min_intensity_threshold), p.mz_tolerance_ppm, p.min_timepoints, p.min_peak_height, p.min_timepoints)
    keys = ["sample_id", "grp"]
    # wide groups are split at density seeds, narrow ones stay in built-in operators
    span = grouped.groupBy(*keys).agg((F.max("mz") - F.min("mz") >= 2 * p.mz_tolerance_ppm * 1e-6 * F.min("mz")).alias("wide"))
    grouped = grouped.join(span, keys)
    cols = [*keys, "scan", "mz", "intensity"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.select(*cols).schema) + ", part int"
    ppm = p.mz_tolerance_ppm

    def split(pdf):
        from ..functions.kernels import split_wide

        pdf = pdf.sort_values(["mz", "scan", "intensity"])
        pdf["part"] = split_wide(pdf.mz.to_numpy(), pdf.mz.iloc[0] * ppm * 1e-6).astype("int32")
        return pdf

    wide = grouped.where("wide").select(*cols).groupBy(*keys).applyInPandas(split, schema)
    parts = grouped.where("not wide").select(*cols, F.lit(0).alias("part")).union(wide).withColumn("track", F.concat_ws("_", F.col("grp").cast("bigint"), "part"))
    keys = ["sample_id", "track"]
    return R.scan_maxima(parts, keys), R.consensus(parts, keys, ["scan", "mz"])


def process(points: DataFrame, p: Parameters, n_scans: int | None = None, scans: DataFrame | None = None) -> Processed:
    """LC workflow. points(sample_id, scan, mz, intensity); scans(sample_id, scan, rtime) gives times, else the scan number
    is the time. With few samples the grid is built sample by sample from the reference, else by centroids."""
    track_points, tracks = extract_tracks(points, p)
    track_points, tracks = settle(track_points), settle(tracks)
    samples = sorted(r[0] for r in tracks.select("sample_id").distinct().collect())  # file names
    n_scans = n_scans or (points.agg(F.max("scan")).first()[0] or 0) + 1
    pairs = T.mass_difference_pairs(tracks.withColumn("key", F.concat_ws("|", "sample_id", "track")), "key", "mz", [L.ISOTOPES["13C/12C"]], p.mz_tolerance_ppm)
    anchors = pairs.where(F.split("id1", r"\|")[0] == F.split("id2", r"\|")[0]).groupBy(F.split("id1", r"\|")[0].alias("sample_id")).agg(F.count("*").alias("n_anchors"))
    counted = tracks.select("sample_id").distinct().join(anchors, "sample_id", "left").na.fill(0)
    reference = p.reference or (X.reference_sample(counted).first() or [None])[0]
    if len(samples) <= p.project_sample_number_small and reference is not None:
        grid = align_samples(tracks, reference, samples, p.mz_tolerance_ppm, p.correction_tolerance_ppm)
    else:
        g = A.centroid_grid(tracks.withColumnRenamed("track", "track_id"), p.mz_tolerance_ppm)
        grid = g.select("sample_id", F.col("track_id").alias("track"), "mz", F.format_string("%.8f_%d", "session", "part").alias("grid_id"), "grid_mz")
    grid = settle(grid)
    on_grid = track_points.join(grid.select("sample_id", "track", "grid_id"), ["sample_id", "track"]).groupBy("sample_id", "grid_id", "scan").agg(F.max("intensity").alias("intensity"))
    on_grid = settle(on_grid)
    rt_map = settle(retention_maps(on_grid, reference, n_scans, p))
    aligned = R.remap(on_grid, rt_map, n_scans, ["sample_id", "grid_id"])
    composite = settle(R.composite(aligned))
    found = P.detect_features(R.dense(composite, ["grid_id"], n_scans), p.peaks(), "grid_id")
    mz = grid.groupBy("grid_id").agg(F.first("grid_mz").alias("mz"))
    found = X.numbered(found.join(mz, "grid_id").withColumn("__o", F.struct("mz", "apex", "grid_id")), "__o").withColumn("feature_id", F.concat(F.lit("F"), F.col("nth"))).drop("nth", "__o")
    if scans is not None:
        axis = R.time_axis(scans.where(F.col("sample_id") == reference), n_scans)
    else:
        axis = points.sparkSession.range(n_scans).select(F.col("id").cast("int").alias("scan"), F.col("id").cast("double").alias("rtime"))
    for side, name in (("apex", "rtime"), ("left_base", "rtime_left_base"), ("right_base", "rtime_right_base")):
        found = found.join(axis.select(F.col("scan").alias(side), F.col("rtime").alias(name)), side, "left")
    found = settle(found)
    back = rt_map.select("sample_id", F.col("ref_scan"), "scan").groupBy("sample_id", "ref_scan").agg(F.max("scan").alias("scan"))
    bounds = X.mapped_bounds(found.select("feature_id", "grid_id", "left_base", "right_base"), on_grid.select("grid_id", "sample_id"), back)
    inside = on_grid.join(bounds, ["sample_id", "grid_id"]).where(F.col("scan").between(F.col("left_base"), F.col("right_base")))
    areas = inside.groupBy("feature_id", "sample_id").agg(F.sum("intensity").alias("area"))
    return Processed(grid, rt_map, composite, found, areas, samples)


def retention_maps(on_grid: DataFrame, reference, n_scans: int, p: Parameters) -> DataFrame:
    """rt_map of every sample but the reference: unique clear peaks of the same grid row are anchors."""
    height, apex_of = p.cal_min_peak_height, unique_apex(p.cal_min_peak_height)
    high = on_grid.groupBy("sample_id", "grid_id").agg(F.max("intensity").alias("top")).where(F.col("top") > height)
    dense = R.dense(on_grid.join(high.select("sample_id", "grid_id"), ["sample_id", "grid_id"]), ["sample_id", "grid_id"], n_scans)
    peaks = dense.select("sample_id", "grid_id", apex_of("intensity").alias("scan")).where("scan is not null")
    ref = peaks.where(F.col("sample_id") == reference).select("grid_id", F.col("scan").alias("ref_scan"))
    pairs = peaks.where(F.col("sample_id") != reference).join(ref, "grid_id").select("sample_id", "scan", "ref_scan")
    return P.calibrate_samples(pairs, n_scans, n_scans, p.peak_number_rt_calibration, p.max_retention_shift, p.num_lowess_iterations)


def process_ms2(processed: Processed, spectra: DataFrame, p: Parameters, gap: float = 5.0, tolerance: float = 0.01, cut: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """LC-MS/MS on top of process: (tracks with their spectra, representatives of the spectra of each track). Spectra
    spectra(spec_id, precursor_mz, rtime, peaks) join every track within the mass tolerance of their precursor; a track's
    spectra are cut at gaps of time and clustered by likeness."""
    tracks = processed.grid.groupBy("grid_id").agg(F.first("grid_mz").alias("mz"))
    attached = attach_to_tracks(tracks.withColumnRenamed("grid_id", "track_id"), spectra, p.mz_tolerance_ppm)
    held = attached.select(F.col("track_id").alias("grid_id"), F.explode("spec_ids").alias("spec_id")).join(spectra, "spec_id")
    return attached, S.cluster_spectra(held.select("grid_id", "spec_id", "rtime", "peaks"), "grid_id", gap, tolerance, cut)


def process_dims(points: DataFrame, p: Parameters) -> DataFrame:
    """Direct infusion: greatest intensity per grid row and sample, no time axis."""
    track_points, tracks = (settle(x) for x in extract_tracks(points, p))
    g = A.centroid_grid(tracks.withColumnRenamed("track", "track_id"), p.mz_tolerance_ppm)
    grid = g.select("sample_id", F.col("track_id").alias("track"), F.format_string("%.8f_%d", "session", "part").alias("grid_id"))
    return X.track_maxima(track_points.join(grid, ["sample_id", "track"]))


def annotate(features: DataFrame, compounds: DataFrame, p: Parameters) -> DataFrame:
    """(feature_id, compound, match_id): empirical compounds of features(feature_id, mz, rtime), singletons and orphans as their own, matched
    to compounds(id, mass) by the neutral mass of a protonated or deprotonated ion after mass calibration."""
    sign = 1 if p.mode == "pos" else -1
    ions = compounds.select("id", (F.col("mass") + sign * L.PROTON).alias("mz"))
    fixed = X.calibrated(features, ions, p.mz_tolerance_ppm).select("feature_id", "rtime", F.col("mz_calibrated").alias("mz"))
    networks = L.empirical_compounds(fixed, p.mode, p.mz_tolerance_ppm, p.khipu_rtime_tolerance)
    labelled = fixed.join(networks, "feature_id", "left").withColumn("compound", F.coalesce("compound", "feature_id"))
    hits = T.ppm_join(ions.select("id", F.col("mz").alias("ion_mz")), fixed.select("feature_id", "mz"), "ion_mz", "mz", p.mz_tolerance_ppm)
    best = hits.groupBy("feature_id").agg(F.min_by("id", F.struct(F.abs(F.col("ion_mz") - F.col("mz")), "id")).alias("match_id"))
    return labelled.join(best, "feature_id", "left").select("feature_id", "compound", "match_id")


def annotate_gc(library: DataFrame, features: DataFrame, areas: DataFrame, knots: DataFrame, p: Parameters) -> DataFrame:
    """Curated library matches of GC features, by retention index and spectrum."""
    indexed = L.kovats(features, knots)
    scores = L.library_scores(library, indexed, areas, p.ms2_tolerance_in_da, p.ri_tolerance, p.corr_cutoff)
    return L.curated(scores, p.entropy_cutoff, p.cosine_cutoff)


def annotate_ms2(spectra: DataFrame, library: DataFrame, p: Parameters, key: str = "inchikey", ms1_da: float = 0.01, least_entropy: float = 0.2, least_cosine: float = 0.3) -> DataFrame:
    """(key, lib_id, spec_id, entropy, cosine, n_matched): spectra(spec_id, precursor_mz, peaks), cleaned of their precursors, find
    their best entry of library(lib_id, lib_precursor_mz, lib_peaks, key) by entropy; pairs whose cosine suffices too stay, and of
    several pairs of one compound the best."""
    clean = spectra.withColumn("peaks", S.cleaned(F.col("peaks"), F.col("precursor_mz"))).where(F.size("peaks") > 0)
    found = S.precursor_search(clean, library, ms1_da, p.ms2_tolerance_in_da, least_entropy).withColumnRenamed("score", "entropy")
    pairs = found.join(clean.select("spec_id", "peaks"), "spec_id").join(library.select("lib_id", "lib_peaks", key), "lib_id")
    both = S.scored(pairs, "peaks", "lib_peaks", p.ms2_tolerance_in_da, "cosine").withColumnRenamed("score", "cosine").where(F.col("cosine") > least_cosine)
    return best_entries(both, key, "cosine", ["lib_id", "spec_id"]).select(key, "lib_id", "spec_id", "entropy", "cosine", "n_matched")
