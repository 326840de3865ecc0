"""Look-ups and small reports over projects: what a browser of results asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tolerance import nearest, ppm_join


def valid_samples(samples: DataFrame) -> DataFrame:
    """Samples whose extraction passed."""
    return samples.where(F.col("status") == "passed")


def minutes_to_seconds(df: DataFrame, column: str = "rtime") -> DataFrame:
    return df.withColumn(column, F.col(column) * 60)


def seconds_to_minutes(df: DataFrame, column: str = "rtime") -> DataFrame:
    return df.withColumn(column, F.col(column) / 60)


def targets(features: DataFrame, wanted: DataFrame, ppm: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(features within ppm of a target, with query_target; targets that no feature meets). features(mz, ...), wanted(mz)."""
    ask = wanted.select(F.col("mz").alias("query_target"))
    hits = ppm_join(features, ask, "mz", "query_target", ppm)
    lost = ask.join(hits.select("query_target").distinct(), "query_target", "left_anti")
    return hits, lost


def example_feature(features: DataFrame, limit: float = 0.9) -> DataFrame:
    """One good feature to begin with: shape and selectivity above the limit, the first by id."""
    return features.where((F.col("goodness_fitting") > limit) & (F.col("cSelectivity") > limit)).orderBy("feature_id").limit(1)


def feature_by_number(features: DataFrame, number: int) -> DataFrame:
    """The feature F{number}, with `found`; one row with nulls and found = false if there is none."""
    ask = features.sparkSession.createDataFrame([(f"F{number}",)], "feature_id string")
    return ask.join(features.withColumn("found", F.lit(True)), "feature_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def features_near_mass(features: DataFrame, tracks: DataFrame, masses: DataFrame, width: float = 0.1) -> DataFrame:
    """(ask_mz, track_id, feature_id): features on the track nearest to each of masses(ask_mz); a track without features has
    one row with a null feature. tracks(track_id, mz), features(feature_id, track_id)."""
    at = nearest(masses.select("ask_mz"), tracks.select("track_id", F.col("mz").alias("track_mz")), "ask_mz", "track_mz", "track_id", width)
    return at.select("ask_mz", "track_id").join(features.select("track_id", "feature_id"), "track_id", "left").select("ask_mz", "track_id", "feature_id")


def features_at_time(features: DataFrame, rtime: float, tolerance: float) -> DataFrame:
    """(feature_id, mz, peak_area) within the band of times, bounds included, in m/z order: a pseudo-spectrum."""
    return features.where(F.col("rtime").between(rtime - tolerance, rtime + tolerance)).select("feature_id", "mz", "peak_area").orderBy("mz", "feature_id")


def track_index(features: DataFrame) -> DataFrame:
    """(track_id, feature_ids) in order of id."""
    return features.groupBy("track_id").agg(F.sort_array(F.collect_list("feature_id")).alias("feature_ids"))


def compound_index(compounds: DataFrame) -> DataFrame:
    """(feature_id, interim_id, ion) of compounds with members ARRAY<STRUCT<feature_id, ion>>: the way back from features."""
    return compounds.select("interim_id", F.explode("members").alias("m")).select("m.feature_id", "interim_id", "m.ion")


def time_deviation(axis: DataFrame, samples: DataFrame, reverse_map: DataFrame) -> DataFrame:
    """(sample_id, scan, rtime, deviation): how far each sample's time lies from the reference's at each scan of axis(scan,
    rtime); reverse_map(sample_id, scan, ref_scan) has changed scans only, the others deviate by 0."""
    moved = reverse_map.join(axis, "scan").join(axis.select(F.col("scan").alias("ref_scan"), F.col("rtime").alias("to")), "ref_scan").select("sample_id", "scan", "to")
    every = axis.withColumn("sample_id", F.explode(F.array(*[F.lit(r[0]) for r in samples.select("sample_id").collect()])))  # samples are few
    return every.join(moved, ["sample_id", "scan"], "left").select("sample_id", "scan", "rtime", (F.coalesce("to", "rtime") - F.col("rtime")).alias("deviation"))


def by_area(features: DataFrame) -> DataFrame:
    """Features in falling order of peak area, by id on ties."""
    return features.orderBy(F.col("peak_area").desc(), "feature_id")


def largest_table(features: DataFrame) -> DataFrame:
    """(table, n) of the table with most features (least name on ties): the reference of a join."""
    return features.groupBy("table").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "table").limit(1)


def acquisition_order(samples: DataFrame) -> DataFrame:
    """Samples in the order of their time stamps, those without one behind, by id."""
    return samples.orderBy(F.col("acquired").asc_nulls_last(), "sample_id")


def next_batch(features: DataFrame, done: DataFrame, size: int) -> DataFrame:
    """The `size` largest features that are not among done(feature_id)."""
    return by_area(features.join(done.select("feature_id"), "feature_id", "left_anti")).limit(size)


def sampled_files(files: DataFrame, how_many: float, seed: int = 0) -> DataFrame:
    """A random choice of files: a share below 1, else a number; the same for the same seed and paths."""
    n = files.count() * how_many if how_many < 1 else how_many
    return files.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(int(n))


def distinct_members(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(member) of all pairs, each once."""
    return pairs.select(F.col(a).alias("member")).union(pairs.select(F.col(b))).distinct()


def merged_split(areas: DataFrame, members: DataFrame) -> DataFrame:
    """(merged_id, sample_id, area): whole-number sums over the members of split features. members(feature_id, merged_id)."""
    return areas.join(members, "feature_id").groupBy("merged_id", "sample_id").agg(F.sum(F.col("area").cast("bigint")).alias("area"))


def as_markdown(fields: list[str]) -> Column:
    """A feature's fields as a list in Markdown; nulls are left out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {f}: \t"), F.col(f).cast("string")) for f in fields])


def quality_points(features: DataFrame) -> DataFrame:
    """(feature_id, log2_snr, log2_area, goodness_fitting): what a quality plot shows; zeros are null."""
    log = lambda c: F.log2(F.nullif(F.col(c), F.lit(0)))
    return features.select("feature_id", log("snr").alias("log2_snr"), log("peak_area").alias("log2_area"), "goodness_fitting")


def region_shades(points: DataFrame) -> DataFrame:
    """Points with shade: log2(intensity + 1) relative to the sample's greatest."""
    shade = F.log2(F.col("intensity") + 1)
    top = points.groupBy("sample_id").agg(F.max(shade).alias("__top"))
    return points.join(top, "sample_id").withColumn("shade", shade / F.col("__top")).drop("__top")


def track_summary(track_points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, number_scans, max_intensity, median_positive): the median of intensities above 0, cut to a whole number."""
    positive = F.when(F.col("intensity") > 0, F.col("intensity"))
    return track_points.groupBy(*keys).agg(F.count("*").alias("number_scans"), F.max("intensity").alias("max_intensity"), F.floor(F.median(positive)).cast("bigint").alias("median_positive"))


def landmarks(marks: DataFrame, grid: DataFrame, axis: DataFrame) -> DataFrame:
    """(mz, rtime) of the reference sample's landmark peaks(ref_track, apex) on grid(ref_track, mz) and axis(scan, rtime)."""
    return marks.join(grid, "ref_track").join(axis.withColumnRenamed("scan", "apex"), "apex").select("mz", "rtime").orderBy("mz", "rtime")

