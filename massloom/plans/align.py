"""Sample-wise mass grid: an ordered fold over a bounded number of samples, each step a pair of joins in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adjacency as A
from ..operators.features import numbered
from ..operators.settle import settle


def landmark_mapping(reference: DataFrame, sample: DataFrame, ppm: float = 5.0, correction_ppm: float = 1.0) -> tuple[DataFrame, float]:
    """(id1, id2) of lists (id, mz, landmark): landmarks match unambiguously first; if more than a fifth of the reference's
    landmarks match and their mean ratio is beyond correction_ppm, the sample's m/z is divided by it; all others then
    match their best neighbour."""
    marks = reference.where("landmark").select("id", "mz")
    n = marks.count()
    first = A.unambiguous_match(marks, sample.where("landmark").select("id", "mz"), ppm)
    stats = first.agg(F.count("*"), F.avg("ratio")).first()
    shift = 0.0
    if stats[0] > 0.2 * n and abs(stats[1] or 0) > correction_ppm * 1e-6:
        shift = stats[1]
        sample = sample.withColumn("mz", F.col("mz") / (1 + shift))
        first = A.unambiguous_match(marks, sample.where("landmark").select("id", "mz"), ppm)
    first = settle(first.select("id1", "id2"))
    rest_ref = reference.join(first.select(F.col("id1").alias("id")), "id", "left_anti").select("id", "mz")
    rest = sample.join(first.select(F.col("id2").alias("id")), "id", "left_anti").select("id", "mz")
    return first.union(A.best_adjacent_match(rest_ref, rest, ppm).select("id1", "id2")), shift


def align_samples(tracks: DataFrame, reference, samples: list, ppm: float = 5.0, correction_ppm: float = 1.0) -> DataFrame:
    """(sample_id, track, mz, grid_id, grid_mz): the grid starts as the reference's tracks; each further sample's matched
    tracks move their grid row's m/z to the mean of both, others become new rows. Landmarks are the tracks that
    stand alone within 100 ppm. The grid is checkpointed after each of the (few) samples."""

    def landmarks(df: DataFrame) -> DataFrame:
        alone = A.selectivity(df, "id", "mz").select("id", (F.col("selectivity") > 0.99).alias("landmark"))
        return settle(df.join(alone, "id"))

    def listed(sample) -> DataFrame:
        return settle(numbered(tracks.where(F.col("sample_id") == sample).withColumn("__o", F.struct("mz", "track")), "__o", "id").select("sample_id", "track", "mz", "id"))

    first = listed(reference)
    grid = first.select("id", "mz")
    members = first.select("sample_id", "track", "mz", F.col("id").alias("grid_id"))
    next_id = first.count()
    for sample in [s for s in samples if s != reference]:
        own = listed(sample)
        pairs, shift = landmark_mapping(landmarks(grid), landmarks(own.select("id", "mz")), ppm, correction_ppm)
        joined = own.join(pairs.select(F.col("id2").alias("id"), F.col("id1").alias("grid_id")), "id", "left").withColumn("moved", F.col("mz") / (1 + shift))
        new = numbered(joined.where("grid_id is null").drop("grid_id"), "id", "nth").withColumn("grid_id", F.col("nth") + next_id).drop("nth")
        joined = settle(joined.where("grid_id is not null").unionByName(new))
        seen = joined.groupBy("grid_id").agg(F.avg("moved").alias("m"))
        both = grid.join(seen.withColumnRenamed("grid_id", "id"), "id", "full")
        grid = settle(both.select("id", F.when(F.col("mz").isNotNull() & F.col("m").isNotNull(), (F.col("mz") + F.col("m")) / 2).otherwise(F.coalesce("mz", "m")).alias("mz")))
        members = members.union(joined.select("sample_id", "track", "mz", "grid_id"))
        next_id = grid.count()
    out = members.join(grid.select(F.col("id").alias("grid_id"), F.col("mz").alias("grid_mz")), "grid_id")
    return out.select("sample_id", "track", "mz", F.col("grid_id").cast("string").alias("grid_id"), "grid_mz")
