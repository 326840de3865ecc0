"""Features that elute together: pairs, clusters along the time axis, their spectra, and annotations carried back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .adjacency import gap_sessions
from .tolerance import band_join


def edges(features: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(a, b, dmz, drt) for pairs a < b of features(feature_id, mz, rtime) nearer in time than tolerance (strict)."""
    side = lambda k: features.select(F.col("feature_id").alias(k), F.col("mz").alias(f"mz_{k}"), F.col("rtime").alias(f"rt_{k}"))
    near = band_join(side("a"), side("b"), "rt_a", "rt_b", F.lit(float(tolerance)), float(tolerance)).where("a < b")
    return near.select("a", "b", F.abs(F.col("mz_a") - F.col("mz_b")).alias("dmz"), F.abs(F.col("rt_a") - F.col("rt_b")).alias("drt"))


def clusters(features: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(feature_id, cluster): connected components of those pairs. Time has one dimension, so they are the runs
    whose neighbours are nearer than tolerance; a run's name is its first time. Features without a partner have no row."""
    runs = gap_sessions(features.select("feature_id", "rtime"), [], "rtime", lambda v, p: v - p >= tolerance, ["rtime", "feature_id"])
    several = runs.groupBy("session").agg(F.count("*").alias("n")).where("n > 1").select("session")
    return runs.join(several, "session").select("feature_id", F.col("session").alias("cluster"))


def fragment_spectra(clustered: DataFrame, features: DataFrame, areas: DataFrame, least: int = 3) -> DataFrame:
    """(cluster, sample_id, total, peaks): of each cluster the sample of the largest summed area (least id on ties) among
    those with at least `least` peaks above 0, its peaks relative to the greatest, in m/z order."""
    held = clustered.join(areas.where("area > 0"), "feature_id")
    total = held.groupBy("cluster", "sample_id").agg(F.sum("area").alias("total"), F.count("*").alias("n"), F.max("area").alias("top")).where(F.col("n") >= least)
    w = Window.partitionBy("cluster").orderBy(F.col("total").desc(), "sample_id")
    best = total.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("cluster", "sample_id", "total", "top")
    rows = held.join(best, ["cluster", "sample_id"]).join(features.select("feature_id", "mz"), "feature_id")
    return rows.groupBy("cluster", "sample_id", "total").agg(F.sort_array(F.collect_list(F.struct("mz", (F.col("area") / F.col("top")).alias("intensity")))).alias("peaks"))


def map_back(clustered: DataFrame, matches: DataFrame, fields: list[str], shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """(feature_id, annotations): every match(cluster, similarity, n_matched, fields...) of a cluster for each of its
    members, as (field, value, similarity, n_matched), best first; absent values read 'Not Found'. With `shown`, annotations is
    that expression over them. Features of the same clusters share their annotations, which are built once."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("Not Found")).alias("value")) for f in fields])
    rows = matches.select("cluster", "similarity", "n_matched", F.explode(each).alias("x"))
    note = F.struct((-F.col("similarity")).alias("order"), F.col("x.field").alias("field"), F.col("x.value").alias("value"), F.col("n_matched"))
    held = clustered.where(F.col("cluster").isNotNull()).groupBy("feature_id").agg(F.sort_array(F.collect_list("cluster")).alias("__in"))
    sets = held.select("__in").distinct().select("__in", F.explode("__in").alias("cluster"))
    listed = sets.join(rows, "cluster").groupBy("__in").agg(F.sort_array(F.collect_list(note)).alias("notes"))
    notes = F.transform("notes", lambda n: F.struct(n["field"].alias("field"), n["value"].alias("value"), (-n["order"]).alias("similarity"), n["n_matched"].alias("n_matched")))
    return held.join(listed.select("__in", (shown(notes) if shown else notes).alias("annotations")), "__in").select("feature_id", "annotations")
