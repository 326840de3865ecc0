"""Feature areas, feature tables, their filters and reports, and picks of references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import correlations
from .settle import settle
from .tolerance import ppm_join


def areas(track_points: DataFrame, features: DataFrame, method: str = "sum") -> DataFrame:
    """(feature_id, sample_id, area). track_points(sample_id, grid_id, scan, intensity); features(feature_id, grid_id,
    left_base, right_base). `sum` adds the points between the bases, both included; `auc` adds max(x[i-1], x[i]),
    a point before the left base counting as 0. Absent tracks have no row (0 in the pivoted table)."""
    inside = track_points.join(features.select("feature_id", "grid_id", "left_base", "right_base"), "grid_id").where(F.col("scan").between(F.col("left_base"), F.col("right_base")))
    if method == "sum":
        return inside.groupBy("feature_id", "sample_id").agg(F.sum("intensity").alias("area"))
    if method != "auc":
        raise ValueError(f"no such area: {method}")
    # a scan's value also stands for the next scan, where that one is inside and lower
    both = inside.select("feature_id", "sample_id", "right_base", F.explode(F.array(F.struct("scan", "intensity"), F.struct((F.col("scan") + 1).alias("scan"), "intensity"))).alias("p"))
    top = both.where(F.col("p.scan") <= F.col("right_base")).groupBy("feature_id", "sample_id", "p.scan").agg(F.max("p.intensity").alias("x"))
    return top.groupBy("feature_id", "sample_id").agg(F.sum("x").alias("area"))


def mapped_bounds(features: DataFrame, tracks: DataFrame, reverse_map: DataFrame) -> DataFrame:
    """Features' bases on the own scans of each sample that has the feature's grid row: tracks(grid_id, sample_id);
    reverse_map(sample_id, ref_scan, scan) has changed scans only, others stay."""
    both = features.join(tracks.select("grid_id", "sample_id").distinct(), "grid_id")
    for side in ("left_base", "right_base"):
        m = reverse_map.select("sample_id", F.col("ref_scan").alias(side), F.col("scan").alias("__scan"))
        both = both.join(m, ["sample_id", side], "left").withColumn(side, F.coalesce("__scan", side)).drop("__scan")
    return both


def feature_table(feature_areas: DataFrame, samples: list[str]) -> DataFrame:
    """Wide table: a column per sample, 0 where a feature has no area. Only for export."""
    return feature_areas.groupBy("feature_id").pivot("sample_id", samples).agg(F.sum("area")).na.fill(0)


def unpivoted(table: DataFrame, id_cols: list[str], samples: list[str]) -> DataFrame:
    return table.unpivot(id_cols, samples, "sample_id", "area")


def track_maxima(track_points: DataFrame) -> DataFrame:
    """(grid_id, sample_id, area): greatest intensity per track, for direct infusion without a time axis."""
    return track_points.groupBy("grid_id", "sample_id").agg(F.max("intensity").alias("area"))


def detection_counts(feature_areas: DataFrame) -> DataFrame:
    """(feature_id, detection_counts): samples with an area above 1 (strict)."""
    return feature_areas.groupBy("feature_id").agg(F.count_if(F.col("area") > 1).alias("detection_counts"))


def rounded(features: DataFrame) -> DataFrame:
    """Export precision, half to even: m/z 4 digits, times 2, shape and selectivity 2."""
    digits = {"mz": 4, "rtime": 2, "rtime_left_base": 2, "rtime_right_base": 2, "cSelectivity": 2, "goodness_fitting": 2}
    return features.select(*[F.bround(c, digits[c]).alias(c) if c in digits else F.col(c) for c in features.columns])


def preferred(features: DataFrame, snr: float = 2, shape: float = 0.7, selectivity: float = 0.7) -> DataFrame:
    """Features that are detected and strictly above the limits, on rounded metrics."""
    return rounded(features).where((F.col("detection_counts") > 0) & (F.col("snr") > snr) & (F.col("goodness_fitting") > shape) & (F.col("cSelectivity") > selectivity))


def reference_sample(samples: DataFrame) -> DataFrame:
    """The sample with most anchor pairs, the greatest id on ties (one row)."""
    return samples.orderBy(F.col("n_anchors").desc(), F.col("sample_id").desc()).limit(1)


def unique_per_track(features: DataFrame, track: str, min_area: float, min_snr: float = 10) -> DataFrame:
    """Calibration features: above both limits, and the only such feature of their track."""
    good = features.where((F.col("peak_area") > min_area) & (F.col("snr") > min_snr))
    return good.withColumn("__n", F.count("*").over(Window.partitionBy(track))).where("__n = 1").drop("__n")


def best_per_compound(members: DataFrame, compound: str) -> DataFrame:
    """Of each compound the feature of the greatest (peak_area, goodness_fitting), the least id on ties."""
    rank = F.struct((-F.col("peak_area")).alias("a"), (-F.col("goodness_fitting")).alias("g"), "feature_id")
    return members.groupBy(compound).agg(F.min(rank).alias("x")).select(compound, "x.feature_id", (-F.col("x.a")).alias("peak_area"))


def orphans(features: DataFrame, members: DataFrame, first: int = 100_000) -> DataFrame:
    """Features of no compound, as compounds of their own, numbered from the number of features plus `first`
    in the order of their ids."""
    rest = features.join(members.select("feature_id").distinct(), "feature_id", "left_anti")
    n = features.count()
    return numbered(rest, "feature_id").withColumn("compound_id", F.col("nth") + n + first).drop("nth")


def numbered(df: DataFrame, order: str, name: str = "nth") -> DataFrame:
    """Dense numbers from 0 in the order of a column: rows are range-partitioned and numbered inside their range, after the
    ranges before (one count per range goes to the driver). Ranges come from a sample, so the rows are kept as they fell:
    computed again, they could fall otherwise than counted."""
    held = settle(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__place", 33)
    sizes = dict(held.groupBy(part.alias("__part")).count().collect())
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total - (p << 33), total + sizes[p]
    shift = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), part) if before else F.lit(0)
    return held.withColumn(name, (F.col("__place") + shift).cast("long")).drop("__place")


def calibrated(features: DataFrame, library: DataFrame, ppm: float = 5.0, limit_ppm: float = 2.0) -> DataFrame:
    """features(feature_id, mz) with m/z divided by 1 + mean ratio of all matches where that ratio is beyond limit_ppm.
    Rows of one m/z match alike, so each pair of distinct values counts as often as its rows pair up. The mean is one
    row, joined back, not collected."""
    held = lambda d, v, n: d.groupBy(F.col("mz").alias(v)).agg(F.count("*").cast("double").alias(n))
    hits = ppm_join(held(features, "fmz", "fn"), held(library, "lmz", "ln"), "fmz", "lmz", ppm)
    pairs = F.col("fn") * F.col("ln")
    ratio = hits.agg(F.coalesce(F.sum((F.col("fmz") - F.col("lmz")) / F.col("lmz") * pairs) / F.sum(pairs), F.lit(0.0)).alias("ratio"))
    shift = F.when(F.abs("ratio") > limit_ppm * 1e-6, 1 + F.col("ratio")).otherwise(F.lit(1.0))
    return features.join(F.broadcast(ratio)).withColumn("mz_calibrated", F.col("mz") / shift)


def clean_pairs(pairs: DataFrame, keys: list[str], x: str, y: str, deviations: float = 3.0) -> DataFrame:
    """Distinct calibration pairs whose difference is strictly within the mean +- 3 population deviations."""
    one = pairs.select(*keys, x, y).distinct()
    d = F.col(y) - F.col(x)
    stats = one.groupBy(*keys).agg(F.avg(d).alias("__m"), F.stddev_pop(d).alias("__s"))
    return one.join(stats, keys).where(F.abs(d - F.col("__m")) < deviations * F.col("__s")).select(*keys, x, y)


def quantitative_feature(matrix: DataFrame, cutoff: float) -> DataFrame:
    """matrix(compound, feature_id, sample_id, area), one row for a feature's sample -> (compound, feature_id, quant_id, corr,
    is_core): the feature of the greatest summed Pearson correlation quantifies a compound; core features correlate above the
    cutoff. A compound's features meet in one kernel, equal ones as one; no pair leaves it."""
    f, c = matrix.schema["feature_id"].dataType.simpleString(), matrix.schema["compound"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(pdf.feature_id.to_numpy(), return_inverse=True)
        _, column = np.unique(pdf.sample_id.to_numpy(), return_inverse=True)
        if len(set(zip(row, column, strict=True))) < len(pdf):
            raise ValueError("a feature has a sample twice")
        x, held = np.full((len(ids), column.max() + 1), np.nan), np.zeros((len(ids), column.max() + 1), bool)
        x[row, column], held[row, column] = pdf.area.to_numpy(float), True
        kinds, first, of, n = np.unique(np.hstack([np.nan_to_num(x), ~np.isnan(x), held]), axis=0, return_index=True, return_inverse=True, return_counts=True)
        own, of = x[first], of.ravel()
        step = max(1, 4_000_000 // len(first))
        total = np.concatenate([np.round(correlations(own[k : k + step], own), 9) @ n for k in range(0, len(first), step)])
        best = np.floor(total[of] * 1e6 + 0.5)
        quant = int(np.flatnonzero(best == best.max())[0])  # ids are in order
        corr = correlations(own, x[quant : quant + 1])[of, 0]
        met = (held & held[quant]).any(1)
        return pd.DataFrame({"compound": pdf["compound"].iloc[0], "feature_id": ids[met], "quant_id": ids[quant], "corr": corr[met], "is_core": corr[met] > cutoff})

    rows = matrix.select("compound", "feature_id", "sample_id", F.col("area").cast("double").alias("area")).where("compound is not null and sample_id is not null")
    return rows.groupBy("compound").applyInPandas(run, f"compound {c}, feature_id {f}, quant_id {f}, corr double, is_core boolean")


def joined_features(members: DataFrame) -> DataFrame:
    """Composite features over tables: greatest metrics, summed counts, members by table."""
    return members.groupBy("composite_id").agg(
        F.max("snr").alias("snr"), F.max("goodness_fitting").alias("goodness_fitting"), F.max("cSelectivity").alias("cSelectivity"),
        F.sum("detection_counts").alias("detection_counts"), F.sort_array(F.collect_list(F.struct("table", "feature_id"))).alias("members"),
    )


def variable_in_groups(feature_areas: DataFrame, group: str) -> DataFrame:
    """Features with a variance above 0 in every group of samples."""
    var = feature_areas.groupBy("feature_id", group).agg(F.var_samp("area").alias("v"))
    return var.groupBy("feature_id").agg(F.min(F.coalesce("v", F.lit(0.0))).alias("least")).where("least > 0").select("feature_id")


def welch(feature_areas: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(feature_id, t, df, p) of Welch's test between two groups, nulls left out."""
    stat = lambda g, f: f(F.when(F.col(group) == g, F.col("area")))
    m = feature_areas.groupBy("feature_id").agg(*[stat(g, f).alias(f"{n}{k}") for k, g in (("1", a), ("2", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(s1 + s2), F.lit(0.0))
    df = (s1 + s2) ** 2 / F.nullif(s1**2 / (F.col("n1") - 1) + s2**2 / (F.col("n2") - 1), F.lit(0.0))

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
        from ..functions.statistics import t_two_sided

        return pd.Series([t_two_sided(x, d) if np.isfinite(x) and np.isfinite(d) else None for x, d in zip(t.astype(float), df.astype(float), strict=True)])

    return m.where("n1 > 1 and n2 > 1").select("feature_id", t.alias("t"), df.alias("df")).withColumn("p", two_sided("t", "df"))


def principal_components(matrix: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(rows with pca vectors, explained shares) of standardised vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    v = matrix.withColumn("__v", array_to_vector(vector))
    scaled = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(v).transform(v)
    model = PCA(k=k, inputCol="__s", outputCol="pca").fit(scaled)
    return model.transform(scaled).drop("__v", "__s"), [float(x) for x in model.explainedVariance]


def concise(matches: DataFrame, prefix: str) -> DataFrame:
    """Of each feature the first match (by position) whose id starts with a prefix."""
    return matches.where(F.col("match_id").startswith(prefix)).groupBy("feature_id").agg(F.min_by("match_id", "pos").alias("match_id"))


def annotations_by_feature(matches: DataFrame) -> DataFrame:
    """All matches of each feature, best score first."""
    return matches.groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct("score", "match_id")), False).alias("matches"))


def log_correlations(table: DataFrame, samples: list[str]) -> DataFrame:
    """One row: R^2 of peak_area's log2 with the max, mean, median and min of the samples' log2 areas."""
    from .tracks import log2_or_null

    long = unpivoted(table, ["feature_id", "peak_area"], samples).withColumn("l", log2_or_null(F.col("area")))
    per = long.groupBy("feature_id", "peak_area").agg(F.max("l").alias("max"), F.avg("l").alias("mean"), F.median("l").alias("median"), F.min("l").alias("min"))
    y = log2_or_null(F.col("peak_area"))
    r2: list[Column] = [F.pow(F.corr(y, F.col(c)), F.lit(2)).alias(f"r2_{c}") for c in ("max", "mean", "median", "min")]
    return per.agg(*r2)
