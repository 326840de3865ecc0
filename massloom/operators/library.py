"""Compound libraries: retention indices, library scoring, curation, pseudo-spectra, empirical compounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .features import quantitative_feature
from .settle import settle
from .spectra import above_base, base_peak, has_peak
from .tolerance import band_join, mass_difference_pairs

#: Masses; fixed values.
PROTON, ELECTRON = 1.00727646677, 0.000549
#: Adduct differences by mode and isotope differences; fixed values.
ADDUCTS = {
    "pos": {"Na/H": 21.98194, "ACN": 41.026549, "NaCOOH": 67.987424, "K/H": 37.955882},
    "neg": {"Na/H": 21.98194, "NaCOOH": 67.987424, "C2HF3": 82.0030, "F<->OH": 1.99566, "ACN": 41.026549, "K/H": 37.955882},
}
ISOTOPES = {"13C/12C": 1.003355, "13C/12C*2": 2.00671, "13C/12C*3": 3.010065, "37Cl/35Cl": 1.9970}


def normalised(library: DataFrame, factor: float | None = None) -> DataFrame:
    """Library rows with peaks and a retention index: ids cpd%08d over the kept rows in the order of `pos`, base peak,
    peaks above base / factor, and m/z rounded half to even. library(pos, name, inchikey, ri string, exact_mass, peaks)."""
    from .features import numbered

    ri = F.expr("try_cast(nullif(trim(ri), '') AS double)")
    kept = library.where((F.size("peaks") > 0) & ri.isNotNull())
    kept = numbered(kept.withColumn("RI", ri), "pos").withColumn("id", F.format_string("cpd%08d", F.col("nth"))).drop("nth", "pos")
    kept = kept.withColumn("base_peak", base_peak(F.col("peaks")))
    if factor:
        kept = kept.withColumn("peaks", above_base(F.col("peaks"), F.col("base_peak.intensity"), factor))
    return kept.withColumn("rounded_list", F.transform("peaks", lambda p: F.bround(p["mz"], 0).cast("int")))


def molecular_ion(exact_mass: Column) -> Column:
    return exact_mass - ELECTRON


def flags(matches: DataFrame, tolerance: float) -> DataFrame:
    """Add has_basepeak and has_molecular_ion (null without an exact mass)."""
    return matches.withColumn("has_basepeak", has_peak(F.col("peaks"), F.col("base_peak.mz"), tolerance)).withColumn("has_molecular_ion", has_peak(F.col("peaks"), molecular_ion(F.col("exact_mass")), tolerance))


#: Knots of an index table: alkane ladders have a few dozen.
MAX_KNOTS = 200


def _knots(knots: DataFrame) -> list[tuple[float, float]]:
    """(minutes, index) in order; the table's size is checked, as it becomes part of the expression."""
    rows = knots.select(F.col("rtime_min").cast("double"), F.col("index").cast("double")).where("rtime_min is not null and index is not null").orderBy("rtime_min", "index").limit(MAX_KNOTS + 1).collect()
    if len(rows) > MAX_KNOTS:
        raise ValueError(f"more than {MAX_KNOTS} retention index knots")
    return [tuple(r) for r in rows]


def kovats(features: DataFrame, knots: DataFrame, time: str = "rtime") -> DataFrame:
    """Add RI: linear between knots(index, rtime_min), held at the ends; time is in seconds. Null without knots."""
    held = _knots(knots)
    m, value = F.col(time) / 60, F.lit(held[-1][1] if held else None).cast("double")
    for (t0, i0), (t1, i1) in reversed(list(zip(held[:-1], held[1:], strict=True))):
        value = F.when(m < t1, F.lit(i0) + (m - t0) * (i1 - i0) / (t1 - t0) if t1 > t0 else F.lit(i0)).otherwise(value)
    if held:
        value = F.when(m <= held[0][0], held[0][1]).otherwise(value)
    return features.withColumn("RI", F.when(m.isNotNull(), value))


def kovats_bracket(times: DataFrame, knots: DataFrame, time: str = "rtime", end: float | None = None) -> DataFrame:
    """Add RI = 100 (index + (t - t0) / (t1 - t)) between the knots before and at or after t, as an older formula has it; null
    before the first knot and at a knot. Beyond the last knot, t1 is `end` (the times' greatest by default) and a tenth."""
    held, t = _knots(knots), F.col(time)
    if end is None:
        end = times.agg(F.max(t)).first()[0] or 0.0
    value = F.lit(None).cast("double")
    for k in reversed(range(len(held))):
        t0, i0 = held[k]
        t1 = held[k + 1][0] if k + 1 < len(held) else float(end) * 1.1
        here = 100 * (F.lit(i0) + (t - t0) / F.nullif(F.lit(t1) - t, F.lit(0.0)))
        value = F.when((t > t0) & (t <= t1), here).otherwise(value)
    return times.withColumn("RI", value)


def fit_kovats(table: DataFrame, frac: float = 0.3) -> DataFrame:
    """Smoothed knots from an alkane table(index, rtime_min) of at most MAX_KNOTS rows, by local regression in one task."""
    _knots(table)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = K.lowess(pdf["index"].to_numpy(float), pdf.rtime_min.to_numpy(float), max(frac, 3 / max(3, len(pdf))))
        return pd.DataFrame({"index": y, "rtime_min": x})

    return table.select(F.col("index").cast("double").alias("index"), F.col("rtime_min").cast("double").alias("rtime_min")).groupBy(F.lit(1)).applyInPandas(run, "index double, rtime_min double")


def ri_penalty(d: Column, least: float = 1, most: float = 100) -> Column:
    """1 under `least`, 0 over `most`, between them 2 / (1 + exp(e d / most))."""
    return F.when(d > most, 0.0).when(d < least, 1.0).otherwise(2 / (1 + F.exp(F.lit(math.e) * d / most)))


def compound_features(library: DataFrame, features: DataFrame, tolerance_da: float = 0.005, ri: float = 30) -> DataFrame:
    """(id, feature_id): features near one of a compound's peaks in m/z and near it in retention index."""
    peaks = library.select("id", F.col("RI").alias("lib_ri"), F.explode("peaks").alias("p")).select("id", "lib_ri", F.col("p.mz").alias("lib_mz"))
    near = band_join(features.select("feature_id", "mz", F.col("RI").alias("f_ri")), peaks, "mz", "lib_mz", F.lit(tolerance_da), 0.01)
    return near.where(F.abs(F.col("lib_ri") - F.col("f_ri")) < ri).select("id", "feature_id").distinct()


def library_scores(library: DataFrame, features: DataFrame, areas: DataFrame, tolerance_da: float = 0.005, ri: float = 30, corr: float = 0.6) -> DataFrame:
    """(id, quant_id, sample_id, n_core, entropy, cosine): per compound the correlated core of its matched features, the
    sample where the quantifying feature is greatest, and that sample's core areas scored against the library."""
    from .spectra import scored

    matched = compound_features(library, features, tolerance_da, ri)
    matrix = matched.join(areas, "feature_id").select(F.col("id").alias("compound"), "feature_id", "sample_id", "area")
    core = quantitative_feature(matrix, corr).where("is_core or feature_id = quant_id").select("compound", "feature_id", "quant_id")
    best = matrix.join(core.select("compound", "quant_id").distinct(), "compound").where("feature_id = quant_id").groupBy("compound").agg(F.max_by("sample_id", F.struct("area", "sample_id")).alias("sample_id"))
    spectrum = core.join(best, "compound").join(matrix, ["compound", "feature_id", "sample_id"]).join(features.select("feature_id", "mz"), "feature_id")
    spectrum = spectrum.groupBy("compound", "quant_id", "sample_id").agg(F.count("*").alias("n_core"), F.sort_array(F.collect_list(F.struct("mz", F.col("area").cast("double").alias("intensity")))).alias("peaks"))
    pairs = spectrum.withColumnRenamed("compound", "id").join(library.select("id", F.col("peaks").alias("lib_peaks")), "id")
    one = scored(pairs, "peaks", "lib_peaks", tolerance_da, "entropy").withColumnRenamed("score", "entropy").drop("n_matched")
    return scored(one, "peaks", "lib_peaks", tolerance_da, "cosine").withColumnRenamed("score", "cosine")


def curated(scores: DataFrame, entropy: float = 0.4, cosine: float = 0.4) -> DataFrame:
    """Matches good by either score, numbered empCpd_%04d in the order of their library ids."""
    from .features import numbered

    kept = numbered(scores.where((F.col("entropy") >= entropy) | (F.col("cosine") >= cosine)), "id")
    return kept.withColumn("interim_id", F.format_string("empCpd_%04d", F.col("nth"))).drop("nth")


def pseudo_spectra(features: DataFrame, seeds: DataFrame, ri: float = 50, factor: float = 1000) -> DataFrame:
    """(seed_id, members): features in a seed's RI window and above its area / factor; windows of one member are left out."""
    s = seeds.select(F.col("feature_id").alias("seed_id"), F.col("RI").alias("seed_ri"), F.col("peak_area").alias("seed_area"))
    near = band_join(features.select("feature_id", "RI", "peak_area"), s, "RI", "seed_ri", F.lit(ri), ri)
    kept = near.where(F.col("peak_area") > F.col("seed_area") / factor)
    return kept.groupBy("seed_id").agg(F.sort_array(F.collect_list("feature_id")).alias("members")).where(F.size("members") > 1)


def spaced_tops(features: DataFrame, gap: float = 100, low: float = 1000, high: float = 4500) -> DataFrame:
    """The largest feature of each retention-index stratum (least id on ties)."""
    inside = features.where((F.col("RI") >= low) & (F.col("RI") < high))
    best = F.min_by("feature_id", F.struct((-F.col("peak_area")).alias("a"), "feature_id"))
    return inside.groupBy(F.floor((F.col("RI") - low) / gap).alias("stratum")).agg(best.alias("feature_id"))


#: Features of a stratum that are clustered at once.
MAX_STRATUM = 8000


def correlation_clusters(features: DataFrame, samples: list[str], cut: float = 1.0, stratum: float = 100, least: float = 1, most: float = 100) -> DataFrame:
    """(feature_id, cluster): Ward clustering of 1 - penalty(dRI) * correlation inside strata of retention index, each
    stratum one kernel call. features(feature_id, RI, areas array over samples). A stratum's table of distances is
    bounded: more than MAX_STRATUM features in one are an error (callers take the largest features first)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_STRATUM:
            raise ValueError(f"more than {MAX_STRATUM} features in one stratum")
        pdf = pdf.sort_values("feature_id", ignore_index=True)
        if len(pdf) == 1:
            return pd.DataFrame({"feature_id": pdf.feature_id, "cluster": [f"{int(pdf.stratum[0])}_1"]})
        with np.errstate(all="ignore"):
            corr = np.nan_to_num(np.corrcoef(np.stack([np.asarray(a, float) for a in pdf.areas])))
        d = np.abs(pdf.RI.to_numpy()[:, None] - pdf.RI.to_numpy())
        penalty = np.where(d > most, 0.0, np.where(d < least, 1.0, 2 / (1 + np.exp(math.e * d / most))))
        label = K.linkage_clusters(1 - penalty * corr, cut, "ward")
        return pd.DataFrame({"feature_id": pdf.feature_id, "cluster": [f"{int(pdf.stratum[0])}_{c}" for c in label]})

    kind = features.schema["feature_id"].dataType.simpleString()
    return features.withColumn("stratum", F.floor(F.col("RI") / stratum)).groupBy("stratum").applyInPandas(run, f"feature_id {kind}, cluster string")


def empirical_compounds(features: DataFrame, mode: str = "pos", ppm: float = 5.0, rt: float = 2.0, rounds: int = 30) -> DataFrame:
    """(feature_id, compound): networks of features that differ by isotope or adduct masses and elute together. The
    compound is the least feature_id of the network, found by repeated minima over neighbours (written out
    each round). Features in no network have no row."""
    deltas = [*ISOTOPES.values(), *ADDUCTS[mode].values()]
    pairs = mass_difference_pairs(features, "feature_id", "mz", deltas, ppm)
    t = features.select("feature_id", "rtime")
    pairs = pairs.join(t.select(F.col("feature_id").alias("id1"), F.col("rtime").alias("t1")), "id1").join(t.select(F.col("feature_id").alias("id2"), F.col("rtime").alias("t2")), "id2")
    edges = pairs.where(F.abs(F.col("t1") - F.col("t2")) < rt).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    return min_labels(edges, rounds)


def min_labels(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(feature_id, compound): least member of each connected component, label by label with pointer jumps."""
    both = settle(edges.union(edges.select("b", "a")).distinct())
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l"))
    for _ in range(rounds):
        near = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("n"))
        new = label.join(near, "a").select("a", F.least("l", "n").alias("l"))
        jump = new.select(F.col("a").alias("l"), F.col("l").alias("j"))
        new = settle(new.join(jump, "l", "left").select("a", F.least("l", F.coalesce("j", "l")).alias("l")))
        same = new.join(label, ["a", "l"], "left_anti").isEmpty()
        label = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.select(F.col("a").alias("feature_id"), F.col("l").alias("compound"))


def combined(cosine: DataFrame, entropy: DataFrame, keys: list[str]) -> DataFrame:
    """Results of two scores side by side; a match found by one of them only keeps a null for the other."""
    a, b = cosine.select(*keys, F.col("score").alias("cosine")), entropy.select(*keys, F.col("score").alias("entropy"))
    return a.join(b, keys, "full")
