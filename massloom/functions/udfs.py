"""Kernels as Arrow-batched pandas functions and as table functions, and their registration for SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import similarity as S


def unique_apex(height: float):
    """Array column -> scan of its only clear peak, or null."""
    from ..operators.peaks import unique_peak

    @F.pandas_udf("int")
    def apex(x: pd.Series) -> pd.Series:
        return pd.Series([unique_peak(np.asarray(v), height) for v in x], dtype="Int32")

    return apex


def _spectra(s: pd.Series) -> list[np.ndarray]:
    return [np.array([(p["mz"], p["intensity"]) for p in v], float).reshape(-1, 2) for v in s]


def similarity(method: str, tolerance: float):
    """Two peak arrays -> score."""
    f = {"cosine": S.greedy_cosine, "hungarian": S.hungarian_cosine, "weighted_dot": S.weighted_dot_product, "linear": S.linear_cosine, "entropy": lambda a, b, t: (S.entropy_similarity(a, b, t), 0)}[method]

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y, tolerance)[0] for x, y in zip(_spectra(a), _spectra(b), strict=True)])

    return score


@udtf(returnType="apex int, left_base int, right_base int, height bigint, peak_area bigint, goodness_fitting double, cSelectivity double, snr int")
class DetectPeaks:
    """SELECT * FROM tracks, LATERAL detect_peaks(intensity): peaks of an array of intensities."""

    def eval(self, intensity: list):
        from ..operators.peaks import PeakParameters, detect_peaks

        names = ("apex", "left_base", "right_base", "height", "peak_area", "goodness_fitting", "cSelectivity", "snr")
        for q in detect_peaks(np.asarray(intensity or []), PeakParameters()):
            yield tuple(q[n] for n in names)


def register(spark: SparkSession) -> None:
    """Make spectrum scores (`spectrum_cosine`, ...) and `detect_peaks` known to SQL."""
    for method in ("cosine", "hungarian", "weighted_dot", "linear", "entropy"):
        spark.udf.register(f"spectrum_{method}", similarity(method, 0.01))
    spark.udtf.register("detect_peaks", DetectPeaks)
