"""Peak detection on composite tracks, and calibration of retention time: grouped numpy kernels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K


@dataclass(frozen=True)
class PeakParameters:
    min_timepoints: int = 6
    min_intensity_threshold: float = 1000
    min_peak_height: float = 100_000
    min_peak_ratio: float = 0.001
    snr: float = 2
    shape: float = 0.5
    wlen: int = 25
    prominence_share: float = 0.02
    area: str = "sum"

    @property
    def fwhm(self) -> int:
        return round(0.5 * self.min_timepoints)

    @property
    def prominence(self) -> int:
        return int(0.33 * self.min_peak_height)


def audit(track: np.ndarray, p: PeakParameters) -> tuple[np.ndarray, float, float, float, float]:
    """(working track less its baseline, baseline, noise, least peak height, scale)."""
    x = np.asarray(track, float)
    top, low, scale = x.max(), p.min_intensity_threshold, 1.0
    if top > 1e8:
        scale = top / 1e8
        x, top = x / scale, 1e8
    middle = np.median(x)
    if middle > low and (x > low).mean() > 0.5 and middle > 10 * p.min_peak_height:
        x = K.detrend(x)
    bottom = x[x < low + np.quantile(x, 0.25)]
    base = max(low, bottom.mean()) if len(bottom) else low
    noise = max(low, bottom.std()) if len(bottom) else low
    if scale > 1 or top > 1000 * p.min_peak_height:
        x = K.moving_average(x, 3 * p.fwhm)
    elif 100 * noise > top or top < 10 * p.min_peak_height:
        x = K.moving_average(x, p.fwhm + 2)
    return x - base, base, noise, max(p.min_peak_height, top * p.min_peak_ratio) - base, scale


def regions(x: np.ndarray, noise: float, least: int) -> list[tuple[int, int]]:
    """[start, end] of runs above the noise, gaps under 3 scans bridged, short ones dropped."""
    at = np.flatnonzero(x > noise)
    if not len(at):
        return []
    runs = np.split(at, np.flatnonzero(np.diff(at) >= 3) + 1)
    return [(int(r[0]), int(r[-1])) for r in runs if r[-1] - r[0] + 1 >= least]


def _evaluate(x: np.ndarray, offset: int, apex: int, left: int, right: int, height: float, p: PeakParameters) -> dict | None:
    at = np.arange(left, right + 1)
    fit = K.fit_gaussian(at, x[left : right + 1], height, apex, at.std())
    if fit is None:
        return None
    good = K.goodness(x[left : right + 1], K.gaussian(at, *fit))
    if good <= p.shape:
        return None
    half = int(max(abs(fit[2]), p.fwhm) * 6)
    left, right = max(left, apex - half), min(right, apex + half)
    return {"apex": apex + offset, "left_base": left + offset, "right_base": right + offset, "height": height, "goodness_fitting": good}


def _detect(x: np.ndarray, offset: int, least: float, noise: float, p: PeakParameters) -> list[dict]:
    prominence = max(p.prominence, p.prominence_share * x.max(), 0.33 * least, 2 * noise)
    ask = {"height": least, "distance": p.fwhm, "prominence": prominence, "width": p.fwhm}
    got = K.find_peaks(x, **ask, wlen=p.wlen)
    if not len(got["peaks"]) and len(x) > p.wlen:
        got = K.find_peaks(x, **ask)
    out = [_evaluate(x, offset, int(a), int(lo), int(hi), float(h), p) for a, lo, hi, h in zip(got["peaks"], got["left_bases"], got["right_bases"], got["heights"], strict=True) if hi - lo >= p.fwhm + 2]
    return resolve_overlaps([o for o in out if o])


def resolve_overlaps(peaks: list[dict], most: int = 3) -> list[dict]:
    """Chains of peaks that overlap by more than `most` scans: two share their sorted bases, more become the
    widest with the chain's bounds."""
    chains: list[list[dict]] = []
    for q in sorted(peaks, key=lambda q: (q["left_base"], q["apex"])):
        if chains and max(c["right_base"] for c in chains[-1]) - q["left_base"] > most:
            chains[-1].append(q)
        else:
            chains.append([q])
    out = []
    for c in chains:
        if len(c) == 2:
            a, b = sorted(c, key=lambda q: q["apex"])
            w = sorted([a["left_base"], a["right_base"], b["left_base"], b["right_base"]])
            out += [a | {"left_base": w[0], "right_base": max(w[1], a["apex"])}, b | {"left_base": min(w[2], b["apex"]), "right_base": w[3]}]
        elif len(c) > 2:
            widest = max(c, key=lambda q: q["right_base"] - q["left_base"])
            out.append(widest | {"left_base": min(q["left_base"] for q in c), "right_base": max(q["right_base"] for q in c)})
        else:
            out += c
    return out


def selectivity(x: np.ndarray, peaks: list[dict]) -> list[float]:
    """Of all points above half a peak's height, the share inside peaks; 0 where counts make no sense."""
    inside = np.zeros(len(x), bool)
    for q in peaks:
        inside[q["left_base"] : q["right_base"] + 1] = True
    out = []
    for q in peaks:
        n, every = int((x[inside] > q["height"] / 2).sum()), int((x > q["height"] / 2).sum())
        out.append(n / every if every >= n > 0 else 0.0)
    return out


def flank_noise(track: np.ndarray, peaks: list[dict], floor: float, otherwise: float, skip: int = 30, take: int = 100) -> list[float]:
    """Mean of the raw track plus 1 over up to `take` non-peak scans on each side of an apex, `skip` scans away."""
    quiet = np.ones(len(track), bool)
    for q in peaks:
        quiet[q["left_base"] : q["right_base"] + 1] = False
    at = np.flatnonzero(quiet)
    out = []
    for q in peaks:
        i = int(np.searchsorted(at, q["apex"]))
        flank = np.concatenate([at[max(0, i - skip - take) : max(0, i - skip)], at[i + skip : i + skip + take]])
        out.append(max(floor, float((np.asarray(track, float)[flank] + 1).mean())) if len(flank) else otherwise)
    return out


def detect_peaks(track: np.ndarray, p: PeakParameters) -> list[dict]:
    """Elution peaks of one composite track with bases, height, area, shape, selectivity and signal to noise."""
    track = np.asarray(track)
    if not len(track) or track.max() <= p.min_intensity_threshold:
        return []
    x, base, noise, least, scale = audit(track, p)
    found: list[dict] = []
    for lo, hi in regions(x, noise, p.fwhm + 2):
        if hi - lo + 1 < 3 * p.fwhm:
            lo, hi = max(0, lo - 3), min(len(x) - 1, hi + 3)
        found += _detect(x[lo : hi + 1], lo, least, noise, p)
    found = resolve_overlaps(found)
    sel, flank = selectivity(x, found), flank_noise(track, found, p.min_intensity_threshold, noise)
    out = []
    for q, s, f in zip(found, sel, flank, strict=True):
        height = (q["height"] + base) * scale
        snr = int(height / f)
        if snr >= p.snr:
            out.append(q | {"height": int(height), "cSelectivity": s, "snr": snr, "peak_area": int(area(track, q["left_base"], q["right_base"], p.area))})
    return out


def area(track: np.ndarray, left: int, right: int, method: str = "sum") -> float:
    """`sum` and `auc` include both bases; `gauss` fits the scans before the right one, 0 where that fails."""
    if method == "gauss":
        at, y = np.arange(left, right), np.asarray(track[left:right], float)
        if len(y) < 3:
            return 0.0
        fit = K.fit_gaussian(at, y, y.max(), left + int(y.argmax()), at.std())
        return K.gaussian_area(abs(fit[0]), fit[2]) if fit else 0.0
    y = np.asarray(track[left : right + 1], float)
    return float((K.max_of_two(y) if method == "auc" else y).sum())


FEATURE = "apex int, left_base int, right_base int, height bigint, peak_area bigint, goodness_fitting double, cSelectivity double, snr int"
_COLUMNS = [c.split()[0] for c in FEATURE.split(", ")]


def detect_features(composites: DataFrame, parameters: PeakParameters, key: str = "grid_id") -> DataFrame:
    """composites(key, intensity array) -> one row per peak. Low tracks are dropped before any array reaches Python."""
    kind = composites.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, *[q[c] for c in _COLUMNS]) for k, x in zip(pdf[key], pdf["intensity"], strict=True) for q in detect_peaks(np.asarray(x), parameters)]
            yield pd.DataFrame(rows, columns=[key, *_COLUMNS])

    high = composites.where(F.array_max("intensity") > parameters.min_intensity_threshold).select(key, "intensity")
    return high.mapInPandas(run, f"{key} {kind}, {FEATURE}")


def unique_peak(track: np.ndarray, height: float = 1e5, fwhm: int = 3, share: float = 0.2) -> int | None:
    """The apex where a track has exactly one clear peak."""
    track = np.asarray(track, float)
    if not len(track) or track.max() <= height:
        return None
    got = K.find_peaks(track, height=height, width=fwhm, prominence=share * track.max())["peaks"]
    return int(got[0]) if len(got) == 1 else None


def calibration_map(sample_scans, reference_scans, n_sample: int, n_reference: int, iterations: int = 3) -> dict[int, int]:
    """Changed scans {sample scan: reference scan} by local regression through cleaned anchor pairs, held at both ends
    by three copies of anchors a tenth of the sample's scans outside."""
    pairs = sorted(set(zip(map(int, sample_scans), map(int, reference_scans), strict=True)))
    if not pairs:
        return {}
    d = np.array([b - a for a, b in pairs], float)
    pairs = [q for q, ok in zip(pairs, (np.abs(d - d.mean()) < 3 * d.std()) | (d.std() == 0), strict=True) if ok]
    low, high = [-0.1 * n_sample] * 3, [1.1 * n_sample] * 3
    x = np.array([*low, *[a for a, _ in pairs], *high], float)
    y = np.array([*low, *[b for _, b in pairs], *high], float)
    share = min(0.6, max(0.2, 0.6 - 0.004 * (len(pairs) - 50)))
    sx, fitted = K.lowess(y, x, share, iterations)
    to = np.rint(K.interpolate(np.arange(n_sample), sx, fitted)).astype(int)
    return {i: int(t) for i, t in enumerate(to) if t != i and 0 <= t <= n_reference - 1}


def calibrate_samples(anchors: DataFrame, n_sample: int, n_reference: int, least: int = 20, most_shift: int | None = None, iterations: int = 3) -> DataFrame:
    """anchors(sample_id, scan, ref_scan) -> rt_map(sample_id, scan, ref_scan), changed scans only. Samples with `least` or
    fewer anchors, or whose fit fails, are not moved."""
    kind = anchors.schema["sample_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if most_shift is not None:
            pdf = pdf[(pdf.scan - pdf.ref_scan).abs() < most_shift]
        moves = calibration_map(pdf.scan, pdf.ref_scan, n_sample, n_reference, iterations) if len(pdf) > least else {}
        return pd.DataFrame([(pdf.sample_id.iloc[0], a, b) for a, b in moves.items()], columns=["sample_id", "scan", "ref_scan"])

    return anchors.select("sample_id", "scan", "ref_scan").groupBy("sample_id").applyInPandas(run, f"sample_id {kind}, scan int, ref_scan int")
