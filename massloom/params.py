"""Parameters of the workflows. Precedence: command line, then file, then these defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Parameters:
    workflow: str = "LC"
    mode: str = "pos"
    mz_tolerance_ppm: float = 5.0
    correction_tolerance_ppm: float = 1.0
    min_timepoints: int = 6
    signal_noise_ratio: float = 2.0
    min_intensity_threshold: float = 1000.0
    min_peak_height: float = 100_000.0
    min_peak_ratio: float = 0.001
    wlen: int = 25
    gaussian_shape: float = 0.5
    peak_area: str = "sum"
    cal_min_peak_height: float = 100_000.0
    peak_number_rt_calibration: int = 20
    num_lowess_iterations: int = 3
    max_retention_shift: int | None = None
    project_sample_number_small: int = 10
    ms2_tolerance_in_da: float = 0.005
    ri_tolerance: float = 30.0
    entropy_cutoff: float = 0.4
    cosine_cutoff: float = 0.4
    corr_cutoff: float = 0.6
    khipu_rtime_tolerance: float = 2.0
    reference: str | None = None

    def derived(self) -> Parameters:
        """What a run from the command line derives from the peak height."""
        return replace(self, cal_min_peak_height=10 * self.min_peak_height)

    def peaks(self):
        from .operators.peaks import PeakParameters

        return PeakParameters(self.min_timepoints, self.min_intensity_threshold, self.min_peak_height, self.min_peak_ratio, self.signal_noise_ratio, self.gaussian_shape, self.wlen, area=self.peak_area)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def _typed(name: str, value: str):
    kind = type(getattr(Parameters(), name))
    if value in ("", "null", "None", "~"):
        return None
    return kind(float(value)) if kind is int else kind(value) if kind in (float, str) else int(value)


def load(path: str | None = None, overrides: dict | None = None) -> Parameters:
    """Parameters from a flat file of `key: value` lines or a JSON object, then overrides; unknown keys are refused."""
    known, got = {f.name for f in fields(Parameters)}, {}
    if path:
        text = Path(path).read_text()
        if text.lstrip().startswith("{"):
            got = json.loads(text)
        else:
            for line in text.splitlines():
                key, sep, value = line.split("#")[0].partition(":")
                if sep and key.strip():
                    got[key.strip()] = _typed(key.strip(), value.strip().strip("'\"")) if key.strip() in known else value.strip()
    got |= overrides or {}
    if unknown := sorted(set(got) - known):
        raise ValueError(f"unknown parameters: {', '.join(unknown)}")
    return Parameters(**got)
