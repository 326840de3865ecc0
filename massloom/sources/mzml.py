"""A Python data source for mzML files: one partition per file, streamed element by element.

    spark.dataSource.register(MzmlSource)
    spark.read.format("mzml").option("table", "points").option("min_intensity", 1000).load(directory)

Tables: `points` (MS1 data points, strictly above min_intensity after cutting to integers), `spectra` (all spectra with
their peaks), `scans` (one row per MS1 scan), `ms2` (MS2 spectra as the track builder wants them). A file that can't
be parsed gives one row with `_corrupt` set in mode=PERMISSIVE (default) and fails in mode=FAILFAST.
With pushdown=true (and Spark's Python filter pushdown on) a lower bound on intensity is applied while parsing.
"""

from __future__ import annotations

import base64
import gzip
import os
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from xml.etree import ElementTree

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, InputPartition

SCHEMAS = {
    "points": "sample string, scan int, rtime double, mz double, intensity bigint, _corrupt string",
    "scans": "sample string, scan int, rtime double, _corrupt string",
    "ms2": "sample string, spec_id string, precursor_mz double, rtime double, peaks array<struct<mz:double,intensity:double>>, _corrupt string",
    "spectra": "sample string, spec_id string, spectrum int, ms_level int, polarity string, rtime double, precursor_mz double, acquired bigint, peaks array<struct<mz:double,intensity:double>>, _corrupt string",
}

#: Terms of the public vocabulary; fixed values.
LEVEL, TIME, POSITIVE, NEGATIVE = "MS:1000511", "MS:1000016", "MS:1000130", "MS:1000129"
MZ_ARRAY, INTENSITY_ARRAY, FLOAT32, FLOAT64, ZLIB, SELECTED_ION = "MS:1000514", "MS:1000515", "MS:1000521", "MS:1000523", "MS:1000574", "MS:1000744"
MINUTE = "UO:0000031"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _array(node) -> tuple[str, np.ndarray]:
    terms = {c.get("accession") for c in node.iter() if _name(c.tag) == "cvParam"}
    data = base64.b64decode(next((c.text or "" for c in node.iter() if _name(c.tag) == "binary"), ""))
    values = np.frombuffer(zlib.decompress(data) if ZLIB in terms else data, "<f8" if FLOAT64 in terms else "<f4").astype(float)
    return ("mz" if MZ_ARRAY in terms else "intensity" if INTENSITY_ARRAY in terms else ""), values


def acquired(stamp: str | None) -> int | None:
    """Epoch seconds of a UTC time stamp, None where it has another form."""
    try:
        return int(datetime.strptime(stamp or "", "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
    except ValueError:
        return None


def read_spectra(path: str) -> Iterator[dict]:
    """All spectra of a file in order. Only one spectrum's tree is held at a time."""
    opened = gzip.open(path) if path.endswith(".gz") else open(path, "rb")
    with opened as file:
        stamp, n = None, 0
        for event, node in ElementTree.iterparse(file, ("start", "end")):
            name = _name(node.tag)
            if event == "start":
                if name == "run":
                    stamp = acquired(node.get("startTimeStamp"))
                continue
            if name != "spectrum":
                continue
            out = {"spectrum": n, "ms_level": None, "polarity": None, "rtime": None, "precursor_mz": None, "acquired": stamp, "mz": np.zeros(0), "intensity": np.zeros(0)}
            for c in node.iter():
                kind = _name(c.tag)
                if kind == "cvParam":
                    term, value = c.get("accession"), c.get("value")
                    if term == LEVEL:
                        out["ms_level"] = int(value)
                    elif term == TIME:
                        out["rtime"] = float(value) * (60 if c.get("unitAccession") == MINUTE else 1)
                    elif term in (POSITIVE, NEGATIVE):
                        out["polarity"] = "pos" if term == POSITIVE else "neg"
                    elif term == SELECTED_ION and out["precursor_mz"] is None:
                        out["precursor_mz"] = float(value)
                elif kind == "binaryDataArray":
                    which, values = _array(c)
                    if which:
                        out[which] = values
            n += 1
            node.clear()
            yield out


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.table = options.get("table", "points")
        self.threshold = float(options.get("min_intensity", 1000 if self.table in ("points", "ms2") else 0))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.limit = int(options.get("peak_limit", 0))
        where, pattern = options["path"], options.get("pattern", ".mzml")
        if os.path.isdir(where):
            self.paths = [os.path.join(where, f) for f in sorted(os.listdir(where)) if pattern.lower() in f.lower()]
        else:
            self.paths = [where]

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition: _File):
        sample = os.path.basename(partition.path).split(".")[0]
        width = len(SCHEMAS[self.table].split(", "))
        try:
            yield from getattr(self, f"_{self.table}")(sample, read_spectra(partition.path))
        except (ElementTree.ParseError, ValueError, zlib.error, OSError) as e:
            if self.strict:
                raise
            yield (sample, *[None] * (width - 2), str(e)[:500])

    def _points(self, sample, spectra):
        scan = 0
        for s in spectra:
            if s["ms_level"] == 1:
                whole = s["intensity"].astype(np.int64)
                for k in np.flatnonzero(whole > self.threshold).tolist():
                    yield sample, scan, s["rtime"], float(s["mz"][k]), int(whole[k]), None
                scan += 1

    def _scans(self, sample, spectra):
        for scan, s in enumerate(s for s in spectra if s["ms_level"] == 1):
            yield sample, scan, s["rtime"], None

    def _ms2(self, sample, spectra):
        n = 0
        for s in spectra:
            if s["ms_level"] == 2 and s["precursor_mz"] is not None:
                keep = (s["intensity"] >= self.threshold) & (s["mz"] < s["precursor_mz"] - 1)
                if keep.any():
                    yield sample, f"{sample}_{n}", s["precursor_mz"], s["rtime"], [(float(m), float(int(i))) for m, i in zip(s["mz"][keep], s["intensity"][keep], strict=True)], None
                    n += 1

    def _spectra(self, sample, spectra):
        for s in spectra:
            keep = np.flatnonzero(s["intensity"] >= self.threshold)
            if self.limit and (s["ms_level"] or 0) > 1:
                keep = np.sort(keep[np.argsort(-s["intensity"][keep], kind="stable")[: self.limit]])
            peaks = [(float(s["mz"][k]), float(s["intensity"][k])) for k in keep]
            yield sample, f"sp{s['spectrum']}", s["spectrum"], s["ms_level"], s["polarity"], s["rtime"], s["precursor_mz"], s["acquired"], peaks, None


class _PushingReader(_Reader):
    """For sessions with spark.sql.python.filterPushdown.enabled; Spark refuses this reader in others."""

    def pushFilters(self, filters):
        """A lower bound on a point's intensity raises the threshold; other filters are left to Spark."""
        for f in filters:
            if self.table == "points" and isinstance(f, GreaterThan) and f.attribute == ("intensity",):
                self.threshold = max(self.threshold, float(f.value))
            else:
                yield f


class MzmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "points")]

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown", "false") == "true" else _Reader)(dict(self.options))
