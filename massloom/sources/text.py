"""Text formats: MSP and MGF spectral libraries, feature tables, target lists, manifests."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Descriptor columns of a feature table, by position; samples follow.
FEATURE_COLUMNS = ("id_number", "mz", "rtime", "rtime_left_base", "rtime_right_base", "parent_masstrack_id", "peak_area", "cSelectivity", "goodness_fitting", "snr", "detection_counts")
#: Names of MSP fields that stand for others, used where those are absent.
ALIASES = {"ExactMass": ("MW", "EXACTMASS", "MOLECULAR WEIGHT"), "Name": ("NAME",), "Formula": ("FORMULA",), "InChIKey": ("INCHIKEY", "InChI Key"), "RetentionTime": ("RETENTIONTIME", "RETENTION_TIME", "RI"), "PrecursorMZ": ("PRECURSORMZ", "PEPMASS")}


def _blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, text) of blocks; Windows line ends are made plain before the cut."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("t"))
    return whole.select("file", F.posexplode(F.split("t", separator)).alias("pos", "text")).where(F.trim("text") != "")


def _peaks(lines: Column) -> Column:
    numbers = F.transform(lines, lambda x: F.split(F.trim(x), r"[\s]+"))
    pairs = F.filter(numbers, lambda p: (F.size(p) == 2) & p[0].rlike(r"^[0-9.eE+-]+$") & p[1].rlike(r"^[0-9.eE+-]+$"))
    return F.transform(pairs, lambda p: F.struct(p[0].try_cast("double").alias("mz"), p[1].try_cast("double").alias("intensity")))


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, fields map, peaks) of blank-line blocks of `key: value` lines and peak lines `mz intensity`, several per line
    between semicolons. The last of repeated keys counts; a value keeps any later separators."""
    lines = F.split("text", "\n")
    meta = F.filter(lines, lambda x: x.contains(": "))
    entry = F.transform(meta, lambda x: F.struct(F.trim(F.split(x, ": ", 2)[0]).alias("k"), F.trim(F.split(x, ": ", 2)[1]).alias("v")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.greatest(F.size(entry) - i - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    raw = F.flatten(F.transform(F.filter(lines, lambda x: ~x.contains(": ")), lambda x: F.split(x, ";")))
    out = _blocks(spark, path, r"\n[ \t]*\n").select("file", "pos", F.map_from_entries(last).alias("fields"), _peaks(raw).alias("peaks"))
    return out.where(F.size("fields") > 0)


def field(name: str) -> Column:
    """A field under its own or an alias's name."""
    return F.coalesce(*[F.element_at("fields", n) for n in (name, *ALIASES.get(name, ()))])


_PAIR = re.compile(r"([0-9.eE+-]+)[\s:,]+([0-9.eE+-]+)")


def _tolerant(text: str) -> list[tuple[dict, list]]:
    out, fields, peaks, reading = [], {}, [], 0
    for line in re.split(r"\r?\n", text or ""):
        key, sep, value = line.partition(":")
        key = key.strip().lower()
        if sep and key in ("name", "num peaks"):
            if key == "name" and (fields or peaks):
                out.append((fields, peaks))
                fields, peaks, reading = {}, [], 0
            fields[key] = value.strip()
            if key == "num peaks":
                reading = int(m[0]) if (m := re.search(r"\d+", value)) else 0
        elif reading and (found := _PAIR.findall(re.sub(r"\"[^\"]*\"", "", line))):
            for a, b in found[: reading - len(peaks)]:
                peaks.append((float(a), float(b)))
            if len(peaks) >= reading:
                out.append((fields, peaks))
                fields, peaks, reading = {}, [], 0
        elif sep:
            fields[key] = value.strip()
    if fields:
        out.append((fields, peaks))
    return out


def read_msp_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, fields map, peaks): records start at Name and end after as many peaks as Num Peaks says; peaks may use commas, colons
    and quoted notes. Keys are lower case."""

    def run(batches):
        for batch in batches:
            rows = [(f, i, list(fields.items()), peaks) for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (fields, peaks) in enumerate(_tolerant(t))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.map_(pa.string(), pa.string())),
                    pa.array([[{"mz": a, "intensity": b} for a, b in r[3]] for r in rows], pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))),
                ],
                ["file", "pos", "fields", "peaks"],
            )

    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.mapInArrow(run, "file string, pos int, fields map<string,string>, peaks array<struct<mz:double,intensity:double>>")


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, fields map, precursor_mz, precursor_intensity, charge, peaks) of BEGIN IONS ... END IONS blocks."""
    blocks = _blocks(spark, path, "END IONS").where(F.col("text").contains("BEGIN IONS"))
    lines = F.split(F.element_at(F.split("text", "BEGIN IONS"), -1), "\n")
    meta = F.filter(lines, lambda x: x.rlike("^[A-Za-z_]+="))
    fields = F.map_from_entries(F.transform(meta, lambda x: F.struct(F.upper(F.split(x, "=", 2)[0]).alias("k"), F.trim(F.split(x, "=", 2)[1]).alias("v"))))
    out = blocks.select("file", "pos", fields.alias("fields"), _peaks(F.filter(lines, lambda x: ~x.contains("="))).alias("peaks"))
    mass = F.split(F.element_at("fields", "PEPMASS"), r"\s+")
    charge = F.element_at("fields", "CHARGE")
    sign = F.when(charge.contains("-"), -1).otherwise(1)
    return out.select("file", "pos", "fields", F.get(mass, F.lit(0)).try_cast("double").alias("precursor_mz"), F.get(mass, F.lit(1)).try_cast("double").alias("precursor_intensity"), (F.regexp_extract(charge, r"\d+", 0).try_cast("int") * sign).alias("charge"), "peaks")


def read_tsv(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Any table with a header, all strings."""
    return spark.read.csv(path, sep=separator, header=True)


def read_feature_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, areas): descriptors by position with types, and the sample columns in long form."""
    wide = read_tsv(spark, path)
    names, samples = wide.columns[: len(FEATURE_COLUMNS)], wide.columns[len(FEATURE_COLUMNS) :]
    text = ("id_number", "parent_masstrack_id")
    features = wide.where(F.col(f"`{names[0]}`").isNotNull()).select(*[F.col(f"`{n}`").try_cast("string" if k in text else "double").alias(k) for n, k in zip(names, FEATURE_COLUMNS, strict=True)], F.col(f"`{names[2]}`").try_cast("double").alias("apex"))
    if not samples:
        return features, spark.createDataFrame([], "feature_id string, sample_id string, area double")
    long = wide.select(F.col(f"`{names[0]}`").alias("feature_id"), *[F.col(f"`{s}`").try_cast("double").alias(s) for s in samples])
    return features, long.unpivot("feature_id", [F.col(f"`{s}`") for s in samples], "sample_id", "area")


def read_feature_list(spark: SparkSession, path: str, mz_col: int = 0, rt_col: int = 1, separator: str = "\t", skip: int = 1) -> DataFrame:
    """(id, mz, rt) with ids row{n} by line number; columns by number. Files are read whole, so lines keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where((F.col("n") >= skip) & (F.trim("line") != ""))
    part = F.split("line", separator)
    return lines.select(F.format_string("row%d", F.col("n") - skip + 1).alias("id"), F.get(part, F.lit(mz_col)).try_cast("double").alias("mz"), F.get(part, F.lit(rt_col)).try_cast("double").alias("rt"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(mz): the first column of a tab or comma table, without its header (lines without a number)."""
    first = F.split("value", "[\t,]")[0].try_cast("double")
    return spark.read.text(path).select(first.alias("mz")).where("mz is not null")


def read_manifest(spark: SparkSession, path: str, pattern: str = ".mzML") -> DataFrame:
    """(sample_id, path): lines of a file list that hold a pattern, numbered from 0 in the order of their paths."""
    from ..operators.features import numbered

    lines = spark.read.text(path).select(F.trim("value").alias("path")).where(F.col("path").contains(pattern))
    return numbered(lines, "path", "sample_id").select("sample_id", "path")


def list_files(spark: SparkSession, directory: str, pattern: str = "*.mzML*") -> DataFrame:
    """(path, length, modified, md5) of matching files; the checksum reads the contents only where it is selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"))


def readable_size(n: Column) -> Column:
    """Bytes as text with a binary unit."""
    out, units = None, ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    for k in range(len(units)):
        text = F.format_string(f"%.1f{units[k]}", n / float(1024**k))
        fits = F.abs(n) < 1024.0 ** (k + 1)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out.otherwise(F.format_string("%.1fPiB", n / float(1024**5)))


def resolve_tables(spark: SparkSession, path: str, name: str = "Feature_table.tsv", folder: str = "export/", default: str = "full_Feature_table.tsv") -> DataFrame:
    """(path) of the feature table that each line of a list means: the line itself where it names one, a file in it where it
    names an export folder, else a file in its export folder; blank lines are left out."""
    line = F.col("value")
    below = lambda *p: F.concat_ws("/", F.rtrim(F.regexp_replace(line, "/+$", "")), *map(F.lit, p))
    found = F.when(line.contains(name), line).when(line.contains(folder), below(default)).otherwise(below(folder.strip("/"), default))
    return spark.read.text(path).where(F.trim("value") != "").select(found.alias("path"))


def read_library(spark: SparkSession, path: str) -> DataFrame | None:
    """A compound library by its extension: MSP records, a JSON list (peaks as pairs of m/z and intensity), else None."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".msp"):
        return read_msp(spark, path)
    if lower.endswith(".json"):
        return spark.read.json(path, multiLine=True)
    return None


def read_quality_table(spark: SparkSession, path: str, most: int = 21) -> DataFrame:
    """The first columns of a feature table as numbers where they are some: its id and up to `most` others, so that the samples
    of wide tables are not read."""
    wide = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    return wide.select(*[F.col(f"`{c}`") for c in wide.columns[: most + 1]])


def read_project(spark: SparkSession, folder: str, samples: int = 20) -> dict[str, DataFrame]:
    """What a browser of results opens: `project` (parameters), `features` with the areas of up to `samples` samples, and
    `compounds` where the folder has them. Only the columns named are read."""
    out = {"project": spark.read.json(f"{folder}/project.json", multiLine=True)}
    wide = read_tsv(spark, f"{folder}/export/full_Feature_table.tsv")
    out["features"] = wide.select(*[F.col(f"`{c}`") for c in wide.columns[: len(FEATURE_COLUMNS) + samples]])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/Annotated_empricalCompounds.json")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        out["compounds"] = spark.read.json(f"{folder}/Annotated_empricalCompounds.json", multiLine=True)
    return out


def read_merge_table(spark: SparkSession, path: str, number_rows: bool = False) -> DataFrame:
    """(feature_id, mz, rtime, line): key columns of a table to be merged, and the line as it is. With number_rows ids are row{n}."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where((F.col("n") > 0) & (F.trim("line") != ""))
    part = F.split("line", "\t")
    ids = F.format_string("row%d", F.col("n")) if number_rows else F.get(part, F.lit(0))
    return lines.select(ids.alias("feature_id"), F.get(part, F.lit(1)).try_cast("double").alias("mz"), F.get(part, F.lit(2)).try_cast("double").alias("rtime"), "line")
