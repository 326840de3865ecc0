"""Exports: feature tables, spectra as MSP and MGF, annotations, tables of annotated compounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.features import feature_table


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def export_table(features: DataFrame, areas: DataFrame, samples: list[str], path: str) -> None:
    """The wide feature table: descriptors and a column per sample."""
    write_tsv(features.join(feature_table(areas, samples), "feature_id", "left").na.fill(0, samples), path)


def _peak_lines(peaks: Column, digits: int = 4) -> Column:
    return F.array_join(F.transform(peaks, lambda p: F.format_string(f"%.{digits}f %.2f", p["mz"], p["intensity"])), "\n")


def msp_text(name: Column, fields: dict[str, Column], peaks: Column) -> Column:
    """One MSP record; null fields are left out."""
    lines = [F.concat(F.lit("NAME: "), name), *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()], F.concat(F.lit("Num Peaks: "), F.size(peaks).cast("string")), _peak_lines(peaks)]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def mgf_text(scan: Column, precursor: Column, peaks: Column, fields: dict[str, Column] | None = None) -> Column:
    """One MGF record, charge 1."""
    lines = [F.lit("BEGIN IONS"), F.concat(F.lit("SCANS="), scan.cast("string")), F.concat(F.lit("PEPMASS="), precursor.cast("string")), F.lit("CHARGE=1"), *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in (fields or {}).items()], _peak_lines(peaks), F.lit("END IONS")]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def write_text(df: DataFrame, text: Column, path: str) -> None:
    df.select(text.alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def msp_to_mgf(msp: DataFrame) -> DataFrame:
    """read_msp's rows as MGF records, SCANS being a block's place."""
    from .text import field

    return msp.select(mgf_text(F.col("pos") + 1, field("PrecursorMZ"), F.col("peaks"), {"NAME": field("Name")}).alias("value"))


def clusters_for_export(clusters: DataFrame) -> DataFrame:
    """MS2 cluster records: rounded, with ids track_{mz}_clus{i}. clusters(grid_id, nth, precursor_mz, rtime, peaks, cluster_size)."""
    c = F.col
    return clusters.select(F.format_string("track_%.4f_clus%d", "precursor_mz", "nth").alias("id"), F.bround("precursor_mz", 4).alias("precursor_mz"), F.bround("rtime", 2).alias("rtime"), "cluster_size", c("grid_id").alias("parent_masstrack_id"), "peaks")


def molecular_networking_table(table: DataFrame, samples: list[str]) -> DataFrame:
    """row ID, row m/z, row retention time (minutes) and `<sample> Peak area` columns."""
    from ..operators.features import numbered

    rows = numbered(table, "id_number", "nth")
    return rows.select((F.col("nth") + 1).alias("row ID"), F.col("mz").alias("row m/z"), (F.col("rtime") / 60).alias("row retention time"), *[F.col(f"`{s}`").alias(f"{s} Peak area") for s in samples])


def annotation_rows(compounds: DataFrame) -> DataFrame:
    """One row per member peak of compounds with members ARRAY<STRUCT<feature_id, ion>> and matches ARRAY<STRING>."""
    return compounds.select("interim_id", "neutral_formula", F.explode("members").alias("m"), F.array_join("matches", ";").alias("matches")).select("m.feature_id", "m.ion", "interim_id", "neutral_formula", "matches")


def compound_table(matches: DataFrame) -> DataFrame:
    """GC compounds: retention index cut to a whole number, share of library peaks that were matched."""
    return matches.withColumn("RI", F.col("RI").cast("int")).withColumn("presence_ratio", F.round(F.col("n_matched") / F.col("n_lib"), 3))


def match_matrix(matches: DataFrame, samples: list[str]) -> DataFrame:
    """Compounds by samples with the matched feature, empty where there is none."""
    return matches.groupBy("compound").pivot("sample_id", samples).agg(F.min("feature_id").cast("string")).na.fill("", samples)


def feature_annotations(annotated: DataFrame, features: DataFrame, library: DataFrame) -> DataFrame:
    """GC annotations, a row per feature: scores and indices to three digits and the distance to the library's index.
    annotated(feature_id, compound, quant_ion, cosine, entropy, id), features(feature_id, mz, rtime, RI, peak_area,
    cSelectivity, goodness_fitting, snr, detection_counts), library(id, name, inchikey, RI)."""
    lib = library.select("id", "name", "inchikey", F.col("RI").alias("lib_RI"))
    both = annotated.join(features, "feature_id").join(lib, "id")
    digits = lambda c: F.round(c, 3).alias(c)
    return both.select(
        F.col("feature_id").alias("feature"), "mz", "rtime", F.round("RI", 3).alias("RI"), F.col("compound").alias("empCpd"), "quant_ion", F.round("cosine", 3).alias("score_cosine"),
        F.round("entropy", 3).alias("score_entropy"), "name", "inchikey", digits("lib_RI"), F.round(F.col("RI") - F.col("lib_RI"), 3).alias("delta_RI"),
        "peak_area", "cSelectivity", F.col("goodness_fitting").alias("peak_shape"), "snr", "detection_counts",
    )


def compound_annotations(compounds: DataFrame, features: DataFrame, library: DataFrame) -> DataFrame:
    """GC compounds, a row each: indices cut to whole numbers, the quantifying ion's time in minutes, and which share of the
    library's peaks was matched. compounds(compound, id, RI, quant_ion, cosine, entropy, n_matched, has_basepeak,
    has_molecular_ion), library(id, name, inchikey, compound_formula, exact_mass, RI, n_peaks)."""
    quant = features.select(F.col("feature_id").alias("quant_ion"), F.col("mz").alias("mz_quant_ion"), F.col("rtime").alias("__t"), F.col("RI").alias("__ri"))
    lib = library.select("id", "name", "inchikey", "compound_formula", "exact_mass", F.col("RI").alias("__lib"), "n_peaks")
    both = compounds.join(quant, "quant_ion").join(lib, "id")
    return both.select(
        F.col("compound").alias("empCpd"), "name", "inchikey", F.col("compound_formula").alias("formula"), F.col("exact_mass").alias("lib_exact_mass"), F.round("cosine", 3).alias("score_cosine"),
        F.round("entropy", 3).alias("score_entropy"), F.col("n_matched").alias("num_matched_peaks"), "quant_ion", "mz_quant_ion", F.round(F.col("__t") / 60, 2).alias("rtime_quant_ion"),
        F.col("RI").cast("int").alias("RI_quant_ion"), F.col("__lib").cast("int").alias("lib_RI"), (F.col("RI") - F.col("__lib")).cast("int").alias("delta_RI"),
        "has_basepeak", F.col("has_molecular_ion").alias("has_molecularion"), F.round(F.col("n_matched") / F.col("n_peaks"), 2).alias("presence_ratio"),
    )


def compound_records(compounds: DataFrame, path: str) -> None:
    """Empirical compounds with their nested members as JSON lines; numbers of any width, nulls as absent fields."""
    compounds.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """(value): every row as one JSON text, nested values too."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def export_folder(spark, parent: str, project: str, stamp: str) -> str:
    """A new folder {project}_{stamp} with export/ in it; a name that is taken gets a number."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(parent).getFileSystem(spark._jsc.hadoopConfiguration())
    name, n = f"{parent}/{project}_{stamp}", 1
    while fs.exists(hadoop.Path(name)):
        name, n = f"{parent}/{project}_{stamp}_{n}", n + 1
    fs.mkdirs(hadoop.Path(f"{name}/export"))
    return name


def remove_intermediates(spark, folder: str, names: tuple[str, ...] = ("intermediate",)) -> None:
    """Removes a project's intermediate folders, and nothing else of it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for n in names:
        path = hadoop.Path(f"{folder}/{n}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
