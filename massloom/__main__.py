"""Command line: python -m massloom process|dims|annotate|tracks|list_workflows ..."""

from __future__ import annotations

import argparse
import sys

from . import params

WORKFLOWS = {"process": "points of a directory to a feature table", "dims": "direct infusion table", "tracks": "mass tracks only", "annotate": "annotate a feature table", "list_workflows": "this list"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="massloom", description="Spark-native mass-spectrometry analytics")
    out.add_argument("run", choices=WORKFLOWS)
    out.add_argument("-i", "--input")
    out.add_argument("-o", "--output")
    out.add_argument("-p", "--parameters")
    out.add_argument("-c", "--compounds")
    out.add_argument("-m", "--mode", choices=("pos", "neg"))
    out.add_argument("--ppm", type=float, dest="mz_tolerance_ppm")
    out.add_argument("--min_peak_height", type=float)
    out.add_argument("--max_retention_shift", type=int)
    out.add_argument("--reference")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.run == "list_workflows":
        print("\n".join(f"{k}: {v}" for k, v in WORKFLOWS.items()))
        return 0
    if not args.input or not args.output:
        parser().error("--input and --output are needed")
    own = {k: v for k in ("mode", "mz_tolerance_ppm", "min_peak_height", "max_retention_shift", "reference") if (v := getattr(args, k)) is not None}
    p = params.load(args.parameters, own).derived()
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import process
    from .sources import sinks, text
    from .sources.mzml import MzmlSource

    spark = SparkSession.builder.appName("massloom").getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{args.output}/_checkpoints")
    if args.run == "annotate":
        features, _ = text.read_feature_table(spark, args.input)
        known = spark.read.parquet(args.compounds)
        sinks.write_tsv(process.annotate(features.withColumnRenamed("id_number", "feature_id"), known, p), args.output)
        return 0
    spark.dataSource.register(MzmlSource)
    points = spark.read.format("mzml").option("min_intensity", p.min_intensity_threshold).load(args.input).where("_corrupt is null").withColumnRenamed("sample", "sample_id").drop("_corrupt")
    if args.run == "tracks":
        process.extract_tracks(points, p)[0].write.mode("overwrite").parquet(args.output)
    elif args.run == "dims":
        sinks.write_tsv(process.process_dims(points, p), args.output)
    else:
        scans = points.select("sample_id", "scan", "rtime").distinct()
        done = process.process(points, p, scans=scans)
        sinks.write_tsv(done.table(), f"{args.output}/full_feature_table")
        sinks.write_tsv(done.preferred(), f"{args.output}/preferred_feature_table")
        spark.createDataFrame([(p.to_json(),)], "value string").select(F.col("value")).write.mode("overwrite").text(f"{args.output}/parameters")
    return 0


if __name__ == "__main__":
    sys.exit(main())
