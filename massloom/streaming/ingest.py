"""Streaming ingestion of new points: stateless per file, appended to a tracks table; stages across samples stay batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import Parameters
from ..plans.process import extract_tracks

POINTS = "sample_id string, scan int, mz double, intensity bigint"


def points_stream(spark: SparkSession, directory: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", max_files).parquet(directory)


def append_tracks(stream: DataFrame, out: str, state: str, p: Parameters | None = None, once: bool = True) -> StreamingQuery:
    """Extract tracks of each micro-batch and write them under its number, so that a batch that is run again replaces itself.
    A sample's points must come in one file."""
    p = p or Parameters()

    def each(batch: DataFrame, number: int) -> None:
        track_points, _ = extract_tracks(batch, p)
        track_points.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()


def gap_sessions_stream(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(user_id, start, end, n, total) of sessions of events(ts, user_id, value) without longer gaps, with a watermark for late rows."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")
