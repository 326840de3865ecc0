"""The operators' inputs made from the benchmark tables, in Spark and in SQL: line items stand for data points,
parts for a compound library, orders for query features, events for ordered tracks, embeddings for spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str):
    return F.date_diff(F.col(c).cast("date"), F.lit("1995-01-01").cast("date"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sample_id"), _day("l_shipdate").alias("scan"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("mz"),
        F.floor(F.col("l_quantity") * 100).cast("bigint").alias("intensity"), "l_orderkey", "l_linenumber",
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_retailprice").alias("lib_mz"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 400).alias("mz"), _day("o_orderdate").alias("rt"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, value, event_id, event_type): pos is the place in the user's order."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").where("value is not null").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "value", "event_id", "event_type", "ts")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("bin", "x")).select("vec_id", "label", "bin", F.abs(F.col("x").cast("double")).alias("intensity"))


POINTS = """points AS (SELECT l_returnflag AS sample_id, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::INT AS scan, l_extendedprice / l_quantity / 100 AS mz,
  floor(l_quantity * 100)::BIGINT AS intensity, l_orderkey, l_linenumber FROM lineitem)"""
LIBRARY = "library AS (SELECT p_partkey AS part_id, p_retailprice AS lib_mz FROM part)"
FEATURES = "features AS (SELECT o_orderkey AS id, o_totalprice / 400 AS mz, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS rt FROM orders)"
EVENTS = "ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value, event_id, event_type, ts FROM events WHERE value IS NOT NULL)"
SPECTRA = "spectra AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS bin, abs(unnest(embedding)::DOUBLE) AS intensity FROM embeddings)"
