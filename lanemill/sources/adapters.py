"""The driver's tables as lanes, frames and poses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import to_lanes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: a vector's place and direction are its first six elements, the next three give
    validity, type and the explicit flag; its label is the lane."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("k"),
        F.col("label").alias("id"),
        F.when(e(7) > -0.3, 1).otherwise(0).alias("valid"),
        F.floor((e(8) + 0.5) * 16).cast("int").alias("type"),
        (e(9) >= 0).alias("explicit"),
        *(e(i).alias(n) for i, n in enumerate(("x", "y", "z", "dx", "dy", "dz"), 1)),
    )


def embedding_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_lanes(embedding_samples(spark, sf_dir))


def hours(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) - F.lit(1704067200000000)) / 3.6e9


def event_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order of time: x is the value, y the hours since 2024 began."""
    events = table(spark, sf_dir, "events")
    samples = events.select(
        F.struct("ts", "event_id").alias("k"),
        F.col("user_id").cast("int").alias("id"),
        F.lit(1).alias("valid"),
        F.lit(6).alias("type"),
        (F.col("user_id") % 2 == 0).alias("explicit"),
        F.col("value").alias("x"),
        hours(F.col("ts")).alias("y"),
        F.lit(0.0).alias("z"),
        F.lit(1.0).alias("dx"),
        F.lit(0.0).alias("dy"),
        F.lit(0.0).alias("dz"),
    )
    return to_lanes(samples)


def event_frames(spark: SparkSession, sf_dir: str, kind: str, minutes: int = 60) -> DataFrame:
    """Points of one kind of event; the frame is the slot of time since 2024 began."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    slot = F.floor(hours(F.col("ts")) * (60 / minutes)).cast("int")
    return rows.select(slot.alias("frame_idx"), F.col("event_id").alias("seq"), F.col("value").alias("x"), hours(F.col("ts")).alias("y"), F.lit(0.0).alias("z"))


def embedding_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pose per label, from its first vector: place is elements 7 to 9, the quaternion 10 to 13."""
    e = lambda i: F.element_at("first", i).cast("double")
    first = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    names = ("x", "y", "z", "q0", "q1", "q2", "q3")
    return first.select(F.col("label").alias("frame_idx"), F.when(e(14) >= 0, "world").otherwise("map").alias("frame_id"), *(e(i).alias(n) for i, n in enumerate(names, 7)))


def embedding_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known transforms between named frames; each is a turn by a quarter and a shift."""
    turn = [0.0, -1.0, 0.0, 0.5, 1.0, 0.0, 0.0, -0.25, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0]
    back = [0.0, 1.0, 0.0, 0.25, -1.0, 0.0, 0.0, 0.5, 0.0, 0.0, 1.0, -2.0, 0.0, 0.0, 0.0, 1.0]
    rows = [("base_link", "pandar64_0", turn), ("world", "map", back), ("map", "world", turn)]
    return spark.createDataFrame(rows, "target_frame string, source_frame string, m array<float>")
