"""Rigid transforms of frames: matrices on the small pose table, one broadcast, one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FrameConfig
from ..functions.geometry import apply_matrix, identity, intensity, matrix_product, normalise_theta, rigid, rotation, vector


def target_frame(poses: DataFrame, config: FrameConfig = FrameConfig()) -> DataFrame:
    """One row: the frame id of the first pose; all frames are converted to it."""
    named = poses.withColumn("frame_id", F.coalesce("frame_id", F.lit(config.default_frame)))
    return named.agg(F.min_by("frame_id", "frame_idx").alias("target"))


def frame_matrices(poses: DataFrame, transforms: DataFrame, config: FrameConfig = FrameConfig()) -> DataFrame:
    """frame_idx and the matrix ``m`` (16 doubles, row-major) from sensor to target frame: target from
    world, world from vehicle, vehicle from sensor. A frame whose transform is unknown is left out."""
    pose = poses.withColumn("frame_id", F.coalesce("frame_id", F.lit(config.default_frame)))
    target = target_frame(poses, config).select("target").scalar()
    of_sensor = transforms.filter((F.col("target_frame") == config.vehicle_frame) & (F.col("source_frame") == config.sensor_frame)).agg(F.first("m").alias("m"))
    to_target = transforms.filter(F.col("target_frame") == target).select(F.col("source_frame").alias("frame_id"), F.col("m").alias("known"))
    rows = pose.withColumn("sensor", of_sensor.select("m").scalar()).filter("sensor IS NOT NULL").join(to_target, "frame_id", "left")
    rows = rows.withColumn("world", F.when(F.col("frame_id") == target, F.array(*identity())).otherwise(F.col("known").cast("array<double>"))).filter("world IS NOT NULL")
    placed = rigid(rotation(*(F.col(f"q{i}").cast("double") for i in range(4))), [F.col(c).cast("double") for c in ("x", "y", "z")])
    as_doubles = lambda c: F.col(c).cast("array<double>")
    chain = rows.withColumn("placed", F.array(*placed)).withColumn("outer", matrix_product(as_doubles("world"), F.col("placed")))
    return chain.select("frame_idx", matrix_product(F.col("outer"), as_doubles("sensor")).alias("m"))


def transform_points(points: DataFrame, matrices: DataFrame, key: str = "frame_idx") -> DataFrame:
    """Points of the frames that have a matrix, moved by it; other columns stay, the angle too.

    Matrices are joined by the frame, one row each; the planner broadcasts them while they are
    small and shuffles by frame beyond that."""
    m = [F.get(F.col("m"), F.lit(i)) for i in range(16)]
    moved = dict(zip(("x", "y", "z"), apply_matrix(m, vector()), strict=True))
    joined = points.join(matrices.select(key, "m"), key)
    return joined.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in points.columns))


def scaled_cloud(cloud: DataFrame) -> DataFrame:
    """A scanned cloud with its byte intensity scaled to 0..1."""
    return cloud.withColumn("intensity", intensity(F.col("intensity")))


def normalised_predictions(points: DataFrame) -> DataFrame:
    """Predicted points with the angle ``theta`` brought to [0, pi) and named intensity."""
    return points.withColumn("intensity", normalise_theta(F.col("theta").cast("double")).cast("float")).drop("theta")


def global_union(*clouds: DataFrame) -> DataFrame:
    """All points of all clouds, column by name."""
    found = clouds[0]
    for other in clouds[1:]:
        found = found.unionByName(other)
    return found
