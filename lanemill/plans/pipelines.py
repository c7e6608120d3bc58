"""The engine's pipelines, from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BatchConfig, FrameConfig, LaneConfig
from ..operators import batching, crop, ingest, merge, present, reorder, transform, trim
from ..storage import materialise


def lane_map(samples: DataFrame, config: LaneConfig = LaneConfig()) -> dict[str, DataFrame]:
    """The four snapshots of a lane map: raw (or cropped), reordered, trimmed, merged."""
    raw = ingest.to_lanes(ingest.keep_samples(ingest.explode_samples(samples), config))
    if config.crop:
        raw = crop.dense_crop(raw, config)
    raw = materialise(raw, "raw")
    ordered = materialise(reorder.reorder_points(raw, config), "reordered")
    trimmed = materialise(trim.trim_overlaps(ordered, config), "trimmed")
    return {"raw": raw, "reordered": ordered, "trimmed": trimmed, "merged": merge.merge_lanes(trimmed, config)}


def convert_frames(poses: DataFrame, clouds: DataFrame, predictions: DataFrame, transforms: DataFrame, config: FrameConfig = FrameConfig()) -> dict[str, DataFrame]:
    """Scans and predictions of the frames with a pose and a known transform, in the target frame."""
    m = transform.frame_matrices(poses, transforms, config)
    return {
        "clouds": transform.transform_points(transform.scaled_cloud(clouds), m),
        "predictions": transform.transform_points(transform.normalised_predictions(predictions), m),
    }


def batch_frames(predictions: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    return batching.batches(predictions, config)


def viewer(flat: DataFrame, seq: int, toggles: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """One row per lane point with origin taken off, style, colour and marker name."""
    lanes = flat if toggles is None else present.toggled(flat, toggles)
    moved = present.rebase(lanes, present.origin(flat) if first is None else first)
    return present.lane_styles(present.lane_colours(moved)).withColumn("marker", F.concat(F.lit(f"seq_{seq}/"), F.col("lane_id").cast("string")))


def lane_topics(lanes: DataFrame, first: DataFrame) -> DataFrame:
    """Lane snapshots (number, lane_id, explicit, ...) as styled markers of the topics lane_viz/seq_<n>."""
    moved = present.rebase(lanes, first)
    seq = F.concat(F.lit("seq_"), F.col("number").cast("string"))
    styled = present.lane_styles(present.lane_colours(moved))
    return styled.withColumns({"topic": F.concat(F.lit("lane_viz/"), seq), "marker": F.concat(seq, F.lit("/"), F.col("lane_id").cast("string"))})


def cloud_topics(clouds: DataFrame, first: DataFrame) -> DataFrame:
    """Global clouds (number, ...) as the points of the topics lidar_viz/seq_<n>."""
    return present.rebase(clouds, first).withColumn("topic", F.concat(F.lit("lidar_viz/seq_"), F.col("number").cast("string")))


def lane_counters(snapshots: dict[str, DataFrame]) -> DataFrame:
    """Lanes and points of each snapshot (name, lanes, points)."""
    found = [df.agg(F.lit(name).alias("name"), F.countDistinct("lane_id").alias("lanes"), F.count(F.lit(1)).alias("points")) for name, df in snapshots.items()]
    return transform.global_union(*found)


def frame_counters(poses: DataFrame, transforms: DataFrame, config: FrameConfig = FrameConfig()) -> DataFrame:
    """Frames with a pose, and those of them that could be converted (frames, converted)."""
    done = transform.frame_matrices(poses, transforms, config).agg(F.count(F.lit(1)).alias("converted"))
    return poses.agg(F.count(F.lit(1)).alias("frames")).withColumn("converted", done.select("converted").scalar())
