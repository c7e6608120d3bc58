"""Jobs from files to files: the three stages in order, and the viewer's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import BatchConfig, FrameConfig, LaneConfig
from ..operators import batching, present
from ..sources import readers, writers
from ..sources.layout import Layout
from . import pipelines

SNAPSHOTS = ("raw", "reordered", "trimmed", "merged")


def lanes_job(spark: SparkSession, samples_path: str, out: str, config: LaneConfig = LaneConfig()) -> dict[str, DataFrame]:
    """Roadgraph samples to the four lane snapshots, as Parquet and as points_seq_0.bin to points_seq_3.bin."""
    found = pipelines.lane_map(readers.read_roadgraph(spark, samples_path), config)
    for k, name in enumerate(SNAPSHOTS):
        writers.write_table(found[name], f"{out}/lanes/{name}")
        found[name] = spark.read.parquet(f"{out}/lanes/{name}")
        writers.write_lane_bin(found[name], f"{out}/points_seq_{k}.bin")
    return found


def frames_job(spark: SparkSession, poses_path: str, pcd_path: str, predictions_path: str, transforms: DataFrame, out: str, config: FrameConfig = FrameConfig()) -> dict[str, DataFrame]:
    """Scans and predictions to the target frame: one folder per frame, and the two global clouds."""
    poses = readers.read_poses(spark, poses_path, config.default_frame)
    found = pipelines.convert_frames(poses, readers.read_pcd(spark, pcd_path), readers.read_predictions(spark, predictions_path), transforms, config)
    for k, name in enumerate(("clouds", "predictions")):
        writers.write_table(found[name], f"{out}/frames/{name}", "frame_idx")
        found[name] = spark.read.parquet(f"{out}/frames/{name}")
        writers.write_cloud_bin(found[name], f"{out}/lidar_seq_{k}.bin")
    writers.write_cloud_files(found["predictions"], f"{out}/pred_frames", "frame_idx", "frame")
    return found


def batches_job(spark: SparkSession, predictions: DataFrame, out: str, config: BatchConfig = BatchConfig()) -> DataFrame:
    """Sliding batches of the converted predictions, one folder and one file batch/batch_<n>.bin per batch;
    both targets are replaced."""
    writers.write_table(batching.batches(predictions, config), f"{out}/batches", "batch_id")
    found = spark.read.parquet(f"{out}/batches")
    writers.write_cloud_files(found, f"{out}/batch", "batch_id", "batch")
    return found


def batch_file(batches: DataFrame, number: int, path: str) -> None:
    """One batch as a binary cloud, its frames one after the other."""
    writers.write_cloud_bin(batches.filter(batches.batch_id == number), path)


def view(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """What a viewer shows of one index: lanes, clouds and batches by their topics, all relative to the
    first lane point. Another index is another call; nothing of the last one is kept."""
    found: dict[str, DataFrame] = {}
    if readers.exists(spark, layout.lanes(0)):
        lanes = readers.read_lane_sequence(spark, layout.out)
        first = present.origin(lanes.filter("number = 0"))
        found["lanes"] = pipelines.lane_topics(lanes, first)
        if readers.exists(spark, layout.cloud(0)):
            found["clouds"] = pipelines.cloud_topics(readers.read_lidar_sequence(spark, layout.out), first)
        if readers.exists(spark, layout.batch(0)):
            found["animation"] = present.rebase(readers.read_batch_sequence(spark, layout.batches), first).withColumnRenamed("number", "batch_id")
    return found


def run_all(spark: SparkSession, layout: Layout, transforms: DataFrame) -> dict[str, DataFrame]:
    """Lanes, frames and batches of one index, from its files to its files, with counters."""
    s = layout.settings
    lanes = lanes_job(spark, layout.roadgraph, layout.out, s.lane)
    frames = frames_job(spark, layout.poses, layout.pcd, layout.predictions, transforms, layout.out, s.frame)
    batches = batches_job(spark, frames["predictions"], layout.out, s.batch)
    poses = readers.read_poses(spark, layout.poses, s.frame.default_frame)
    return {**lanes, **frames, "batches": batches, "lane_counters": pipelines.lane_counters(lanes), "frame_counters": pipelines.frame_counters(poses, transforms, s.frame)}
