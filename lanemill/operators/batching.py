"""Count-based sliding batches over frames, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BatchConfig


def live_frames(frames: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    """The frames (distinct ``frame_idx``) that a scan from index 0 reads before it stops at a run of
    too many misses or beyond the frame limit, with their ordinals.

    The windows run over frame numbers, of which the limit leaves a bounded number, not over points."""
    limit = config.start_index + config.frame_limit
    idx = frames.select("frame_idx").filter("frame_idx >= 0").distinct()
    late = idx.filter(F.col("frame_idx") >= limit).agg(F.min("frame_idx").alias("late")).select("late").scalar()
    idx = idx.filter(F.col("frame_idx") <= F.coalesce(late, F.lit(limit)))
    order = Window.orderBy("frame_idx")
    gap = F.col("frame_idx") - F.lag("frame_idx", 1, -1).over(order) - 1
    runs = idx.withColumn("stop", (gap > config.max_misses).cast("int"))
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alive = runs.withColumn("stops", F.sum("stop").over(before)).filter("stops = 0").select("frame_idx")
    return alive.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))


def batch_frames(live: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    """(batch_id, frame_idx): batch b holds the ordinals slide*b to slide*b + size - 1, if all are there."""
    size, slide = config.size, config.slide
    n = live.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    first = F.greatest(F.ceil((F.col("ordinal") - (size - 1)) / slide), F.lit(0)).cast("int")
    last = F.floor(F.col("ordinal") / slide).cast("int")
    rows = live.filter(first <= last).select(F.explode(F.sequence(first, last)).alias("batch_id"), "frame_idx")
    return rows.filter(F.col("batch_id") * slide + size <= n)


def final_batch(live: DataFrame, frames: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    """(batch_id, frame_idx) of the batch that ends with the last frame, by frame number; empty if the
    last regular batch reaches as far, or if the range begins beyond the last frame."""
    size, slide = config.size, config.slide
    ends = live.agg(
        F.max("frame_idx").alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    saved = F.when(F.col("n") >= size, F.floor((F.col("n") - size) / slide) + 1).otherwise(0)
    ends = ends.withColumn("batches", saved.cast("int"))
    closing = live.join(ends, F.col("ordinal") == (F.col("batches") - 1) * slide + size - 1).agg(F.max("frame_idx").alias("closing"))
    begin = F.col("last") - size + 1
    begin = F.when(begin < 0, config.start_index).otherwise(begin)
    saved_begin = F.coalesce(closing.select("closing").scalar() - size + 1, F.lit(-1))
    bounds = ends.withColumn("begin", begin).filter(F.col("begin") > saved_begin)
    first, last, number = (bounds.select(c).scalar() for c in ("begin", "last", "batches"))
    return frames.select("frame_idx").distinct().filter(F.col("frame_idx").between(first, last)).select(number.alias("batch_id"), "frame_idx")


def batches(points: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    """``points`` with the batch_id of every batch that their frame is in."""
    live = live_frames(points, config)
    members = batch_frames(live, config).unionByName(final_batch(live, points, config))
    return points.join(members, "frame_idx").select("batch_id", *points.columns)
