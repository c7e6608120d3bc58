"""Crop to a square around the densest grid cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LaneConfig
from ..functions.geometry import cell_centre, grid_cell


def bounding_box(points: DataFrame) -> DataFrame:
    """One row: min_x, max_x, min_y, max_y."""
    return points.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))


def grid_index(points: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """``points`` with cell number ``idx`` (row-major; a point on the upper border of x may fall to
    the next row's first cell) and ``cols``."""
    box = bounding_box(points)
    low_x, high_x, low_y = (box.select(c).scalar() for c in ("min_x", "max_x", "min_y"))
    cols = F.greatest(F.ceil((high_x - low_x) / config.cell_size).cast("int"), F.lit(1))
    gx, gy = grid_cell(F.col("x"), low_x, config.cell_size), grid_cell(F.col("y"), low_y, config.cell_size)
    return points.withColumn("cols", cols).withColumn("idx", gy * cols + gx)


def density_grid(points: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """Points per grid cell, and the last point (in lane and position order) that each cell got."""
    return grid_index(points, config).groupBy("idx", "cols").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("lane_id", "pos")).alias("last"))


def density_mode(points: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """One row: the fullest cell; of equal ones, the one that was full first. idx, n, cx, cy."""
    best = density_grid(points, config).orderBy(F.desc("n"), "last").limit(1)
    box = bounding_box(points)
    low_x, low_y = box.select("min_x").scalar(), box.select("min_y").scalar()
    gx, gy = F.col("idx") % F.col("cols"), F.expr("idx div cols")
    return best.select("idx", "n", cell_centre(low_x, gx, config.cell_size).alias("cx"), cell_centre(low_y, gy, config.cell_size).alias("cy"))


def dense_crop(points: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """Points within half the crop size of the fullest cell's centre, both borders included; lanes
    that keep more than one point, positions renumbered."""
    mode = density_mode(points, config)
    cx, cy = mode.select("cx").scalar(), mode.select("cy").scalar()
    half = config.crop_size / 2
    inside = points.filter((F.abs(F.col("x") - cx) <= half) & (F.abs(F.col("y") - cy) <= half))
    lane = Window.partitionBy("lane_id")
    kept = inside.withColumn("n", F.count(F.lit(1)).over(lane)).filter("n > 1").drop("n")
    return kept.withColumn("pos", (F.row_number().over(lane.orderBy("pos")) - 1).cast("long"))


def voxel_downsample(points: DataFrame, size: float = 0.3) -> DataFrame:
    """Mean of x, y, z in each voxel; optional, the maps are kept unfiltered."""
    cells = [F.floor(F.col(c) / size).alias(f"v{c}") for c in ("x", "y", "z")]
    return points.groupBy(*cells).agg(*(F.avg(c).alias(c) for c in ("x", "y", "z")), F.count(F.lit(1)).alias("n"))
