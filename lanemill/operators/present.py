"""What a viewer draws: styled markers, segments, origin, toggles and playback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import style


def lane_colours(lanes: DataFrame, id_column: str = "lane_id") -> DataFrame:
    """``lanes`` with hash, hue and r, g, b of their id."""
    hashed = lanes.withColumn("hash", style.hash_id(F.col(id_column))).withColumn("hue", style.hue(F.col("hash")))
    red, green, blue = style.hsv_to_rgb(F.col("hue"))
    return hashed.withColumns({"r": red, "g": green, "b": blue})


def lane_styles(lanes: DataFrame) -> DataFrame:
    """``lanes`` with scale, alpha and line width by their explicit flag."""
    explicit = F.col("explicit")
    return lanes.withColumns({"scale": style.marker_scale(explicit), "alpha": style.marker_alpha(explicit), "line_width": style.line_width(explicit)})


def origin(flat: DataFrame) -> DataFrame:
    """One row: the first point in lane and position order."""
    return flat.agg(F.min_by(F.struct("x", "y", "z"), F.struct("lane_id", "pos")).alias("o")).select("o.*")


def rebase(points: DataFrame, first: DataFrame) -> DataFrame:
    """``points`` relative to the one-row ``first``; unchanged where there is none."""
    moved = {c: F.col(c) - F.coalesce(first.select(c).scalar(), F.lit(0.0)) for c in ("x", "y", "z")}
    return points.withColumns(moved)


def toggled(lanes: DataFrame, toggles: DataFrame) -> DataFrame:
    """``lanes`` whose explicit flag is turned where they have an odd number of toggles."""
    odd = toggles.groupBy("lane_id").agg((F.count(F.lit(1)) % 2 == 1).alias("odd"))
    turned = F.col("explicit") != F.coalesce("odd", F.lit(False))
    return lanes.join(odd, "lane_id", "left").withColumn("explicit", turned).drop("odd")


def playback(ticks: DataFrame, n_batches: int) -> DataFrame:
    """``ticks`` (tick) with the batch that is shown at each, round and round."""
    return ticks.withColumn("batch_id", F.pmod(F.col("tick"), F.lit(max(n_batches, 1))))
