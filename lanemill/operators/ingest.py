"""Parallel sample arrays to lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LaneConfig

COLUMNS = ("id", "xyz", "dir", "valid", "type", "explicit")


def explode_samples(df: DataFrame) -> DataFrame:
    """One row per sample: k, id, valid, type, explicit, x..dz. ``df`` has the six arrays, by the
    names of COLUMNS or below ``roadgraph_samples/``; xyz and dir are flat with stride 3."""
    if "id" not in df.columns:
        df = df.select(*(F.col(f"`roadgraph_samples/{c}`").alias(c) for c in COLUMNS))
    rows = df.select(F.posexplode("id").alias("k", "id"), "xyz", "dir", "valid", "type", "explicit")
    at = lambda c, i: F.get(F.col(c), i)  # noqa: E731  null beyond the end
    found = rows.select(
        F.col("k").cast("long").alias("k"),
        "id",
        *(at(c, F.col("k")).alias(c) for c in ("valid", "type", "explicit")),
        *(at("xyz", F.col("k") * 3 + i).alias(n) for i, n in enumerate(("x", "y", "z"))),
        *(at("dir", F.col("k") * 3 + i).alias(n) for i, n in enumerate(("dx", "dy", "dz"))),
    )
    if dict(found.dtypes)["explicit"] == "string":  # as files have it: what is no boolean ends the ingest
        flag = F.lower("explicit").try_cast("boolean")
        found = found.withColumn("bad", ~F.col("explicit").isin("true", "false")).withColumn("explicit", flag)
    return found


def keep_samples(samples: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """Valid samples of lane types. A file is taken up to the first lane whose flag is no boolean: only a
    lane's first sample gives its flag, so others do no harm."""
    kept = samples.filter((F.col("valid") == 1) & F.col("type").isin(*config.lane_types))
    if "bad" not in kept.columns:
        return kept
    first = kept.groupBy("id").agg(F.min_by(F.struct("k", "bad"), "k").alias("s"))
    stop = first.filter("s.bad").agg(F.min("s.k").alias("stop")).select("stop").scalar()
    return kept.filter(stop.isNull() | (F.col("k") < stop)).drop("bad")


def to_lanes(samples: DataFrame) -> DataFrame:
    """Flat lanes: position in order of k; type and explicit are those of the lane's first sample."""
    lane = Window.partitionBy("id").orderBy("k")
    first = lane.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return samples.select(
        F.col("id").alias("lane_id"),
        F.first("type").over(first).alias("type"),
        F.first("explicit").over(first).alias("explicit"),
        (F.row_number().over(lane) - 1).cast("long").alias("pos"),
        "x", "y", "z", "dx", "dy", "dz",
    )


def lane_attributes(samples: DataFrame) -> DataFrame:
    """One row per lane: first-seen type and explicit, number of points; a map-side combined aggregate."""
    return samples.groupBy(F.col("id").alias("lane_id")).agg(
        F.min_by("type", "k").alias("type"), F.min_by("explicit", "k").alias("explicit"), F.count(F.lit(1)).alias("n_points")
    )


def nest(flat: DataFrame) -> DataFrame:
    """Flat lanes to one row per lane with its points in order."""
    point = F.struct("pos", "x", "y", "z", "dx", "dy", "dz")
    rows = flat.groupBy("lane_id").agg(F.first("type").alias("type"), F.first("explicit").alias("explicit"), F.array_sort(F.collect_list(point)).alias("p"))
    return rows.select("lane_id", "type", "explicit", F.transform("p", lambda q: q.dropFields("pos")).alias("points"))


def flatten(lanes: DataFrame) -> DataFrame:
    rows = lanes.select("lane_id", "type", "explicit", F.posexplode("points").alias("pos", "p"))
    return rows.select("lane_id", "type", "explicit", F.col("pos").cast("long").alias("pos"), "p.*")


def renumber(flat: DataFrame) -> DataFrame:
    """Close gaps in positions."""
    lane = Window.partitionBy("lane_id").orderBy("pos")
    return flat.withColumn("pos", (F.row_number().over(lane) - 1).cast("long"))
