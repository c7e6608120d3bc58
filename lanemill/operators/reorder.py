"""Greedy ordering of a lane's points. Each step depends on the one before, so a lane is one
group; lanes run in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LaneConfig
from ..functions.geometry import EPSILON, direction_score
from ..schemas import LANES_FLAT
from .spatial import radius_pairs

#: Candidates behind this score are passed over; scores below/above the next two count as behind/ahead.
BEHIND, COUNT_BEHIND, COUNT_AHEAD, SCORE_SHIFT = -0.5, -0.3, 0.0, 1.1


def neighbour_counts(flat: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """lane_id, pos and how many points of the lane within the start radius lie behind and ahead."""
    points = flat.select("lane_id", "pos", "x", "y", "z", "dx", "dy", "dz")
    pairs = radius_pairs(points, points.select("lane_id", "pos", "x", "y", "z"), config.start_radius, by=("lane_id",), single=False, inclusive=True)
    at = lambda names, side: [F.col(f"{n}_{side}") for n in names]
    score = direction_score(at(("dx", "dy", "dz"), "a"), at("xyz", "a"), at("xyz", "b"))
    near = pairs.filter("pos_a <> pos_b").select(F.col("lane_id_a").alias("lane_id"), F.col("pos_a").alias("pos"), score.alias("score"))
    counts = near.groupBy("lane_id", "pos").agg(
        F.count_if(F.col("score") < COUNT_BEHIND).alias("behind"), F.count_if((F.col("score") >= COUNT_BEHIND) & (F.col("score") > COUNT_AHEAD)).alias("ahead")
    )
    both = flat.select("lane_id", "pos").join(counts, ["lane_id", "pos"], "left")
    return both.select("lane_id", "pos", F.coalesce("behind", F.lit(0)).alias("behind"), F.coalesce("ahead", F.lit(0)).alias("ahead"))


def start_points(flat: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """One row per lane: the point with the fewest behind it, then most ahead, then first."""
    best = F.min(F.struct("behind", (-F.col("ahead")).alias("less"), "pos"))
    return neighbour_counts(flat, config).groupBy("lane_id").agg(best.alias("s")).select("lane_id", F.col("s.pos").alias("pos"), F.col("s.behind").alias("behind"), (-F.col("s.less")).alias("ahead"))


def greedy_order(xyz: np.ndarray, direction: np.ndarray, radius: float = 3.0) -> np.ndarray:
    """Indices of the points in greedy order; lanes below two points stay as they are.

    Points are sorted along the axis of the widest extent. A step first looks at the points within a
    window on that axis, and widens it until no point outside can cost less than the best inside: a
    cost is at least the squared distance over the largest score that the direction allows."""
    n = len(xyz)
    if n < 2:
        return np.arange(n)
    ok = np.isfinite(xyz).all(axis=1)
    axis = int(np.argmax(np.ptp(xyz[ok], axis=0))) if ok.any() else 0
    along = np.argsort(xyz[:, axis], kind="stable")  # not-a-number comes last
    line = xyz[along, axis]
    steepest = np.sqrt((direction * direction).sum(axis=1)) + SCORE_SHIFT
    left = np.ones(n, bool)

    def scores(i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy, dz = (xyz[others, c] - xyz[i, c] for c in range(3))
        sq = dx * dx + dy * dy + dz * dz
        r = np.sqrt(sq)
        ahead = (dx * direction[i, 0] + dy * direction[i, 1] + dz * direction[i, 2]) / np.where(r < EPSILON, 1.0, r)
        return sq, np.where(r < EPSILON, -1.0, ahead)

    def window(i: int, width: float) -> np.ndarray:
        """Points left within ``width`` of point ``i`` along the axis, in their own order."""
        at, slack = xyz[i, axis], width * (1 + 1e-9)
        some = along[np.searchsorted(line, at - slack, "left") : np.searchsorted(line, at + slack, "right")]
        return np.sort(some[left[some]])

    best = None
    for i in range(n):
        others = window(i, radius)
        sq, s = scores(i, others)
        near = (sq <= radius * radius) & (others != i)
        key = (int((near & (s < COUNT_BEHIND)).sum()), -int((near & (s >= COUNT_BEHIND) & (s > COUNT_AHEAD)).sum()), i)
        best = key if best is None or key < best else best
    order = [best[2]]
    left[best[2]] = False
    while len(order) < n:
        i, width, found = order[-1], max(radius, 1e-3), None
        while found is None:
            others = window(i, width)
            whole = len(others) == n - len(order) or not np.isfinite(width)
            if whole:
                others = np.flatnonzero(left)
            sq, s = scores(i, others)
            fit = s >= BEHIND
            if fit.any():
                cost = np.where(fit, sq / np.where(fit, s + SCORE_SHIFT, 1.0), np.inf)
                k = int(np.argmin(cost))
                if whole or cost[k] * steepest[i] < width * width * (1 - 1e-9):
                    found = int(others[k])
            elif whole:
                found = int(others[np.argmin(sq)])
            width *= 4
        order.append(found)
        left[found] = False
    return np.array(order)


def reorder_points(flat: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """``flat`` with every lane's points in greedy order."""
    radius = config.start_radius

    def run(lane: pd.DataFrame) -> pd.DataFrame:
        lane = lane.sort_values("pos", kind="stable")
        order = greedy_order(lane[["x", "y", "z"]].to_numpy(float), lane[["dx", "dy", "dz"]].to_numpy(float), radius)
        lane = lane.iloc[order].copy()
        lane["pos"] = np.arange(len(lane), dtype=np.int64)
        return lane

    columns = [c.split()[0] for c in LANES_FLAT.split(", ")]
    return flat.select(*columns).groupBy("lane_id").applyInPandas(run, LANES_FLAT)
