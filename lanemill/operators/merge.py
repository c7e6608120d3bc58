"""Scored matching of lane ends, and stitching of the chains it makes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LaneConfig
from ..functions.geometry import distance, distance_sq, dot, minus, undirected_angle_degrees, vector
from ..storage import materialise
from .graph import connected_components, greedy_matching
from .polyline import endpoints, lane_metrics
from .spatial import finite, radius_pairs

#: Share of the search radius that rounding to single precision may move an end by, for the narrow join.
MOVED = 0.01


def _around(rows: DataFrame, at: list[Column], width: float, n: int, reach: float, names: tuple[str, ...], hold: tuple[float, float] | None = None) -> DataFrame:
    """``rows`` copied to the cells, named by ``names``, that come within ``reach`` of a place, at most
    ``n`` cells away; with ``hold``, to those that hold places with lengths in between only.

    Cells are chosen inside an array: the planner does not look into it, as it would into a filter."""
    steps, zero = range(-n, n + 1), F.lit(0.0)
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in steps for j in steps for k in steps))

    def chosen(o: Column) -> Column:
        low = [(F.floor(x / width) + o[d]) * width for x, d in zip(at, "ijk", strict=True)]
        short = [F.greatest(zero, c - x, x - c - width) for c, x in zip(low, at, strict=True)]
        ok = dot(short, short) <= reach * reach
        if hold:
            least, most = [F.greatest(zero, c, -c - width) for c in low], [F.greatest(F.abs(c), F.abs(c + width)) for c in low]
            ok = ok & (dot(least, least) <= hold[1] ** 2) & (dot(most, most) >= hold[0] ** 2)
        return ok

    rows = rows.withColumn("o", F.explode(F.filter(offsets, chosen)))
    return rows.withColumns({name: F.floor(x / width) + F.col("o")[d] for name, x, d in zip(names, at, "ijk", strict=True)}).drop("o")


def facing_pairs(ends: DataFrame, radius: float, degrees: float) -> DataFrame:
    """All pairs of ends that may be candidates, the smaller lane id first, with suffixes ``_a`` and
    ``_b``; and some others. Directions (``o``) point out of the lane.

    Such ends look at each other: a's direction out of its lane, b's into its own and the link from a
    to b differ by less than the threshold. So each end is moved out of its lane by one length, which
    brings the two places nearer than the radius; they meet in cells of moved places and of directions.
    One side is copied to the cells around its place, the other to those around its direction.
    Ends that rounding moves far (huge coordinates) or that have no finite direction meet all in the
    radius, as do all ends if the threshold is too wide for that."""
    single, direction = vector(), vector(names=("dx", "dy", "dz"))
    ends = finite(ends.withColumns({f"e{c}": F.col(c) for c in "xyz"}))
    t = math.radians(degrees)
    most = radius * (1 + 2 * MOVED)
    move, reach = most / (2 * (1 + math.cos(t))), most / (1 + math.cos(t)) * math.sqrt(1 + math.sin(t / 2) ** 2) * (1 + 1e-6) + 2 * MOVED * radius
    chord = 2 * math.sin(t / 2) * (1 + 1e-6)
    # Written, as the lanes' windows and what is computed from them would be repeated on each side.
    ends = ends.withColumns({f"o{c}": F.when(F.col("front"), -d).otherwise(d) for c, d in zip("xyz", direction, strict=True)})
    ends = ends.withColumns({f"m{c}": F.col(c) + move * F.col(f"o{c}") for c in "xyz"}).withColumn("length", dot(direction, direction))
    ends = materialise(ends.withColumn("rounding", distance(vector(names=("ex", "ey", "ez")), single)), "ends")
    kept = ["lane_id", "front", *(f"{n}{c}" for n in "eo" for c in "xyz")]
    near = lambda a, b: radius_pairs(a.select(*"xyz", *kept), b.select(*"xyz", *kept), radius).filter("lane_id_a < lane_id_b")
    if not 0 < degrees < 60:
        return near(ends, ends)
    known = F.coalesce((F.col("length") < 2) & (F.col("rounding") <= MOVED * radius), F.lit(False))  # NaN is above all numbers
    plain, odd = ends.filter(known & (F.col("length") > 0)), ends.filter(~known)
    # Dealt out, and not broadcast: few bytes are read, but many copies are made and many pairs met.
    plain = plain.repartition(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out, moved = vector("o"), vector("m")
    places, ways = ("px", "py", "pz"), ("qx", "qy", "qz")
    a = _around(plain, moved, reach, 1, reach, places).withColumns({n: F.floor(d / (chord / 2)) for n, d in zip(ways, out, strict=True)})
    b = plain.withColumns({n: F.floor(x / reach) for n, x in zip(places, moved, strict=True)})
    b = _around(b, [-d for d in out], chord / 2, 2, chord, ways, (1 - 1e-6, 1 + 1e-6))
    keys = [*places, *ways]
    sides = [x.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("x", "y", "z", *kept))) for x, s in ((a, "a"), (b, "b"))]
    met = sides[0].hint("merge").join(sides[1], keys)
    met = met.filter((F.col("lane_id_a") < F.col("lane_id_b")) & (distance_sq(*([F.col(f"{c}_{s}") for c in "xyz"] for s in "ab")) < radius * radius)).drop(*keys)
    return met if odd.isEmpty() else met.unionByName(near(odd, ends)).unionByName(near(plain, odd))


def merge_candidates(ends: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """Pairs of ends of different lanes that are near, nearly parallel and in line, with their score;
    each pair once, the smaller lane id first. Coincident ends have no direction between them and
    are never in line."""
    pairs = facing_pairs(ends, config.search_radius, config.direction_threshold_deg)
    a, b = ([F.col(f"e{c}_{s}") for c in ("x", "y", "z")] for s in "ab")
    u, v = ([F.col(f"o{c}_{s}") for c in ("x", "y", "z")] for s in "ab")
    link, apart, t = minus(b, a), distance(a, b), math.cos(math.radians(config.direction_threshold_deg))
    in_line = (dot(u, link) / apart > t) & (-dot(v, link) / apart > t)
    kept = pairs.filter((apart > 0) & in_line & (undirected_angle_degrees(u, v) <= config.direction_threshold_deg))
    score = config.weight_distance * apart + config.weight_direction * (1 - F.abs(dot(u, v)))
    return kept.select(F.col("lane_id_a").alias("id_a"), "front_a", F.col("lane_id_b").alias("id_b"), "front_b", score.alias("score"))


def chain(lanes: dict[int, float], links: list[tuple[int, bool, int, bool]]) -> list[tuple[int, int, int, bool]]:
    """(lane, root, place, flipped) of one component's lanes, given their lengths and the accepted
    links in order of acceptance. The root is the longest lane (of equal ones, the first that a
    breadth-first walk from the smallest id meets); places count from it, backwards along its front."""
    of: dict[int, dict[bool, tuple[int, bool]]] = {lane: {} for lane in lanes}
    beside: dict[int, list[int]] = {lane: [] for lane in lanes}
    for a, front_a, b, front_b in links:
        of[a][front_a], of[b][front_b] = (b, front_b), (a, front_a)
        beside[a].append(b)
        beside[b].append(a)
    walk, seen = [min(lanes)], {min(lanes)}
    for lane in walk:
        for other in beside[lane]:
            if other not in seen:
                seen.add(other)
                walk.append(other)
    root = max(walk, key=lambda lane: (lanes[lane], -walk.index(lane)))
    found, used = [(root, root, 0, False)], {root}
    for front, step in ((False, 1), (True, -1)):
        lane, end, place = root, front, 0
        while end in of[lane]:
            lane, at = of[lane][end]
            if lane in used:
                break
            used.add(lane)
            place += step
            # Walking on behind the root, a lane met at its front keeps its order; ahead of it, the other way round.
            found.append((lane, root, place, at != (step > 0)))
            end = not at
    return found


def chains(lengths: DataFrame, accepted: DataFrame) -> DataFrame:
    """lane_id, root_id, place and flipped of every lane that a link joins. ``lengths``: lane_id, length."""
    groups = connected_components(accepted.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    members = groups.join(lengths.withColumnRenamed("lane_id", "id"), "id").select("component", "id", "length")
    links = accepted.join(groups.withColumnRenamed("id", "id_a"), "id_a").select(F.col("component").alias("of"), "id_a", "front_a", "id_b", "front_b", "score")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["score", "id_a", "front_a", "id_b", "front_b"])
        rows = [(int(a), bool(f), int(b), bool(g)) for a, f, b, g in right[["id_a", "front_a", "id_b", "front_b"]].itertuples(index=False)]
        found = chain(dict(zip(left["id"].astype(int), left["length"], strict=True)), rows)
        return pd.DataFrame(found, columns=["lane_id", "root_id", "place", "flipped"])

    return members.groupBy("component").cogroup(links.groupBy("of")).applyInPandas(run, "lane_id int, root_id int, place int, flipped boolean")


def stitch(flat: DataFrame, placed: DataFrame) -> DataFrame:
    """Points of placed lanes joined to one lane with the root's id, type and explicit flag; other
    lanes stay. Directions are not turned. Only lane-level rows ever went through Python."""
    roots = flat.groupBy("lane_id").agg(F.first("type").alias("root_type"), F.first("explicit").alias("root_explicit")).withColumnRenamed("lane_id", "root_id")
    rows = flat.join(placed, "lane_id", "left").join(roots, "root_id", "left")
    key = F.coalesce("root_id", "lane_id")
    along = F.when(F.coalesce("flipped", F.lit(False)), -F.col("pos")).otherwise(F.col("pos"))
    order = Window.partitionBy(key).orderBy(F.coalesce("place", F.lit(0)), along)
    return rows.select(
        key.alias("lane_id"),
        F.when(F.col("root_id").isNull(), F.col("type")).otherwise(F.col("root_type")).alias("type"),
        F.when(F.col("root_id").isNull(), F.col("explicit")).otherwise(F.col("root_explicit")).alias("explicit"),
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        "x", "y", "z", "dx", "dy", "dz",
    )


def merge_lanes(flat: DataFrame, config: LaneConfig = LaneConfig()) -> DataFrame:
    """Candidates, greedy matching, chains and stitching."""
    accepted = greedy_matching(merge_candidates(endpoints(flat), config))
    lengths = lane_metrics(flat, config).select("lane_id", "length")
    return stitch(flat, chains(lengths, accepted))
