"""Registered queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BatchConfig, LaneConfig
from ..functions import geometry, style
from ..operators import batching, crop, graph, ingest, merge, polyline, present, reorder, spatial, transform, trim
from ..sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Radii for places within half a unit of each other.
CLOSE = replace(LaneConfig(), start_radius=0.1, overlap_radius=0.05, search_radius=0.2)
#: Long steps are usual between the events of a user.
TRACKS = replace(LaneConfig(), max_segment=100.0)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


SAMPLES = """s AS (
  SELECT vec_id AS k, label AS id, CASE WHEN CAST(embedding[7] AS DOUBLE) > -0.3 THEN 1 ELSE 0 END AS valid,
         CAST(floor((CAST(embedding[8] AS DOUBLE) + 0.5) * 16) AS INTEGER) AS type, CAST(embedding[9] AS DOUBLE) >= 0 AS explicit,
         CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
         CAST(embedding[4] AS DOUBLE) AS dx, CAST(embedding[5] AS DOUBLE) AS dy, CAST(embedding[6] AS DOUBLE) AS dz
  FROM embeddings)"""
LANES = (
    SAMPLES
    + """, l AS (
  SELECT id AS lane_id, first_value(type) OVER w AS type, first_value(explicit) OVER w AS explicit,
         row_number() OVER w - 1 AS pos, x, y, z, dx, dy, dz FROM s WINDOW w AS (PARTITION BY id ORDER BY k))"""
)
TRACK = """e AS (
  SELECT CAST(user_id AS INTEGER) AS lane_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         value AS x, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS y, CAST(0 AS DOUBLE) AS z, user_id % 2 = 0 AS explicit
  FROM events)"""
GRID = (
    TRACK
    + """, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly FROM e),
g AS (SELECT e.*, lx, ly, CAST(greatest(ceil((hx - lx) / 50), 1) AS INTEGER) AS cols,
        CAST(trunc((y - ly) / 50) AS INTEGER) * CAST(greatest(ceil((hx - lx) / 50), 1) AS INTEGER) + CAST(trunc((x - lx) / 50) AS INTEGER) AS idx
      FROM e, b),
h AS (SELECT idx, cols, count(*) AS n, max((lane_id, pos)) AS last, any_value(lx) AS lx, any_value(ly) AS ly FROM g GROUP BY idx, cols),
m AS (SELECT idx, n, lx + (idx % cols) * 50 + 25.0 AS cx, ly + (idx // cols) * 50 + 25.0 AS cy FROM h ORDER BY n DESC, last LIMIT 1)"""
)
FLOATS = """, f AS (SELECT *, CAST(CAST(x AS FLOAT) AS DOUBLE) AS fx, CAST(CAST(y AS FLOAT) AS DOUBLE) AS fy, CAST(CAST(z AS FLOAT) AS DOUBLE) AS fz FROM l)"""
NEAR = "(a.fx-b.fx)*(a.fx-b.fx) + (a.fy-b.fy)*(a.fy-b.fy) + (a.fz-b.fz)*(a.fz-b.fz)"


# --- ingest and crop -------------------------------------------------------------------------


@query(f"""WITH {SAMPLES}
SELECT id AS lane_id, arg_min(type, k) AS type, arg_min(explicit, k) AS explicit, CAST(count(*) AS BIGINT) AS n_points
FROM s WHERE valid = 1 AND type BETWEEN 6 AND 13 GROUP BY id""")
def lane_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.lane_attributes(ingest.keep_samples(adapters.embedding_samples(spark, sf_dir)))


@query(f"""WITH {SAMPLES},
p AS (SELECT id, x, y, z, k, type, explicit FROM s WHERE valid = 1 AND type BETWEEN 6 AND 13)
SELECT id AS lane_id, first_value(type) OVER w AS type, first_value(explicit) OVER w AS explicit,
       row_number() OVER w - 1 AS pos, x, y, z FROM p WINDOW w AS (PARTITION BY id ORDER BY k)""")
def lane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays to samples and back: columnar input, validity and type filters, first-seen attributes."""
    samples = adapters.embedding_samples(spark, sf_dir)
    flat = lambda *names: F.flatten(F.transform("p", lambda q: F.array(*(q[n] for n in names))))
    one = lambda n: F.transform("p", lambda q: q[n])
    # One object of parallel arrays per lane, as a roadgraph holds them.
    objects = samples.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "id", "valid", "type", "explicit", "x", "y", "z", "dx", "dy", "dz"))).alias("p"))
    objects = objects.select(one("id").alias("id"), flat("x", "y", "z").alias("xyz"), flat("dx", "dy", "dz").alias("dir"), *(one(n).alias(n) for n in ("valid", "type", "explicit")))
    return ingest.to_lanes(ingest.keep_samples(ingest.explode_samples(objects))).select("lane_id", "type", "explicit", "pos", "x", "y", "z")


@query(f"WITH {TRACK} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM e")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.bounding_box(adapters.event_lanes(spark, sf_dir))


@query(f"WITH {GRID} SELECT idx, n, last[1] AS last_lane, last[2] AS last_pos FROM h")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = crop.density_grid(adapters.event_lanes(spark, sf_dir))
    return grid.select("idx", "n", F.col("last.lane_id").alias("last_lane"), F.col("last.pos").alias("last_pos"))


@query(f"WITH {GRID} SELECT idx, n, round(cx, 4) AS cx, round(cy, 4) AS cy FROM m")
def density_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.density_mode(adapters.event_lanes(spark, sf_dir)).select("idx", "n", rounded("cx").alias("cx"), rounded("cy").alias("cy"))


@query(f"""WITH {GRID},
i AS (SELECT e.*, count(*) OVER (PARTITION BY lane_id) AS c FROM e, m WHERE abs(x - cx) <= 150 AND abs(y - cy) <= 150)
SELECT lane_id, row_number() OVER (PARTITION BY lane_id ORDER BY pos) - 1 AS pos, x, round(y, 6) AS y FROM i WHERE c > 1""")
def dense_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.dense_crop(adapters.event_lanes(spark, sf_dir)).select("lane_id", "pos", "x", rounded("y", 6).alias("y"))


@query(f"""WITH {LANES}
SELECT CAST(floor(x / 0.3) AS BIGINT) AS vx, CAST(floor(y / 0.3) AS BIGINT) AS vy, CAST(floor(z / 0.3) AS BIGINT) AS vz,
       round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crop.voxel_downsample(adapters.embedding_lanes(spark, sf_dir))
    return found.select("vx", "vy", "vz", *(rounded(c, 6).alias(c) for c in ("x", "y", "z")), "n")


# --- polylines -------------------------------------------------------------------------------

STEPS = """, d AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step
  FROM e WINDOW w AS (PARTITION BY lane_id ORDER BY pos)),
k AS (SELECT lane_id, count(*) AS n_points, coalesce(sum(step) FILTER (step <= 100), 0) AS length,
        sqrt(pow(arg_max(x, pos) - arg_min(x, pos), 2) + pow(arg_max(y, pos) - arg_min(y, pos), 2)) AS chord FROM d GROUP BY lane_id)"""


@query(f"WITH {TRACK}{STEPS} SELECT lane_id, n_points, round(length, 4) AS length FROM k")
def lane_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.lane_metrics(adapters.event_lanes(spark, sf_dir), TRACKS).select("lane_id", "n_points", rounded("length").alias("length"))


@query(f"WITH {TRACK}{STEPS} SELECT lane_id, round(length, 4) AS length, round(CASE WHEN length < 1e-6 THEN 0 ELSE chord / length END, 6) AS linearity FROM k")
def lane_linearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.lane_metrics(adapters.event_lanes(spark, sf_dir), TRACKS).select("lane_id", rounded("length").alias("length"), rounded("linearity", 6).alias("linearity"))


@query(f"""WITH {TRACK}, t AS (SELECT lane_id, pos, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM e WINDOW w AS (PARTITION BY lane_id ORDER BY pos))
SELECT lane_id, pos, x, round(y, 6) AS y, x2, round(y2, 6) AS y2 FROM t WHERE x2 IS NOT NULL""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.segments(adapters.event_lanes(spark, sf_dir)).select("lane_id", "pos", "x", rounded("y", 6).alias("y"), "x2", rounded("y2", 6).alias("y2"))


ENDS = """, q AS (SELECT lane_id, pos, x, y, z, lead(pos) OVER w IS NULL AS is_last, pos = 0 AS is_first,
    lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz
  FROM l WINDOW w AS (PARTITION BY lane_id ORDER BY pos)),
r AS (SELECT lane_id, is_first AS front, x, y, z, CASE WHEN is_first THEN nx - x ELSE x - px END AS ux,
        CASE WHEN is_first THEN ny - y ELSE y - py END AS uy, CASE WHEN is_first THEN nz - z ELSE z - pz END AS uz
      FROM q WHERE is_first <> is_last),
ends AS (SELECT *, CASE WHEN ux*ux+uy*uy+uz*uz > 0 THEN ux / sqrt(ux*ux+uy*uy+uz*uz) ELSE 0 END AS dx,
        CASE WHEN ux*ux+uy*uy+uz*uz > 0 THEN uy / sqrt(ux*ux+uy*uy+uz*uz) ELSE 0 END AS dy,
        CASE WHEN ux*ux+uy*uy+uz*uz > 0 THEN uz / sqrt(ux*ux+uy*uy+uz*uz) ELSE 0 END AS dz,
        CAST(CAST(x AS FLOAT) AS DOUBLE) AS fx, CAST(CAST(y AS FLOAT) AS DOUBLE) AS fy, CAST(CAST(z AS FLOAT) AS DOUBLE) AS fz FROM r)"""


@query(f"WITH {LANES}{ENDS} SELECT lane_id, front, x, y, z, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz FROM ends")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = polyline.endpoints(adapters.embedding_lanes(spark, sf_dir))
    return found.select("lane_id", "front", "x", "y", "z", *(rounded(c, 6).alias(c) for c in ("dx", "dy", "dz")))


@query(f"""WITH {LANES},
n AS (SELECT a.lane_id, a.pos, (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z) AS sq,
        a.dx*(b.x-a.x) + a.dy*(b.y-a.y) + a.dz*(b.z-a.z) AS along FROM l a JOIN l b ON a.lane_id = b.lane_id AND a.pos <> b.pos),
c AS (SELECT lane_id, pos, CASE WHEN sqrt(sq) < 1e-6 THEN -1 ELSE along / sqrt(sq) END AS score FROM n WHERE sq <= 0.1 * 0.1),
t AS (SELECT l.lane_id, l.pos, coalesce(sum(CASE WHEN score < -0.3 THEN 1 ELSE 0 END), 0) AS behind,
        coalesce(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END), 0) AS ahead FROM l LEFT JOIN c ON c.lane_id = l.lane_id AND c.pos = l.pos GROUP BY l.lane_id, l.pos)
SELECT lane_id, pos, CAST(behind AS BIGINT) AS behind, CAST(ahead AS BIGINT) AS ahead
FROM t QUALIFY row_number() OVER (PARTITION BY lane_id ORDER BY behind, ahead DESC, pos) = 1""")
def start_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.start_points(adapters.embedding_lanes(spark, sf_dir), CLOSE)


# Point after point: from the last one, the cheapest of the points that are left and not behind, or the nearest.
@query(f"""WITH RECURSIVE {LANES},
n AS (SELECT a.lane_id, a.pos, (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z) AS sq,
        a.dx*(b.x-a.x) + a.dy*(b.y-a.y) + a.dz*(b.z-a.z) AS along FROM l a JOIN l b ON a.lane_id = b.lane_id AND a.pos <> b.pos),
c AS (SELECT lane_id, pos, CASE WHEN sqrt(sq) < 1e-6 THEN -1 ELSE along / sqrt(sq) END AS score FROM n WHERE sq <= 0.1 * 0.1),
t AS (SELECT l.lane_id, l.pos, coalesce(sum(CASE WHEN score < -0.3 THEN 1 ELSE 0 END), 0) AS behind,
        coalesce(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END), 0) AS ahead FROM l LEFT JOIN c ON c.lane_id = l.lane_id AND c.pos = l.pos GROUP BY l.lane_id, l.pos),
st AS (SELECT lane_id, pos FROM t QUALIFY row_number() OVER (PARTITION BY lane_id ORDER BY behind, ahead DESC, pos) = 1),
wk AS (
  SELECT lane_id, pos, CAST(0 AS BIGINT) AS place, [pos] AS used FROM st
  UNION ALL
  SELECT lane_id, pos, place, used FROM (
    SELECT w.lane_id, b.pos, w.place + 1 AS place, list_append(w.used, b.pos) AS used,
           (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z) AS sq,
           a.dx*(b.x-a.x) + a.dy*(b.y-a.y) + a.dz*(b.z-a.z) AS along
    FROM wk w JOIN l a ON a.lane_id = w.lane_id AND a.pos = w.pos JOIN l b ON b.lane_id = w.lane_id AND NOT list_contains(w.used, b.pos)) q
  QUALIFY row_number() OVER (PARTITION BY lane_id ORDER BY
    CASE WHEN sqrt(sq) < 1e-6 OR along / sqrt(sq) < -0.5 THEN 1 ELSE 0 END,
    CASE WHEN sqrt(sq) < 1e-6 OR along / sqrt(sq) < -0.5 THEN sq ELSE sq / (along / sqrt(sq) + 1.1) END, pos) = 1)
SELECT l.lane_id, l.type, l.explicit, w.place AS pos, l.x, l.y, l.z, l.dx, l.dy, l.dz FROM wk w JOIN l ON l.lane_id = w.lane_id AND l.pos = w.pos""")
def reorder_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.reorder_points(adapters.embedding_lanes(spark, sf_dir), CLOSE)


# --- radius joins, trimming, merging ---------------------------------------------------------


@query(f"""WITH {LANES}{FLOATS}
SELECT a.lane_id AS lane_a, a.pos AS pos_a, b.lane_id AS lane_b, b.pos AS pos_b
FROM f a JOIN f b ON a.lane_id < b.lane_id AND {NEAR} < 0.05 * 0.05""")
def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = adapters.embedding_lanes(spark, sf_dir).select("lane_id", "pos", "x", "y", "z")
    pairs = spatial.radius_pairs(points, points, CLOSE.overlap_radius).filter("lane_id_a < lane_id_b")
    return pairs.selectExpr("lane_id_a AS lane_a", "pos_a", "lane_id_b AS lane_b", "pos_b")


OVERLAPS = f""", o AS (SELECT a.*, EXISTS (SELECT 1 FROM f b WHERE b.lane_id <> a.lane_id AND {NEAR} < 0.05 * 0.05) AS hit FROM f a)"""


@query(f"WITH {LANES}{FLOATS}{OVERLAPS} SELECT lane_id, pos, hit FROM o")
def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlap_flags(adapters.embedding_lanes(spark, sf_dir), CLOSE.overlap_radius).select("lane_id", "pos", F.col("overlaps").alias("hit"))


@query(f"""WITH {LANES}{FLOATS}{OVERLAPS},
c AS (SELECT *, min(pos) FILTER (NOT hit) OVER (PARTITION BY lane_id) AS low, max(pos) FILTER (NOT hit) OVER (PARTITION BY lane_id) AS high FROM o),
k AS (SELECT *, count(*) OVER (PARTITION BY lane_id) AS n FROM c WHERE pos BETWEEN low AND high)
SELECT lane_id, row_number() OVER (PARTITION BY lane_id ORDER BY pos) - 1 AS pos, x, y, z FROM k WHERE n > 1""")
def trim_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trim_static(adapters.embedding_lanes(spark, sf_dir), CLOSE).select("lane_id", "pos", "x", "y", "z")


@query()
def trim_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trim_overlaps(adapters.embedding_lanes(spark, sf_dir), CLOSE)


CANDIDATES = """, pr AS (SELECT a.lane_id AS id_a, a.front AS front_a, b.lane_id AS id_b, b.front AS front_b,
    a.dx AS ax, a.dy AS ay, a.dz AS az, b.dx AS bx, b.dy AS by_, b.dz AS bz, b.x-a.x AS cx, b.y-a.y AS cy, b.z-a.z AS cz
  FROM ends a JOIN ends b ON a.lane_id < b.lane_id AND (a.fx-b.fx)*(a.fx-b.fx) + (a.fy-b.fy)*(a.fy-b.fy) + (a.fz-b.fz)*(a.fz-b.fz) < 0.2 * 0.2),
sc AS (SELECT *, ax*bx + ay*by_ + az*bz AS dt, sqrt(cx*cx+cy*cy+cz*cz) AS dist FROM pr),
cand AS (SELECT *, dist + 5 * (1 - abs(dt)) AS score FROM sc
  WHERE degrees(acos(least(abs(dt), 1))) <= 30 AND dist > 0
    AND (CASE WHEN front_a THEN -1 ELSE 1 END) * (ax*cx + ay*cy + az*cz) / dist > cos(radians(30))
    AND (CASE WHEN front_b THEN 1 ELSE -1 END) * (bx*cx + by_*cy + bz*cz) / dist > cos(radians(30)))"""

# Short lanes, so that many ends are near each other: a lane for each three consecutive vectors.
SHORT = SAMPLES + """, l AS (SELECT CAST(k // 3 AS INTEGER) AS lane_id, k % 3 AS pos, type, explicit, x, y, z, dx, dy, dz FROM s)"""


def short_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three consecutive vectors are a lane."""
    samples = adapters.embedding_samples(spark, sf_dir).withColumn("id", F.floor(F.col("k") / 3).cast("int"))
    return ingest.to_lanes(samples)


@query(f"WITH {SHORT}{ENDS}{CANDIDATES} SELECT id_a, front_a, id_b, front_b, round(score, 6) AS score FROM cand")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_candidates(polyline.endpoints(short_lanes(spark, sf_dir)), CLOSE).withColumn("score", rounded("score", 6))


# One pass over the candidates in order, with the ends that are taken so far.
GREEDY = """, rk AS (SELECT *, row_number() OVER (ORDER BY score, id_a, front_a, id_b, front_b) AS k,
    [CAST(id_a AS VARCHAR) || front_a, CAST(id_b AS VARCHAR) || front_b] AS es FROM cand),
pass AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken, false AS ok
  UNION ALL
  SELECT rk.k, CASE WHEN list_has_any(taken, es) THEN taken ELSE list_concat(taken, es) END, NOT list_has_any(taken, es)
  FROM pass JOIN rk ON rk.k = pass.k + 1),
acc AS (SELECT rk.* FROM pass JOIN rk ON rk.k = pass.k WHERE ok)"""


@query(f"WITH RECURSIVE {SHORT}{ENDS}{CANDIDATES}{GREEDY} SELECT id_a, front_a, id_b, front_b, round(score, 6) AS score FROM acc")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.greedy_matching(merge.merge_candidates(polyline.endpoints(short_lanes(spark, sf_dir)), CLOSE))
    return found.withColumn("score", rounded("score", 6))


@query(f"""WITH RECURSIVE {LANES}{FLOATS}, v AS (SELECT f.*, s.k FROM f JOIN (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS pos FROM s) s ON s.id = f.lane_id AND s.pos = f.pos),
ed AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k <> b.k AND {NEAR} < 0.05 * 0.05),
reach AS (SELECT a AS id, b AS other FROM ed UNION SELECT r.id, e.b FROM reach r JOIN ed e ON e.a = r.other)
SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors that are linked by distances below the radius."""
    points = adapters.embedding_samples(spark, sf_dir).select("k", "x", "y", "z")
    pairs = spatial.radius_pairs(points, points, CLOSE.overlap_radius).filter("k_a < k_b")
    return graph.connected_components(pairs.select(F.col("k_a").alias("a"), F.col("k_b").alias("b")))


# From the longest lane of each component along the links, behind it and then ahead of it.
def _along(name: str, start: str, front: str, step: int, used: str) -> str:
    return f""", {name} AS (
  SELECT root, root AS lane, {front} AS at_front, CAST(0 AS INTEGER) AS place, false AS flipped, {used} AS used FROM {start}
  UNION ALL
  SELECT w.root, k.other, NOT k.other_front, w.place + ({step}), k.other_front <> {str(step > 0).lower()}, list_append(w.used, k.other)
  FROM {name} w JOIN lk k ON k.lane = w.lane AND k.front = w.at_front AND NOT list_contains(w.used, k.other))"""


CHAINS = (
    """, lk AS (SELECT id_a AS lane, front_a AS front, id_b AS other, front_b AS other_front FROM acc
  UNION ALL SELECT id_b, front_b, id_a, front_a FROM acc),
rc AS (SELECT lane, other FROM lk UNION SELECT rc.lane, lk.other FROM rc JOIN lk ON lk.lane = rc.other),
co AS (SELECT lane, least(lane, min(other)) AS component FROM rc GROUP BY lane),
sp AS (SELECT lane_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step
  FROM l WINDOW w AS (PARTITION BY lane_id ORDER BY pos)),
le AS (SELECT lane_id, coalesce(sum(step) FILTER (step <= 10), 0) AS length FROM sp GROUP BY lane_id),
ro AS (SELECT arg_max(lane, length) AS root FROM co JOIN le ON le.lane_id = co.lane GROUP BY component)"""
    + _along("wa", "ro", "false", 1, "[root]")
    + """, us AS (SELECT root, arg_max(used, place) AS used FROM wa GROUP BY root)"""
    + _along("wb", "us", "true", -1, "used")
    + """, pd AS (SELECT root, lane, place, flipped FROM wa UNION ALL SELECT root, lane, place, flipped FROM wb WHERE place < 0),
fs AS (SELECT lane_id, arg_min(type, pos) AS type, arg_min(explicit, pos) AS explicit FROM l GROUP BY lane_id)"""
)


@query(f"""WITH RECURSIVE {SHORT}{ENDS}{CANDIDATES}{GREEDY}{CHAINS}
SELECT coalesce(root, l.lane_id) AS lane_id, fs.type, fs.explicit,
       row_number() OVER (PARTITION BY coalesce(root, l.lane_id) ORDER BY coalesce(place, 0), CASE WHEN flipped THEN -pos ELSE pos END) - 1 AS pos,
       x, y, z, dx, dy, dz FROM l LEFT JOIN pd ON pd.lane = l.lane_id JOIN fs ON fs.lane_id = coalesce(pd.root, l.lane_id)""")
def merge_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_lanes(short_lanes(spark, sf_dir), CLOSE)


# --- transforms ------------------------------------------------------------------------------

POSES = """fi AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label),
po AS (SELECT label AS frame_idx, CASE WHEN CAST(e[14] AS DOUBLE) >= 0 THEN 'world' ELSE 'map' END AS frame_id,
  CAST(e[7] AS DOUBLE) AS px, CAST(e[8] AS DOUBLE) AS py, CAST(e[9] AS DOUBLE) AS pz,
  CAST(e[10] AS DOUBLE) AS q0, CAST(e[11] AS DOUBLE) AS q1, CAST(e[12] AS DOUBLE) AS q2, CAST(e[13] AS DOUBLE) AS q3 FROM fi)"""


@query(f"""WITH {LANES}, {POSES}
SELECT lane_id, pos,
  round((1-2*(q1*q1+q2*q2))*x + 2*(q0*q1-q2*q3)*y + 2*(q0*q2+q1*q3)*z + px, 6) AS x,
  round(2*(q0*q1+q2*q3)*x + (1-2*(q0*q0+q2*q2))*y + 2*(q1*q2-q0*q3)*z + py, 6) AS y,
  round(2*(q0*q2-q1*q3)*x + 2*(q1*q2+q0*q3)*y + (1-2*(q0*q0+q1*q1))*z + pz, 6) AS z
FROM l JOIN po ON po.frame_idx = l.lane_id""")
def rigid_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = adapters.embedding_poses(spark, sf_dir)
    m = geometry.rigid(geometry.rotation(*(F.col(f"q{i}") for i in range(4))), [F.col(c) for c in ("x", "y", "z")])
    matrices = poses.select(F.col("frame_idx").alias("lane_id"), F.array(*m).alias("m"))
    points = adapters.embedding_lanes(spark, sf_dir).select("lane_id", "pos", "x", "y", "z")
    return transform.transform_points(points, matrices, "lane_id").select("lane_id", "pos", *(rounded(c, 6).alias(c) for c in ("x", "y", "z")))


@query(f"""WITH {POSES}, tg AS (SELECT arg_min(frame_id, frame_idx) AS target FROM po),
se(i, j, v) AS (VALUES (0,0,0.0),(0,1,-1.0),(0,2,0.0),(0,3,0.5),(1,0,1.0),(1,1,0.0),(1,2,0.0),(1,3,-0.25),(2,0,0.0),(2,1,0.0),(2,2,1.0),(2,3,2.0),(3,0,0.0),(3,1,0.0),(3,2,0.0),(3,3,1.0)),
ba(i, j, v) AS (VALUES (0,0,0.0),(0,1,1.0),(0,2,0.0),(0,3,0.25),(1,0,-1.0),(1,1,0.0),(1,2,0.0),(1,3,0.5),(2,0,0.0),(2,1,0.0),(2,2,1.0),(2,3,-2.0),(3,0,0.0),(3,1,0.0),(3,2,0.0),(3,3,1.0)),
wo AS (SELECT frame_idx, i, j, CASE WHEN frame_id = target THEN CASE WHEN i = j THEN 1.0 ELSE 0.0 END WHEN target = 'world' THEN ba.v ELSE se.v END AS v
       FROM po, tg, se JOIN ba USING (i, j)),
pl AS (SELECT frame_idx, u.i, u.j, u.v FROM po, LATERAL (VALUES
  (0,0,1-2*(q1*q1+q2*q2)),(0,1,2*(q0*q1-q2*q3)),(0,2,2*(q0*q2+q1*q3)),(0,3,px),
  (1,0,2*(q0*q1+q2*q3)),(1,1,1-2*(q0*q0+q2*q2)),(1,2,2*(q1*q2-q0*q3)),(1,3,py),
  (2,0,2*(q0*q2-q1*q3)),(2,1,2*(q1*q2+q0*q3)),(2,2,1-2*(q0*q0+q1*q1)),(2,3,pz),(3,0,0),(3,1,0),(3,2,0),(3,3,1)) u(i, j, v)),
ou AS (SELECT wo.frame_idx, wo.i, pl.j, sum(wo.v * pl.v) AS v FROM wo JOIN pl ON pl.frame_idx = wo.frame_idx AND wo.j = pl.i GROUP BY 1, 2, 3)
SELECT ou.frame_idx, CAST(4 * ou.i + se.j AS INTEGER) AS cell, round(sum(ou.v * se.v), 6) AS v FROM ou JOIN se ON ou.j = se.i GROUP BY ou.frame_idx, ou.i, se.j""")
def transform_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform.frame_matrices(adapters.embedding_poses(spark, sf_dir), adapters.embedding_transforms(spark, sf_dir))
    return found.select("frame_idx", F.posexplode("m").alias("cell", "v")).withColumn("v", rounded("v", 6))


@query("""WITH t AS (SELECT vec_id, CAST(embedding[10] AS DOUBLE) * 20 AS theta FROM embeddings)
SELECT vec_id, round(((theta % pi()) + pi()) % pi(), 6) AS theta FROM t""")
def theta_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    theta = F.element_at("embedding", 10).cast("double") * 20
    return adapters.table(spark, sf_dir, "embeddings").select("vec_id", rounded(geometry.normalise_theta(theta), 6).alias("theta"))


@query("SELECT event_id, round(CAST(CAST(CAST(floor(value) AS INTEGER) % 256 AS FLOAT) / CAST(255 AS FLOAT) AS DOUBLE), 6) AS intensity FROM events")
def intensity_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.floor("value").cast("int") % 256).cast("short")
    return adapters.table(spark, sf_dir, "events").select("event_id", rounded(geometry.intensity(level).cast("double"), 6).alias("intensity"))


@query("""SELECT CAST(floor((epoch_us(ts) - 1704067200000000) / 3.6e9) AS INTEGER) AS frame_idx, event_id AS seq, value AS x
FROM events WHERE event_type IN ('purchase', 'view')""")
def global_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.global_union(*(adapters.event_frames(spark, sf_dir, kind) for kind in ("purchase", "view"))).select("frame_idx", "seq", "x")


# --- frames and batches ----------------------------------------------------------------------


def _live(minutes: int) -> str:
    return f"""fr AS (SELECT DISTINCT CAST(floor((epoch_us(ts) - 1704067200000000) / 3.6e9 * {60 / minutes}) AS INTEGER) AS frame_idx FROM events WHERE event_type = 'purchase'),
ga AS (SELECT frame_idx, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (ORDER BY frame_idx) AS stops
       FROM (SELECT frame_idx, frame_idx - lag(frame_idx, 1, -1) OVER (ORDER BY frame_idx) - 1 AS gap FROM fr) q),
li AS (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) - 1 AS ordinal FROM ga
       WHERE stops = 0 AND frame_idx <= coalesce((SELECT min(frame_idx) FROM fr WHERE frame_idx >= 30000), 30000)),
ba AS (SELECT u.b AS batch_id, frame_idx, ordinal, (SELECT count(*) FROM li) AS n
       FROM li, LATERAL (SELECT unnest(range(greatest(CAST(ceil((ordinal - 19) / 15) AS BIGINT), 0), ordinal // 15 + 1)) AS b) u),
re AS (SELECT * FROM ba WHERE batch_id * 15 + 20 <= n)"""


@query(f"WITH {_live(15)} SELECT frame_idx, ordinal FROM li")
def frame_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.live_frames(adapters.event_frames(spark, sf_dir, "purchase", 15))


@query(f"WITH {_live(60)} SELECT CAST(batch_id AS INTEGER) AS batch_id, frame_idx FROM re")
def frame_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batch_frames(batching.live_frames(adapters.event_frames(spark, sf_dir, "purchase")))


@query(f"""WITH {_live(60)},
bo AS (SELECT max(frame_idx) AS last, (SELECT coalesce(max(batch_id) + 1, 0) FROM re) AS batches,
         (SELECT coalesce(arg_max(frame_idx, (batch_id, ordinal)) - 19, -1) FROM re) AS saved FROM li),
bb AS (SELECT *, CASE WHEN last - 19 < 0 THEN 20000 ELSE last - 19 END AS begin_ FROM bo)
SELECT CAST(batches AS INTEGER) AS batch_id, frame_idx FROM fr, bb WHERE begin_ > saved AND frame_idx BETWEEN begin_ AND last""")
def final_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapters.event_frames(spark, sf_dir, "purchase")
    return batching.final_batch(batching.live_frames(frames), frames)


@query(f"""WITH {_live(60)}
SELECT CAST(r.batch_id AS INTEGER) AS batch_id, count(*) AS n_points, round(sum(e.value), 4) AS total
FROM re r JOIN events e ON event_type = 'purchase' AND CAST(floor((epoch_us(e.ts) - 1704067200000000) / 3.6e9) AS INTEGER) = r.frame_idx GROUP BY r.batch_id""")
def batch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the regular batches, added up."""
    points = adapters.event_frames(spark, sf_dir, "purchase")
    members = batching.batch_frames(batching.live_frames(points, BatchConfig()))
    return points.join(members, "frame_idx").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_points"), rounded(F.sum("x")).alias("total"))


# --- viewer ----------------------------------------------------------------------------------


@query("""WITH a AS (SELECT c_custkey AS id, CAST((CAST(c_custkey AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT) AS h FROM customer),
b AS (SELECT id, CAST((CAST(xor(h >> 16, h) AS HUGEINT) * 73244475) % 4294967296 AS BIGINT) AS h FROM a),
c AS (SELECT id, CAST((CAST(xor(h >> 16, h) AS HUGEINT) * 73244475) % 4294967296 AS BIGINT) AS h FROM b),
d AS (SELECT id, xor(h >> 16, h) AS hash FROM c),
e AS (SELECT id, hash, (CAST(hash AS DOUBLE) * CAST(0.61803398875 AS DOUBLE)) % 1.0 AS hue0 FROM d),
f AS (SELECT id, hash, CASE WHEN hue0 BETWEEN 0.62 AND 0.7 THEN (hue0 + CAST(0.2 AS DOUBLE)) % 1.0 ELSE hue0 END AS hue FROM e),
g AS (SELECT *, CAST(floor(hue * 6) AS INTEGER) % 6 AS i, hue * 6 - floor(hue * 6) AS fr FROM f),
h AS (SELECT *, CAST(0.95 AS DOUBLE) AS v, 0.95 * (1 - CAST(0.85 AS DOUBLE)) AS p, 0.95 * (1 - 0.85 * fr) AS q, 0.95 * (1 - 0.85 * (1 - fr)) AS t FROM g)
SELECT id AS c_custkey, hash,
  round(CAST(CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END AS DOUBLE), 4) AS r,
  round(CAST(CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END AS DOUBLE), 4) AS g,
  round(CAST(CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END AS DOUBLE), 4) AS b FROM h""")
def lane_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = present.lane_colours(adapters.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return found.select("c_custkey", "hash", *(rounded(c).alias(c) for c in ("r", "g", "b")))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 0.5 ELSE 0.2 END AS scale, CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.3 END AS alpha,
  CASE WHEN c_acctbal >= 0 THEN 0.3 ELSE 0.1 END AS line_width FROM customer""".replace("0.5 ", "CAST(0.5 AS DOUBLE) ").replace("THEN 1.0 ", "THEN CAST(1.0 AS DOUBLE) ").replace("THEN 0.3 ", "THEN CAST(0.3 AS DOUBLE) "))
def lane_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = adapters.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") >= 0).alias("explicit"))
    return present.lane_styles(lanes).drop("explicit")


@query("SELECT c_custkey, 'seq_' || CAST(c_nationkey AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) AS marker FROM customer")
def marker_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = adapters.table(spark, sf_dir, "customer")
    return customers.select("c_custkey", style.marker_name(F.col("c_nationkey"), F.col("c_custkey")).alias("marker"))


@query(f"""WITH {TRACK}, o AS (SELECT arg_min(x, (lane_id, pos)) AS ox, arg_min(y, (lane_id, pos)) AS oy FROM e)
SELECT lane_id, pos, round(x - ox, 6) AS x, round(y - oy, 6) AS y FROM e, o""")
def rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = adapters.event_lanes(spark, sf_dir)
    return present.rebase(flat, present.origin(flat)).select("lane_id", "pos", rounded("x", 6).alias("x"), rounded("y", 6).alias("y"))


@query("""WITH t AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM events)
SELECT CAST(u.user_id AS INTEGER) AS lane_id, (u.user_id % 2 = 0) <> (coalesce(n, 0) % 2 = 1) AS explicit FROM u LEFT JOIN t USING (user_id)""")
def toggle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events").withColumn("lane_id", F.col("user_id").cast("int"))
    lanes = events.select("lane_id", (F.col("user_id") % 2 == 0).alias("explicit")).distinct()
    return present.toggled(lanes, events.filter("event_type = 'click'").select("lane_id"))


@query("""WITH h AS (SELECT DISTINCT CAST(floor((epoch_us(ts) - 1704067200000000) / 3.6e9) AS INTEGER) AS tick FROM events)
SELECT tick, tick % 44 AS batch_id FROM h""")
def playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = adapters.table(spark, sf_dir, "events").select(F.floor(adapters.hours(F.col("ts"))).cast("int").alias("tick")).distinct()
    return present.playback(ticks, 44)
