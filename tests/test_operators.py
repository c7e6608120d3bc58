"""Hand-made cases and plain-Python models of the order-dependent operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanemill.config import BatchConfig, LaneConfig
from lanemill.functions import geometry
from lanemill.operators import batching, crop, graph, ingest, merge, polyline, present, reorder, spatial, trim
from lanemill.streaming import frames as streaming

FLAT = "lane_id int, type int, explicit boolean, pos long, x double, y double, z double, dx double, dy double, dz double"


def flat(spark, lanes):
    rows = [(i, 6, i % 2 == 0, k, float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else 0.0, 1.0, 0.0, 0.0) for i, points in lanes.items() for k, p in enumerate(points)]
    return spark.createDataFrame(rows, FLAT)


def lanes_of(df):
    found = {}
    for r in df.orderBy("lane_id", "pos").collect():
        found.setdefault(r.lane_id, []).append((r.x, r.y))
    return found


def test_ingest_filters_and_first_seen_attributes(spark):
    df = spark.createDataFrame(
        [([1, 1, 2, 1, 3], [float(i) for i in range(15)], [0.0] * 15, [1, 0, 1, 1, 1], [6, 7, 14, 9, 5], [True, False, True, False, True])],
        "id array<int>, xyz array<double>, dir array<double>, valid array<int>, type array<int>, explicit array<boolean>",
    )
    rows = ingest.to_lanes(ingest.keep_samples(ingest.explode_samples(df))).orderBy("pos").collect()
    assert [(r.lane_id, r.type, r.explicit, r.pos, r.x) for r in rows] == [(1, 6, True, 0, 0.0), (1, 6, True, 1, 9.0)]
    nested = ingest.nest(ingest.to_lanes(ingest.keep_samples(ingest.explode_samples(df))))
    assert [p.x for p in nested.first().points] == [0.0, 9.0]
    assert ingest.flatten(nested).count() == 2


def test_density_tie_goes_to_the_cell_that_was_full_first(spark):
    points = flat(spark, {1: [(0, 0), (60, 0), (60, 0), (0, 0)], 2: [(120, 120)]})
    assert crop.density_mode(points).first().idx == 1
    same_x = flat(spark, {1: [(5, 0), (5, 60)]})
    assert crop.density_mode(same_x).first().n == 1


def test_crop_border_is_inside_and_lone_points_go(spark):
    points = flat(spark, {1: [(25, 25)] * 3 + [(175, 25), (175.1, 25)], 2: [(0, 0), (500, 500)]})
    found = lanes_of(crop.dense_crop(points))
    assert (175.0, 25.0) in found[1] and (175.1, 25.0) not in found[1] and 2 not in found


def test_length_skips_long_segments(spark):
    rows = {r.lane_id: r for r in polyline.lane_metrics(flat(spark, {1: [(0, 0), (10, 0), (20.01, 0)], 2: [(0, 0)], 3: [(0, 0), (0, 0)]})).collect()}
    assert rows[1].length == pytest.approx(10) and rows[1].linearity == pytest.approx(2.001)
    assert rows[2].length == 0 and rows[2].linearity == 0 and rows[3].linearity == 0


def test_theta_and_angles(spark):
    df = spark.createDataFrame([(-0.1,), (math.pi,), (7.0,), (float("inf"),)], "t double").select(geometry.normalise_theta(F.col("t")).alias("t"))
    found = [r.t for r in df.collect()]
    assert found[0] == pytest.approx(math.pi - 0.1) and found[1] == pytest.approx(0) and found[2] == pytest.approx(7 - 2 * math.pi) and found[3] is None
    v = lambda *x: [F.lit(float(a)) for a in x]
    row = spark.range(1).select(geometry.angle_degrees(v(1, 0, 0), v(0, 2, 0)).alias("a"), geometry.angle_degrees(v(0, 0, 0), v(1, 0, 0)).alias("b"), geometry.direction_score(v(1, 0, 0), v(0, 0, 0), v(0, 0, 0)).alias("c")).first()
    assert row.a == pytest.approx(90) and row.b == 0 and row.c == -1


def test_unnormalised_quaternion_and_matrix_chain(spark):
    m = geometry.rigid(geometry.rotation(*(F.lit(x) for x in (0.0, 0.0, 1.0, 1.0))), [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    row = spark.range(1).select(F.array(*m).alias("m")).select(geometry.matrix_product(F.col("m"), F.col("m")).alias("p")).first()
    a = np.array([[-1, -2, 0, 1], [2, -1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]], float)
    assert np.allclose(np.array(row.p).reshape(4, 4), a @ a)


def plain_order(xyz, direction, radius=3.0):
    """The greedy ordering, point by point."""
    n = len(xyz)
    if n < 2:
        return list(range(n))

    def score(i, j):
        d = [b - a for a, b in zip(xyz[i], xyz[j], strict=True)]
        r = math.sqrt(sum(x * x for x in d))
        return -1.0 if r < 1e-6 else sum(x * y for x, y in zip(direction[i], d, strict=True)) / r

    sq = lambda i, j: sum((a - b) ** 2 for a, b in zip(xyz[i], xyz[j], strict=True))
    keys = []
    for i in range(n):
        s = [score(i, j) for j in range(n) if j != i and sq(i, j) <= radius * radius]
        keys.append((sum(x < -0.3 for x in s), -sum(x >= -0.3 and x > 0 for x in s), i))
    order, left = [min(keys)[2]], set(range(n)) - {min(keys)[2]}
    while left:
        i = order[-1]
        fit = [(sq(i, j) / (score(i, j) + 1.1), j) for j in sorted(left) if score(i, j) >= -0.5]
        j = min(fit)[1] if fit else min((sq(i, j), j) for j in left)[1]
        order.append(j)
        left.remove(j)
    return order


def test_reorder_matches_the_plain_model_and_permutes(spark):
    rnd = random.Random(5)
    for _ in range(60):
        n = rnd.randint(0, 9)
        xyz = [[rnd.randint(0, 4) for _ in range(3)] for _ in range(n)]
        direction = [rnd.choice(([1, 0, 0], [0, 1, 0], [0, 0, 0])) for _ in range(n)]
        assert reorder.greedy_order(np.array(xyz, float).reshape(n, 3), np.array(direction, float).reshape(n, 3)).tolist() == plain_order(xyz, direction)
    for n in (60, 90):  # long lanes, where a window holds few of the points; directions of any length
        xyz = [[rnd.uniform(0, 60), rnd.choice((0.0, 2.0, 5.0)), rnd.uniform(0, 1)] for _ in range(n)]
        direction = [[rnd.uniform(-3, 3), rnd.uniform(-1, 1), 0.0] for _ in range(n)]
        assert reorder.greedy_order(np.array(xyz), np.array(direction)).tolist() == plain_order(xyz, direction)
    odd = np.array([[0, 0, 0], [np.nan, 0, 0], [np.inf, 1, 0], [5, 0, 0], [1, 0, 0]])
    assert sorted(reorder.greedy_order(odd, np.ones((5, 3)))) == [0, 1, 2, 3, 4]
    shuffled = flat(spark, {1: [(2, 0), (0, 0), (3, 0), (1, 0)], 2: [(4, 4)]})
    assert lanes_of(reorder.reorder_points(shuffled)) == {1: [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)], 2: [(4.0, 4.0)]}
    assert {r.lane_id: r.pos for r in reorder.start_points(shuffled).collect()} == {1: 1, 2: 0}


def test_radius_join_equals_all_pairs(spark):
    rnd = random.Random(2)
    points = {i: [(rnd.uniform(-2, 2), rnd.uniform(-2, 2), rnd.uniform(-1, 1)) for _ in range(12)] for i in range(5)}
    df = flat(spark, points).select("lane_id", "pos", "x", "y", "z")
    found = {(r.lane_id_a, r.pos_a, r.lane_id_b, r.pos_b) for r in spatial.radius_pairs(df, df, 0.6).collect()}
    all_points = [(i, k, np.float32(p)) for i, ps in points.items() for k, p in enumerate(ps)]
    wanted = {(i, k, j, m) for i, k, p in all_points for j, m, q in all_points if ((p.astype(float) - q.astype(float)) ** 2).sum() < 0.36}
    assert found == wanted


def plain_trim(points, order, radius):
    live = {(i, k) for i, ps in points.items() for k in range(len(ps))}
    near = lambda i, k: any(j != i and sum((a - b) ** 2 for a, b in zip(points[i][k], points[j][m], strict=True)) < radius**2 for j, m in live)
    for i in order:
        for walk in (range(len(points[i])), range(len(points[i]) - 1, -1, -1)):
            if not any((i, k) in live for k in range(len(points[i]))):
                break
            for k in walk:
                if not near(i, k):
                    break
                live.discard((i, k))
    kept = {i: [points[i][k] for k in range(len(points[i])) if (i, k) in live] for i in points}
    return {i: ps for i, ps in kept.items() if len(ps) > 1}


def test_ordered_trim_matches_the_plain_model(spark):
    rnd = random.Random(11)
    for _ in range(4):
        points = {}
        for i in range(5):
            x, y, step = rnd.uniform(0, 4), rnd.uniform(0, 1), rnd.uniform(-0.3, 0.3)
            points[i] = [(x + k * 0.4, y + k * step + rnd.uniform(-0.1, 0.1)) for k in range(8)]
        df = flat(spark, points)
        metrics = [(r.lane_id, r.length, r.linearity) for r in polyline.lane_metrics(df).collect()]
        wanted = plain_trim(points, trim.trim_order(metrics), 0.3)
        found = lanes_of(trim.trim_overlaps(df))
        assert {i: [tuple(map(float, p)) for p in ps] for i, ps in wanted.items()} == found


def test_less_straight_lane_is_trimmed_first(spark):
    found = lanes_of(trim.trim_overlaps(flat(spark, {1: [(0, 0), (1, 0), (2, 0)], 2: [(0, 0.2), (1, 0.9), (2, 0.9), (3, 0.2)]})))
    assert found[1] == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)] and found[2][0] == (1.0, 0.9)


def test_overlap_in_the_middle_stays(spark):
    points = flat(spark, {1: [(0, 0), (1, 0), (2, 0)], 2: [(1, -1), (1, 0.1), (1, 1)]})
    assert len(lanes_of(trim.trim_static(points))[1]) == 3


def plain_matching(edges):
    busy, found = set(), []
    for score, a, fa, b, fb in sorted((s, a, fa, b, fb) for a, fa, b, fb, s in edges):
        if (a, fa) not in busy and (b, fb) not in busy:
            busy |= {(a, fa), (b, fb)}
            found.append((a, fa, b, fb, score))
    return sorted(found)


def test_matching_equals_the_sequential_pass(spark):
    rnd = random.Random(3)
    for _ in range(3):
        edges = list({(a, rnd.random() < 0.5, b, rnd.random() < 0.5, float(rnd.randint(0, 4))) for a in range(7) for b in range(a + 1, 7) if rnd.random() < 0.5})
        df = spark.createDataFrame(edges, "id_a int, front_a boolean, id_b int, front_b boolean, score double")
        assert sorted(tuple(r) for r in graph.greedy_matching(df).collect()) == plain_matching(edges)
    assert graph.greedy_matching(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(3, 1), (1, 2), (2, 3)]
    found = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(found[i] == 20 for i in range(20, 61)) and all(found[i] == 1 for i in (1, 2, 3)) and len(found) == 44
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize(("second", "wanted"), [([(3, 0), (4, 0)], [0, 1, 3, 4]), ([(4, 0), (3, 0)], [0, 1, 3, 4]), ([(-2, 0), (-1, 0)], [-2, -1, 0, 1]), ([(-1, 0), (-2, 0)], [-2, -1, 0, 1])])
def test_all_four_pairings_are_stitched(spark, second, wanted):
    config = LaneConfig(search_radius=2.5)
    # Lane 1 is the longer one, hence the root.
    found = merge.merge_lanes(flat(spark, {1: [(0, 0), (0.5, 0.4), (1, 0)], 2: second}), LaneConfig(search_radius=2.5, direction_threshold_deg=50))
    xs = [x for x, _ in lanes_of(found)[1]]
    assert sorted(xs) in (xs, xs[::-1]) and [x for x in sorted(xs) if x != 0.5] == wanted
    assert config.search_radius == 2.5


def test_coincident_or_turned_ends_do_not_merge(spark):
    same = flat(spark, {1: [(0, 0), (1, 0)], 2: [(1, 0), (2, 0)]})
    assert merge.merge_candidates(polyline.endpoints(same)).count() == 0
    turned = flat(spark, {1: [(0, 0), (1, 0)], 2: [(2, 0), (2 + math.cos(math.radians(31)), math.sin(math.radians(31)))]})
    assert merge.merge_candidates(polyline.endpoints(turned)).count() == 0


def test_merging_keeps_points_and_passes_short_lanes_through(spark):
    lanes = {1: [(0, 0), (1, 0)], 2: [(2, 0), (3, 0)], 3: [(4, 0), (5, 0)], 4: [(50, 50)]}
    found = lanes_of(merge.merge_lanes(flat(spark, lanes)))
    assert found == {1: [(float(x), 0.0) for x in range(6)], 4: [(50.0, 50.0)]}


def plain_batches(frames, config):
    frames, buffer, found, misses, last, saved = set(frames), [], [], 0, -1, -1
    i = 0
    while True:
        if i not in frames:
            misses += 1
            i += 1
            if misses > config.max_misses:
                break
            continue
        misses, last = 0, i
        buffer.append(i)
        if len(buffer) >= config.size:
            found.append(list(buffer))
            saved = i - len(buffer) + 1
            buffer = buffer[config.slide :]
        i += 1
        if i > config.start_index + config.frame_limit:
            break
    if last >= 0:
        begin = last - config.size + 1
        begin = config.start_index if begin < 0 else begin
        forced = [f for f in range(begin, last + 1) if f in frames]
        if begin > saved and forced:
            found.append(forced)
    return {(b, f) for b, fs in enumerate(found) for f in fs}


def test_batches_equal_the_scan(spark):
    rnd = random.Random(9)
    cases = [range(20), range(25), range(19), range(0), [i for i in range(60) if not 30 <= i < 35], [i for i in range(60) if not 30 <= i < 36], [i for i in range(90) if rnd.random() < 0.7]]
    for config in (BatchConfig(), BatchConfig(size=4, overlap=1, start_index=3, frame_limit=30)):
        for frames in cases:
            df = spark.createDataFrame([(f, 0.0) for f in frames], "frame_idx int, x double")
            assert {(r.batch_id, r.frame_idx) for r in batching.batches(df, config).collect()} == plain_batches(frames, config), (config, list(frames))
    with pytest.raises(ValueError):
        BatchConfig(size=5, overlap=5)


def test_streaming_state_equals_the_scan():
    config = BatchConfig(size=4, overlap=1)
    rnd = random.Random(1)
    for _ in range(50):
        frames = [i for i in range(80) if rnd.random() < 0.6]
        state, found = streaming.START, set()
        for a in range(0, len(frames), 7):
            state, more = streaming.advance(state, frames[a : a + 7], config)
            found |= set(more)
            assert len(state[3]) < config.size
        regular = plain_batches(frames, config)
        assert found <= regular and {b for b, _ in regular} - {b for b, _ in found} <= {max((b for b, _ in regular), default=0)}


def test_streaming_query(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", i) for i in range(25)], "dataset string, frame_idx int").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("dataset string, frame_idx int").parquet(str(source))
    query = streaming.sliding_batches(stream).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert spark.table("batches").count() == 20
    finally:
        query.stop()


def test_presentation(spark):
    lanes = flat(spark, {1: [(1, 1)], 2: [(3, 5)]})
    assert present.origin(lanes).first().x == 1.0
    moved = present.rebase(lanes, present.origin(lanes)).orderBy("lane_id").collect()
    assert (moved[1].x, moved[1].y) == (2.0, 4.0)
    turned = present.toggled(lanes, spark.createDataFrame([(1,), (2,), (2,)], "lane_id int"))
    assert {r.lane_id: r.explicit for r in turned.collect()} == {1: True, 2: True}
    row = present.lane_colours(spark.createDataFrame([(1,)], "lane_id int")).first()
    x = 2654435761
    for _ in range(2):
        x = ((x >> 16) ^ x) * 0x45D9F3B % 2**32
    assert row.hash == (x >> 16) ^ x


def test_candidates_of_crowded_ends_equal_all_pairs(spark):
    """Ends within one radius of each other, with single ends that have no finite direction or none at all."""
    import math

    import numpy as np

    from lanemill.config import LaneConfig
    from lanemill.operators.merge import facing_pairs, merge_candidates

    g = np.random.default_rng(3)
    for shift, degrees in ((0.0, 30.0), (5000.0, 30.0), (0.0, 50.0), (3e7, 30.0)):
        d = g.normal(size=(150, 3))
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        d[:2], d[2:4] = np.nan, 0
        x = g.uniform(-1, 1, (150, 3)) + shift
        rows = [(int(i // 2), bool(i % 2), *map(float, x[i]), *map(float, d[i])) for i in range(150)]
        ends = spark.createDataFrame(rows, "lane_id int, front boolean, x double, y double, z double, dx double, dy double, dz double")
        config = LaneConfig(direction_threshold_deg=degrees)
        found = {tuple(r)[:4] for r in merge_candidates(ends, config).collect()}
        f, t, want = x.astype(np.float32).astype(float), math.cos(math.radians(degrees)), set()
        near = 0
        for i in range(150):
            for j in range(150):
                link = x[j] - x[i]
                apart = math.sqrt(link @ link)
                if rows[i][0] < rows[j][0] and ((f[j] - f[i]) ** 2).sum() < 1.5**2 and apart > 0:
                    near += 1
                    u, v = (-d[k] if rows[k][1] else d[k] for k in (i, j))
                    angle = math.degrees(math.acos(min(abs(u @ v), 1)))
                    above = lambda c: math.isnan(c) or c > t  # noqa: E731  NaN is above all numbers, as in SQL
                    if above(u @ link / apart) and above(-(v @ link) / apart) and (math.isnan(angle) or angle <= degrees):
                        want.add((rows[i][0], rows[i][1], rows[j][0], rows[j][1]))
        assert found == want and want
        if shift == 0.0 and degrees == 30.0:  # the plain ends meet few others
            assert facing_pairs(ends.filter("dx <> 0 AND NOT isnan(dx)"), 1.5, degrees).count() < near / 2


def test_one_pass_equals_the_rounds(spark):
    import random

    from lanemill.operators.graph import connected_components, greedy_matching

    r = random.Random(4)
    rows = sorted({(r.randrange(60), r.random() < 0.5, r.randrange(60, 120), r.random() < 0.5) for _ in range(300)})
    edges = spark.createDataFrame([(*x, r.randrange(9) / 4) for x in rows], "id_a int, front_a boolean, id_b int, front_b boolean, score double")
    a, b = (sorted(map(tuple, greedy_matching(edges, few).collect())) for few in (0, 200_000))
    assert a == b and a
    pairs = spark.createDataFrame([(r.randrange(150), r.randrange(150)) for _ in range(80)], "a int, b int")
    a, b = (connected_components(pairs, few) for few in (0, 200_000))
    assert a.schema.simpleString() == b.schema.simpleString() and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
