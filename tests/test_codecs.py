import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from lanemill.sources import codecs, readers, writers

clouds = hnp.arrays(np.float32, st.tuples(st.integers(0, 6), st.just(4)), elements=st.floats(-1e6, 1e6, width=32))


@given(clouds)
@settings(deadline=None, max_examples=30)
def test_cloud_round_trip_and_size(points):
    data = codecs.encode_cloud(points)
    assert len(data) == 12 + 16 * len(points)
    assert np.array_equal(codecs.decode_cloud(data), points)


def test_lanes_round_trip_sorted_with_zero_layer():
    lanes = [(7, True, np.ones((2, 3))), (3, False, np.zeros((0, 3))), (-1, True, np.arange(9).reshape(3, 3))]
    data = codecs.encode_lanes(lanes)
    assert len(data) == 4 + sum(13 + 12 * len(p) for _, _, p in lanes)
    found = codecs.decode_lanes(data)
    assert [x[:3] for x in found] == [(-1, 0, True), (3, 0, False), (7, 0, True)]
    assert np.array_equal(found[0][3], np.arange(9).reshape(3, 3))


def test_truncated_files_are_refused():
    for data, decode in ((codecs.encode_cloud(np.ones((2, 4))), codecs.decode_cloud), (codecs.encode_lanes([(1, True, np.ones((2, 3)))]), codecs.decode_lanes)):
        for cut in (2, len(data) - 1):
            with pytest.raises(codecs.Truncated):
                decode(data[:cut])


def test_partial_prediction_is_ignored():
    points = np.arange(8, dtype="f4").reshape(2, 4)
    assert np.array_equal(codecs.decode_predictions(codecs.encode_predictions(points) + b"abc"), points)


def test_pcd_binary_and_ascii():
    xyz, intensity = np.array([[1.5, 2, 3], [4, 5, 6]]), np.array([0, 255])
    found = codecs.decode_pcd(codecs.encode_pcd(xyz, intensity))
    assert found["x"].tolist() == [1.5, 4] and found["intensity"].tolist() == [0, 255]
    text = b"# c\nVERSION .7\nFIELDS x y z intensity\nSIZE 4 4 4 1\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n1 2 3 9\n"
    assert codecs.decode_pcd(text)["intensity"].tolist() == [9]


def test_files_through_spark(spark, tmp_path):
    flat = spark.createDataFrame([(2, 6, True, 0, 1.0, 2.0, 3.0), (2, 6, True, 1, 4.0, 5.0, 6.0), (1, 7, False, 0, 0.0, 0.0, 0.0)], "lane_id int, type int, explicit boolean, pos long, x double, y double, z double")
    writers.write_lane_bin(flat, str(tmp_path / "points_seq_0.bin"))
    assert [x[:3] for x in codecs.decode_lanes((tmp_path / "points_seq_0.bin").read_bytes())] == [(1, 0, False), (2, 0, True)]
    rows = readers.read_lane_bin(spark, str(tmp_path)).orderBy("lane_id", "pos").collect()
    assert [(r.seq, r.lane_id, r.pos, r.x) for r in rows] == [(0, 1, 0, 0.0), (0, 2, 0, 1.0), (0, 2, 1, 4.0)]
    cloud = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 0.5), (0, 0, 9.0, 8.0, 7.0, 0.25)], "frame_idx int, seq long, x float, y float, z float, intensity float")
    (tmp_path / "c").mkdir()
    writers.write_cloud_bin(cloud, str(tmp_path / "c/frame_4.bin"))
    rows = readers.read_cloud_bin(spark, str(tmp_path / "c")).orderBy("seq").collect()
    assert [(r.frame_idx, r.seq, r.x) for r in rows] == [(4, 0, 9.0), (4, 1, 1.0)]
    for n in (0, 1, 3):
        (tmp_path / f"lidar_seq_{n}.bin").write_bytes(codecs.encode_cloud(np.zeros((0, 4))))
    assert sorted(r.number for r in readers.sequence_files(spark, str(tmp_path), "lidar_seq_").collect()) == [0, 1]


def test_poses_and_roadgraph(spark, tmp_path):
    good = '{"x":1,"y":2,"z":3,"q0":0,"q1":0,"q2":0,"q3":1}'
    for name, text in (("3.json", good), ("1.json", good.replace("{", '{"frame_id":"map",')), ("x.json", good), ("2.json", "{oops"), ("4.json", '{"x":1}')):
        (tmp_path / name).write_text(text)
    rows = readers.read_poses(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.frame_id) for r in rows] == [(1, "map"), (3, "world")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/0.json").write_text(
        '{"roadgraph_samples/id":[5,5],"roadgraph_samples/xyz":[1,2,3,4,5,6],"roadgraph_samples/dir":[1,0,0,1,0,0],"roadgraph_samples/valid":[1,0],"roadgraph_samples/type":[6,6],"roadgraph_samples/explicit":[true,false]}'
    )
    from lanemill.operators import ingest

    lanes = ingest.to_lanes(ingest.keep_samples(ingest.explode_samples(readers.read_roadgraph(spark, str(tmp_path / "r/0.json"))))).collect()
    assert [(r.lane_id, r.pos, r.x, r.explicit) for r in lanes] == [(5, 0, 1.0, True)]
