"""The jobs end to end, from files to files."""

import json

import numpy as np
import pytest

from lanemill.config import BatchConfig
from lanemill.plans import jobs, pipelines
from lanemill.sources import codecs


def test_lanes_from_json_to_files(spark, tmp_path):
    ids, xyz = [], []
    for lane, xs in ((1, [0, 2, 1]), (2, [3.2, 4]), (3, [100, 101])):
        for x in xs:
            ids.append(lane)
            xyz += [x, 0, 0]
    n = len(ids)
    rows = {"id": ids, "xyz": xyz, "dir": [1, 0, 0] * n, "valid": [1] * n, "type": [6] * n, "explicit": [True] * n}
    (tmp_path / "0.json").write_text(json.dumps({f"roadgraph_samples/{k}": v for k, v in rows.items()}))
    found = jobs.lanes_job(spark, str(tmp_path / "0.json"), str(tmp_path / "out"))
    assert [found[s].count() for s in jobs.SNAPSHOTS] == [7, 7, 7, 7]
    merged = codecs.decode_lanes((tmp_path / "out/points_seq_3.bin").read_bytes())
    assert [(x[0], x[3][:, 0].round(1).tolist()) for x in merged] == [(1, [0, 1, 2, pytest.approx(3.2, abs=1e-5), 4]), (3, [100, 101])]
    view = pipelines.viewer(found["merged"], 3).orderBy("lane_id", "pos").first()
    assert (view.marker, view.x, view.scale) == ("seq_3/1", 0.0, 0.5)


def test_frames_and_batches(spark, tmp_path):
    for name in ("poses", "pcd", "pred"):
        (tmp_path / name).mkdir()
    for i in range(24):
        pose = {"x": float(i), "y": 0, "z": 0, "q0": 0, "q1": 0, "q2": 0, "q3": 1}
        (tmp_path / f"poses/{i}.json").write_text(json.dumps(pose))
        (tmp_path / f"pred/{i}.bin").write_bytes(codecs.encode_predictions(np.array([[1, 2, 3, -0.5]])))
        if i % 2:
            (tmp_path / f"pcd/{i}.pcd").write_bytes(codecs.encode_pcd(np.array([[1.0, 0, 0]]), np.array([255])))
    (tmp_path / "poses/99.json").write_text(json.dumps({"frame_id": "nowhere", "x": 0, "y": 0, "z": 0, "q0": 0, "q1": 0, "q2": 0, "q3": 1}))
    identity = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    transforms = spark.createDataFrame([("base_link", "pandar64_0", identity)], "target_frame string, source_frame string, m array<float>")
    found = jobs.frames_job(spark, *(str(tmp_path / n) for n in ("poses", "pcd", "pred")), transforms, str(tmp_path / "out"))
    clouds = {r.frame_idx: (r.x, r.intensity) for r in found["clouds"].collect()}
    assert clouds == {i: (1.0 + i, 1.0) for i in range(24) if i % 2}
    assert found["predictions"].filter("abs(intensity - 2.6415927) < 1e-6").count() == 24
    assert len(codecs.decode_cloud((tmp_path / "out/lidar_seq_1.bin").read_bytes())) == 24
    batches = jobs.batches_job(spark, found["predictions"], str(tmp_path / "out"), BatchConfig(size=8, overlap=2))
    sizes = {r.batch_id: r["count"] for r in batches.groupBy("batch_id").count().collect()}
    assert sizes == {0: 8, 1: 8, 2: 8, 3: 8}
    jobs.batch_file(batches, 1, str(tmp_path / "batch_1.bin"))
    assert len(codecs.decode_cloud((tmp_path / "batch_1.bin").read_bytes())) == 8


def test_settings_from_a_file_and_from_names(tmp_path):
    from lanemill import config

    path = tmp_path / "p.yaml"
    path.write_text("# paths\npred_folder: \"nms#1/\"  # quoted\ncrop_mode: true\noverlap_radius: 0.4\nlinearity_tolerance: 0.02\nvehicle_frame: 'car'\nbatch_size: 8\noverlap_size: 2\nstart_index: 7\n")
    s = config.settings({"search_radius": 2}, config.read_settings(str(path)))
    assert (s.pred_folder, s.lane.crop, s.lane.overlap_radius, s.lane.search_radius) == ("nms#1", True, 0.4, 2.0)
    assert (s.frame.vehicle_frame, s.batch.size, s.batch.overlap, s.batch.start_index) == ("car", 8, 2, 7)
    for bad in ({"gone": 1}, {"crop_mode": 3}, {"batch_size": 2, "overlap_size": 2}):
        with pytest.raises(ValueError):
            config.settings(bad)


def test_all_jobs_of_one_index_and_what_a_viewer_shows(spark, tmp_path):
    from lanemill.config import settings
    from lanemill.sources import readers
    from lanemill.sources.layout import Layout

    layout = Layout(str(tmp_path), 3, settings({"batch_size": 4, "overlap_size": 1, "start_index": 3}))
    for folder in (layout.poses, layout.pcd, layout.predictions, layout.roadgraph.rsplit("/", 1)[0]):
        (tmp_path / folder).mkdir(parents=True)
    rows = {"id": [1, 1, 2, 2], "xyz": [float(x) for x in range(12)], "dir": [1, 0, 0] * 4, "valid": [1] * 4, "type": [6] * 4, "explicit": [True, True, False, False]}
    (tmp_path / layout.roadgraph).write_text(json.dumps({f"roadgraph_samples/{k}": v for k, v in rows.items()}))
    for i in range(6):
        (tmp_path / layout.pose(i)).write_text(json.dumps({"x": 0, "y": 0, "z": 0, "q0": 0, "q1": 0, "q2": 0, "q3": 1}))
        (tmp_path / layout.prediction(i)).write_bytes(codecs.encode_predictions(np.array([[i, 2, 3, 4.0], [i, 2, 4, 4.0]])))
        (tmp_path / layout.scan(i)).write_bytes(codecs.encode_pcd(np.array([[i, 0.0, 0]]), np.array([51])))
    identity = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    transforms = spark.createDataFrame([("base_link", "pandar64_0", identity)], "target_frame string, source_frame string, m array<float>")
    found = jobs.run_all(spark, layout, transforms)
    assert {r.name: (r.lanes, r.points) for r in found["lane_counters"].collect()} == dict.fromkeys(jobs.SNAPSHOTS, (2, 4))
    assert tuple(found["frame_counters"].first()) == (6, 6)
    # A frame's file and a batch's file hold its points in order; batches by number: 0 to 3, and the last four frames.
    assert codecs.decode_cloud((tmp_path / layout.frame(5)).read_bytes())[:, 2].tolist() == [3, 4]
    assert [codecs.decode_cloud((tmp_path / layout.batch(b)).read_bytes())[::2, 0].tolist() for b in (0, 1)] == [[0, 1, 2, 3], [2, 3, 4, 5]]
    assert not readers.exists(spark, layout.batch(2)) and readers.exists(spark, layout.cloud(1))
    assert readers.read_frame_files(spark, layout.frames).count() == 12
    shown = jobs.view(spark, layout)
    assert {r.topic for r in shown["lanes"].collect()} == {f"lane_viz/seq_{k}" for k in range(4)}
    clouds = {r.topic: r.intensity for r in shown["clouds"].collect()}
    assert clouds == {"lidar_viz/seq_0": pytest.approx(0.2), "lidar_viz/seq_1": pytest.approx(4 - np.pi, abs=1e-5)}
    assert shown["animation"].groupBy("batch_id").count().count() == 2
    (tmp_path / layout.cloud(0)).rename(tmp_path / layout.cloud(2))  # a gap ends the sequence
    assert readers.read_lidar_sequence(spark, layout.out).count() == 0
    assert jobs.view(spark, Layout(str(tmp_path), 4)) == {}


def test_ingest_ends_at_a_flag_that_is_no_boolean(spark, tmp_path):
    from lanemill.operators import ingest
    from lanemill.sources import readers

    rows = {"id": [1, 1, 2, 3, 1], "xyz": [0.0] * 15, "dir": [0.0] * 15, "valid": [1] * 5, "type": [6, 6, 7, 6, 6], "explicit": [True, 5, False, "x", True]}
    for name, flags, kept in (("a", rows["explicit"], 3), ("b", [True, 5, False, True, True], 5), ("c", [1, True, True, True, True], 0)):
        (tmp_path / f"{name}.json").write_text(json.dumps({f"roadgraph_samples/{k}": flags if k == "explicit" else v for k, v in rows.items()}))
        found = ingest.keep_samples(ingest.explode_samples(readers.read_roadgraph(spark, str(tmp_path / f"{name}.json"))))
        assert found.count() == kept and dict(found.dtypes)["explicit"] == "boolean"


def test_streamed_frames_end_with_the_final_batch(spark, tmp_path):
    from lanemill.operators import batching
    from lanemill.sources import readers
    from lanemill.streaming import frames

    for numbers in ([*range(11)], [*range(10)], [0, 1, 2, 4, 5, 9, 10, 11, 12, 14], [0, 1], [], [0, 1, 2, 3, 30, 31]):
        for config in (BatchConfig(4, 1, start_index=3), BatchConfig(5, 0, start_index=0), BatchConfig(4, 3)):
            state, found = frames.START, []
            for f in numbers:
                state, more = frames.advance(state, [f], config)
                found += more
            df = spark.createDataFrame([(f,) for f in numbers], "frame_idx int")
            if config.overlap == 1:
                want = batching.batches(df, config).select("batch_id", "frame_idx").collect()
                assert sorted(found + frames.final(state, config)) == sorted(map(tuple, want)), (numbers, config)
    folder = tmp_path / "frames"
    folder.mkdir()
    for i in range(6):
        (folder / f"frame_{i}.bin").write_bytes(codecs.encode_cloud(np.zeros((1, 4))))
    (folder / "other.bin").write_bytes(b"")
    stream = frames.sliding_batches(readers.tail_frames(spark, str(folder), "d"), BatchConfig(4, 1))
    query = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.frame_idx for r in spark.table("tailed").collect()) == [0, 1, 2, 3]
