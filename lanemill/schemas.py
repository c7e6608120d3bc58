"""Schemas of the engine's tables."""

from __future__ import annotations

POINT = "struct<x: double, y: double, z: double, dx: double, dy: double, dz: double>"
LANES_FLAT = "lane_id int, type int, explicit boolean, pos bigint, x double, y double, z double, dx double, dy double, dz double"
LANES = f"lane_id int, type int, explicit boolean, points array<{POINT}>"
CLOUD = "frame_idx int, seq bigint, x float, y float, z float, intensity float"
POSES = "frame_idx int, frame_id string, x float, y float, z float, q0 float, q1 float, q2 float, q3 float"
TRANSFORMS = "target_frame string, source_frame string, m array<float>"
CANDIDATES = "id_a int, front_a boolean, id_b int, front_b boolean, score double"
BATCHES = "batch_id int, frame_idx int, seq bigint, x float, y float, z float, intensity float"
ROADGRAPH = (
    "`roadgraph_samples/id` array<int>, `roadgraph_samples/xyz` array<double>, `roadgraph_samples/dir` array<double>, "
    "`roadgraph_samples/valid` array<int>, `roadgraph_samples/type` array<int>, `roadgraph_samples/explicit` array<string>"
)
