"""Binary formats as pure functions over bytes. All numbers are little-endian.

* lanes: u32 count; per lane i32 id, i32 layer (always 0), u8 explicit, u32 n, n x 3 float32
* cloud: u32 clusters; per cluster i32 id, u32 n, n x 4 float32 (x, y, z, intensity)
* predictions: 4 float32 (x, y, z, theta) each, no header; a partial last record is ignored
* PCD: text header, then ascii or binary points; fields x, y, z and intensity
"""

from __future__ import annotations

import struct

import numpy as np


class Truncated(ValueError):
    """A file ends before the points that its header announces."""


def _take(data: bytes, at: int, fmt: str) -> tuple:
    size = struct.calcsize(fmt)
    if at + size > len(data):
        raise Truncated(f"{at + size} bytes announced, {len(data)} there")
    return struct.unpack_from(fmt, data, at)


def _points(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    if at + 4 * width * n > len(data):
        raise Truncated(f"{at + 4 * width * n} bytes announced, {len(data)} there")
    return np.frombuffer(data, "<f4", width * n, at).reshape(n, width)


def encode_lane(lane_id: int, explicit: bool, xyz: np.ndarray) -> bytes:
    return struct.pack("<iiBI", lane_id, 0, bool(explicit), len(xyz)) + np.ascontiguousarray(xyz, "<f4").tobytes()


def encode_lanes(lanes: list[tuple[int, bool, np.ndarray]]) -> bytes:
    """Lanes in ascending order of their ids."""
    return struct.pack("<I", len(lanes)) + b"".join(encode_lane(*x) for x in sorted(lanes, key=lambda x: x[0]))


def decode_lanes(data: bytes) -> list[tuple[int, int, bool, np.ndarray]]:
    """(id, layer, explicit, points) of every lane."""
    (count,) = _take(data, 0, "<I")
    at, found = 4, []
    for _ in range(count):
        lane_id, layer, explicit, n = _take(data, at, "<iiBI")
        at += 13
        found.append((lane_id, layer, bool(explicit), _points(data, at, n, 3)))
        at += 12 * n
    return found


def encode_cloud(points: np.ndarray) -> bytes:
    """One cluster with id 0."""
    return struct.pack("<IiI", 1, 0, len(points)) + np.ascontiguousarray(points, "<f4").tobytes()


def decode_cloud(data: bytes) -> np.ndarray:
    """Points of all clusters; their ids are dropped."""
    (count,) = _take(data, 0, "<I")
    at, found = 4, [np.empty((0, 4), "<f4")]
    for _ in range(count):
        _, n = _take(data, at, "<iI")
        at += 8
        found.append(_points(data, at, n, 4))
        at += 16 * n
    return np.concatenate(found)


def decode_predictions(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4", len(data) // 16 * 4).reshape(-1, 4)


def encode_predictions(points: np.ndarray) -> bytes:
    return np.ascontiguousarray(points, "<f4").tobytes()


_NUMPY = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4"}


def decode_pcd(data: bytes) -> np.ndarray:
    """Structured rows with at least x, y, z, intensity."""
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise Truncated("no DATA line")
        words = data[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            head[words[0]] = words[1:]
    names, n = head["FIELDS"], int(head["POINTS"][0])
    kind = np.dtype([(f, _NUMPY[t, int(s)]) for f, t, s in zip(names, head["TYPE"], head["SIZE"], strict=True)])
    if head["DATA"][0] == "ascii":
        rows = [tuple(line.split()) for line in data[at:].decode("ascii").splitlines() if line.strip()]
        found = np.array([tuple(float(v) for v in r) for r in rows[:n]], [(f, "f8") for f in names]).astype(kind)
    elif head["DATA"][0] == "binary":
        if at + n * kind.itemsize > len(data):
            raise Truncated(f"{n} points announced")
        found = np.frombuffer(data, kind, n, at)
    else:
        raise ValueError(f"PCD data of kind {head['DATA'][0]} is not read")
    if len(found) < n:
        raise Truncated(f"{n} points announced, {len(found)} there")
    return found


def encode_pcd(xyz: np.ndarray, intensity: np.ndarray) -> bytes:
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "u1")])
    rows = np.empty(len(xyz), kind)
    rows["x"], rows["y"], rows["z"], rows["intensity"] = xyz[:, 0], xyz[:, 1], xyz[:, 2], intensity
    n = len(rows)
    head = f"VERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 1\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    return head.encode() + rows.tobytes()
