"""Sorted hash arrays in files: written range by range, mapped into memory, searched many keys at once.

A table is a number of segments, written one after the other. A segment deals its keys to buckets
by their upper bits and keeps the lower 32 bits sorted within each bucket, so an entry needs 4
bytes and its share of the bucket starts, and a key that is not there is taken for one that is
once in some 10^8 lookups. Values are small counts: one byte each, larger ones in a list beside.
"""

from __future__ import annotations

import os
import uuid

import numpy as np

from .textkit import mix

#: Entries of a bucket, on average.
FILL = 16
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
_BYTE = 255


def squeeze(values: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and (place, count) of those that a byte cannot hold, places counted from ``base``."""
    flat = np.ascontiguousarray(values).reshape(-1)
    large = np.flatnonzero(flat >= _BYTE)
    return np.minimum(flat, _BYTE).astype(np.uint8), np.column_stack([large + base, flat[large]]).astype(np.int64)


def stretch(low: np.ndarray, places: np.ndarray, large: np.ndarray) -> np.ndarray:
    """The counts at ``places`` again, from their bytes and the list of (place, count)."""
    found = low.astype(np.int64)
    more = np.flatnonzero(low == _BYTE)
    if len(more):
        found.reshape(-1)[more] = large[np.searchsorted(large[:, 0], places.reshape(-1)[more]), 1]
    return found


def save(path: str, array: np.ndarray) -> None:
    """Write an array whole or not at all; attempts of one task replace each other's equal file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        np.save(out, array)
    os.replace(own, path)


def mapped(path: str, kind: str) -> np.ndarray:
    if not os.path.getsize(path):
        return np.empty(0, kind)
    return np.asarray(np.memmap(path, kind, "r"))


class Files:
    """Raw files that grow and appear together under their names when they are closed."""

    def __init__(self, path: str, parts: tuple[str, ...]):
        self.path, self.own = path, uuid.uuid4().hex
        self.out = {p: open(f"{path}.{p}.{self.own}", "wb") for p in parts}

    def write(self, part: str, array: np.ndarray) -> None:
        self.out[part].write(np.ascontiguousarray(array).data)

    def close(self) -> None:
        for part, out in self.out.items():
            out.close()
            os.replace(f"{self.path}.{part}.{self.own}", f"{self.path}.{part}")


class TableWriter:
    def __init__(self, path: str, planes: int = 1):
        self.files, self.planes = Files(path, ("starts", "rest", "low", "large", "segments")), planes
        self.starts = self.entries = 0

    def add(self, segment: int, keys: np.ndarray, *values: np.ndarray) -> None:
        """The next segment; its keys are distinct."""
        h, n = mix(keys), max(1, len(keys) // FILL)
        bucket = ((h >> _HALF) * np.uint64(n)) >> _HALF
        joint = (bucket << _HALF) | (h & _LOW)
        order = np.argsort(joint)
        joint = joint[order]
        self.files.write("starts", np.searchsorted(joint, np.arange(n + 1, dtype=np.uint64) << _HALF).astype(np.uint32))
        self.files.write("rest", (joint & _LOW).astype(np.uint32))
        low, large = squeeze(np.column_stack(values)[order], self.entries * self.planes)
        self.files.write("low", low)
        self.files.write("large", large)
        self.files.write("segments", np.array([segment, self.starts, n, self.entries], np.int64))
        self.starts += n + 1
        self.entries += len(keys)

    def close(self) -> None:
        self.files.close()


class Table:
    """A written table, mapped; ``segments`` is the number of segments that there may be."""

    def __init__(self, path: str, segments: int, planes: int = 1):
        self.planes = planes
        self.first = np.zeros((3, segments), np.int64)  # starts, buckets and entries before it
        for k, *at in mapped(f"{path}.segments", "<i8").reshape(-1, 4):
            self.first[:, k] = at
        self.starts, self.rest = mapped(f"{path}.starts", "<u4"), mapped(f"{path}.rest", "<u4")
        self.low, self.large = mapped(f"{path}.low", "u1").reshape(-1, planes), mapped(f"{path}.large", "<i8").reshape(-1, 2)

    def find(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Values of the keys in their segments, a row each; zeros where there are none."""
        found = np.zeros((len(keys), self.planes), np.int64)
        if not len(self.rest):
            return found
        h = mix(keys)
        base, n, entry = self.first[:, segment]
        at = base + (((h >> _HALF) * n.astype(np.uint64)) >> _HALF).astype(np.int64)
        at = np.where(n > 0, at, 0)
        low, high = entry + self.starts[at], np.where(n > 0, entry + self.starts[np.minimum(at + 1, len(self.starts) - 1)], entry)
        rest, end, last = (h & _LOW).astype(np.uint32), high.copy(), len(self.rest) - 1
        width = int((high - low).max(initial=0))
        while width:
            middle = (low + high) >> 1
            less = (self.rest[np.minimum(middle, last)] < rest) & (low < high)
            low = np.where(less, middle + 1, low)
            high = np.where(less, high, middle)
            width >>= 1
        hit = np.flatnonzero((low < end) & (self.rest[np.minimum(low, last)] == rest))
        place = low[hit]
        found[hit] = stretch(self.low[place], place[:, None] * self.planes + np.arange(self.planes), self.large)
        return found
