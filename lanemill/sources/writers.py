"""Sinks for the binary map formats. Parquet, partitioned by frame or batch, is the native default.

A binary map is one file, so tasks write parts in order into a staging folder, and the commit copies
their bytes one after the other behind the header, in the driver. Files of single frames or
batches are written whole by the task that has their points. The target must be a path that
driver and executors share."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import codecs


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    count: int


class _Joined(DataSourceWriter):
    """Parts in order of their partition, behind a header that counts what they hold."""

    def __init__(self, path: str, header: str):
        self.path, self.header = path.removeprefix("file://"), header
        self.staging = f"{self.path}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.staging, exist_ok=True)

    def write(self, rows: Iterator) -> Part:
        name, count = f"{self.staging}/{uuid.uuid4().hex}", 0
        with open(name, "wb") as out:
            for row in rows:
                out.write(row["content"])
                count += row["count"]
        return Part(TaskContext.get().partitionId(), name, count)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        total = sum(m.count for m in parts)
        target = f"{self.staging}/joined"
        with open(target, "wb") as out:
            out.write(struct.pack("<I", total) if self.header == "lanes" else struct.pack("<IiI", 1, 0, total))
            for m in parts:
                with open(m.name, "rb") as part:
                    shutil.copyfileobj(part, out)
        os.replace(target, self.path)
        shutil.rmtree(self.staging)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class MapBin(DataSource):
    """Format ``map_bin``; rows are (content, count), option ``header`` is lanes or cloud."""

    @classmethod
    def name(cls) -> str:
        return "map_bin"

    def schema(self) -> str:
        return "content binary, count long"

    def writer(self, schema, overwrite: bool) -> _Joined:
        return _Joined(self.options["path"], self.options.get("header", "cloud"))


def write_lane_bin(flat: DataFrame, path: str) -> None:
    """Lanes in ascending id order: id, explicit and single-precision points; type and directions
    have no place in the format."""
    flat.sparkSession.dataSource.register(MapBin)
    point = F.struct("pos", *(F.col(c).cast("float").alias(c) for c in ("x", "y", "z")))
    lanes = flat.groupBy("lane_id").agg(F.first("explicit").alias("explicit"), F.array_sort(F.collect_list(point)).alias("p"))
    lanes = lanes.repartitionByRange("lane_id").sortWithinPartitions("lane_id")

    def run(frames):
        for frame in frames:
            content = [codecs.encode_lane(i, e, np.array([(q["x"], q["y"], q["z"]) for q in p], "<f4").reshape(-1, 3)) for i, e, p in zip(frame["lane_id"], frame["explicit"], frame["p"], strict=True)]
            yield frame.assign(content=content, count=1)[["content", "count"]]

    lanes.mapInPandas(run, "content binary, count long").write.format("map_bin").mode("append").option("header", "lanes").save(path)


def write_cloud_bin(cloud: DataFrame, path: str, order: tuple[str, ...] = ("frame_idx", "seq")) -> None:
    """One cluster of all points, in ``order``. An empty cloud makes no file."""
    if cloud.isEmpty():
        return
    cloud.sparkSession.dataSource.register(MapBin)
    rows = cloud.repartitionByRange(*order).sortWithinPartitions(*order).select(*(F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "intensity")))

    def run(frames):
        for frame in frames:
            yield frame.iloc[:1].assign(content=[codecs.encode_predictions(frame[["x", "y", "z", "intensity"]].to_numpy())], count=len(frame))[["content", "count"]]

    rows.mapInPandas(run, "content binary, count long").write.format("map_bin").mode("append").option("header", "cloud").save(path)


def write_cloud_files(cloud: DataFrame, folder: str, by: str, name: str, order: tuple[str, ...] = ("frame_idx", "seq")) -> int:
    """One cloud file ``<name>_<value>.bin`` for each value of ``by``, points in ``order``; the folder is
    emptied first. Returns the number of files. A task streams the points of its files in order and
    gives a file its name when it is whole, so an attempt that is lost leaves no half of one."""
    target = folder.removeprefix("file://")
    shutil.rmtree(target, ignore_errors=True)
    os.makedirs(target)
    rows = cloud.repartition(by).sortWithinPartitions(by, *order).select(F.col(by).alias("of"), *(F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "intensity")))

    def run(frames):
        of = out = own = None
        count = 0

        def finish():
            out.seek(0)
            out.write(struct.pack("<IiI", 1, 0, count))
            out.close()
            os.replace(own, f"{target}/{name}_{of}.bin")
            return pd.DataFrame({"file": [f"{name}_{of}.bin"]})

        for frame in frames:
            for value, points in frame.groupby("of", sort=False):
                if value != of:
                    if out:
                        yield finish()
                    of, count, own = value, 0, f"{target}/.{uuid.uuid4().hex}"
                    out = open(own, "wb")
                    out.write(struct.pack("<IiI", 1, 0, 0))
                out.write(codecs.encode_predictions(points[["x", "y", "z", "intensity"]].to_numpy()))
                count += len(points)
        if out:
            yield finish()

    return rows.mapInPandas(run, "file string").count()


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet, replaced as a whole; one folder per value of ``partition``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
