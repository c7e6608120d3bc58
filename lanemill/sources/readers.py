"""Sources. Files are read by Spark, from any store it knows, and decoded in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions.geometry import normalise_theta, stem_index
from . import codecs


def read_roadgraph(spark: SparkSession, path: str) -> DataFrame:
    """Roadgraph JSON objects with their six parallel arrays."""
    return spark.read.schema(schemas.ROADGRAPH).json(path, multiLine=True)


def read_poses(spark: SparkSession, path: str, default_frame: str = "world") -> DataFrame:
    """One pose per JSON file whose stem is a number; files that are no pose are left out."""
    kind = "frame_id string, x float, y float, z float, q0 float, q1 float, q2 float, q3 float, _corrupt string"
    rows = spark.read.schema(kind).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True, pathGlobFilter="*.json")
    rows = rows.select(stem_index(F.col("_metadata.file_path")).alias("frame_idx"), "*")
    rows = rows.filter("frame_idx IS NOT NULL AND _corrupt IS NULL AND x + y + z + q0 + q1 + q2 + q3 IS NOT NULL")
    return rows.withColumn("frame_id", F.coalesce("frame_id", F.lit(default_frame))).drop("_corrupt")


def _decoded(spark: SparkSession, path: str, pattern: str, rows_of: Callable[[bytes], pd.DataFrame], columns: str) -> DataFrame:
    files = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=True).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = rows_of(bytes(content))
                rows.insert(0, "path", name)
                yield rows

    return files.mapInPandas(run, f"path string, {columns}")


def _cloud_rows(points) -> pd.DataFrame:
    rows = pd.DataFrame(points, columns=["x", "y", "z", "intensity"])
    rows.insert(0, "seq", range(len(rows)))
    return rows


def _numbered(rows: DataFrame, name: str = "frame_idx") -> DataFrame:
    """The number at the end of the file's stem instead of its path."""
    number = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).try_cast("int")
    return rows.select(number.alias(name), *(c for c in rows.columns if c != "path")).filter(F.col(name).isNotNull())


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """PCD frames; the intensity is the byte as it is."""

    def rows_of(content: bytes) -> pd.DataFrame:
        p = codecs.decode_pcd(content)
        rows = pd.DataFrame({"x": p["x"].astype("f4"), "y": p["y"].astype("f4"), "z": p["z"].astype("f4"), "intensity": p["intensity"].astype("i2")})
        rows.insert(0, "seq", range(len(rows)))
        return rows

    return _numbered(_decoded(spark, path, "*.pcd", rows_of, "seq long, x float, y float, z float, intensity short"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless prediction frames: x, y, z, theta."""
    rows = _decoded(spark, path, "*.bin", lambda b: _cloud_rows(codecs.decode_predictions(b)), "seq long, x float, y float, z float, intensity float")
    return _numbered(rows).withColumnRenamed("intensity", "theta")


def read_cloud_bin(spark: SparkSession, path: str, number: str = "frame_idx", pattern: str = "*.bin") -> DataFrame:
    """Cloud files (frames, global clouds, batches), all clusters together."""
    return _numbered(_decoded(spark, path, pattern, lambda b: _cloud_rows(codecs.decode_cloud(b)), "seq long, x float, y float, z float, intensity float"), number)


def read_lidar_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """The global clouds lidar_seq_0.bin, lidar_seq_1.bin, ... up to the first that is missing, their
    intensity taken as an angle and brought to [0, pi)."""
    rows = _in_sequence(spark, read_cloud_bin(spark, folder, "number", "lidar_seq_*.bin"), folder, "lidar_seq_")
    return rows.withColumn("intensity", normalise_theta(F.col("intensity").cast("double")).cast("float"))


def read_lane_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """The lane snapshots points_seq_0.bin, points_seq_1.bin, ... up to the first that is missing."""
    rows = read_lane_bin(spark, folder).withColumnRenamed("seq", "number")
    return _in_sequence(spark, rows, folder, "points_seq_")


def read_batch_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """The batches batch_0.bin, batch_1.bin, ... up to the first that is missing."""
    return _in_sequence(spark, read_cloud_bin(spark, folder, "number", "batch_*.bin"), folder, "batch_")


def read_frame_files(spark: SparkSession, folder: str) -> DataFrame:
    """Converted frames frame_<i>.bin."""
    return read_cloud_bin(spark, folder, pattern="frame_*.bin")


def _in_sequence(spark: SparkSession, rows: DataFrame, folder: str, prefix: str) -> DataFrame:
    # As many rows as files.
    return rows.join(F.broadcast(sequence_files(spark, folder, prefix).select("number")), "number")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def tail_frames(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """Streaming (dataset, frame_idx) of the frame files that appear in a folder, for sliding batches."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "frame_*.bin").load(folder)
    number = F.regexp_extract("path", r"frame_(\d+)\.bin$", 1).try_cast("int")
    return files.select(F.lit(dataset).alias("dataset"), number.alias("frame_idx")).filter("frame_idx IS NOT NULL")


def read_lane_bin(spark: SparkSession, path: str) -> DataFrame:
    """Lane files: seq, lane_id, layer, explicit, pos, x, y, z."""

    def rows_of(content: bytes) -> pd.DataFrame:
        parts = [pd.DataFrame({"lane_id": i, "layer": layer, "explicit": explicit, "pos": range(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}) for i, layer, explicit, p in codecs.decode_lanes(content)]
        empty = pd.DataFrame(columns=["lane_id", "layer", "explicit", "pos", "x", "y", "z"])
        return pd.concat(parts) if parts else empty

    columns = "lane_id int, layer int, explicit boolean, pos long, x float, y float, z float"
    return _numbered(_decoded(spark, path, "points_seq_*.bin", rows_of, columns), "seq")


def sequence_files(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(number, path) of the files ``prefix``0.bin, ``prefix``1.bin, ... up to the first that is missing."""
    files = spark.read.format("binaryFile").options(pathGlobFilter=f"{prefix}*.bin", recursiveFileLookup=True).load(path).select("path")
    numbered = files.select(F.regexp_extract("path", rf"{prefix}(\d+)\.bin$", 1).try_cast("int").alias("number"), "path").filter("number IS NOT NULL")
    return numbered.withColumn("place", F.row_number().over(Window.orderBy("number")) - 1).filter("number = place").drop("place")
