"""Structured Streaming forms of batching, toggles and playback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import BatchConfig

STATE = "seen long, last int, stopped boolean, buffer array<int>, closing int, recent array<int>"
START = (0, -1, False, [], -1, [])
OUTPUT = "dataset string, batch_id int, frame_idx int"


def advance(state: tuple, frames: list[int], config: BatchConfig) -> tuple[tuple, list[tuple[int, int]]]:
    """State after more frame numbers, and the (batch_id, frame_idx) of batches they complete.

    The state holds the frames since the last batch's overlap and the last frames by number: less than
    two batches."""
    seen, last, stopped, buffer, closing, recent = state
    found = []
    for frame in sorted(set(frames)):
        if stopped or frame <= last:
            continue
        if frame - last - 1 > config.max_misses or last >= config.start_index + config.frame_limit:
            stopped = True
            continue
        last, seen = frame, seen + 1
        recent = [f for f in recent if f > frame - config.size] + [frame]
        buffer = [*buffer, frame]
        if len(buffer) >= config.size:
            batch = (seen - config.size) // config.slide
            found += [(batch, f) for f in buffer]
            closing, buffer = frame, buffer[config.slide :]
    return (seen, last, stopped, buffer, closing, recent), found


def final(state: tuple, config: BatchConfig) -> list[tuple[int, int]]:
    """(batch_id, frame_idx) of the batch that ends with the last frame, by frame number; empty if the
    last regular batch reaches as far."""
    seen, last, _, _, closing, recent = state
    begin = last - config.size + 1 if last >= config.size - 1 else config.start_index
    saved = closing - config.size + 1 if closing >= 0 else -1
    number = (seen - config.size) // config.slide + 1 if seen >= config.size else 0
    return [(number, f) for f in recent if f >= begin] if last >= 0 and begin > saved else []


def sliding_batches(frames: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    """Streaming (dataset, batch_id, frame_idx) from a stream of (dataset, frame_idx) that brings each
    dataset's frames in ascending order of micro-batches. Late frames are passed over, like a scan
    that has moved on. A row without a frame number says that the dataset has ended: its final batch
    is given, and frames after it are passed over."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else START
        now = (*now[:3], list(now[3]), now[4], list(now[5]))
        numbers = [f for r in rows for f in r["frame_idx"]]
        ended = any(pd.isna(f) for f in numbers)
        now, found = advance(now, [int(f) for f in numbers if not pd.isna(f)], config)
        if ended and now[5]:
            found += final(now, config)
            now = (now[0], now[1], True, [], now[4], [])
        state.update(now)
        yield pd.DataFrame([(key[0], b, f) for b, f in found], columns=["dataset", "batch_id", "frame_idx"])

    return frames.groupBy("dataset").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def toggle_parity(events: DataFrame) -> DataFrame:
    """Streaming (lane_id, odd): whether a lane's flag is turned; for complete or update mode."""
    return events.groupBy("lane_id").agg((F.count(F.lit(1)) % 2 == 1).alias("odd"))


def playback_ticks(spark: SparkSession, n_batches: int, rows_per_second: int = 1) -> DataFrame:
    """Streaming (tick, batch_id) at a fixed rate, round and round."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("value").alias("tick"), F.pmod("value", F.lit(max(n_batches, 1))).alias("batch_id"))
