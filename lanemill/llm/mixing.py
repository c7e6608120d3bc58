"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks in a hashed order. A source with quota q of the Q
slots of a frame gets, for its j-th block of a phase, release floor(j*Q/q) and deadline
ceil((j+1)*Q/q); each slot takes the released block with the earliest deadline. So after any
number of slots every source is within less than one block of its share. The frame is longer
than the run by a factor (``FINER``), so that rounding the weights to quotas moves no source by
more than one block in as many, however long the run; only the slots that the run fills are
scheduled, on the driver. When a source has no block left, a new phase begins with the quotas of
the others; all documents are placed, none is dropped or repeated.

The driver holds one number of 8 bytes for each block, half a byte a document; the slots travel
to the rows as a broadcast of the same size. Larger blocks (``block_docs``) make it smaller: at a
billion documents the default needs 500 MB, and blocks of 1024 documents 8 MB.

Defined cases: a null source is a source of its own; weights of unknown sources are ignored and
sources without a weight, or with a weight that is not positive, come last in their natural
proportions; rows without an id are placed by a hash of their columns; rows with the same id keep
any order among themselves; an empty table gives an empty result; extra columns are carried,
whatever their names.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, shared_table, shuffle_partitions

#: Documents in a block.
BLOCK_DOCS = 16
#: Slots of a frame, at least, and for each block of the run.
FRAME, FINER = 1000, 4096
#: Blocks of a source whose slots travel in one row.
CHUNK = 1024
#: Without target weights, a source's weight is its number of documents to this power.
ALPHA = 0.7


def quotas(weights: dict[str, float], frame: int = FRAME) -> dict[str, int]:
    """Whole slots of a frame for each weight, by largest remainders, one at least."""
    frame = max(frame, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: w * frame / total for s, w in weights.items()}
    found = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, frame - sum(found.values()))]:
        found[s] += 1
    return found


def due(quota: dict[str, int]) -> Iterator[str]:
    """The source of each slot in turn: of the released blocks, the one with the earliest deadline."""
    size = sum(quota.values())
    done = dict.fromkeys(quota, 0)
    pending, ready = [(0, s) for s in sorted(quota)], []
    for t in range(size):
        while pending and pending[0][0] <= t:
            _, s = heapq.heappop(pending)
            heapq.heappush(ready, (-(-(done[s] + 1) * size // quota[s]), s))
        _, s = heapq.heappop(ready)
        done[s] += 1
        if done[s] < quota[s]:
            heapq.heappush(pending, (done[s] * size // quota[s], s))
        yield s


def frame_slots(quota: dict[str, int]) -> dict[str, list[int]]:
    """The slots of one frame that each source's blocks get, earliest deadline first."""
    slots: dict[str, list[int]] = {s: [] for s in quota}
    for t, s in enumerate(due(quota)):
        slots[s].append(t)
    return slots


@dataclass
class Phase:
    base: int  # slots before this phase
    size: int  # slots of a frame
    quota: dict[str, int]
    first: dict[str, int]  # blocks of each source before this phase
    slots: dict[str, array]  # of each source's blocks in this phase


def phases(blocks: dict[str, int], weights: dict[str, float], frame: int = FRAME) -> list[Phase]:
    """The schedule of all blocks; in each phase but the last, one source or more comes to its end."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    found, base = [], 0
    while left:
        wanted = {s: weights[s] for s in left if weights.get(s, 0) > 0} or {s: float(n) for s, n in left.items()}
        n = sum(left.values())
        # Releases and deadlines are computed in 64 bits, as products of a block's number and the frame.
        quota = quotas(wanted, max(frame, n * max(1, min(FINER, 2**62 // n**2))))
        phase = Phase(base, sum(quota.values()), quota, {s: done[s] for s in quota}, {s: array("q") for s in quota})
        for t, s in enumerate(due(quota), base):
            phase.slots[s].append(t)
            if len(phase.slots[s]) == left[s]:
                base = t + 1
                break
        for s, slots in phase.slots.items():
            done[s] += len(slots)
            left[s] -= len(slots)
        found.append(phase)
        left = {s: n for s, n in left.items() if n > 0}
    return found


def _hashed(df: DataFrame) -> Column:
    """A number in [0, 1) from the id; rows without an id are spread by all that they hold. Two passes
    over the same rows, or a repeated task, give the same numbers."""
    others = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    return F.xxhash64(F.lit(11), F.when(F.col("doc_id").isNull(), others).otherwise(F.xxhash64("doc_id"))) / F.lit(2.0**64) + 0.5


def schedule(df: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, frame: int = FRAME, alpha: float = ALPHA) -> DataFrame:
    """``df`` with ``__lm_block`` (number within its source), ``__lm_place`` (within its block),
    ``__lm_phase``, ``__lm_release``, ``__lm_slot`` and ``__lm_deadline``. Slot and place order the mix."""
    spark = df.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    # The hashed order within a source, found by buckets so that no task holds a whole source.
    n_buckets = 4 * shuffle_partitions(df)
    keyed = df.withColumn("__lm_source", key).withColumn("__lm_rank", _hashed(df))
    keyed = keyed.withColumn("__lm_bucket", F.floor(F.col("__lm_rank") * n_buckets))
    sizes = shared_table(spark, keyed.groupBy("__lm_source", "__lm_bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    upto = Window.partitionBy("__lm_source").orderBy("__lm_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.select(F.col("__lm_source").alias("s"), F.col("__lm_bucket").alias("b"), (F.sum("n").over(upto) - F.col("n")).alias("before"))
    totals = {r["__lm_source"]: r["n"] for r in sizes.groupBy("__lm_source").agg(F.sum("n").alias("n")).collect()}
    if weights is None:
        wanted = {s: n**alpha for s, n in totals.items()}
    else:
        wanted = {"null" if s is None else f"={s}": w for s, w in weights.items()}
    plan = phases({s: -(-n // block_docs) for s, n in totals.items()}, wanted, frame)
    rows = []
    for k, phase in enumerate(plan):
        for s, slots in phase.slots.items():
            first, end = phase.first[s], phase.first[s] + len(slots)
            for chunk in range(first // CHUNK, -(-end // CHUNK)):
                low, high = max(first, chunk * CHUNK), min(end, (chunk + 1) * CHUNK)
                rows.append((s, chunk, k, first, low, high, phase.base, phase.size, phase.quota[s], slots[low - first : high - first].tolist()))
    del plan
    table = spark.createDataFrame(
        rows, "p_source string, p_chunk long, p_phase int, p_first long, p_low long, p_high long, p_base long, p_size long, p_quota long, p_slots array<long>"
    )
    within = Window.partitionBy("__lm_source", "__lm_bucket").orderBy("__lm_rank", "doc_id")
    numbered = keyed.withColumn("__lm_row", F.row_number().over(within) - 1).join(F.broadcast(before) if len(totals) * n_buckets < 100_000 else before, (F.col("s") == F.col("__lm_source")) & (F.col("b") == F.col("__lm_bucket")))
    index = F.col("before") + F.col("__lm_row")
    numbered = numbered.withColumn("__lm_block", (index / block_docs).cast("long")).withColumn("__lm_place", (index % block_docs).cast("int"))
    on = (F.col("p_source") == F.col("__lm_source")) & (F.col("p_chunk") == F.floor(F.col("__lm_block") / CHUNK))
    on &= (F.col("__lm_block") >= F.col("p_low")) & (F.col("__lm_block") < F.col("p_high"))
    released = "p_base + ((__lm_block - p_first) * p_size) div p_quota"
    deadline = "p_base + ((__lm_block - p_first + 1) * p_size + p_quota - 1) div p_quota"
    return numbered.join(F.broadcast(table), on).select(
        *(F.col(c) for c in df.columns),
        "__lm_block",
        "__lm_place",
        F.col("p_phase").alias("__lm_phase"),
        F.expr(released).alias("__lm_release"),
        F.element_at("p_slots", (F.col("__lm_block") - F.col("p_low") + 1).cast("int")).alias("__lm_slot"),
        F.expr(deadline).alias("__lm_deadline"),
    )


def mixed(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows and columns of ``df`` in the order of the mix."""
    return schedule(df, weights).repartitionByRange(shuffle_partitions(df), "__lm_slot", "__lm_place").sortWithinPartitions("__lm_slot", "__lm_place").select(*df.columns)


def positioned(df: DataFrame) -> DataFrame:
    """``df``, read from files that ``mixed`` rows were written to, with ``__lm_position``: the place of
    each row in the mix, from 0. Files are numbered in the order of the mix and hold their rows in it;
    rows that come from no file have no position (null)."""
    try:
        rows = df.select(*df.columns, F.col("_metadata.file_name").alias("__lm_file"), F.col("_metadata.row_index").alias("__lm_index"))
    except AnalysisException:
        return df.withColumn("__lm_position", F.lit(None).cast("long"))
    number = F.regexp_extract("__lm_file", r"part-(\d+)", 1).try_cast("long")
    # As many rows as files.
    files = rows.groupBy("__lm_file").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(number, "__lm_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = files.select("__lm_file", (F.sum("n").over(upto) - F.col("n")).alias("__lm_begin"))
    found = rows.join(F.broadcast(begins), "__lm_file")
    return found.select(*df.columns, (F.col("__lm_begin") + F.col("__lm_index")).alias("__lm_position"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schedule(documents(spark, sf_dir).select("doc_id", "source"))
    names = ("block", "place", "phase", "release", "slot", "deadline")
    return found.select("doc_id", "source", *(F.col(f"__lm_{n}").alias(n) for n in names))
