"""Equi-joins whose hot keys are dealt out to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that share a hot key, and the most keys that count as hot at once.
WAYS, MOST_HOT = 64, 10_000
#: Rows of a key below which it is never worth dealing out.
LEAST_HOT = 2_000


def hot_keys(sizes: DataFrame, key: str, total: int, size: str = "size") -> DataFrame:
    """The keys with so large a share of ``total`` rows that at most ``MOST_HOT`` can have it."""
    return sizes.filter(F.col(size) >= max(LEAST_HOT, total // MOST_HOT)).select(key)


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``; rows of ``left`` with one of the keys in ``hot`` are
    dealt to ``WAYS`` tasks by their other columns, and rows of ``right`` with such a key are copied
    to each of them. ``hot`` is broadcast: it must come from ``hot_keys``, which bounds it."""
    marked = hot.select(key).distinct().withColumn("__hot", F.lit(True))
    others = [c for c in left.columns if c != key]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*others), F.lit(WAYS))).otherwise(0).cast("int")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(F.broadcast(marked), key, "left").withColumn("__salt", salt).drop("__hot")
    b = right.join(F.broadcast(marked), key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return a.join(b, [key, "__salt"], how).drop("__salt")
