"""Connected components and greedy matching as rounds of joins; nothing is collected. What is left when
it is few rows takes one sequential pass in one task, as a round of joins costs more than that."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Most rows that one task takes in one pass.
FEW = 200_000


def _components(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of all edges (u, v) in one pass."""
    of: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := of.setdefault(x, x)) != x:
            of[x] = of[up]
            x = up
        return x

    for part in parts:
        for u, v in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
            low, high = sorted((root(u), root(v)))
            of[high] = low
    yield pd.DataFrame({"id": list(of), "component": [root(x) for x in of]})


def _matched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy matching of all candidates in one pass."""
    found = [p for p in parts if len(p)]
    if not found:
        return
    rows = pd.concat(found).sort_values(["score", "id_a", "front_a", "id_b", "front_b"])
    busy, kept = set(), []
    for a, b in zip(zip(rows["id_a"], rows["front_a"], strict=True), zip(rows["id_b"], rows["front_b"], strict=True), strict=True):
        kept.append(a not in busy and b not in busy)
        if kept[-1]:
            busy |= {a, b}
    yield rows[kept]


def connected_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(id, component) for every end of the edges (a, b); a component is named by its smallest id.

    Alternating large and small stars, a logarithmic number of rounds; each round is written. Minima
    are combined before each shuffle; a centre's edges are two numbers each, and where they outgrow a
    task, adaptive execution splits the joins."""
    stars = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    if stars.count() <= few:
        kind = stars.schema["u"].dataType.simpleString()
        return stars.repartition(1).mapInPandas(_components, f"id {kind}, component {kind}")
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        sides = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        stars = materialise(small.filter("u <> v").distinct(), "stars")
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select("v", "v")).distinct()


def greedy_matching(candidates: DataFrame, few: int = FEW) -> DataFrame:
    """Accepted candidates (id_a, front_a, id_b, front_b, score): lowest score first, each lane end once.

    Equal scores are ordered by ids and ends, so the order is strict; then taking, again and
    again, the candidates that are first at both their ends gives what one sequential pass gives."""
    key = F.struct("score", "id_a", "front_a", "id_b", "front_b")
    left = materialise(candidates.withColumn("key", key), "candidates")
    accepted, columns = None, ("id_a", "front_a", "id_b", "front_b", "score")
    while left.count() > few:
        ends = left.select(F.col("id_a").alias("id"), F.col("front_a").alias("front"), "key").unionByName(left.select(F.col("id_b").alias("id"), F.col("front_b").alias("front"), "key"))
        best = ends.groupBy("id", "front").agg(F.min("key").alias("best"))
        a = best.select(F.col("id").alias("id_a"), F.col("front").alias("front_a"), F.col("best").alias("best_a"))
        b = best.select(F.col("id").alias("id_b"), F.col("front").alias("front_b"), F.col("best").alias("best_b"))
        taken = materialise(left.join(a, ["id_a", "front_a"]).join(b, ["id_b", "front_b"]).filter("key = best_a AND key = best_b").select(*left.columns), "accepted")
        accepted = taken if accepted is None else accepted.unionByName(taken)
        busy = taken.select(F.col("id_a").alias("id"), F.col("front_a").alias("front")).union(taken.select("id_b", "front_b"))
        for side in ("a", "b"):
            left = left.join(busy.toDF(f"id_{side}", f"front_{side}"), [f"id_{side}", f"front_{side}"], "left_anti")
        left = materialise(left.select(*taken.columns), "candidates")
    rest = left.select(*columns)
    rest = materialise(rest.repartition(1).mapInPandas(_matched, rest.schema), "accepted")
    return rest if accepted is None else accepted.select(*columns).unionByName(rest)
