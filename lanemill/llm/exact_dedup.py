"""Exact deduplication with Patricia tries.

Rows are dealt by the length and content hash of their normalised text (all ASCII blanks
deleted). Each task inserts the full normalised byte strings of its share into a compressed
radix trie; a terminal node holds the owner of its text: most code points in the original
text, then smallest ``doc_id`` (null ids last). Hashes only deal rows out, equality is decided
on whole byte strings in the trie. Copies are combined inside every map task before the
shuffle, so a hot text crosses it at most once per task. A trie over its byte limit spills its
largest subtree as a run in key order; runs and what is left are merged at the end.

Defined cases: null text counts as empty, and all empty or blank texts are equal; of rows that
repeat text and id any one is the owner (they are the same row); an empty table gives an empty
result; columns beside ``doc_id`` and ``text`` are carried as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import documents, frugal, shared_folder, shared_table, shuffle_partitions, text_bytes

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes a trie may hold in one task before it spills a subtree.
TRIE_BYTES = 96 << 20
#: Bytes a map task combines before it hands on what it has.
COMBINE_BYTES = 24 << 20
#: Each node and owner counts as so many bytes.
NODE_BYTES = 400

Owner = tuple  # (order, row, count): order is (-code points, id is null, id)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("edge", "kids", "owner")

    def __init__(self, edge: bytes, owner: Owner | None = None):
        self.edge, self.kids, self.owner = edge, {}, owner


def better(a: Owner | None, b: Owner) -> Owner:
    if a is None:
        return b
    order, row, count = a if a[0] <= b[0] else b
    return order, row, a[2] + b[2]


class PatriciaTrie:
    """Byte strings to owners; subtrees below the root are spilled whole, in key order."""

    def __init__(self, limit: int = TRIE_BYTES, spill_dir: str | None = None):
        self.root, self.limit, self.spill_dir = Node(b""), limit, spill_dir
        self.held, self.by_first, self.runs = 0, {}, []

    def insert(self, key: bytes, owner: Owner, weight: int = 0) -> None:
        node, at, grown = self.root, 0, weight
        while at < len(key):
            child = node.kids.get(key[at])
            if child is None:
                node.kids[key[at]] = Node(key[at:], owner)
                grown += len(key) - at + NODE_BYTES
                break
            if key.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            k = common_prefix(child.edge, key[at : at + len(child.edge)])
            fork = Node(child.edge[:k])
            child.edge = child.edge[k:]
            fork.kids[child.edge[0]] = child
            node.kids[key[at]] = fork
            grown += NODE_BYTES
            node, at = fork, at + k
        else:
            node.owner = better(node.owner, owner)
        first = key[0] if key else -1
        self.by_first[first] = self.by_first.get(first, 0) + grown
        self.held += grown
        if self.held > self.limit and self.spill_dir:
            self.spill()

    def spill(self) -> None:
        first = max((k for k in self.by_first if k >= 0), key=self.by_first.get, default=None)
        if first is None:
            return
        path = f"{self.spill_dir}/{uuid.uuid4().hex}"
        with open(path, "wb") as out:
            for item in walk(self.root.kids.pop(first), b""):
                pickle.dump(item, out, pickle.HIGHEST_PROTOCOL)
        self.runs.append(path)
        self.held -= self.by_first.pop(first)

    def items(self) -> Iterator[tuple[bytes, Owner]]:
        """All texts with their owners in key order, once each; removes the runs."""
        last: tuple[bytes, Owner] | None = None
        sources = [walk(self.root, b""), *map(read_run, self.runs)]
        for key, owner in heapq.merge(*sources, key=lambda x: x[0]):
            if last and last[0] == key:
                last = key, better(last[1], owner)
                continue
            if last:
                yield last
            last = key, owner
        if last:
            yield last
        for path in self.runs:
            os.unlink(path)


def walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Owner]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        prefix += node.edge
        if node.owner is not None:
            yield prefix, node.owner
        stack.extend((node.kids[k], prefix) for k in sorted(node.kids, reverse=True))


def read_run(path: str) -> Iterator[tuple[bytes, Owner]]:
    with open(path, "rb") as run:
        while True:
            try:
                yield pickle.load(run)
            except EOFError:
                return


def normalise(text: bytes) -> bytes:
    return text.translate(None, BLANKS)


def code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


#: What travels beside the rows; the prefix keeps it apart from columns of the same meaning.
_EXTRA = [("__lm_len", T.LongType()), ("__lm_hash", T.LongType()), ("__lm_points", T.LongType()), ("__lm_count", T.LongType())]


def _combine(schema: pa.Schema):
    """A map task's rows to one row per distinct text in it."""

    def flush(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for key, (order, row, count) in trie.items():
            digest = int.from_bytes(hashlib.sha256(key).digest()[:8], "little", signed=True)
            rows.append(row | {"__lm_len": len(key), "__lm_hash": digest, "__lm_points": -order[0], "__lm_count": count})
            size += len(key)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            for row, text in zip(batch.to_pylist(), text_bytes(batch.column("text")), strict=True):
                order = (-code_points(text), row["doc_id"] is None, row["doc_id"] or 0)
                trie.insert(normalise(text), (order, row, 1), len(text))
                if trie.held > COMBINE_BYTES:
                    yield from flush(trie)
                    trie = PatriciaTrie()
        yield from flush(trie)

    return run


def _own(schema: pa.Schema, spill_dir: str, limit: int):
    """All rows of some (length, hash) keys to one row per distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit, spill_dir)
        names = [n for n in schema.names if not n.startswith("__lm_")]
        for batch in batches:
            for row, text in zip(batch.to_pylist(), text_bytes(batch.column("text")), strict=True):
                order = (-row["__lm_points"], row["doc_id"] is None, row["doc_id"] or 0)
                kept = {n: row[n] for n in names}
                trie.insert(normalise(text), (order, kept, row["__lm_count"]), len(text))
        rows, size = [], 0
        for key, (order, row, count) in trie.items():
            rows.append(row | {"__lm_points": -order[0], "__lm_count": count, "__lm_sha256": hashlib.sha256(key).hexdigest()})
            size += len(key)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def owners(df: DataFrame, carry_text: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: the owner's columns, then ``__lm_points`` (its code
    points), ``__lm_count`` (rows with that text) and ``__lm_sha256``."""
    fields = df.schema.fields
    sent = T.StructType(fields + [T.StructField(n, t) for n, t in _EXTRA])
    kept = [f for f in fields if carry_text or f.name != "text"]
    out = T.StructType(kept + [T.StructField("__lm_points", T.LongType()), T.StructField("__lm_count", T.LongType()), T.StructField("__lm_sha256", T.StringType())])
    spill_dir = shared_folder(df.sparkSession, "trie")
    dealt = df.mapInArrow(frugal(_combine(to_arrow_schema(sent))), sent).repartition(shuffle_partitions(df), "__lm_len", "__lm_hash")
    return dealt.mapInArrow(frugal(_own(to_arrow_schema(out), spill_dir, trie_bytes)), out)


def deduplicate(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that own their text, with the columns of ``df``."""
    return owners(df).select(*df.columns)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256(normalise(t)).hexdigest() for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shas, pa.string())], ["doc_id", "text_sha256"])


def decisions(df: DataFrame) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts with over a thousandth of all rows (at most 1000 of them) are joined by broadcast, the
    rest by a shuffle that no single text can load with more than a thousandth of the rows.
    """
    spark, df = df.sparkSession, df.select("doc_id", "text")
    own = shared_table(spark, owners(df, carry_text=False), "owners").select(
        F.col("__lm_sha256").alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.col("__lm_count").alias("group_size")
    )
    total = own.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") > max(1, total // 1000)
    heavy = own.filter(hot).select("text_sha256", F.struct("keep_id", "group_size").alias("heavy"))
    light = own.filter(~hot).select(F.col("text_sha256").alias("own_key"), F.struct("keep_id", "group_size").alias("light"))
    rows = df.mapInArrow(frugal(_digests), "doc_id long, text_sha256 string").join(F.broadcast(heavy), "text_sha256", "left")
    spread = F.when(F.col("heavy").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")))
    both = rows.withColumn("own_key", spread).join(light, "own_key", "left")
    own = F.coalesce(F.col("heavy"), F.col("light"))
    return both.select(
        "doc_id", own["keep_id"].alias("keep_id"), own["group_size"].alias("group_size"), F.col("doc_id").eqNullSafe(own["keep_id"]).alias("kept"), "text_sha256"
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(documents(spark, sf_dir))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
