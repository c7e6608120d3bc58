"""Near-duplicate detection: a chosen-path similarity join on minwise tokens.

Documents are sets of five-word shingles. Each independent tree first puts a set into the node
named by one of its minwise tokens; sets with Jaccard similarity J meet there with probability
J. Nodes that are too large branch again by further minwise tokens, small ones are compared
exhaustively, and independent trees are repeated: ``plan`` takes as many as the target recall
needs at the threshold. Every link is confirmed on the full sets, re-read from the texts.

What keeps the work linear in large groups: equal sets are one class from the start, and in
every node each class is first compared with a few leaders only. Links found this way join the
classes into components; only nodes that still hold different components go on to branch. In a
small node all sets are intersected at once, and it gives no more links than it takes to join
its components, so no link between components is lost and the many pairs of a group are never
listed.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing;
fewer than five words count as one shingle; rows that repeat a text are one class; rows without
an id are linked like all others, and a component of such rows only has the id null; ids may be
numbers or strings and may repeat; an empty table gives an empty result; other columns are
neither used nor needed. ``representatives`` keeps one row of each component, the one with the
smallest id (null last, then by a hash of the text), whether ids repeat or are missing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.joins import dealt_join, hot_keys
from .common import blocks, documents, frugal, release, shared_table, text_bytes
from .textkit import mix, word_hashes

SHINGLE = 5
#: Share of the links that may be missed by never meeting, by the trees' own arithmetic.
MISS = 1e-6
#: Independent trees at least, and sketch positions from which the similarity of two sets is estimated.
TREES, SKETCH = 16, 128
#: Leaders of a node: different orders of the classes, one for each tree modulo this.
LEADERS = 4
#: Nodes up to this size, and up to so many shingles, are compared exhaustively; larger ones
#: branch, up to a depth.
SMALL, SMALL_SHINGLES, DEPTH = 4096, 2 << 20, 12
#: Shingles in up to so many sets of a node are counted pair by pair, others by matrix products.
RARE, WIDTH = 16, 2048
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 5.0
_MASKS = [int(x) & 0x7FFFFFFFFFFFFFFF for x in mix(np.arange(LEADERS, dtype=np.uint64) + np.uint64(77))]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and their numbers."""
    words, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    parts = []
    rolled = mix(words) if len(words) else words
    if len(words) >= SHINGLE:
        width = len(words) - SHINGLE + 1
        rolled = np.zeros(width, np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : k + width]
        rolled = mix(rolled)
    for a, n in zip(starts, counts, strict=True):
        if n >= SHINGLE:
            parts.append(np.unique(rolled[a : a + n - SHINGLE + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for k in range(a, a + n):
                whole = mix(whole + words[k : k + 1])
            parts.append(whole)
        else:
            parts.append(np.empty(0, np.uint64))
    return np.concatenate([*parts, np.empty(0, np.uint64)]), np.array([len(p) for p in parts], np.int64)


def plan(share: float) -> tuple[int, int]:
    """(trees, least): two sets of similarity ``share`` are in one first node in ``least`` or more of
    so many trees, but for ``MISS`` of them. The number of such trees is binomial."""
    trees = max(TREES, math.ceil(math.log(MISS) / math.log1p(-min(share, 1 - 1e-9))))
    missed, least = 0.0, 0
    while least < trees:
        missed += math.comb(trees, least) * share**least * (1 - share) ** (trees - least)
        if missed > MISS:
            break
        least += 1
    return trees, max(least, 1)


def set_print(hashes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit prints of the sets that lie one after the other, none of them empty."""
    one, two = mix(hashes ^ np.uint64(0x1F83D9ABFB41BD6B)), mix(hashes ^ np.uint64(0x5BE0CD19137E2179))
    return np.column_stack([np.add.reduceat(one, begin), np.bitwise_xor.reduceat(two, begin) + sizes.astype(np.uint64)])


def described(hashes: np.ndarray, sizes: np.ndarray, n_trees: int = TREES) -> tuple[list, list, list]:
    """Of each set: its 128-bit print, the minwise tokens of the trees, and its sketch."""
    full = np.flatnonzero(sizes)
    if not len(full):
        return [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    prints = set_print(hashes, begin, sizes[full])
    factors = mix(np.arange(1, n_trees + SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    least = np.empty((len(full), len(factors)), np.uint64)
    for k, factor in enumerate(factors):
        least[:, k] = np.minimum.reduceat(hashes * factor, begin)
    trees = mix(least[:, :n_trees] + np.arange(n_trees, dtype=np.uint64))
    sketch = (mix(least[:, n_trees:]) >> np.uint64(40)).astype(np.uint16)
    out: tuple[list, list, list] = ([None] * len(sizes), [None] * len(sizes), [None] * len(sizes))
    for i, k in enumerate(full):
        out[0][k], out[1][k], out[2][k] = prints[i].tobytes(), trees[i].tobytes(), sketch[i].tobytes()
    return out


def _describe(n_trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in blocks([len(t) for t in texts]):
                hashes, sizes = shingle_sets(texts[a:b])
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "key")]
                columns = [*own, pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in described(hashes, sizes, n_trees))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_shingles", "print", "trees", "sketch"])

    return run


def _nodes(n_trees: int):
    """A row for each class and tree: the node, and the number of the order that picks its leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = np.frombuffer(b"".join(batch.column("trees").to_pylist()), np.int64)
            cid = np.repeat(np.asarray(batch.column("cid")), n_trees)
            order = np.tile(np.arange(n_trees, dtype=np.int32) % LEADERS, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(trees), pa.array(cid), pa.array(order)], ["node", "cid", "pick"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [pack.compress(t) for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "packed"])


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed texts with the prints of their sets; texts without a word are left out."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for a, b in blocks([len(t) for t in texts]):
            hashes, sizes = shingle_sets(texts[a:b])
            full = np.flatnonzero(sizes)
            if len(full):
                prints = set_print(hashes, (np.cumsum(sizes) - sizes)[full], sizes[full])
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([pack.compress(texts[a + k]) for k in full], pa.binary())], ["print", "packed"])


def _same_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts whose set is the class's: ids that stand for several texts are told apart here."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [unpack.decompress(t) for t in batch.column("packed").to_pylist()]
        wanted = batch.column("print").to_pylist()
        for a, b in blocks([len(t) for t in texts]):
            hashes, sizes = shingle_sets(texts[a:b])
            full = np.flatnonzero(sizes)
            prints = set_print(hashes, (np.cumsum(sizes) - sizes)[full], sizes[full]) if len(full) else ()
            keep = [a + k for k, p in zip(full.tolist(), prints, strict=True) if p.tobytes() == wanted[a + k]]
            yield batch.select(["cid", "packed"]).take(pa.array(keep, pa.int64()))


def _confirm(share: float):
    """Pairs (a, b) with their packed texts: those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        memo: dict[int, np.ndarray] = {}

        def full(cid: int, packed: bytes) -> np.ndarray:
            if cid not in memo:
                if len(memo) >= 64:
                    memo.clear()
                memo[cid] = shingle_sets([unpack.decompress(packed)])[0]
            return memo[cid]

        for batch in batches:
            kept = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "packed_a", "packed_b")), strict=True)
            for i, (a, b, x, y) in enumerate(rows):
                s, t = full(a, x), full(b, y)
                if min(len(s), len(t)) * 100 < share * 100 * max(len(s), len(t)) - 1e-6:
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= round(share * 100) * (len(s) + len(t) - both):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return run


def _similar(low: float):
    """Pairs (a, b) with their sketches: those that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((s == t).mean(axis=1) >= low))

    return run


def _branch(depth: int, share: float):
    """Memberships in large nodes to memberships in their children: each node picks one sketch
    position, and a second one so often that 1/share children are expected for a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.asarray(batch.column("node")).view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
            for turn in range(2):
                draw = mix(node + np.uint64(1000 * depth + turn))
                rows = np.arange(len(node)) if not turn else np.flatnonzero((draw >> np.uint64(11)) < np.uint64(int((1 / share - 1) * (1 << 53))))
                at = (mix(draw)[rows] % np.uint64(SKETCH)).astype(np.int64)
                child = mix(draw[rows] + sketch[rows, at].astype(np.uint64))
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(part.column(c) for c in ("cid", "comp", "sketch", "n"))], ["node", "cid", "comp", "sketch", "n"])

    return run


def _near(low: float):
    """Members of a small node that may reach the threshold with a member of another component; at
    most as many rows as came in."""

    def run(table: pa.Table) -> pa.Table:
        comp = np.asarray(table["comp"])
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, SKETCH)
        found = np.zeros(len(comp), bool)
        for i in range(len(comp) - 1):
            hit = (comp[i + 1 :] != comp[i]) & ((sketch[i + 1 :] == sketch[i]).mean(axis=1) >= low)
            found[i + 1 :] |= hit
            found[i] |= hit.any()
        return table.select(["node", "cid", "comp"]).filter(pa.array(found))

    return run


def overlaps(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sizes)
    _, column, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(n, dtype=np.int64), sizes), counts[column]
    found = np.zeros((n, n), np.float32)
    # Rare columns: the few pairs of each, one distance in the column after the other.
    few = np.flatnonzero((often > 1) & (often <= RARE))
    few = few[np.argsort(column[few], kind="stable")]
    for step in range(1, RARE):
        few_now = np.flatnonzero(column[few[step:]] == column[few[:-step]]) if step < len(few) else few[:0]
        if not len(few_now):
            break
        pairs = row[few[few_now]] * n + row[few[few_now + step]]
        np.add.at(found.reshape(-1), pairs, np.float32(1))
    found += found.T
    # Frequent columns: products of the incidence matrix, some columns at a time.
    many = np.flatnonzero(often > RARE)
    _, place = np.unique(column[many], return_inverse=True)
    order = np.argsort(place, kind="stable")
    row, place = row[many][order], place[order]
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, WIDTH):
        a, b = np.searchsorted(place, (first, first + WIDTH))
        part = np.zeros((n, WIDTH), np.float32)
        part[row[a:b], place[a:b] - first] = 1
        found += part @ part.T
    np.fill_diagonal(found, sizes)
    return found


def _join(share: float):
    """Links of a small node that join different components, confirmed on the full sets; a link
    between components that others of the node join already is left out."""

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        cid, comp = table["cid"].to_pylist(), table["comp"].to_pylist()
        hashes, sizes = shingle_sets([unpack.decompress(x) for x in table["packed"].to_pylist()])
        common = overlaps(hashes, sizes)
        root = {c: c for c in comp}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i in range(len(cid)):
            own = common[i, i + 1 :]
            for j in (i + 1 + np.flatnonzero(100 * own >= round(share * 100) * (sizes[i] + sizes[i + 1 :] - own))).tolist():
                x, y = find(comp[i]), find(comp[j])
                if x != y:
                    root[x] = y
                    found.append((cid[i], cid[j]))
        del common, hashes
        release()
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return run


def _classes(df: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n_shingles, print) and classes (print, cid, comp, rep, head): equal sets are
    a class, ``comp`` names its component, ``rep`` is its smallest id and ``head`` the row that comes
    first. ``key`` is a hash of the text, by which rows with the same id are told apart."""
    spark, kind = df.sparkSession, df.schema["doc_id"].dataType.simpleString()
    low = share - SLACK * math.sqrt(share * (1 - share) / SKETCH)
    n_trees, min_nodes = plan(share)
    docs = df.select("doc_id", "text")
    described_as = f"doc_id {kind}, key long, n_shingles long, print binary, trees binary, sketch binary"
    rows = shared_table(spark, docs.withColumn("key", F.xxhash64("text")).mapInArrow(frugal(_describe(n_trees)), described_as), "described")
    classes = rows.filter("print IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("rep"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("head"),
        F.first("trees").alias("trees"),
        F.first("sketch").alias("sketch"),
        F.first("n_shingles").alias("n"),
    )
    classes = shared_table(spark, classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = classes.count() * n_trees

    # First nodes of all trees; what stands alone in its node is dropped.
    nodes = classes.select("cid", "trees").mapInArrow(frugal(_nodes(n_trees)), "node long, cid long, pick int")
    mask = F.element_at(F.array(*map(F.lit, _MASKS)), F.col("pick") + 1)
    heads = nodes.groupBy("node", "pick").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("cid").bitwiseXOR(mask)).alias("least"))
    heads = shared_table(spark, heads.filter("size > 1").select("node", "size", F.col("least").bitwiseXOR(mask).alias("head")), "heads")
    crowded = hot_keys(heads, "node", total)
    met = shared_table(spark, dealt_join(nodes.select("node", "cid"), heads.select("node", "head"), "node", crowded), "nodes")
    likely = met.groupBy("cid").count().filter(F.col("count") >= min_nodes).select("cid")
    wanted = classes.join(likely, "cid").select("cid", "print", "rep")
    by_id = docs.filter("doc_id IS NOT NULL").mapInArrow(frugal(_packed), f"doc_id {kind}, packed binary")
    # Rows that repeat an id and a text count once; the join has brought them together.
    by_id = wanted.filter("rep IS NOT NULL").withColumnRenamed("rep", "doc_id").join(by_id, "doc_id").groupBy("doc_id", "cid", F.xxhash64("packed").alias("h"))
    by_id = by_id.agg(F.first("print").alias("print"), F.first("packed").alias("packed")).select("cid", "print", "packed").mapInArrow(frugal(_same_print), "cid long, packed binary")
    # A class without any id is found by its print; its texts are combined before they are shuffled.
    by_print = docs.filter("doc_id IS NULL").select("text").mapInArrow(frugal(_printed), "print binary, packed binary").groupBy("print").agg(F.first("packed").alias("packed"))
    by_print = wanted.filter("rep IS NULL").join(by_print, "print").select("cid", "packed")
    texts = shared_table(spark, by_id.union(by_print), "texts")
    sketches = classes.join(likely, "cid").select("cid", "sketch", "n")

    # Each class with the leaders of its nodes; a leader of many is dealt to many tasks.
    stars = met.filter("cid <> head").selectExpr("least(cid, head) AS a", "greatest(cid, head) AS b").distinct()
    leading = hot_keys(heads.groupBy("head").agg(F.sum("size").alias("size")), "head", total)
    for side in "ab":
        stars = dealt_join(stars, sketches.select(F.col("cid").alias(side), F.col("sketch").alias(f"sketch_{side}")), side, leading.toDF(side))
    both = stars.mapInArrow(frugal(_similar(low)), "a long, b long")
    for side in "ab":
        both = dealt_join(both, texts.toDF(side, f"packed_{side}"), side, leading.toDF(side))
    links = shared_table(spark, both.mapInArrow(frugal(_confirm(share)), "a long, b long"), "links")
    comps = shared_table(spark, connected_components(links).toDF("cid", "comp"), "components")

    # Nodes that still hold different components.
    member = met.select("node", "cid").join(sketches, "cid").join(comps, "cid", "left").select("node", "cid", F.coalesce("comp", "cid").alias("comp"), "sketch", "n")
    small: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        mixed = member.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        mixed = mixed.filter("low < high").select("node", ((F.col("size") <= SMALL) & (F.col("weight") <= SMALL_SHINGLES)).alias("small"))
        member = shared_table(spark, dealt_join(member, mixed, "node", crowded), "members")
        small.append(member.filter("small").drop("small"))
        member = member.filter("NOT small").drop("small")
        if member.isEmpty():
            break
        member = member.mapInArrow(frugal(_branch(depth, share)), "node long, cid long, comp long, sketch binary, n long")
        crowded = hot_keys(member.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "node", total)
    else:
        # What no depth has split is dealt out in blocks and compared pair of blocks by pair of blocks.
        small.append(_in_blocks(member))
    mixed = small[0]
    for more in small[1:]:
        mixed = mixed.union(more)
    near = mixed.groupBy("node").applyInArrow(_near(low), "node long, cid long, comp long")
    joins = near.join(texts, "cid").select("node", "cid", "comp", "packed").groupBy("node").applyInArrow(_join(share), "a long, b long")
    links = links.union(shared_table(spark, joins.distinct(), "links"))
    comps = connected_components(links).toDF("cid", "comp")
    found = classes.select("cid", "print", "rep", "head").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    return rows.select("doc_id", "key", "n_shingles", "print"), shared_table(spark, found, "components")


def _of_rows(rows: DataFrame, of_class: DataFrame) -> DataFrame:
    """``rows`` with the columns of their class; rows without a word have none, and prints of many rows are
    joined by dealing them out."""
    full = rows.filter("print IS NOT NULL")
    sizes = full.groupBy("print").agg(F.count(F.lit(1)).alias("size"))
    found = dealt_join(full, of_class, "print", hot_keys(sizes, "print", rows.count()))
    return found.unionByName(rows.filter("print IS NULL"), allowMissingColumns=True)


def linked(df: DataFrame, share: float = 0.8) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id linked, over any number of links)
    of every row of ``df``; links are pairs of sets with Jaccard similarity ``share`` or more."""
    rows, classes = _classes(df, share)
    own = classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = classes.join(own, "comp").select("print", "component_id")
    return _of_rows(rows, of_class).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _in_blocks(member: DataFrame) -> DataFrame:
    """Memberships of large nodes, copied to nodes of two blocks each, so that every pair meets."""
    blocks_ = F.ceil(F.greatest(F.count(F.lit(1)) * 2.5 / SMALL, F.sum("n") * 2.5 / SMALL_SHINGLES))
    sizes = member.groupBy("node").agg(blocks_.alias("blocks"))
    block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    dealt = member.join(sizes, "node").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    node = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.select(node.alias("node"), "cid", "comp", "sketch", "n")


def representatives(df: DataFrame, share: float = 0.8) -> DataFrame:
    """One row of each near-duplicate group of ``df``, with all columns, and every row without a word.

    Rows are told apart by id and text, so other texts that share an id with a dropped row stay."""
    rows, classes = _classes(df, share)
    first = classes.groupBy("comp").agg(F.min("head").alias("first"))
    of_class = classes.join(first, "comp").select("print", "first")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    decided = _of_rows(rows, of_class).filter("print IS NOT NULL").withColumn("dropped", own != F.col("first"))
    # Of each (id, text): dropped, or repeated so that one row of several is to stay.
    decided = decided.groupBy(F.col("doc_id").alias("__lm_id"), F.col("key").alias("__lm_of")).agg(F.max("dropped").alias("__lm_dropped"), F.count(F.lit(1)).alias("n"))
    decided = shared_table(df.sparkSession, decided.filter("__lm_dropped OR n > 1").drop("n"), "decided")
    keyed = df.withColumn("__lm_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__lm_id")) & (F.col("__lm_key") == F.col("__lm_of"))
    alone = keyed.join(decided, same, "left_anti")
    several = keyed.join(decided.filter("NOT __lm_dropped"), same, "left_semi").dropDuplicates(["doc_id", "__lm_key"])
    return alone.unionByName(several).select(*df.columns)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(documents(spark, sf_dir), 0.85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(words) = 0 THEN []
         WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""
