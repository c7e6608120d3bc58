"""Interpolated modified Kneser-Ney language model over word n-grams, of order 3 unless told otherwise.

Counting is distributed: each map task reduces its tokens to distinct n-grams with counts, and
ranges of the hash space add them up, one range in memory at a time. What a range finds goes to
sorted hash arrays in the shared folder; workers that score text map the files into memory, so no
worker or driver holds the model.

* words: count, the number of words it follows (continuation count), and as a context its total
  and the numbers of followers seen once, twice, more often;
* pairs: adjusted count (the number of words before the pair; behind the begin of a text the count);
* contexts of two words: total and the numbers of followers seen once, twice, more often; a context
  that is not kept, but known as a pair, has one follower, seen once;
* triples: count.

A triple is dealt by its middle word, so that a range has all it takes for the triple's context
and for the pair of its last two words. A word that would fill a range alone (they are counted
first, and there are no more of them than ranges) has its triples dealt by their first two words,
and its pairs are added up afterwards.

P(w|uv) = max(c(uvw)-D, 0)/c(uv) + gamma(uv) * P(w|v), and so on down to continuation counts of
words, interpolated with the uniform distribution over all known words and one unknown. The first
word of a text has the begin as its only context. With order 2 pairs have their counts.

Defined cases: null and empty texts have the one end token; repeated rows count and are scored
each; a null id counts as the empty text for the fold; an empty table, or one without training
rows, gives every token the unknown word's probability; other columns are neither used nor
needed, and a column to keep may have any name but those of the results.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, fold, frugal, shared_folder, shared_table, shuffle_partitions, text_bytes
from .hashtables import Files, Table, TableWriter, mapped, squeeze, stretch
from .textkit import mix, word_hashes

ORDER = 3
END, BEGIN, NONE = (np.uint64(x) for x in (0x51ED270B0A1F4C61, 0xC2B2AE3D27D4EB4F, 0x9F6ABC9D1E3C5A77))
#: Tokens that a map task counts at once (places in them have 21 bits), and the longest piece of them.
HOLD, PIECE = (1 << 21) - 2, 1 << 19
#: Tokens of a range, and ranges in which each shard's words are counted.
RANGE, WORD_RANGES = 4_000_000, 8
#: Most frequent words that a range of words names as candidates for hot ones.
TOP = 256
KINDS = 4  # counts of counts: 1, 2, 3, 4
WORD_PLANES = ("count", "follows", "total", "n1", "n2", "n3")


def sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts (words, then one end each), each text behind the marks NONE and
    BEGIN, and the number of tokens of each text."""
    hashes, words = word_hashes(texts)
    now = np.insert(hashes, np.cumsum(words), END)
    size = words + 1
    return np.insert(now, np.repeat(np.cumsum(size) - size, 2), np.tile([NONE, BEGIN], len(size))), size


def gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its first words and that of its last."""
    return mix(context + mix(word ^ np.uint64(0xA0761D6478BD642F)))


def range_of(h: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the hash space, so sorted hashes lie in order of their ranges."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = begins(keys)
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def begins(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def followers(counts: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Total, and the numbers of counts that are 1, 2 and more, of the runs that begin at ``first``."""
    if not len(counts):
        return [np.empty(0, np.int64)] * 4
    return [np.add.reduceat(x, first) for x in (counts, *((counts == k).astype(np.int64) for k in (1, 2)), (counts > 2).astype(np.int64))]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in as few bytes as their largest needs, compressed. Ascending ones are
    kept as steps, and of all numbers first the lowest bytes, then the next ones."""
    parts = [bytes([len(arrays)])]
    for x in arrays:
        x = np.ascontiguousarray(x).astype(np.uint64)
        rising = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        x = np.diff(x, prepend=np.uint64(0)) if rising else x
        size = np.min_scalar_type(int(x.max(initial=0))).itemsize
        planes = x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
        parts += [bytes([size, rising]), len(x).to_bytes(5, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, found = zstandard.ZstdDecompressor().decompress(blob), 1, []
    for _ in range(data[0]):
        size, rising, n = data[at], data[at + 1], int.from_bytes(data[at + 2 : at + 7], "little")
        planes = np.frombuffer(data, np.uint8, size * n, at + 7).reshape(size, n)
        x = np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1)
        found.append(np.cumsum(x, dtype=np.uint64) if rising else x)
        at += 7 + size * n
    return found


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for a, b in blocks([len(t) for t in texts]):
            yield texts[a:b]


_ROWS = "range long, kind int, blob binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["range", "kind", "blob"])


def _in_ranges(rows: DataFrame, shards: int, per_shard: int) -> DataFrame:
    """Rows dealt to tasks by shard, in order of their ranges within."""
    return rows.repartition(shards, F.expr(f"range div {per_shard}")).sortWithinPartitions("range", "kind")


def _each_range(open_shard: Callable, per_shard: int):
    """A task that takes its rows range by range. ``open_shard(shard)`` gives (work, close): ``work`` takes the
    number of a range and its (kind, blob) rows, which it may consume, and yields rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = at = work = close = None
        held: list[tuple[int, bytes]] = []
        for batch in batches:
            for k, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("range", "kind", "blob")), strict=True):
                if k != at and held:
                    yield _batch(list(work(at, held)))
                    held = []
                if k // per_shard != shard:
                    if close:
                        close()
                    shard = k // per_shard
                    work, close = open_shard(shard)
                at = k
                held.append((kind, blob))
        if held:
            yield _batch(list(work(at, held)))
        if close:
            close()

    return run


# --- counting words ------------------------------------------------------------------------


def _count_words(n: int):
    def flush(parts: list) -> pa.RecordBatch:
        keys, counts = add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        ranges = range_of(keys, n)
        cuts = np.append(begins(ranges), len(keys))
        return _batch([(int(ranges[a]), 0, pack(keys[a:b], counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for texts in _texts(batches):
            hashes, words = word_hashes(texts)
            keys, counts = np.unique(hashes, return_counts=True)
            parts += [(keys, counts), (np.array([END]), np.array([len(words)]))]
            held += len(keys)
            if held > PIECE:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _own_words(folder: str):
    """A shard's words and counts to a file in order; what each range holds to the driver."""

    def open_shard(shard: int):
        files, done = Files(f"{folder}/counted-{shard}", ("keys", "low", "large")), [0]

        def work(at: int, rows: list) -> Iterator[tuple]:
            parts = [unpack(b) for _, b in rows]
            keys, counts = add_up(np.concatenate([p[0] for p in parts]).astype(np.uint64), np.concatenate([p[1] for p in parts]).astype(np.int64))
            low, large = squeeze(counts, done[0])
            for part, array in zip(("keys", "low", "large"), (keys, low, large), strict=True):
                files.write(part, array)
            done[0] += len(keys)
            top = np.argsort(-counts, kind="stable")[:TOP]
            yield at, 0, pack(np.array([len(keys), counts.sum()]), keys[top], counts[top])

        return work, files.close

    return _each_range(open_shard, WORD_RANGES)


# --- counting n-grams ----------------------------------------------------------------------

_COUNTS, _CONTEXT, _FOLLOWER, _HOT = range(4)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes with marks, and which of them end an n-gram of this piece; a piece repeats the two
    tokens before it."""
    seq, _ = sequence(texts)
    real = (seq != NONE) & (seq != BEGIN)
    for a in range(0, len(seq), PIECE):
        low = max(0, a - 2)
        ends = real[low : a + PIECE].copy()
        ends[: a - low] = False
        yield seq[low : a + PIECE], ends


def _count_grams(n: int, hot: np.ndarray, order: int):
    """Map tasks' distinct triples with counts, to the ranges that own them."""

    def flush(parts: list) -> pa.RecordBatch:
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        ends = np.flatnonzero(np.concatenate([p[1] for p in parts]))
        at = at.astype(np.uint64)
        before = at[ends - 2] if order > 2 else np.full(len(ends), np.searchsorted(words, NONE), np.uint64)
        keys, counts = np.unique((at[ends - 1] << np.uint64(42)) | (before << np.uint64(21)) | at[ends], return_counts=True)
        v, u, w = ((keys >> np.uint64(s) & np.uint64((1 << 21) - 1)).astype(np.int64) for s in (42, 21, 0))
        ranges = range_of(words[v], n)
        warm = np.flatnonzero(np.isin(words, hot)[v])
        ranges[warm] = range_of(gram(words[u[warm]], words[v[warm]]), n)
        if len(warm):
            order_ = np.argsort(ranges, kind="stable")
            ranges, v, u, w, counts = (x[order_] for x in (ranges, v, u, w, counts))
        cuts, rows = np.append(begins(ranges), len(ranges)), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = np.zeros(len(words), bool)
            for x in (u, v, w):
                own[x[a:b]] = True
            place = np.cumsum(own) - 1
            runs = begins(v[a:b])
            lengths = np.diff(np.append(runs, b - a))
            rows.append((int(ranges[a]), 0, pack(words[own], place[v[a:b][runs]], lengths, place[u[a:b]], place[w[a:b]], counts[a:b])))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for texts in _texts(batches):
            for piece in _pieces(texts):
                if held + len(piece[0]) > HOLD:
                    yield flush(parts)
                    parts, held = [], 0
                parts.append(piece)
                held += len(piece[0])
        if parts:
            yield flush(parts)

    return run


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, KINDS + 1), minlength=KINDS + 2)[1 : KINDS + 1].astype(np.int64)


def _of_words(n: int, kind: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """What is known of words (sorted hashes), to the words' ranges."""
    ranges = range_of(keys, n)
    cuts = np.append(begins(ranges), len(keys)) if len(keys) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(ranges[a]), kind, pack(keys[a:b], *(v[a:b] for v in values))


def _own_grams(folder: str, n: int, per_shard: int, hot: np.ndarray, order: int):
    """A range's triples, contexts and pairs to the shard's tables, and what it knows of words and of
    the pairs behind hot words to their ranges."""

    def merged(rows: list) -> tuple[np.ndarray, ...]:
        parts = [unpack(b) for _, b in rows]
        rows.clear()
        words, place = np.unique(np.concatenate([p[0] for p in parts]).astype(np.uint64), return_inverse=True)
        offset = np.cumsum([0, *(len(p[0]) for p in parts)])
        v = np.concatenate([place[k + np.repeat(p[1].astype(np.int64), p[2].astype(np.int64))] for k, p in zip(offset, parts, strict=False)]).astype(np.uint64)
        u, w = (np.concatenate([place[k + p[i].astype(np.int64)] for k, p in zip(offset, parts, strict=False)]).astype(np.uint64) for i in (3, 4))
        counts = np.concatenate([p[5] for p in parts]).astype(np.int64)
        bits = np.uint64(max(1, (len(words) - 1).bit_length()))
        if 3 * int(bits) <= 64:
            order_ = np.argsort((((v << bits) | u) << bits) | w)
        else:
            order_ = np.lexsort((w, u, v))
        u, v, w, counts = (x[order_] for x in (u, v, w, counts))
        first = begins(v, u, w)
        return words, *(x[first].astype(np.int64) for x in (u, v, w)), np.add.reduceat(counts, first)

    def open_shard(shard: int):
        tables = {name: TableWriter(f"{folder}/{name}-{shard}", planes) for name, planes in (("triples", 1), ("contexts", 4), ("pairs", 1))}

        def work(at: int, rows: list) -> Iterator[tuple]:
            segment = at % per_shard
            words, u, v, w, counts = merged(rows)
            full = words[u] != NONE
            context = gram(words[u], words[v])
            tables["triples"].add(segment, gram(context, words[w])[full], counts[full])
            first = begins(v, u)
            stats = followers(counts, first)
            kept = full[first] & (stats[0] > 1)
            tables["contexts"].add(segment, context[first][kept], *(x[kept] for x in stats))
            # Pairs: how many words come before each, or its count behind the begin of a text.
            order_ = np.argsort((v << 32) | w, kind="stable")
            v, w, counts, alone = v[order_], w[order_], counts[order_], ~full[order_]
            first = begins(v, w)
            adjusted = np.add.reduceat(np.where(alone, counts, 1), first)
            v, w = v[first], w[first]
            warm = np.isin(words, hot)[v]
            if warm.any():
                a, b = words[v[warm]], words[w[warm]]
                ranges = range_of(gram(a, b), n)
                by_range = np.argsort(ranges, kind="stable")
                cuts = np.append(begins(ranges[by_range]), len(by_range))
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    own = by_range[x:y]
                    yield int(ranges[own[0]]), _HOT, pack(a[own], b[own], adjusted[warm][own])
            v, w, adjusted = v[~warm], w[~warm], adjusted[~warm]
            tables["pairs"].add(segment, gram(words[v], words[w]), adjusted)
            first = begins(v) if len(v) else np.empty(0, np.int64)
            yield from _of_words(n, _CONTEXT, words[v[first]], *followers(adjusted, first))
            times = np.bincount(w, minlength=len(words))
            yield from _of_words(n, _FOLLOWER, words[times > 0], times[times > 0])
            yield -1, _COUNTS, pack(counts_of_counts(counts[~alone]), counts_of_counts(adjusted))

        return work, lambda: [t.close() for t in tables.values()]

    return _each_range(open_shard, per_shard)


def _own_hot_pairs(folder: str, n: int, per_shard: int):
    """Pairs behind hot words: the parts of their adjusted counts added up, to the shard's table."""

    def open_shard(shard: int):
        table = TableWriter(f"{folder}/hot-{shard}")

        def work(at: int, rows: list) -> Iterator[tuple]:
            parts = [unpack(b) for _, b in rows]
            a, b = (np.concatenate([p[i] for p in parts]).astype(np.uint64) for i in (0, 1))
            adjusted = np.concatenate([p[2] for p in parts]).astype(np.int64)
            order_ = np.lexsort((b, a))
            a, b = a[order_], b[order_]
            first = begins(a, b)
            adjusted = np.add.reduceat(adjusted[order_], first)
            a, b = a[first], b[first]
            table.add(at % per_shard, gram(a, b), adjusted)
            runs = begins(a)
            yield from _of_words(n, _CONTEXT, a[runs], *followers(adjusted, runs))
            yield from _of_words(n, _FOLLOWER, *np.unique(b, return_counts=True))
            yield -1, _COUNTS, pack(np.zeros(KINDS, np.int64), counts_of_counts(adjusted))

        return work, table.close

    return _each_range(open_shard, per_shard)


def _own_stats(folder: str, n: int, per_shard: int):
    """All that is known of the words of a shard, to its files in order of the hashes."""

    def open_shard(shard: int):
        files, done = Files(f"{folder}/words-{shard}", ("keys", "low", "large")), [0]
        known, low, large = (mapped(f"{folder}/counted-{shard}.{p}", k) if os.path.exists(f"{folder}/counted-{shard}.{p}") else np.empty(0, k) for p, k in (("keys", "<u8"), ("low", "u1"), ("large", "<i8")))
        large = large.reshape(-1, 2)

        def work(at: int, rows: list) -> Iterator[tuple]:
            parts = {kind: [unpack(b) for k, b in rows if k == kind] for kind in (_CONTEXT, _FOLLOWER)}
            joined = lambda kind, i, t: np.concatenate([np.empty(0, t), *(p[i] for p in parts[kind])]).astype(t)
            own = add_up(joined(_CONTEXT, 0, np.uint64), *(joined(_CONTEXT, i, np.int64) for i in (1, 2, 3, 4)))
            after = add_up(joined(_FOLLOWER, 0, np.uint64), joined(_FOLLOWER, 1, np.int64))
            x, y = np.searchsorted(range_of(known, n), (at, at + 1))
            keys = np.union1d(known[x:y], own[0])  # the begin of a text is a context, but no word
            stats = np.zeros((len(keys), len(WORD_PLANES)), np.int64)
            stats[np.searchsorted(keys, known[x:y]), 0] = stretch(low[x:y], np.arange(x, y), large)
            stats[np.searchsorted(keys, after[0]), 1] = after[1]
            for i, values in enumerate(own[1:], 2):
                stats[np.searchsorted(keys, own[0]), i] = values
            files.write("keys", keys)
            for part, array in zip(("low", "large"), squeeze(stats, done[0]), strict=True):
                files.write(part, array)
            done[0] += stats.size
            yield -1, _COUNTS, pack(counts_of_counts(after[1]), np.array([after[1].sum(), (after[1] > 2).sum()]))

        return work, files.close

    return _each_range(open_shard, per_shard)


# --- the model -----------------------------------------------------------------------------


def discounts(coc: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more (Chen and Goodman); 0.5 to 1.5 where data are few."""
    n1, n2, n3, n4 = (float(x) for x in coc)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), k) for k, d in enumerate(found, 1))])


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    shards: int
    per_shard: int  # ranges of a shard
    hot: np.ndarray
    n_tokens: int
    n_types: int
    triple_discounts: np.ndarray
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    n_pairs: int  # distinct pairs: the sum of continuation counts
    rest: float  # probability that the word level leaves to the uniform distribution


def train(df: DataFrame, order: int = ORDER) -> Model:
    """Count ``text`` of all rows of ``df``; ``order`` is 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark, n = df.sparkSession, shuffle_partitions(df)
    folder = shared_folder(spark, "lm")
    texts = df.select("text")
    words = _in_ranges(texts.mapInArrow(frugal(_count_words(n * WORD_RANGES)), _ROWS), n, WORD_RANGES)
    found = [unpack(r["blob"]) for r in words.mapInArrow(frugal(_own_words(folder)), _ROWS).collect()]
    n_types, n_tokens = (int(sum(int(p[0][i]) for p in found)) for i in (0, 1))
    per_shard = max(1, math.ceil(n_tokens / (n * RANGE)))
    ranges = n * per_shard
    hot = np.sort(np.concatenate([np.empty(0, np.uint64), *(p[1].astype(np.uint64)[p[2] > n_tokens / ranges] for p in found)]))
    grams = _in_ranges(texts.mapInArrow(frugal(_count_grams(ranges, hot, order)), _ROWS), n, per_shard)
    parts = shared_table(spark, grams.mapInArrow(frugal(_own_grams(folder, ranges, per_shard, hot, order)), _ROWS), "grams")
    pairs = _in_ranges(parts.filter(f"kind = {_HOT}"), n, per_shard).mapInArrow(frugal(_own_hot_pairs(folder, ranges, per_shard)), _ROWS)
    pairs = shared_table(spark, pairs, "pairs")
    parts = parts.filter(f"kind <> {_HOT}").union(pairs)
    stats = _in_ranges(parts.filter(f"kind <> {_COUNTS}"), n, per_shard).mapInArrow(frugal(_own_stats(folder, ranges, per_shard)), _ROWS)
    tally = lambda rows, i, least: sum((unpack(r["blob"])[i].astype(np.int64) for r in rows), np.zeros(least, np.int64))
    of_grams = parts.filter(f"kind = {_COUNTS}").collect()
    of_words = stats.collect()
    triple_coc, pair_coc = (tally(of_grams, i, KINDS) for i in (0, 1))
    word_coc, (n_pairs, more) = tally(of_words, 0, KINDS), tally(of_words, 1, 2).tolist()
    d = discounts(word_coc)
    rest = (d[1] * word_coc[0] + d[2] * word_coc[1] + d[3] * more) / n_pairs if n_pairs else 1.0
    return Model(folder, order, n, per_shard, hot, n_tokens, n_types, discounts(triple_coc), discounts(pair_coc), d, n_pairs, float(rest))


class Mapped:
    """The model's files mapped into a worker's memory."""

    def __init__(self, model: Model):
        self.m, self.ranges, self.tables = model, model.shards * model.per_shard, {}

    def table(self, name: str, shard: int, planes: int) -> Table | None:
        if (name, shard) not in self.tables:
            path = f"{self.m.folder}/{name}-{shard}"
            self.tables[name, shard] = Table(path, self.m.per_shard, planes) if os.path.exists(f"{path}.segments") else None
        return self.tables[name, shard]

    def by_shard(self, ranges: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shards = ranges // self.m.per_shard
        order = np.argsort(shards, kind="stable")
        cuts = np.searchsorted(shards[order], np.arange(self.m.shards + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            yield int(k), order[cuts[k] : cuts[k + 1]]

    def find(self, name: str, keys: np.ndarray, ranges: np.ndarray, planes: int = 1) -> np.ndarray:
        """Values of ``keys`` in their ranges; zeros where there are none."""
        out = np.zeros((len(keys), planes), np.int64)
        for shard, own in self.by_shard(ranges):
            table = self.table(name, shard, planes)
            if table:
                out[own] = table.find(keys[own], ranges[own] % self.m.per_shard)
        return out

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Counts and statistics of sorted distinct words."""
        out = np.zeros((len(keys), len(WORD_PLANES)), np.int64)
        for shard, own in self.by_shard(range_of(keys, self.ranges)):
            if ("words", shard) not in self.tables:
                path = f"{self.m.folder}/words-{shard}"
                self.tables["words", shard] = (mapped(f"{path}.keys", "<u8"), mapped(f"{path}.low", "u1"), mapped(f"{path}.large", "<i8").reshape(-1, 2)) if os.path.exists(f"{path}.keys") else None
            if self.tables["words", shard] is None or not len(self.tables["words", shard][0]):
                continue
            table, low, large = self.tables["words", shard]
            at = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
            hit = np.flatnonzero(table[at] == keys[own])
            places = at[hit][:, None] * len(WORD_PLANES) + np.arange(len(WORD_PLANES))
            out[own[hit]] = stretch(low[places], places, large)
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, and the model's log10 probability."""
        m = self.m
        seq, size = sequence(texts)
        words, at = np.unique(seq, return_inverse=True)
        stats = self.words(words)
        ends = np.flatnonzero((seq != NONE) & (seq != BEGIN))
        count, follows = stats[:, 0], stats[:, 1]
        unigram = np.maximum(follows - m.word_discounts[np.minimum(follows, 3)], 0) / max(m.n_pairs, 1) + m.rest / (m.n_types + 1)
        is_hot = np.isin(words, m.hot)
        of_word = range_of(words, self.ranges)

        # All pairs of neighbours, as n-grams and as contexts.
        pairs, place = np.unique((at[:-1] << 32) | at[1:], return_inverse=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        both = gram(words[a], words[b])
        own = range_of(both, self.ranges)
        adjusted = np.zeros(len(pairs), np.int64)
        for name, some, where in (("pairs", np.flatnonzero(~is_hot[a]), of_word[a]), ("hot", np.flatnonzero(is_hot[a]), own)):
            adjusted[some] = self.find(name, both[some], where[some])[:, 0]
        bound = lambda c, d, total, n1, n2, n3: (np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total, 1), np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0))
        now, before = at[ends], at[ends - 1]
        high, gamma = bound(adjusted[place[ends - 1]], m.pair_discounts, *stats[before, 2:].T)
        p = high + gamma * unigram[now]
        if m.order > 2:
            later = np.flatnonzero(seq[ends - 2] != NONE)  # all tokens but the first of a text
            context = place[ends[later] - 2]
            where = np.where(is_hot[b], own, of_word[b])
            kept = self.find("contexts", both, where, 4)
            alone = (kept[:, 0] == 0) & (adjusted > 0)  # one follower, seen once
            kept[alone, :2] = 1
            together = self.find("triples", gram(both[context], words[now[later]]), where[context])[:, 0]
            high, gamma = bound(together, m.triple_discounts, *kept[context].T)
            p[later] = high + gamma * p[later]
        base = np.log10((count + 0.5) / (m.n_tokens + 0.5 * (m.n_types + 1)))[now]
        begin = np.cumsum(size) - size
        return size, *(np.add.reduceat(x, begin) for x in ((count[now] > 0).astype(np.int64), base, np.log10(p)))


def score(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep``, then n_tokens, n_known, base_score and score of each whole text."""
    names = ["n_tokens", "n_known", "base_score", "score"]
    if set(keep) & set(names):
        raise ValueError(f"columns to keep may not be named {', '.join(names)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = Mapped(model)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in blocks([len(t) for t in texts]):
                found = found_in.score(texts[a:b])
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))], [*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, "text").mapInArrow(frugal(run), f"{fields}, n_tokens long, n_known long, base_score double, score double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 1
    model = train(docs.filter(~held_out))
    found = score(docs, model, ["doc_id"])
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity")
    )


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op1_lm_scoring`` that SQL can express."""
    found = op1_lm_scoring(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LM_BASE_SQL = """
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
fold AS (
  SELECT doc_id, text, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 1 AS held_out
  FROM documents, step),
d AS (
  SELECT doc_id, held_out, unnest(list_append(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), chr(10))) AS token
  FROM fold),
c AS (SELECT token, count(*) AS c FROM d WHERE NOT held_out GROUP BY token),
n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, n AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + CAST(0.5 AS DOUBLE)) / (n + CAST(0.5 AS DOUBLE) * (v + 1)))), 4) AS base_score
FROM d LEFT JOIN c USING (token), n GROUP BY doc_id, held_out, n
"""
