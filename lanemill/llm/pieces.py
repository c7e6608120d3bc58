"""SentencePiece encoding and decoding with N-best segmentations.

The vocabulary is read from a public model, never trained. A piece's score is its log
probability; the scores of BPE models are ranks, which Zipf's law turns into log
probabilities (minus the logarithm of the rank). Text outside the vocabulary falls back to
byte pieces, so decoding returns every text exactly.

No piece continues past a blank that follows another character, so the piece lattice of a text
is cut there into chunks. A forward Viterbi pass over each distinct chunk gives the best score
of every prefix. These scores are exact heuristics for the backward A-star search, which
yields segmentations best first: from the end, a partial path is worth its own score plus the
best prefix before it. The N best of a text come from its N-1 chunks that lose least by their
second-best segmentation; A-star runs on those only, as all others keep their best one.

Defined cases: null text counts as empty and has no piece; equal scores keep the path whose
last pieces are longest; very long unbroken texts take the same search in plain Python;
repeated rows get equal results; an empty table gives an empty result; extra columns are
carried where the caller names them.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, frugal, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations per text.
N_BEST = 4
#: Chunks up to this many characters are segmented many at a time.
WIDE = 40
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
_BASE = 0x9E3779B97F4A7C15
_SALT = np.uint64(0xD6E8FEB86659FD93)
_CELLS = 1_500_000
_LEAD = 20
#: Distinct chunks that a task remembers from one block of texts to the next.
MEMORY = 250_000


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]  # with plain blanks; empty for control and byte pieces
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    byte_score: float  # of a character outside the vocabulary, for each byte


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    raw = [model.get_score(i) for i in range(n)]
    ranks = min(x for x, s in zip(raw, special, strict=True) if not s) < -100  # log probabilities stay far above
    scores = [-math.log(2 + min(-x, n)) if ranks else x for x in raw]
    pieces = ["" if s else model.id_to_piece(i).replace("▁", " ") for i, s in enumerate(special)]
    if any(" " in p.lstrip(" ") for p in pieces):
        raise ValueError("a piece continues past a blank; texts cannot be cut at blanks")
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces, so not every text could be decoded")
    return Vocabulary(tuple(pieces), tuple(scores), tuple(byte_ids), min(scores) - 10)


class _Numbers(dict):
    """Numbers of chunks, in the order in which they are first asked for."""

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number


class Segmenter:
    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.ids = {p: i for i, p in enumerate(v.pieces) if p}
        self.longest = max(map(len, self.ids))
        self.bytes_of = [p.encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.powers = [np.uint64(pow(_BASE, k, 1 << 64)) for k in range(self.longest + 1)]
        by_hash = sorted((self._hash(p), i) for p, i in self.ids.items())
        self.keys = np.array([h for h, _ in by_hash], np.uint64)
        self.key_ids = np.array([i for _, i in by_hash], np.int32)
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.scores = np.array(v.scores)
        #: Whether any key has these leading bits: few other hashes need the search.
        self.maybe = np.zeros(1 << _LEAD, bool)
        self.maybe[self.keys >> np.uint64(64 - _LEAD)] = True
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of earlier chunks."""
        self.number = _Numbers()
        self.memo: dict[str, list] = {}
        self.best, self.gap = np.zeros(0), np.zeros(0)
        self.count, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.empty(0, np.int32)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + (ord(c) + 1) * int(_SALT)) % (1 << 64)
        return h

    # --- one chunk, in plain Python -----------------------------------------------------

    def lattice(self, chunk: str) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
        """Edges (start, id or -1 for byte pieces, score) by end, longest first, and forward scores."""
        edges: list[list[tuple[int, int, float]]] = [[] for _ in range(len(chunk) + 1)]
        best = [0.0] + [-math.inf] * len(chunk)
        get, scores = self.ids.get, self.v.scores
        for end in range(1, len(chunk) + 1):
            for start in range(max(0, end - self.longest), end):
                i = get(chunk[start:end])
                if i is not None:
                    edges[end].append((start, i, scores[i]))
                elif start == end - 1:
                    edges[end].append((start, -1, self.v.byte_score * len(chunk[start].encode())))
            best[end] = max(best[s] + x for s, _, x in edges[end])
        return edges, best

    def n_best(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations by backward A-star search, best first."""
        found = self.memo.get(chunk)
        if found is not None and len(found) >= n:
            return found[:n]
        edges, best = self.lattice(chunk)
        found, tie = [], 0
        heap = [(-best[-1], 0, len(chunk), 0.0, None)]
        while heap and len(found) < n:
            _, _, at, after, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((after, ids))
                continue
            for start, i, x in edges[at]:
                tie += 1
                piece = [i] if i >= 0 else [self.v.byte_ids[b] for b in chunk[start].encode()]
                heapq.heappush(heap, (-(best[start] + x + after), tie, start, x + after, (piece, path)))
        if len(self.memo) > 10_000:
            self.memo.clear()
        if len(chunk) <= 200:
            self.memo[chunk] = found
        return found

    # --- many chunks of one length, with arrays -----------------------------------------

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that belong to a piece, and the ids of these pieces."""
        rows = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _LEAD)])
        at = np.minimum(np.searchsorted(self.keys, hashes[rows]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[rows]
        return rows[hit], self.key_ids[at[hit]]

    def wide(self, chunks: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks of ``size`` characters: best scores, what the second best loses, numbers of
        pieces, and all pieces in order (-1-c for a character c in bytes)."""
        n = len(chunks)
        chars = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(n, size)
        prefix = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * self.powers[1] + (chars[:, j].astype(np.uint64) + np.uint64(1)) * _SALT
        width = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4))) * self.v.byte_score
        ahead = np.full((size + 1, n), -np.inf)
        ahead[0] = 0
        length, piece = np.zeros((size + 1, n), np.int8), np.zeros((size + 1, n), np.int32)
        edge = {}
        for j in range(1, size + 1):
            for k in range(min(self.longest, j), 0, -1):
                rows, ids = self.look(prefix[j] - prefix[j - k] * self.powers[k])
                score = self.scores[ids]
                if k == 1:  # every character has an edge, if only as bytes
                    every, score = score, width[:, j - 1].copy()
                    score[rows], single = every, np.full(n, -1, np.int32)
                    single[rows], rows, ids = ids, np.arange(n), single
                elif not len(rows):
                    continue
                edge[j, k] = rows, score
                total = ahead[j - k, rows] + score
                better = total > ahead[j, rows]
                ahead[j, rows[better]] = total[better]
                length[j, rows[better]] = k
                piece[j, rows[better]] = ids[better]
        behind = np.full((size + 1, n), -np.inf)
        behind[size] = 0
        for j in range(size, 0, -1):
            for k in range(1, min(self.longest, j) + 1):
                if (j, k) in edge:
                    rows, score = edge[j, k]
                    behind[j - k, rows] = np.maximum(behind[j - k, rows], score + behind[j, rows])
        # The path from its end; a cell is a place at which a piece of the best path ends.
        ends = np.zeros((size + 1, n), bool)
        at, rows = np.full(n, size), np.arange(n)
        while True:
            live = at > 0
            if not live.any():
                break
            ends[at[live], rows[live]] = True
            at = at - np.where(live, length[at, rows], 0)
        second = np.full(n, -np.inf)
        for (j, k), (rows, score) in edge.items():
            through = ahead[j - k, rows] + score + behind[j, rows]
            through[ends[j, rows] & (length[j, rows] == k)] = -np.inf
            second[rows] = np.maximum(second[rows], through)
        found = np.where(piece[1:] >= 0, piece[1:], -1 - chars.T.astype(np.int64))
        inside = ends[1:].T
        return ahead[size], ahead[size] - second, inside.sum(axis=1), found.T[inside]

    # --- texts ---------------------------------------------------------------------------

    def expand(self, ids: np.ndarray) -> np.ndarray:
        """Characters in bytes (negative) as their byte pieces."""
        low = np.flatnonzero(ids < 0)
        if not len(low):
            return ids
        out, last = [], 0
        for i in low:
            out.append(ids[last:i])
            out.append(np.array([self.v.byte_ids[b] for b in chr(-1 - int(ids[i])).encode()], ids.dtype))
            last = i + 1
        return np.concatenate([*out, ids[last:]])

    def learn(self, chunks: list[str]) -> None:
        """Best segmentations of chunks that are not yet remembered, in the order of their numbers."""
        score, gap, count = np.zeros(len(chunks)), np.zeros(len(chunks)), np.zeros(len(chunks), np.int64)
        pieces: list[np.ndarray] = []
        order: list[int] = []
        by_size: dict[int, list[int]] = {}
        for k, c in enumerate(chunks):
            by_size.setdefault(len(c), []).append(k)
        for size, own in by_size.items():
            if size > WIDE:
                for k in own:
                    two = self.n_best(chunks[k], 2)
                    score[k], gap[k], count[k] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf, len(two[0][1])
                    pieces.append(np.array(two[0][1], np.int32))
                    order.append(k)
                continue
            step = max(1, _CELLS // (size * self.longest))
            for a in range(0, len(own), step):
                some = own[a : a + step]
                score[some], gap[some], count[some], ids = self.wide([chunks[k] for k in some], size)
                pieces.append(ids.astype(np.int32))
                order += some
        begin = np.empty(len(chunks), np.int64)
        begin[order] = len(self.flat) + np.cumsum(count[order]) - count[order]
        self.best, self.gap = np.concatenate([self.best, score]), np.concatenate([self.gap, gap])
        self.count, self.begin = np.concatenate([self.count, count]), np.concatenate([self.begin, begin])
        self.flat = np.concatenate([self.flat, *pieces])

    def encode(self, texts: list[str], n: int = N_BEST) -> list[tuple[np.ndarray, float, list[tuple[float, list]]]]:
        """For each text its best ids, their score, and the next ``n``-1 segmentations as (score,
        swaps); a swap (at, drop, ids) replaces ``drop`` of the best pieces from ``at`` on."""
        if len(self.number) > MEMORY:
            self.forget()
        number = self.number
        places, upto = [], []
        for text in texts:
            if text:
                places.extend(map(number.__getitem__, _CHUNK.findall(" " + text)))
            upto.append(len(places))
        self.learn(list(islice(number, len(self.best), None)))
        chunks, where = list(number), np.array(places, np.int64)
        gap, score, count, begin, flat = self.gap, self.best, self.count, self.begin, self.flat
        found, last = [], 0
        for end in upto:
            own = where[last:end]
            last = end
            counts = count[own]
            stops = np.cumsum(counts)
            ids = flat[np.repeat(begin[own] - (stops - counts), counts) + np.arange(stops[-1] if len(own) else 0)]
            total = float(score[own].sum())
            found.append((self.expand(ids), total, self.others(chunks, own, gap, total, n) if n > 1 and len(own) else []))
        return found

    def others(self, chunks: list[str], own: np.ndarray, gap: np.ndarray, total: float, n: int) -> list[tuple[float, list]]:
        """Segmentations 2 to ``n`` of a text: A-star lists of the chunks that lose least, merged."""
        loss = gap[own]
        few = np.argpartition(loss, n - 1)[: n - 1] if len(own) > n - 1 else np.arange(len(own))
        few = np.sort(few[np.isfinite(loss[few])])
        lists = [self.n_best(chunks[own[i]], n) for i in few]
        # Choices (one rank per chunk) in order of what they lose.
        heap, seen, found = [(0.0, (0,) * len(lists))], set(), []
        while heap and len(found) < n:
            lost, ranks = heapq.heappop(heap)
            found.append((lost, ranks))
            for i in range(len(lists)):
                after = (*ranks[:i], ranks[i] + 1, *ranks[i + 1 :])
                if after[i] < len(lists[i]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (sum(x[0][0] - x[r][0] for x, r in zip(lists, after, strict=True)), after))
        return [(total - lost, [(int(few[i]), lists[i][r][1]) for i, r in enumerate(ranks) if r]) for lost, ranks in found[1:]]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=1)
def segmenter_of(vocabulary: Vocabulary) -> Segmenter:
    """One segmenter per worker process; what it remembers of texts ends with the task."""
    return Segmenter(vocabulary)


def segment(df: DataFrame, keep: list[str], n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """Columns ``keep``, then ``ids`` (best pieces of the whole text), ``score``, and ``others``:
    the next ``n``-1 segmentations as score and swaps (chunk number, ids instead of its best)."""
    vocabulary = load(model)
    swap = pa.struct([("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))])
    other = pa.list_(pa.struct([("score", pa.float64()), ("swaps", pa.list_(swap))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = segmenter_of(vocabulary)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in text_bytes(batch.column("__lm_text"))]
            for a, b in blocks([len(t) for t in texts]):
                found = segmenter.encode(texts[a:b], n)
                ends = np.cumsum([0] + [len(x[0]) for x in found]).astype(np.int32)
                flat = np.concatenate([x[0] for x in found]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                others = pa.array([[{"score": s, "swaps": [{"chunk": c, "ids": w} for c, w in swaps]} for s, swaps in x[2]] for x in found], other)
                columns = [batch.column(c).slice(a, b - a) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, ids, pa.array([x[1] for x in found], pa.float64()), others], [*keep, "__lm_ids", "__lm_score", "__lm_others"])
        segmenter.forget()  # Spark gives tasks to idle workers in turn, so it would soon stand in each of them

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    schema = ", ".join([*fields, "__lm_ids array<int>, __lm_score double, __lm_others array<struct<score:double,swaps:array<struct<chunk:int,ids:array<int>>>>>"])
    return df.select(*keep, F.col("text").alias("__lm_text")).mapInArrow(frugal(run), schema)


def decode(df: DataFrame, keep: list[str], column: str = "ids", model: str = MODEL) -> DataFrame:
    """Columns ``keep``, then the ``text`` whose pieces are in ``column``."""
    vocabulary = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = segmenter_of(vocabulary)
        for batch in batches:
            ids = batch.column("__lm_coded")
            for a in range(0, len(ids), 1000):
                part = ids.slice(a, 1000)
                texts = [segmenter.decode(x.values.to_numpy() if x.is_valid else ()) for x in part]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, 1000) for c in keep), pa.array(texts, pa.string())], [*keep, "__lm_text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    return df.select(*keep, F.col(column).alias("__lm_coded")).mapInArrow(frugal(run), ", ".join([*fields, "__lm_text string"]))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the best pieces and of the text decoded from them, and the N-best scores."""
    found = segment(documents(spark, sf_dir), ["doc_id"])
    whole = decode(found, ["doc_id", "__lm_ids", "__lm_score", "__lm_others"], "__lm_ids")
    return whole.select(
        "doc_id",
        F.size("__lm_ids").cast("long").alias("n_pieces"),
        F.sha2(F.concat_ws(",", F.col("__lm_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.col("__lm_score").alias("score"),
        F.transform("__lm_others", lambda x: x["score"]).alias("other_scores"),
        F.sha2("__lm_text", 256).alias("decoded_sha256"),
    )
