"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes weighted counts of its words and of the shapes of its character triples (letter
cases, digits, blanks and each punctuation mark), and of how often its words and lines repeat.
The singular vectors of a bounded labelled sample span the latent space. The sample's latent
vectors are broadcast; every document's cosines with all of them are computed exactly, in
blocks, and the nearest neighbours vote with weights that grow with similarity.

Cosines are computed in double precision, in blocks of one size, and taken to nine digits, so a
text's score does not depend on the texts that share its block.

Defined cases: a null text counts as empty and gets the vote of the sample's texts nearest to
the empty text; of neighbours with equal cosines the first in the sample's order (by id) count;
with no labelled row every score is 0.5; repeated rows get equal scores; an empty table gives an
empty result; a column to keep may have any name but ``score``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, fold, frugal, labels, text_bytes
from .textkit import word_hashes

#: Most labelled documents in the sample.
SAMPLE_DOCS = 6000
#: Hashed shapes and words, latent dimensions, neighbours, and the power that turns similarity to weight.
SHAPES, WORDS, LATENT, NEIGHBOURS, POWER = 1024, 1024, 64, 25, 4
REPEATS = 12
#: Texts whose cosines are computed at once, and the steps in which they are taken.
ROWS, STEPS = 256, 10**9
_SHAPE = np.array([ord("a") if 97 <= b < 123 or b >= 128 else ord("A") if 65 <= b < 91 else ord("0") if 48 <= b < 58 else b for b in range(256)], np.uint32)
_SLOT = np.array([zlib.crc32(bytes([b])) & 0x7FFFFFFF for b in range(256)], np.int64)


#: Features of a text.
WIDTH = SHAPES + WORDS + 3 * REPEATS


def _steps(share: np.ndarray) -> np.ndarray:
    """Shares in [0, 1] as soft one-hot rows, so that near shares stay near."""
    centres = np.linspace(0, 1, REPEATS)
    return np.exp(-(((share[:, None] - centres) * REPEATS) ** 2) / 2)


def features(texts: list[bytes]) -> np.ndarray:
    """Rows of damped shape counts, then word counts, then three soft one-hot groups; each of unit length."""
    n = len(texts)
    if not n:
        return np.zeros((0, WIDTH), np.float32)
    joined = b"\n\n".join(texts) + b"\n\n"
    data = np.frombuffer(joined, np.uint8)
    shape = _SLOT[_SHAPE[data]]
    triple = (shape[:-2] * 31 + shape[1:-1] * 1009 + shape[2:] * 32749) % SHAPES
    sizes = np.array([len(t) + 2 for t in texts])
    doc = np.repeat(np.arange(n), sizes)[: len(triple)]
    counts = np.bincount(doc * SHAPES + triple, minlength=n * SHAPES).reshape(n, SHAPES).astype(np.float32)
    counts = np.sqrt(counts / sizes[:, None])
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    hashes, words = word_hashes(texts)
    ends = np.cumsum(words)
    slot = np.repeat(np.arange(n), words) * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64)
    terms = np.sqrt(np.bincount(slot, minlength=n * WORDS).reshape(n, WORDS).astype(np.float32))
    terms /= np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1e-9)
    distinct, again, lines = np.ones(n), np.zeros(n), np.ones(n)
    for i in range(n):
        own = hashes[ends[i] - words[i] : ends[i]]
        if len(own) > 1:
            _, c = np.unique(own, return_counts=True)
            distinct[i], again[i] = len(c) / len(own), np.mean(own[1:] == own[:-1])
        parts = texts[i].split(b"\n")
        lines[i] = len(set(parts)) / len(parts)
    rest = np.concatenate([_steps(distinct), _steps(again), _steps(lines)], axis=1).astype(np.float32)
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    return np.concatenate([counts, terms, rest], axis=1)


@dataclass
class Model:
    weight: np.ndarray  # of each feature
    axes: np.ndarray  # features to latent dimensions
    vectors: np.ndarray  # of the sample, unit length
    labels: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of at most ``ROWS`` texts; always computed in a full block."""
        full = np.zeros((ROWS, x.shape[1]))
        full[: len(x)] = x * self.weight
        y = full @ self.axes
        return y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        n = len(self.labels)
        if not n:
            return np.full(len(x), 0.5)
        found, k, order = np.empty(len(x)), min(NEIGHBOURS, n), np.arange(n)
        for a in range(0, len(x), ROWS):
            cosines = np.rint((self.latent(x[a : a + ROWS]) @ self.vectors.T)[: len(x) - a] * STEPS)
            # Cosine and order in one whole number, so that no two neighbours tie.
            near = np.sort(np.argpartition(-(cosines.astype(np.int64) * n - order), k - 1, axis=1)[:, :k], axis=1)
            weight = np.clip(np.take_along_axis(cosines, near, axis=1) / STEPS, 1e-3, 1) ** POWER
            found[a : a + ROWS] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(found, 0, 1)


def sample(docs: DataFrame, marks: DataFrame, label: str, size: int) -> DataFrame:
    """At most ``size`` labelled documents (those with the smallest hashed ids): doc_id, text, label."""
    rank = F.xxhash64(F.lit(5), "doc_id")
    few = marks.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    few = few.orderBy(rank, "doc_id").limit(size)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"])


def featured(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the packed features of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in blocks([len(t) for t in texts]):
                rows = [x.tobytes() for x in features(texts[a:b]).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), pa.array(rows, pa.binary())], [*keep, "features"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, "text").mapInArrow(frugal(run), f"{fields}, features binary")


def train(docs: DataFrame, marks: DataFrame, label: str = "quality", size: int = SAMPLE_DOCS) -> Model:
    """Latent space and labelled vectors of a sample of at most ``size`` rows."""
    rows = featured(sample(docs, marks, label, size), ["doc_id", "label"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return Model(np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros((0, 1)), np.zeros(0))
    x = np.stack([np.frombuffer(r["features"], np.float16) for r in rows]).astype(np.float32)
    seen = (x > 0).mean(axis=0)
    weight = 1 + np.log(1 / np.maximum(seen, 1 / len(x)))
    y = x * weight.astype(np.float32)
    _, axes = np.linalg.eigh((y.T @ y).astype(np.float64))
    model = Model(weight, np.ascontiguousarray(axes[:, ::-1][:, :LATENT]), np.zeros((0, 1)), np.array([float(r["label"]) for r in rows]))
    model.vectors = np.concatenate([model.latent(x[a : a + ROWS])[: len(x) - a] for a in range(0, len(x), ROWS)])
    return model


def score(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the ``score`` of each whole text; the model travels as a broadcast."""
    if "score" in keep:
        raise ValueError("a column to keep may not be named score")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            parts = [sent.value.score(features(texts[a:b])) for a, b in blocks([len(t) for t in texts])]
            found = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.float64())], [*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, "text").mapInArrow(frugal(run), f"{fields}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = documents(spark, sf_dir), labels(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train(docs, marks.filter(~held_out))
    found = score(docs, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
