"""Language identification by compression.

One zstandard raw-content dictionary per language is filled from a bounded sample of labelled
texts. A whole text is reduced to its letters in lower case, words that repeat the one before
left out, and cut into equal blocks; every block is compressed with every dictionary, and the
language with the smallest summed size wins. The relative margin to the second smallest says
how sure that is, and a narrow margin rejects. Texts of all lengths take the same encoder, level
and rule; each block ends with the same run of line breaks (see ``FILLER``).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; sizes that tie go
to the language that comes first by name; with no labelled row every text is ``und``; repeated
rows get the same answer each; other columns are neither used nor needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, fold, frugal, shared_table, text_bytes

#: Most labelled documents that fill one language's dictionary, and its size in bytes.
SAMPLE_DOCS = 200
DICTIONARY_BYTES = 112 << 10
#: Each so many-th sampled row is held out of the dictionaries.
HELD_OUT = 5
#: Bytes of a piece of a text, at least; of a dictionary (the encoder takes no fewer); and of all
#: dictionaries together: beyond 256 languages each gets an equal share.
PIECE, LEAST_BYTES, ALL_BYTES = 256, 8, 28 << 20
#: Texts are compressed in equal blocks of at most this many bytes.
BLOCK = 4096
LEVEL = 6
#: Ends every block. The encoder stores a block that it cannot shorten as it is, which would tell no
#: language from another; with a run that it can shorten, it always encodes. It costs all alike.
FILLER = b"\n" * 400
#: Margins below this share of what all but ``LOW`` of all rightly recognised rows outside the dictionaries
#: reach reject a text; without such rows only a tie does.
SHARE, LOW, MIN_MARGIN = 0.3, 0.01, 0.001
#: Steps of a margin that are told apart.
STEPS = 1_000_000


WORD = re.compile(r"[^\W\d_]+")


def letters(text: bytes) -> bytes:
    """The words of a text in lower case with single spaces, repeats of the word before left out."""
    last, words = None, []
    for w in WORD.findall(text.decode("utf-8", "replace").lower()):
        if w != last:
            words.append(w)
            last = w
    return " ".join(words).encode()


def spread(text: bytes, size: int) -> bytes:
    """``size`` bytes of a text in equal pieces from all over it; a shorter text as a whole."""
    if len(text) <= size:
        return text
    n = max(1, size // PIECE)
    return b"\n".join(text[k * len(text) // n :][: max(size // n - 1, 1)] for k in range(n))


def fill(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Pieces of every text, up to ``size`` bytes: what short texts leave of their equal shares goes to the longer ones."""
    room = share = size - len(texts)
    for k, n in enumerate(sorted(map(len, texts))):
        share = room // (len(texts) - k)
        if n > share:
            break
        room -= n
        share = size
    found = b"\n".join(spread(t, max(share, 1)) for t in texts)[:size]
    return found * -(-LEAST_BYTES // len(found)) if found else found


def place_of() -> Column:
    """A row's place in hashed order, from 0 to 1."""
    return F.xxhash64(F.lit(7), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))) / F.lit(2.0**64) + 0.5


def sampled(df: DataFrame, sample_docs: int) -> DataFrame:
    """lang, rank, place (from 0 in hashed order), languages (their number) and plain text of the sampled rows:
    for each language those with letters and the smallest hashed ids, ``sample_docs`` for its dictionary
    and a quarter more between them that no dictionary sees."""
    rows = df.filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count()
    counts = counts.select("lang", "count", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("languages"))
    # A hash threshold per language keeps the expected sample at twice the bound before the exact cut.
    most = sample_docs * HELD_OUT // (HELD_OUT - 1)
    few = rows.withColumn("rank", place_of()).join(F.broadcast(counts), "lang").filter(F.col("rank") * F.col("count") <= 2.0 * most + 20.0)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(letters(t), DICTIONARY_BYTES) for t in text_bytes(batch.column("text"))]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))

    few = few.select("lang", "languages", "rank", "text").mapInArrow(frugal(plain), "lang string, languages long, rank double, text binary")
    order = Window.partitionBy("lang").orderBy("rank", "text")
    return few.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < most).select("lang", "languages", "rank", "place", "text")


def dictionary_rows(sample: DataFrame) -> DataFrame:
    return sample.filter(f"place % {HELD_OUT} <> {HELD_OUT - 1}")


def learn(sample: DataFrame) -> dict[str, bytes]:
    """Language to dictionary content; the dictionaries together stay within ``ALL_BYTES``."""

    def one(table: pa.Table) -> pa.Table:
        size = min(DICTIONARY_BYTES, max(LEAST_BYTES, ALL_BYTES // table.column("languages")[0].as_py()))
        rows = sorted(zip(table.column("place").to_pylist(), table.column("text").to_pylist(), strict=True))
        return pa.table({"lang": table.column("lang")[:1], "content": pa.array([fill([t for _, t in rows], size)], pa.binary())})

    return {r["lang"]: bytes(r["content"]) for r in dictionary_rows(sample).groupBy("lang").applyInArrow(one, "lang string, content binary").collect()}


def train(df: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Language to dictionary content, from rows with text and lang: every language that labels a
    text with a letter, each from pieces of all its sampled rows."""
    return learn(sampled(df, sample_docs))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(k for k, v in dictionaries.items() if len(v) >= LEAST_BYTES)
        self.encoders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        """Compressed bytes of the whole text under each language's dictionary."""
        total = [0] * len(self.langs)
        step = -(-len(text) // max(1, -(-len(text) // BLOCK)))
        for at in range(0, len(text), max(step, 1)):
            block = text[at : at + step] + FILLER
            for k, c in enumerate(self.encoders):
                total[k] += len(c.compress(block))
        return total

    def __call__(self, text: bytes) -> tuple[str, float, float]:
        """Language, score and margin of a text."""
        plain = letters(text)
        if not self.langs or not plain:
            return "und", 0.0, 0.0
        sizes = self.sizes(plain)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [x for k, x in enumerate(sizes) if k != best]
        margin = (min(rest) - sizes[best]) / max(min(rest), 1) if rest else 1.0
        return self.langs[best], min(1.0, 0.5 + 5 * margin), margin


def predict(df: DataFrame, dictionaries: dict[str, bytes], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df``, then lang_pred, score and margin of its whole ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model(t) for t in text_bytes(batch.column("__lm_text"))]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array([x[i] for x in found], t) for i, t in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "__lm_lang", "__lm_score", "__lm_margin"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    schema = f"{fields}, __lm_lang string, __lm_score double, __lm_margin double"
    return df.select(*keep, F.col("text").alias("__lm_text")).mapInArrow(frugal(run), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs.filter(~held_out))
    found = predict(docs, model, ["doc_id"])
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("__lm_lang").alias("lang_pred"), F.col("__lm_score").alias("score"), F.col("__lm_margin").alias("margin")
    )


def least_margin(found: DataFrame, used: DataFrame) -> float:
    """The margin below which a text is in no learned language, from all labelled rows that no dictionary
    saw. ``found``: what ``predict`` gives, with doc_id, text and lang; ``used``: the rows in the dictionaries.

    Margins are counted in steps, so what is sorted does not grow with the rows."""
    right = found.filter("lang = __lm_lang").withColumn("rank", place_of())
    right = right.join(F.broadcast(used.select("lang", "rank")), ["lang", "rank"], "left_anti")
    steps = right.groupBy(F.floor(F.col("__lm_margin") * STEPS).alias("step")).count()
    every = Window.partitionBy(F.lit(1))
    steps = steps.select("step", F.sum("count").over(every.orderBy("step")).alias("upto"), F.sum("count").over(every).alias("total"))
    low = steps.filter(F.col("upto") > LOW * F.col("total")).agg(F.min("step").alias("low")).first()["low"]
    return max(MIN_MARGIN, SHARE * (low or 0) / STEPS)


def accepted(df: DataFrame, min_margin: float | None = None) -> DataFrame:
    """The rows of ``df`` whose language is found with a margin of ``min_margin`` or more; learns the
    languages, and the margin unless it is given, from the labelled rows of ``df`` itself. All margins
    are then written, as the threshold comes from them."""
    sample = shared_table(df.sparkSession, sampled(df, SAMPLE_DOCS), "languages")
    found = predict(df, learn(sample), df.columns)
    if min_margin is None:
        found = shared_table(df.sparkSession, found, "margins")
        min_margin = least_margin(found, dictionary_rows(sample))
    return found.filter(f"__lm_lang <> 'und' AND __lm_margin >= {min_margin}").select(*df.columns)
