"""Toxicity scored on text restored by a noisy-channel decoder.

Stretches that may be disguised (letters mixed with look-alike digits and signs, single letters
spaced out, characters drawn out) become character lattices: each character may stand for
itself, for a letter it looks like, for a repeat of the one before, or for nothing. Viterbi
search under a character language model finds the most likely clean reading; all other text
has a single path and stays as it is. The restored words are matched with a lexicon of words
and word beginnings learned from labelled rows.

The lexicon comes from all labelled rows: tasks count words and entries, the counts are added
up by entry, and toxic texts that firm entries leave open are covered by a greedy choice.

All distinct words add their evidence. A lexicon entry's is the share of toxic texts among the
labelled ones that hold it (at least one half), and independent entries combine as such: one
minus the product of what each leaves. Where there is no entry, the score is the share of toxic
texts among the labelled ones that the lexicon leaves open.

Defined cases: null and empty texts get the score of a text without evidence; repeated rows
get equal scores; with no labelled row every score is 0; very long tokens are decoded whole; an
empty table gives an empty result; a column to keep may have any name but ``score``.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, frugal, labels, shared_table, text_bytes

#: A lexicon entry must be in so many unlike toxic texts, and this rarely in others.
MIN_TEXTS, MIN_PURITY, PRIOR = 6, 0.9, 3.0
#: Toxic texts that such entries leave open may add entries that are in so many of them and in no other text.
MIN_OPEN = 3
#: Counts (or words) that a task holds before it passes them on.
HELD = 200_000
#: Pairs of open texts and entries up to which their cover takes one pass in the driver instead of rounds.
ONE_PASS = 200_000
#: Lengths of the word beginnings that may be entries.
BEGINNINGS = (4, 5, 6)
# Letters that digits and signs look like.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Costs in nats: of a look-alike, of leaving one out, of leaving out another sign, of reading a
#: sign as a blank, and of a repeat that stands for nothing.
COST_LOOK, COST_LOST, COST_SIGN, COST_BLANK, COST_REPEAT = 1.0, 9.0, 0.2, 1.5, 2.2
WORD = re.compile(r"[^\W\d_]+")
#: Signs that end a token without being part of it; signs that begin one, those that look like letters apart.
TRAILING = "!$|+(.,;:?#%&*)]}\"'-_~…”“’‘»«›‹>"
LEADING = ".,;:?#%&*)]}[{\"'-_~…”“„‚’‘»«›‹<>¿¡"
_SIGNS, _PLAIN, _LOOKS = (re.escape("".join(sorted(set(x)))) for x in (TRAILING + LEADING, set(TRAILING + LEADING) - LOOKS.keys(), LOOKS))
#: One letter, with signs around it; or one sign, with plain signs after it where it looks like a letter.
LONE = rf"(?<!\S)(?:[{_SIGNS}]*+[^\s{_SIGNS}][{_SIGNS}]*+|[{_LOOKS}][{_PLAIN}]*+|\S)(?!\S)"
#: Lone letters parted by blanks; drawn-out letters; words with every letter doubled; letters with single signs between them.
SPACED = re.compile(rf"{LONE}(?:\s++{LONE}){{2,}}")
DRAWN = re.compile(r"([^\W\d_])\1\1")
DOUBLED = re.compile(r"(?:([^\W\d_])\1){3,}")
DOTTED = re.compile(r"(?:\w[.\-_*]){2,}\w")
LOOKING = re.compile("[" + re.escape("".join(LOOKS)) + "]")


def spaced(run: str) -> str:
    """The lone letters of a run with single blanks between them, the signs around them left out."""
    return " ".join(x if len(x) == 1 else x.strip(TRAILING + LEADING) or x[0] for x in run.split())


def disguised(token: str) -> str:
    """The part of a token (lower case) that may be disguised; empty for all plain tokens."""
    if token.isalpha():
        return token if DRAWN.search(token) or DOUBLED.fullmatch(token) else ""
    core = token.lstrip(LEADING).rstrip(TRAILING)
    if not WORD.search(core):
        return ""
    if core[0] == "(" and (DOTTED.fullmatch(core[1:].lstrip(LEADING)) or DOUBLED.fullmatch(core[1:])):
        return core[1:].lstrip(LEADING)  # a bracket, as what it holds is disguised by itself
    return core if LOOKING.search(core) or DRAWN.search(core) or DOUBLED.fullmatch(core) or DOTTED.fullmatch(core) or " " in core else ""


@dataclass
class CharacterModel:
    """A trigram model of characters, smoothed by the bigram and unigram models."""

    three: dict[str, float] = field(default_factory=dict)
    two: dict[str, float] = field(default_factory=dict)
    one: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def grams(words: Iterable[tuple[str, int]]) -> Counter:
        """Counts of one to three characters that follow each other in words and after them."""
        counts = Counter()
        for word, n in words:
            text = f"  {word} "
            for i in range(2, len(text)):
                for k in range(3):
                    counts[text[i - k : i + 1]] += n
        return counts

    @classmethod
    def fit(cls, words: Counter) -> CharacterModel:
        return cls.of(cls.grams(words.items()))

    @classmethod
    def of(cls, grams: dict[str, int]) -> CharacterModel:
        before = Counter()
        for g, c in grams.items():
            before[g[:-1]] += c
        models = [{g: math.log(c / before[g[:-1]]) for g, c in grams.items() if len(g) == k + 1} for k in range(3)]
        return cls(models[2], models[1], models[0])

    def cost(self, context: str, c: str) -> float:
        """Nats of ``c`` after the last two characters, backing off by a fixed factor."""
        x = self.three.get(context + c)
        if x is None:
            x = self.two.get(context[1:] + c)
            x = x - 1.0 if x is not None else self.one.get(c, -12.0) - 2.0
        return -x


def restore(stretch: str, model: CharacterModel) -> str:
    """The most likely clean reading of a disguised stretch (lower case), by Viterbi search.

    A state is the last two characters read."""
    states: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    for c in stretch:
        readings: list[tuple[str | None, float]] = []
        if c.isalpha():
            readings.append((c, 0.0))
        else:
            looks = LOOKS.get(c, "")
            readings += [(x, COST_LOOK) for x in looks]
            readings += [(None, COST_LOST if looks else COST_SIGN), (" ", COST_LOST if looks else COST_BLANK)]
        after: dict[str, tuple[float, tuple]] = {}
        for context, (cost, path) in states.items():
            options = list(readings)
            for x, extra in readings:
                if x is not None and x == context[1] and x != " ":
                    options.append((None, extra + COST_REPEAT))  # one more of the same, drawn out
            for x, extra in options:
                if x is None or (x == " " and context[1] == " "):
                    key, total, way = context, cost + extra, path
                else:
                    key, total, way = context[1] + x, cost + extra + model.cost(context, x), (x, path)
                if key not in after or total < after[key][0]:
                    after[key] = total, way
        states = after
    ends = [(cost + model.cost(context, " ") * (context[1] != " "), context, path) for context, (cost, path) in states.items()]
    path, out = min(ends, key=lambda x: (x[0], x[1]))[2], []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def plain_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def entries(words: Iterable[str]) -> set[str]:
    """Possible lexicon entries of a text: ``word$`` and word beginnings."""
    found = {w + "$" for w in words if len(w) > 2}
    for k in BEGINNINGS:
        found.update(w[:k] for w in words if len(w) > k)
    return found


@dataclass
class Model:
    characters: CharacterModel
    lexicon: dict[str, float]
    base: float  # score of a text without evidence


class Evidence(dict):
    """What a token's strongest entry leaves, as a logarithm; the token is restored where it may be disguised.
    A bounded memo."""

    LIMIT = 200_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        words = set(WORD.findall(token))
        if stretch := disguised(token):
            words.update(restore(stretch, self.model.characters).split())
        found = math.log1p(-min(max((self.model.lexicon.get(e, 0.0) for e in entries(words)), default=0.0), 0.999))
        if len(self) >= self.LIMIT:
            self.clear()
        if len(token) < 200:
            self[token] = found
        return found

    def score(self, text: str) -> float:
        """The combined evidence of a whole text, or the base score if there is none."""
        text = text.lower()
        tokens = set(text.split())
        tokens.update(spaced(m[0]) for m in SPACED.finditer(text))
        left = math.fsum(map(self.__getitem__, tokens))  # exact, so the order of the tokens does not matter
        return max(0.5, -math.expm1(left)) if left < 0 else self.model.base


def _unpacked(column: pa.Array) -> Iterator[list[str]]:
    """The words of each text, as they were packed."""
    unpack = zstandard.ZstdDecompressor()
    for x in column.to_pylist():
        yield unpack.decompress(x).decode().split()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        words = (sorted(plain_words(t.decode("utf-8", "replace"))) for t in text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack.compress("\n".join(w).encode()) for w in words], pa.binary())], ["doc_id", "words"])


def labelled(docs: DataFrame, marks: DataFrame, label: str) -> DataFrame:
    """The distinct words of every labelled text: doc_id, label, words; of texts with the same id one counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = marks.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("boolean").alias("label"))
    words = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(frugal(_packed), f"doc_id {kind}, words binary")
    found = words.join(own, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("words").alias("words"))
    return shared_table(docs.sparkSession, found, "labelled")


def _counts(held: Counter, **also: bool) -> pa.RecordBatch:
    """The counts of keys as rows; they are counted anew from then on."""
    own = [pa.array([x] * len(held), pa.bool_()) for x in also.values()]
    batch = pa.RecordBatch.from_arrays([*own, pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], [*also, "key", "n"])
    held.clear()
    return batch


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each word is, and (clean) in how many texts that are not toxic each entry is."""
    words, clean = Counter(), Counter()
    for batch in batches:
        for label, own in zip(batch.column("label").to_pylist(), _unpacked(batch.column("words")), strict=True):
            words.update(own)
            if not label:
                clean.update(entries(own))
            if len(words) + len(clean) > HELD:
                yield _counts(words, clean=False)
                yield _counts(clean, clean=True)
    yield _counts(words, clean=False)
    yield _counts(clean, clean=True)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of unlike texts: near copies share their least hashed word and become one row."""
    pack, held, size = zstandard.ZstdCompressor(level=1), {}, 0

    def rows() -> pa.RecordBatch:
        words = [pack.compress("\n".join(sorted(w)).encode()) for w in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(words, pa.binary())], ["kind", "words"])

    for batch in batches:
        for words in _unpacked(batch.column("words")):
            if words:
                own = held.setdefault(min(zlib.crc32(w.encode()) for w in words), set())
                size -= len(own)
                own.update(words)
                size += len(own)
            if size > HELD:
                yield rows()
                held, size = {}, 0
    yield rows()


def _of_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many kinds of texts each entry is; the rows of a kind follow each other."""
    held, kind, own = Counter(), None, set()
    for batch in batches:
        for k, words in zip(batch.column("kind").to_pylist(), _unpacked(batch.column("words")), strict=True):
            if k != kind:
                held.update(entries(own))
                kind, own = k, set()
                if len(held) > HELD:
                    yield _counts(held)
            own.update(words)
    held.update(entries(own))
    yield _counts(held)


def _of_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _counts(CharacterModel.grams(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True)))


def cover(pairs: DataFrame, one_pass: int = ONE_PASS) -> tuple[list[str], int]:
    """Of the entries ``key`` of open texts ``doc_id``, those that a greedy cover takes, and how many texts they cover.

    The entry in most open texts is taken (of equal ones that with the largest ``n``, then key) and
    its texts go, as long as it is in ``MIN_OPEN`` texts. An entry that comes first in each of its
    texts is taken anyhow, since the counts of others only fall; all such are taken in one round.
    """
    taken: list[str] = []
    covered = 0
    while True:
        often = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("open")).filter(F.col("open") >= MIN_OPEN)
        pairs = shared_table(pairs.sparkSession, pairs.join(often, "key"), "open")
        if pairs.count() <= one_pass:
            rest, more = _cover([tuple(r) for r in pairs.select("doc_id", "key", "n").collect()])
            return taken + rest, covered + more
        rank = F.struct("open", "n", "key")
        best = pairs.groupBy("doc_id").agg(F.max(rank).alias("best"))
        first = pairs.join(best, "doc_id").groupBy("key").agg(F.min(rank == F.col("best")).alias("first")).filter("first").select("key")
        first = shared_table(pairs.sparkSession, first, "taken")
        gone = shared_table(pairs.sparkSession, pairs.join(first, "key").select("doc_id").distinct(), "covered")
        taken += [r.key for r in first.collect()]
        covered += gone.count()
        pairs = pairs.drop("open").join(gone, "doc_id", "left_anti")


def _cover(rows: list[tuple]) -> tuple[list[str], int]:
    """The same in one pass over (text, entry, n)."""
    order = {key: i for i, (_, key) in enumerate(sorted({(n, key) for _, key, n in rows}, reverse=True))}
    texts, holders = {}, {}
    for text, key, _ in rows:
        texts.setdefault(text, []).append(key)
        holders.setdefault(key, set()).add(text)
    heap = [(-len(own), order[key], key) for key, own in holders.items()]
    heapq.heapify(heap)
    taken, covered = [], 0
    while heap:
        count, place, key = heapq.heappop(heap)
        own = holders[key]
        if len(own) < MIN_OPEN:
            continue
        if len(own) < -count:  # some of its texts have gone since
            heapq.heappush(heap, (-len(own), place, key))
            continue
        taken.append(key)
        covered += len(own)
        for text in list(own):
            for other in texts.pop(text):
                holders[other].discard(text)
    return taken, covered


def train(docs: DataFrame, marks: DataFrame, label: str = "toxic") -> Model:
    """Learn from all labelled rows; only lexicon entries, character counts and the last open texts are collected."""
    spark = docs.sparkSession
    rows = labelled(docs, marks, label)
    total = rows.count()
    if not total:
        return Model(CharacterModel(), {}, 0.0)
    counts = rows.select("label", "words").mapInArrow(frugal(_of_rows), "clean boolean, key string, n long")
    counts = shared_table(spark, counts.groupBy("clean", "key").agg(F.sum("n").alias("n")), "counts")
    grams = counts.filter("NOT clean").select("key", "n").mapInArrow(frugal(_of_grams), "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    characters = CharacterModel.of(dict(zip(grams["key"].to_pylist(), grams["n"].to_pylist(), strict=True)))

    # Entries in some kinds of toxic texts, and in how many other texts they are.
    toxic = rows.filter("label")
    kinds = toxic.select("words").mapInArrow(frugal(_kinds), "kind long, words binary").repartition("kind").sortWithinPartitions("kind")
    likely = kinds.mapInArrow(frugal(_of_kinds), "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_OPEN)
    clean = counts.filter("clean").select("key", F.col("n").alias("clean"))
    likely = likely.join(clean, "key", "left").select("key", "n", F.coalesce("clean", F.lit(0)).alias("clean"))
    firm = (F.col("n") >= MIN_TEXTS) & (F.col("n") / (F.col("n") + F.col("clean")) >= MIN_PURITY)
    likely = shared_table(spark, likely.withColumn("firm", firm).filter("firm OR clean = 0"), "entries")
    lexicon = {r.key: (r.n + 0.5) / (r.n + r.clean + PRIOR) for r in likely.filter("firm").collect()}

    sent = spark.sparkContext.broadcast(frozenset(lexicon))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [entries(words) for words in _unpacked(batch.column("words"))]
            found = [None if own & sent.value else sorted(own) for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    open_ = toxic.select("doc_id", "words").mapInArrow(frugal(left), f"doc_id {kind}, keys array<string>").filter("keys IS NOT NULL")
    open_ = shared_table(spark, open_, "left")
    pure = likely.filter("NOT firm").select("key", "n")
    taken, covered = cover(open_.select("doc_id", F.explode("keys").alias("key")).join(pure, "key"))
    few = spark.createDataFrame([(x,) for x in taken], "key string")
    lexicon |= {r.key: (r.n + 0.5) / (r.n + PRIOR) for r in pure.join(few, "key").collect()}
    return Model(characters, lexicon, min(0.4, (open_.count() - covered + 0.5) / (total + 1)))


def score(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the ``score`` of each whole text; the model travels as a broadcast."""
    if "score" in keep:
        raise ValueError("a column to keep may not be named score")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(sent.value)
        for batch in batches:
            found = [evidence.score(t.decode("utf-8", "replace")) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.float64())], [*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, "text").mapInArrow(frugal(run), f"{fields}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = documents(spark, sf_dir), labels(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train(docs.filter(~held_out), marks.filter(~held_out))
    found = score(docs, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
