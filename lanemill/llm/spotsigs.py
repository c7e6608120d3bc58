"""SpotSigs fingerprints, with DataFrame functions only.

A spot is a common word (an anchor) with the chain of the two content words that follow it
within a short window; common words in between are passed over. The set of a text's hashed
spots is its fingerprint; chains of three words are added where no spot covers a word. Sets are
compared by Jaccard similarity. ``classes`` compares all fingerprints with each other: sets whose
lengths are too far apart to reach the threshold are told apart by their length partition, or by
the bound that the lengths set, before any element is compared. ``op9_spotsigs`` compares given
pairs, whose exact likeness is asked for, so nothing is pruned there.

Defined cases: null text counts as empty; a text without any spot is marked by all its chains
of three words, and one with fewer than three words by its words as a whole, so every text has
at least one signature and equal texts have equal fingerprints; rows that repeat an id follow
each other in descending order of their texts, rows without an id come after all others; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from .common import documents, shared_table, shuffle_partitions

# Common words of four languages.
ANCHORS = (
    "a an and are as at be by for from he in is it of on or that the this to was were which with "
    "als am auf aus bei das dem den der des die ein eine einen er es für im ist mit nicht sie sind und von zu zur "
    "au aux avec ce dans de du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "al como con del el ella las lo los más no para pero por su una y"
).split()
#: Content words in a chain, and how many words after the anchor they may come from.
CHAIN, REACH = 2, 6


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the distinct spot signatures of column ``text`` as array ``out``."""
    words, raw = f"{out}_words", f"{out}_raw"
    anchor = lambda w: w.isin(ANCHORS)
    chain = lambda i: F.slice(F.filter(F.slice(F.col(words), i + 2, REACH), lambda w: ~anchor(w)), 1, CHAIN)
    spots = F.transform(F.col(words), lambda w, i: F.when(anchor(w), F.concat(F.array(w), chain(i))))
    found = F.transform(F.filter(F.col(raw), lambda x: F.size(x) == CHAIN + 1), lambda x: F.xxhash64(x))
    triples = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.slice(F.col(words), i, 3)))
    return (
        df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
        .withColumn(raw, spots)
        .withColumn(raw, found)
        .withColumn(
            out,
            F.array_distinct(F.when(F.size(raw) > 0, F.col(raw)).when(F.size(words) > 2, triples).otherwise(F.array(F.xxhash64(F.col(words))))),
        )
        .drop(words, raw)
    )


def covering(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the distinct signatures of column ``text`` as array ``out``: its spots, and a chain of
    three words from each word where no spot starts there or at one of the two words before, so that
    no word is left out; the last three words are a chain unless a spot starts there. A text of fewer
    than three words is marked by its words as a whole."""
    words, raw = f"{out}_words", f"{out}_raw"
    anchor = lambda w: w.isin(ANCHORS)
    chain = lambda i: F.slice(F.filter(F.slice(F.col(words), i + 2, REACH), lambda w: ~anchor(w)), 1, CHAIN)
    spots = F.transform(F.col(words), lambda w, i: F.when(anchor(w), F.concat(F.array(w), chain(i))))
    starts = lambda i: F.coalesce(F.size(F.get(F.col(raw), i)) == CHAIN + 1, F.lit(False))
    last = F.size(words) - 3
    mark = lambda w, i: F.when(starts(i), F.xxhash64(F.get(F.col(raw), i))).when(
        (i == last) | ((i < last) & ~starts(i - 1) & ~starts(i - 2)), F.xxhash64(F.slice(F.col(words), i + 1, 3))
    )
    marks = F.filter(F.transform(F.col(words), mark), lambda x: x.isNotNull())
    return (
        df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
        .withColumn(raw, spots)
        .withColumn(out, F.array_distinct(F.when(F.size(words) > 2, marks).otherwise(F.array(F.xxhash64(F.col(words))))))
        .drop(words, raw)
    )


def fingerprint(signature: Column) -> Column:
    """The set of signatures as one string."""
    return F.sha2(F.array_join(F.transform(F.array_sort(signature), lambda s: F.hex(s)), ","), 256)


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a comparison where their lengths rule out ``threshold``."""
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    if not threshold:
        return exact
    return F.when(F.least(F.size(a), F.size(b)) < threshold * F.greatest(F.size(a), F.size(b)), F.lit(0.0)).otherwise(exact)


def length_partition(signature: Column, threshold: float) -> Column:
    """Number of the partition of a set's length. Lengths of one partition are within a factor of
    ``threshold``, so sets that reach it lie in the same or in neighbouring partitions."""
    return F.floor(F.log(F.size(signature).cast("double")) / -math.log(threshold) + 1e-9).cast("int")


def classes(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and ``class_id`` of each row: the smallest id that a chain of links leads to, where sets
    with a Jaccard similarity of ``threshold`` or more are linked. No link between classes is lost.

    Equal sets are one candidate, whatever their number. A set posts as many of its rarest signatures
    as two sets at the threshold must share one of, to its own length partition and the one below, so
    every link meets in a post. First each set is compared with the first of each of its posts, which
    is linear in the posts and joins large groups. Only posts that still hold sets of different
    classes then compare those of different classes with each other; pairs within a class, whose
    comparison could change nothing, are never formed.

    Defined cases beside those above: rows without an id belong to the class of their text, whose
    ``class_id`` is null if no row of it has one; empty texts are one class."""
    spark = df.sparkSession
    rows = covering(df.select("doc_id", "text"), "text", "sigs").withColumn("print", fingerprint(F.col("sigs")))
    rows = shared_table(spark, rows.select("doc_id", "sigs", "print"), "spots")
    sets = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.min("sigs").alias("sigs"))
    sets = shared_table(spark, sets.withColumn("n", F.size("sigs")).withColumn("rep", F.monotonically_increasing_id()), "sets")
    each = sets.select("rep", "n", length_partition(F.col("sigs"), threshold).alias("home"), F.explode("sigs").alias("sig"))
    ranked = each.join(each.groupBy("sig").agg(F.count(F.lit(1)).alias("uses")), "sig")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("uses", "sig"))
    rare = ranked.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    posts = shared_table(spark, rare.select("rep", "n", F.explode(F.array(F.col("home"), F.col("home") - 1)).alias("part"), "sig"), "posts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sides = [sets.select(F.col("rep").alias(side), F.col("sigs").alias(f"sigs_{side}")) for side in "ab"]
        compared = pairs.distinct().join(sides[0], "a").join(sides[1], "b")
        return compared.filter(likeness(F.col("sigs_a"), F.col("sigs_b"), threshold) >= threshold).select("a", "b")

    fits = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9
    heads = posts.groupBy("part", "sig").agg(F.min(F.struct("rep", "n")).alias("head"))
    stars = posts.join(heads, ["part", "sig"]).filter((F.col("head.rep") < F.col("rep")) & fits(F.col("n"), F.col("head.n")))
    links = shared_table(spark, confirmed(stars.select(F.col("head.rep").alias("a"), F.col("rep").alias("b"))), "links")
    joined = shared_table(spark, connected_components(links).toDF("rep", "comp"), "joined")
    labelled = posts.join(joined, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = labelled.groupBy("part", "sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("part", "sig")
    rest = shared_table(spark, labelled.join(mixed, ["part", "sig"], "left_semi"), "rest")
    x, y = (rest.select("part", "sig", *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "comp"))) for side in "ab")
    across = x.join(y, ["part", "sig"]).filter((F.col("rep_a") < F.col("rep_b")) & (F.col("comp_a") != F.col("comp_b")) & fits(F.col("n_a"), F.col("n_b")))
    links = links.unionByName(confirmed(across.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))))
    comps = connected_components(links).toDF("rep", "comp")
    named = sets.select("print", "first_id", "rep").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    names = named.groupBy("comp").agg(F.min("first_id").alias("class_id"))
    return rows.select("doc_id", "print").join(named.join(names, "comp").select("print", "class_id"), "print").select("doc_id", "class_id")


def with_next(df: DataFrame, mark: Callable[[DataFrame, str, str], DataFrame] = signatures) -> DataFrame:
    """Rows (doc_id, text) with their signatures ``sigs`` by ``mark``, and ``next_text`` and ``next_sigs`` of the
    next document in descending doc_id; after the last comes the first.

    Ids are cut at quantiles into buckets; a window finds the next row in a bucket, and one row
    per bucket is passed on to the bucket above it. The whole text is shuffled once."""
    n = 4 * shuffle_partitions(df)
    cuts = df.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    # The number of cuts at or below an id; -1 where there is none.
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0))
    base = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("bucket", bucket)
    heads = base.groupBy("bucket").agg(F.max("doc_id").alias("head_id"))
    # One text per bucket; the few heads are at most one more than the cuts.
    first = base.join(F.broadcast(heads.withColumnRenamed("bucket", "head_bucket")), (F.col("bucket") == F.col("head_bucket")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    first = first.groupBy("bucket").agg(F.max("text").alias("text"))
    down = Window.orderBy(F.col("bucket").desc())
    passed = first.select("bucket", F.coalesce(F.lead("text").over(down), F.first("text").over(down)).alias("border_text"))
    passed = mark(passed, "border_text", "border_sigs")
    dealt = mark(base.repartition(n, "bucket"), "text", "sigs")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    follows = dealt.withColumn("after_text", F.lead("text").over(order)).withColumn("after_sigs", F.lead("sigs").over(order))
    return follows.join(passed.hint("merge"), "bucket").select(
        "doc_id",
        "text",
        "sigs",
        F.coalesce(F.col("after_text"), F.col("border_text")).alias("next_text"),
        F.coalesce(F.col("after_sigs"), F.col("border_sigs")).alias("next_sigs"),
    )


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(documents(spark, sf_dir).select("doc_id", "text"), covering).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third)
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), third)))
    rows = covering(rows.select("doc_id", "n_chars", "edited", "sigs", "next_sigs"), "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
        length_partition(F.col("sigs"), 0.8).alias("length_partition"),
    )


def spotsigs_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op9_spotsigs`` that SQL can express: all but the hashed fingerprints."""
    found = op9_spotsigs(spark, sf_dir)
    near = [F.round(c, 6).alias(c) for c in ("near_edited", "near_next")]
    return found.select("doc_id", "n_chars", "edited_sha256", *near, "n_signatures", "length_partition")


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all documents whose fingerprints' sets reach the default similarity."""
    return classes(documents(spark, sf_dir))


SPOTSIGS_SQL = f"""
WITH a AS (SELECT [{", ".join(f"'{w}'" for w in ANCHORS)}] AS anchors),
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER w, max(doc_id) OVER ()) AS next_id,
        coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM t WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM n),
bt AS (SELECT doc_id, 'text' AS kind, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
w AS (SELECT doc_id, kind, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM bt),
c AS (SELECT w.*, len(words) AS n, list_transform(range(1, len(words) + 1), lambda i: CASE WHEN list_contains(anchors, words[i])
        THEN list_concat([words[i]], list_filter(words[i + 1:i + {REACH}], lambda x: NOT list_contains(anchors, x))[1:{CHAIN}]) END) AS chains FROM w, a),
s AS (SELECT *, list_transform(chains, lambda x: CASE WHEN len(x) = {CHAIN + 1} THEN array_to_string(x, ' ') END) AS spots FROM c),
m AS (SELECT doc_id, kind, CASE WHEN n < 3 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_filter(
    list_transform(range(1, n + 1), lambda i: CASE WHEN spots[i] IS NOT NULL THEN spots[i]
      WHEN i = n - 2 OR (i < n - 2 AND (i < 2 OR spots[i - 1] IS NULL) AND (i < 3 OR spots[i - 2] IS NULL)) THEN array_to_string(words[i:i + 2], ' ') END),
    lambda x: x IS NOT NULL)) END AS sigs FROM s),
j AS (SELECT e.doc_id, length(e.text) AS n_chars, sha256(edited) AS edited_sha256, x.sigs AS own, y.sigs AS other, z.sigs AS after
  FROM e JOIN m x ON x.doc_id = e.doc_id AND x.kind = 'text' JOIN m y ON y.doc_id = e.doc_id AND y.kind = 'edited'
  JOIN m z ON z.doc_id = e.next_id AND z.kind = 'text'),
k AS (SELECT *, len(list_intersect(own, other)) AS p, len(list_intersect(own, after)) AS q FROM j)
SELECT doc_id, n_chars, edited_sha256, round(p / (len(own) + len(other) - p), 6) AS near_edited, round(q / (len(own) + len(after) - q), 6) AS near_next,
       CAST(len(own) AS BIGINT) AS n_signatures, CAST(floor(ln(len(own)) / -ln(CAST(0.8 AS DOUBLE)) + 1e-9) AS INTEGER) AS length_partition
FROM k
"""

#: All pairs of sets that share a signature, without partitions or pruning.
CLASSES_SQL = f"""
WITH RECURSIVE a AS (SELECT [{", ".join(f"'{w}'" for w in ANCHORS)}] AS anchors),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT w.*, len(words) AS n, list_transform(range(1, len(words) + 1), lambda i: CASE WHEN list_contains(anchors, words[i])
        THEN list_concat([words[i]], list_filter(words[i + 1:i + {REACH}], lambda x: NOT list_contains(anchors, x))[1:{CHAIN}]) END) AS chains FROM w, a),
s AS (SELECT *, list_transform(chains, lambda x: CASE WHEN len(x) = {CHAIN + 1} THEN array_to_string(x, ' ') END) AS spots FROM c),
m AS (SELECT doc_id, CASE WHEN n < 3 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_filter(
    list_transform(range(1, n + 1), lambda i: CASE WHEN spots[i] IS NOT NULL THEN spots[i]
      WHEN i = n - 2 OR (i < n - 2 AND (i < 2 OR spots[i - 1] IS NULL) AND (i < 3 OR spots[i - 2] IS NULL)) THEN array_to_string(words[i:i + 2], ' ') END),
    lambda x: x IS NOT NULL)) END AS sigs FROM s),
u AS MATERIALIZED (SELECT doc_id, len(sigs) AS n, unnest(sigs) AS sig FROM m),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.sig = y.sig AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 10 * count(*) >= 8 * (x.n + y.n - count(*))),
r AS (SELECT a AS doc_id, b AS other FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.other)
SELECT m.doc_id, least(m.doc_id, min(r.other)) AS class_id FROM m LEFT JOIN r ON r.doc_id = m.doc_id GROUP BY m.doc_id
"""
