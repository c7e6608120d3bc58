"""Operators that look at all texts together, against SQL or brute force."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanemill.llm import exact_dedup, mixing, neardup, pieces
from lanemill.llm import queries as llm_queries
from tests.oracle import assert_same, connect

DOC = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "A B c d e f"), (4, " \t\n"), (5, "long text é " * 9000), (6, "a b"), (7, "a b")]
    return spark.createDataFrame([(*r, "k", None if r[0] == 2 else "s", 9, "clash") for r in rows], DOC + ", lang string, source string, n_chars long, kept string")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_equals_sql(spark, name):
    assert_same(llm_queries.QUERIES[name](spark, SF), connect(SF).sql(llm_queries.ORACLES[name]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(llm_queries.QUERIES))
def test_every_row_gets_a_result(spark, name):
    assert llm_queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# --- op4 -------------------------------------------------------------------------------------


def test_trie_keeps_whole_strings_with_and_without_spills(tmp_path):
    rnd = random.Random(1)
    keys = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))).encode() for _ in range(2000)]
    wanted = {}
    for i, k in enumerate(keys):
        wanted.setdefault(k, []).append(i)
    for limit, spill_dir in ((1 << 30, None), (8000, str(tmp_path))):
        trie = exact_dedup.PatriciaTrie(limit, spill_dir)
        for i, k in enumerate(keys):
            trie.insert(k, ((0, False, i), {"id": i}, 1))
        spilled = len(trie.runs)
        assert bool(spilled) == bool(spill_dir)
        found = list(trie.items())
        assert [k for k, _ in found] == sorted(wanted)
        assert all(o[0][2] == min(wanted[k]) and o[1]["id"] == min(wanted[k]) and o[2] == len(wanted[k]) for k, o in found)
    assert not list(tmp_path.iterdir())


def test_owners_and_decisions_on_odd_rows(spark, odd):
    rows = exact_dedup.decisions(odd).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (1, 2, True)
    assert {by[i].keep_id for i in (2, 3)} == {4} and by[4].group_size == 3  # the blank text is the longest
    assert by[None].keep_id is None and by[None].kept and by[7].keep_id == 6 and not by[7].kept
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5, 6]
    assert exact_dedup.decisions(odd.limit(0)).count() == 0


def test_longest_original_wins(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "a  b"), (4, "a\t\tb"), (5, "a b")], DOC)
    assert {r.doc_id: r.keep_id for r in exact_dedup.decisions(df).collect()} == {1: 3, 2: 3, 3: 3, 4: 3, 5: 5}


# --- op2 -------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_components(docs, share):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= round(100 * share) * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, groups=14):
    rnd = random.Random(seed)
    docs, next_id = [], 0
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(4, 160))]
        for _ in range(rnd.randint(1, 9)):
            text = list(base)
            for _ in range(rnd.randint(0, 5)):
                text[rnd.randrange(len(text))] = f"x{rnd.randint(0, 9999)}"
            docs.append((next_id, " ".join(text)))
            next_id += 1
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(next_id + k, passage + " " + " ".join(f"q{rnd.random()}" for _ in range(rnd.randint(5, 30)))) for k in range(12)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("share", [0.8, 0.85])
def test_components_equal_all_pairs(spark, share):
    docs = near_copies(int(share * 100))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.linked(spark.createDataFrame(docs, DOC), share).collect()}
    assert found == plain_components(docs, share)


def test_large_nodes_branch_and_lose_no_component(spark, monkeypatch):
    """With tiny nodes, every group has to branch; components stay those of all pairs."""
    docs = near_copies(5, groups=6) + [(1000 + k, " ".join([f"s{i}" for i in range(80)] + [f"t{k}"])) for k in range(40)]
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "DEPTH", 3)
    found = {r.doc_id: r.component_id for r in neardup.linked(spark.createDataFrame(docs, DOC), 0.8).collect()}
    assert found == {d: c for d, (_, c) in plain_components(docs, 0.8).items()}


def test_recall_near_the_threshold_with_deep_branching(spark, monkeypatch):
    """Pairs just above the threshold in crowded nodes that branch to full depth; no block comparison."""
    rnd, docs = random.Random(11), []
    common = [f"c{i}" for i in range(30)]
    for k in range(60):
        own = [f"o{k}_{i}" for i in range(170)]
        other = list(own)
        for _ in range(3):
            other[rnd.randrange(20, 150)] = f"x{k}_{rnd.random()}"
        docs += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join(common + other))]
    wanted = {d: c for d, (_, c) in plain_components(docs, 0.8).items()}
    pairs = [d for d, c in wanted.items() if d != c]
    assert len(pairs) > 50
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "DEPTH", 12)
    found = {r.doc_id: r.component_id for r in neardup.linked(spark.createDataFrame(docs, DOC), 0.8).collect()}
    assert sum(found[d] == wanted[d] for d in pairs) >= 0.9 * len(pairs)
    assert all(found[d] in (d, wanted[d]) for d in found)


def test_trees_follow_the_threshold():
    import math

    for share in (0.3, 0.5, 0.8, 0.85, 0.95, 1.0):
        trees, least = neardup.plan(share)
        missed = sum(math.comb(trees, k) * share**k * (1 - share) ** (trees - k) for k in range(least))
        assert missed <= 1.01e-6 and 1 <= least <= trees
    assert neardup.plan(0.3)[0] > neardup.plan(0.8)[0]


def test_rows_are_dropped_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a + " tail"), (5, b), (5, b), (7, b), (None, c), (None, c + " tail"), (None, a + " end"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, DOC)
    kept = sorted((str(r.doc_id), (r.text or "")[:3]) for r in neardup.representatives(df).collect())
    assert kept == [("1", "a0 "), ("5", "b0 "), ("None", ""), ("None", ""), ("None", "c0 ")]
    by = sorted((str(r.doc_id), str(r.component_id)) for r in neardup.linked(df).collect())
    assert by == sorted([("1", "1"), ("5", "1"), ("5", "5"), ("5", "5"), ("7", "5"), ("None", "1"), *[("None", "None")] * 4])
    text_ids = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r.component_id for r in neardup.linked(text_ids).collect()} == {"d1", "d5", None}


def test_near_duplicates_on_odd_rows(spark, odd):
    by = {r.doc_id: r for r in neardup.linked(odd).collect()}
    assert by[1].component_id == 1 and by[None].component_id == 1  # equal words, other case
    assert all(by[i].component_id == i and by[i].n_shingles == 0 for i in (2, 3, 4))
    assert (by[7].component_id, by[7].n_shingles) == (6, 1)
    assert neardup.linked(odd.limit(0)).count() == 0
    assert neardup.representatives(odd).columns == odd.columns


# --- op10 ------------------------------------------------------------------------------------


def test_frame_keeps_every_source_within_a_block():
    rnd = random.Random(1)
    for _ in range(30):
        weights = {f"s{i}": rnd.random() + 0.01 for i in range(rnd.randint(1, 9))}
        quota = mixing.quotas(weights, 60)
        size, slots = sum(quota.values()), mixing.frame_slots(quota)
        assert sorted(t for s in slots.values() for t in s) == list(range(size))
        for s, q in quota.items():
            for t in range(size + 1):
                assert abs(sum(x < t for x in slots[s]) - t * q / size) < 1


@pytest.mark.parametrize(
    "blocks, power",
    [({"hot": 20_000, **{f"s{i}": 1_063 for i in range(40)}}, 0.7), ({f"z{i}": 40_000 // i for i in range(1, 302)}, 0.7), ({"large": 9_996, "small": 4}, 1.0)],
)
def test_whole_runs_stay_within_a_block_of_the_weights(blocks, power):
    weights = {s: n**power for s, n in blocks.items()}
    placed = dict.fromkeys(blocks, 0)
    slots = 0
    for phase in mixing.phases(blocks, weights):
        total = sum(weights[s] for s in phase.slots)
        n = sum(map(len, phase.slots.values()))
        assert phase.base == slots and sorted(t for x in phase.slots.values() for t in x) == list(range(slots, slots + n))
        for s, at in phase.slots.items():
            share = weights[s] / total
            for k, t in enumerate(at):  # the deviation is largest just before and just after a block
                assert abs(k - (t - slots) * share) < 1.001 and abs(k + 1 - (t + 1 - slots) * share) < 1.001
            assert abs(len(at) - n * share) < 1.001
            placed[s] += len(at)
        slots += n
    assert placed == blocks


def test_mix_places_every_row_once_and_on_time(spark, odd):
    rows = [(i, "src0" if i % 3 else f"src{i % 7}") for i in range(1500)] + [(None, None), (7, "src1"), (7, "src1")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("clash"))
    found = mixing.schedule(df, {"src0": 1.0, "src1": 2.0, "src3": 1.0, "gone": 4.0, "src2": 0.0}, block_docs=4, frame=40)
    assert found.columns[:3] == df.columns
    rows = found.collect()
    assert len(rows) == 1503 and sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == sorted([*range(1500), -1, 7, 7])
    assert all(r["__lm_release"] <= r["__lm_slot"] < r["__lm_deadline"] for r in rows)
    assert len({(r["__lm_slot"], r["__lm_place"]) for r in rows}) == 1503
    slots = {(r.source, r["__lm_block"]): r["__lm_slot"] for r in rows}
    assert sorted(slots.values()) == list(range(len(slots)))
    first = [s for (s, _), t in sorted(slots.items(), key=lambda x: x[1])][:20]
    assert abs(first.count("src1") - 10) <= 1 and set(first) == {"src0", "src1", "src3"}
    assert mixing.schedule(odd).count() == 9 and mixing.mixed(odd.limit(0)).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


# --- the pipeline ----------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as pipeline

    rnd = random.Random(4)
    stems = {"aa": ["kata", "lumi", "peto"], "bb": ["strov", "grazn", "vlok"]}
    word = lambda lang: "".join(rnd.choice(stems[lang]) for _ in range(3))
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        text = " ".join(word(lang) + rnd.choice("aeiou") for _ in range(60))
        rows.append((len(rows), text, lang, f"src{i % 3}", len(text)))
        if i % 6 == 0:
            rows.append((len(rows), text.replace(" ", "  "), lang, "src0", 0))
        if i % 5 == 0:
            rows.append((len(rows), text + " end", lang, None, 0))
    rows += [(900, None, "aa", "src0", 0), (901, "12 34 !!", "bb", "src1", 8), (902, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.shared_table(spark, stage(spark, docs, ""), name)
        kept[name] = [tuple(r) for r in docs.collect()]
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text_of = {r[0]: r[1] for r in rows}
    assert {r[0] for r in kept["language_id"]} == {r[0] for r in rows if r[0] < 900}
    owners = {}
    for d in sorted(r[0] for r in kept["language_id"]):
        owners.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text_of[d]), []).append(d)
    exact = {max(group, key=lambda d: (len(text_of[d]), -d)) for group in owners.values()}
    assert {r[0] for r in kept["exact_dedup"]} == exact
    near = {d for d, (_, c) in plain_components([(d, text_of[d]) for d in exact], 0.8).items() if d == c}
    assert {r[0] for r in kept["near_dedup"]} == near and len(near) < len(exact)
    assert sorted(kept["mixing"], key=str) == sorted(kept["near_dedup"], key=str)
    # The last stage gives each document its place in the mix.
    clean = spark.createDataFrame(kept["near_dedup"], "doc_id long, text string, lang string, source string, n_chars long")
    due = sorted(mixing.schedule(clean).collect(), key=lambda r: (r["__lm_slot"], r["__lm_place"]))
    position = docs.columns.index("mix_position")
    assert [r[0] for r in sorted(kept["sentencepiece"], key=lambda r: r[position])] == [r.doc_id for r in due]
    assert sorted(r[position] for r in kept["sentencepiece"]) == list(range(len(due)))
    assert mixing.positioned(clean).filter("__lm_position IS NOT NULL").count() == 0
    s = pieces.Segmenter(pieces.load())
    place = docs.columns.index("ids")
    assert {r[0]: s.decode(r[place]) for r in kept["sentencepiece"]} == {d: text_of[d] for d in near}


def test_each_stage_asks_for_small_batches_by_itself(spark):
    import corpus_pipeline as pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, f"kata lumi peto {i}", "aa", "s", 9) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = pipeline.shared_table(spark, docs, "docs")
    before = spark.conf.get(name)
    for stage, run in pipeline.STAGES:
        spark.conf.set(name, "10000")
        run(spark, docs, "")
        assert int(spark.conf.get(name)) <= 1000, stage
    spark.conf.set(name, before)


def test_workers_keep_nothing_of_texts_after_a_task(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(64)], "doc_id long, text string").repartition(8)
    assert pieces.segment(docs, ["doc_id"]).count() == 64
    described = neardup.linked(docs)
    assert described.count() == 64

    def kept(batches):
        from lanemill.llm import textkit

        segmenter = pieces.segmenter_of(pieces.load())
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(segmenter.number) + len(segmenter.memo) + len(segmenter.flat) + sum(map(len, textkit._POWERS))]})

    # More tasks than workers, so that each idle worker gets some.
    assert {r.n for r in spark.range(0, 16, 1, 16).mapInArrow(kept, "n long").collect()} == {0}
