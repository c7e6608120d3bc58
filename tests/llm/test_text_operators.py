"""Operators that look at one text at a time, against brute force or round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lanemill.llm import automata, hashtables, langid, lm, pieces, quality, secrets, spotsigs, textkit, toxicity

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows, null ids, a very long text, clashing column names."""
    rows = [(1, "The cat sat on the mat and the dog"), (1, "The cat sat on the mat and the dog"), (2, None), (3, ""), (None, "x y"), (4, " \t\n"), (5, "é ÀB cd " * 20_000), (6, "a")]
    return spark.createDataFrame([(*r, "k", "s", 9, 1.0) for r in rows], DOC + ", lang string, source string, n_chars long, score double")


def test_word_hashes_follow_the_words():
    texts = [b"", b"A b\x0bc", b" a\tB  ", "É é".encode(), b"x" * 100_000]
    h, n = textkit.word_hashes(texts)
    assert n.tolist() == [0, 3, 2, 2, 1]
    assert h[0] == h[3] and h[1] == h[4] and h[5] != h[6] and len(set(h.tolist())) == 6


# --- op3 -------------------------------------------------------------------------------------


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_spans_equal_the_regexes():
    scanner = automata.Scanner(*automata.compiled(tuple(secrets.RULES)))
    rnd = random.Random(1)
    parts = ["password", "Passwd", "secret", "TOKEN", "api_key", "apikey", "=", ":", '"', "'", " ", "abc", "abcdefgh", "AKIA", "AKIAABCDEFGHIJKL", "Z9", "0123456789abcdef", "deadbeef", "é", "\n", "-"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [s for s in secrets.spans(scanner, text.encode()) if s[1] < 3] == plain_spans(text), text


def test_automaton_equals_re_on_other_grammar():
    for pattern in ("a(b|cd)*e?", "[^x]{2,3}y", "(?:ab){2}", "\\d+\\.\\w", "[a-c-]+z"):
        rule = automata.Rule("r", pattern)
        scanner = automata.Scanner(*automata.compiled((rule,)))
        rnd = random.Random(pattern)
        for _ in range(300):
            text = "".join(rnd.choice("abcdexyz1.-") for _ in range(rnd.randint(0, 12)))
            ends = {s[2] for s in scanner.spans(text.encode())}
            assert all(any(re.fullmatch(pattern, text[i:e]) for i in range(e)) for e in ends)
            assert bool(ends) == any(m.group() for m in re.finditer(pattern, text))


def test_more_kinds_and_odd_rows(spark, odd):
    end = " -----BEGIN RSA PRIVATE KEY----- "
    rows = secrets.scan(spark.createDataFrame([(1, "é ghp_" + "aZ9" * 12 + end)], DOC)).first().spans
    assert [(s.kind, s.start, s.end) for s in rows] == [("github", 2, 42), ("private_key", 43, 74)]
    # A base span inside one of another kind stays.
    rows = secrets.scan(spark.createDataFrame([(1, "é ghp_" + "a" * 36 + end)], DOC)).first().spans
    assert [(s.kind, s.start, s.end) for s in rows] == [("github", 2, 42), ("hex", 6, 42), ("private_key", 43, 74)]
    assert secrets.scan(odd).count() == 8 and secrets.scan(odd.limit(0)).count() == 0


# --- op1 -------------------------------------------------------------------------------------


def plain_model(train, order):
    """P(word | two words before), from its definition over lists of tokens."""
    padded = [[None, 0, *t] for t in train]
    count = Counter(w for t in train for w in t)
    triples = Counter(g for t in padded for g in zip(t, t[1:], t[2:], strict=False))
    pairs = Counter()
    for (u, v, w), c in triples.items():
        pairs[v, w] += c if u is None or order == 2 else 1
    if order == 2:
        pairs = Counter(g for t in padded for g in zip(t[1:], t[2:], strict=False))
    follows = Counter(w for _, w in pairs)
    full = {g: c for g, c in triples.items() if g[0] is not None}
    coc = lambda counts: [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    d1, d2, d3 = (lm.discounts(coc(x.values())) for x in (follows, pairs, full))
    of = [defaultdict(list), defaultdict(list)]
    for (v, _), c in pairs.items():
        of[0][v].append(c)
    for (u, v, _), c in full.items():
        of[1][u, v].append(c)
    n = len(pairs)

    def p(u, v, w):
        x = max(follows[w] - d1[min(follows[w], 3)], 0) / n + sum(d1[min(c, 3)] for c in follows.values()) / n / (len(count) + 1)
        for level, d, context, c in ((0, d2, v, pairs[v, w]), (1, d3, (u, v), full.get((u, v, w), 0))):
            seen = of[level].get(context)
            if seen and (level == 0 or order > 2):
                x = max(c - d[min(c, 3)], 0) / sum(seen) + sum(d[min(k, 3)] for k in seen) / sum(seen) * x
        return x

    return count, pairs, p


@pytest.mark.parametrize("order, split", [(3, False), (3, True), (2, False), (2, True)])
def test_model_equals_its_definition_and_sums_to_one(spark, monkeypatch, order, split):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rnd.choice(words[: rnd.randint(1, 12)]) for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(60, None)]
    docs += [(i, docs[i - 61][1]) for i in range(61, 66)]
    df = spark.createDataFrame(docs, DOC)
    if split:  # many ranges, and most words are hot
        monkeypatch.setattr(lm, "RANGE", 20)
    model = lm.train(df.filter("doc_id < 50 OR doc_id > 60"), order)
    assert not split or (model.per_shard > 5 and len(model.hot) > 3)
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [-1]
    train = [token(t) for i, t in docs if i < 50 or i > 60]
    count, pairs, p = plain_model(train, order)
    n = sum(count.values())
    assert (model.n_tokens, model.n_types, model.n_pairs) == (n, len(count), len(pairs))
    for u, v in [(None, 0), (0, "w0"), ("w0", "w1"), ("w11", "w0"), ("unseen", "w1"), ("w1", "unseen")]:
        assert sum(p(u, v, w) for w in [*count, "unseen"]) == pytest.approx(1)
    found = {r.doc_id: r for r in lm.score(df, model, ["doc_id"]).collect()}
    for i, t in docs:
        t = token(t)
        assert found[i].score == pytest.approx(sum(math.log10(p(u, v, w)) for u, v, w in zip([None, 0, *t], [0, *t], t, strict=False)))
        assert found[i].base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (len(count) + 1))) for w in t))
        assert (found[i].n_tokens, found[i].n_known) == (len(t), sum(count[w] > 0 for w in t))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(400)).encode()
    whole = list(lm._pieces([text, b"a b"]))
    monkeypatch.setattr(lm, "PIECE", 33)
    parts = list(lm._pieces([text, b"a b"]))
    grams = lambda pieces: sorted(tuple(map(int, s[k - 2 : k + 1])) for s, e in pieces for k in np.flatnonzero(e))
    assert len(whole) == 1 and len(parts) > 10 and grams(parts) == grams(whole)


def test_packed_arrays_come_back():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, 300):
        for top in (1, 200, 70_000, 1 << 40, (1 << 64) - 1):
            x = rnd.integers(0, top, n, dtype=np.uint64, endpoint=True)
            found = lm.unpack(lm.pack(x, np.sort(x), np.zeros(n, np.int64)))
            assert (found[0] == x).all() and (found[1] == np.sort(x)).all() and found[2].tolist() == [0] * n


def test_hash_tables_give_back_what_was_put_in(tmp_path):
    rnd = np.random.default_rng(3)
    writer, kept = hashtables.TableWriter(f"{tmp_path}/t", 2), {}
    for segment, n in ((0, 5000), (2, 0), (3, 1)):
        keys = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        values = rnd.integers(0, 600, (2, len(keys)))
        kept[segment] = keys, values
        writer.add(segment, keys, *values)
    writer.close()
    table = hashtables.Table(f"{tmp_path}/t", 4, 2)
    for segment, (keys, values) in kept.items():
        assert (table.find(keys, np.full(len(keys), segment)) == values.T).all()
    other = rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert not table.find(other, rnd.integers(0, 4, 5000)).any()


def test_model_of_nothing(spark, odd):
    model = lm.train(odd.limit(0))
    assert [r.score for r in lm.score(odd, model, ["doc_id"]).collect()] == [0.0] * 8
    assert lm.score(odd.limit(0), lm.train(odd), ["doc_id"]).count() == 0


# --- op5, op6, op7 ---------------------------------------------------------------------------


def junk(rnd):
    return " ".join(f"{rnd.choice('abcdef') * 4}{rnd.choice(['###', '$$$', '%%%'])}" for _ in range(60))


def prose(rnd, toxic=False):
    stems = ["river", "stone", "light", "garden", "window", "letter", "winter", "summer", "bridge", "market"]
    words = [rnd.choice(stems) + rnd.choice(stems) for _ in range(60)]
    if toxic:
        words[rnd.randrange(60)] = rnd.choice(["idiot", "moron"])
    return " ".join(words).capitalize() + "."


def test_quality_on_held_out_rows(spark, odd):
    rnd = random.Random(2)
    docs = [(i, junk(rnd) if i % 3 == 0 else prose(rnd)) for i in range(150)]
    df = spark.createDataFrame(docs, DOC)
    marks = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    model = quality.train(df, marks, size=80)
    assert len(model.labels) == 80
    found = {r.doc_id: r.score for r in quality.score(df, model, ["doc_id"]).collect()}
    assert all((found[i] >= 0.3) == (i % 3 != 0) for i in range(100, 150))
    scores = [r.score for r in quality.score(odd, model, ["doc_id"]).collect()]
    assert len(scores) == 8 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    nothing = quality.train(df, marks.limit(0))
    assert {r.score for r in quality.score(odd, nothing, ["doc_id"]).collect()} == {0.5}


def test_cosine_votes_equal_a_plain_search():
    rnd = np.random.default_rng(0)
    x = rnd.random((60, quality.WIDTH)).astype(np.float32)
    x[20:60] = x[np.arange(40) % 4]  # exact ties: the first ones count
    model = quality.Model(np.ones(x.shape[1]), rnd.standard_normal((x.shape[1], 8)), np.zeros((0, 1)), rnd.integers(0, 2, 60).astype(float))
    model.vectors = model.latent(x)[:60]
    together = model.score(x)
    for i, row in enumerate(x):
        cosine = np.rint(model.vectors @ model.latent(row[None])[0] * quality.STEPS) / quality.STEPS
        near = sorted(range(60), key=lambda k: (-cosine[k], k))[: quality.NEIGHBOURS]
        w = np.clip(cosine[near], 1e-3, 1) ** quality.POWER
        assert together[i] == pytest.approx((w * model.labels[near]).sum() / w.sum())
        assert model.score(row[None])[0] == together[i]  # alone or with others


def test_quality_sees_words_and_a_text_alone_scores_as_in_a_batch(spark):
    rnd = random.Random(5)
    good, bad = (["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(30)] for _ in range(2))
    docs = [(i, " ".join(rnd.choice(good if i % 2 else bad) for _ in range(40))) for i in range(300)]  # same shapes, other words
    df = spark.createDataFrame(docs, DOC)
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    model = quality.train(df, marks)
    found = {r.doc_id: r.score for r in quality.score(df, model, ["doc_id"]).collect()}
    assert all((found[i] >= 0.5) == bool(i % 2) for i in range(200, 300))
    for i in (0, 1, 250):
        assert model.score(quality.features([docs[i][1].encode()]))[0] == found[i]
    with pytest.raises(ValueError):
        quality.score(df.withColumn("score", F.lit(1)), model, ["score"])


def test_toxic_words_are_found_in_disguise(spark, odd):
    rnd = random.Random(3)
    docs = [(i, prose(rnd, toxic=i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(docs, DOC)
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, marks)
    evidence = toxicity.Evidence(model)
    for bad in ("you idiot", "you IDIOT!!", "i d i o t here", "m0ron", "m0r0n", "iiidiooot", "m.o.r.o.n", "1d1ot"):
        assert evidence.score(bad) >= 0.5, bad
    for fine in ("the river garden", "covid19 is 3rd", "", "aaaa bbbb", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "winter-summer"):
        assert evidence.score(fine) < 0.5, fine
    found = {r.doc_id: r.score for r in toxicity.score(df, model, ["doc_id"]).collect()}
    assert all((found[i] >= 0.5) == (i % 4 == 0) for i in range(200))
    assert toxicity.score(odd, model, ["doc_id"]).count() == 8
    assert {r.score for r in toxicity.score(odd, toxicity.train(df, marks.limit(0)), ["doc_id"]).collect()} == {0.0}
    assert evidence.score("x" * 300_000 + " idiot") >= 0.5 and evidence.score("l0" * 500) < 0.5  # very long tokens
    one, other = (evidence.score(f"an {w}") for w in ("idiot", "moron"))
    both = evidence.score("idiot moron")
    assert both == pytest.approx(1 - (1 - one) * (1 - other)) and 1 > both > max(one, other) and min(one, other) >= 0.5


def test_disguises_next_to_signs_and_blanks(spark):
    rnd = random.Random(3)
    docs = [(i, prose(rnd, toxic=i % 4 == 0)) for i in range(200)]
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    evidence = toxicity.Evidence(toxicity.train(spark.createDataFrame(docs, DOC), marks))
    for bad in ("you i d i o t.", "i d i o t!", '"i d i o t"', "(i d i o t)", "i  d  i\to\nt", "m o r o n,", '"m.o.r.o.n"', "(m-o-r-o-n)", "iiddiioott", "mmoorroonn.", "i. d. i. o. t."):
        assert evidence.score(bad) >= 0.5, bad
    for fine in ("a b c", "- - - -", "! ! !", "the river. A garden", "(a)", "1 2 3 4", "((", "! " * 3000, "!" * 3000):
        assert evidence.score(fine) < 0.5, fine
    assert toxicity.spaced("s c u m.") == "s c u m" and toxicity.SPACED.search("you s c u m.")[0] == "s c u m."


def plain_lexicon(rows):
    """Lexicon and number of missed toxic texts of (words, toxic), one entry taken after the other."""
    t = toxicity
    seen, clean = defaultdict(set), Counter()
    for words, label in rows:
        if not label:
            clean.update(t.entries(words))
        elif words:
            for e in t.entries(words):
                seen[e].add(min(zlib.crc32(w.encode()) for w in words))
    likely = {e: len(kinds) for e, kinds in seen.items() if len(kinds) >= t.MIN_OPEN}
    evidence = {e: (n + 0.5) / (n + clean[e] + t.PRIOR) for e, n in likely.items()}
    found = {e: evidence[e] for e, n in likely.items() if n >= t.MIN_TEXTS and n / (n + clean[e]) >= t.MIN_PURITY}
    pure = {e for e in likely if not clean[e]} - found.keys()
    left = [x & pure for x in (t.entries(words) for words, label in rows if label) if not x & found.keys()]
    while new := Counter(e for x in left for e in x):
        best = max(new, key=lambda e: (new[e], likely[e], e))
        if new[best] < t.MIN_OPEN:
            break
        found[best] = evidence[best]
        left = [x for x in left if best not in x]
    return found, sum(label and not (t.entries(words) & found.keys()) for words, label in rows)


def test_toxicity_learns_from_every_labelled_row(spark):
    rnd = random.Random(11)
    name = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    common, bad, rare = [name() for _ in range(60)], ["zidiot", "zmoron", "zcretin"], [f"zz{name()}" for _ in range(6)]
    docs = []
    for i in range(8600):
        words = [rnd.choice(common) for _ in range(5)]
        if i % 10 == 0:
            words += [rnd.choice(bad)] if i % 100 else [rare[i // 100 % 20]] if i // 100 % 20 < 6 else []
        docs.append((i, " ".join(words)))
    docs += [(8600 + i, docs[20][1] + " ZIDIOT") for i in range(30)] + [(8700, None), (8701, ""), (8702, "zmoron")]
    labels = [(i, 1, int(i % 10 == 0 or 8600 <= i < 8630)) for i, _ in docs] + [(20, 1, 1), (99_999, 1, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, DOC), marks)
    toxic = {i: t for i, _, t in labels}
    rows = [(toxicity.plain_words(text or ""), bool(toxic[i])) for i, text in docs]
    lexicon, missed = plain_lexicon(rows)
    assert model.lexicon == lexicon and {"zidiot$", "zcretin$"} <= lexicon.keys() and set(rare) & {e[:-1] for e in lexicon}
    assert model.base == min(0.4, (missed + 0.5) / (len(rows) + 1)) and missed
    assert model.characters == toxicity.CharacterModel.fit(Counter(w for words, _ in rows for w in words))


def test_a_cover_in_rounds_takes_what_one_pass_takes(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        n = [rnd.randint(3, 5) for _ in range(30)]
        pairs = [(d, f"e{k}", n[k]) for d in range(80) for k in rnd.sample(range(30), rnd.randint(0, 4))]
        left, taken = {d: {k for x, k, _ in pairs if x == d} for d in range(80)}, set()
        while True:  # one entry after the other
            often = Counter(k for own in left.values() for k in own)
            best = max(often, key=lambda k: (often[k], n[int(k[1:])], k), default=None)
            if best is None or often[best] < toxicity.MIN_OPEN:
                break
            taken.add(best)
            left = {d: own for d, own in left.items() if best not in own}
        df = spark.createDataFrame(pairs, "doc_id long, key string, n long")
        for one_pass in (0, 60, 10_000):
            found, covered = toxicity.cover(df, one_pass)
            assert set(found) == taken and len(found) == len(taken) and covered == 80 - len(left)


def test_viterbi_equals_the_best_of_all_readings():
    model = toxicity.CharacterModel.fit(Counter({"moron": 5, "stone": 9, "light": 4}))

    def readings(text, context="  "):
        if not text:
            yield "", model.cost(context, " ") * (context[1] != " ")
            return
        c, looks = text[0], toxicity.LOOKS.get(text[0], "")
        options = [(c, 0.0)] if c.isalpha() else [(x, toxicity.COST_LOOK) for x in looks] + [(None, toxicity.COST_LOST if looks else toxicity.COST_SIGN), (" ", toxicity.COST_LOST if looks else toxicity.COST_BLANK)]
        options += [(None, cost + toxicity.COST_REPEAT) for x, cost in options if x is not None and x == context[1] and x != " "]
        for x, cost in options:
            skip = x is None or (x == " " and context[1] == " ")
            for rest, more in readings(text[1:], context if skip else context[1] + x):
                yield ("" if skip else x) + rest, more + cost + (0 if skip else model.cost(context, x))

    for text in ("m0ron", "m.o.n", "st00ne", "1ight", "ooo"):
        best = min(cost for _, cost in readings(text))
        got = toxicity.restore(text, model)
        assert min(cost for r, cost in readings(text) if r == got) == pytest.approx(best)


def test_languages(spark, odd):
    rnd = random.Random(6)
    stems = {"aa": ["kata", "lumi", "peto"], "bb": ["strov", "grazn", "vlok"]}
    text = lambda lang, n: " ".join(rnd.choice(stems[lang]) + rnd.choice(stems[lang]) for _ in range(n))
    docs = [(i, text("aa" if i % 2 else "bb", 40 if i < 60 else rnd.randint(2, 60)), "aa" if i % 2 else "bb") for i in range(120)]
    df = spark.createDataFrame(docs, DOC + ", lang string")
    model = langid.train(df.filter("doc_id < 60"))
    assert set(model) == {"aa", "bb"}
    found = {r.doc_id: r for r in langid.predict(df, model, ["doc_id"]).collect()}
    assert all(found[i]["__lm_lang"] == lang for i, _, lang in docs[60:])
    rows = langid.predict(odd, model, ["doc_id", "score"]).collect()
    assert [r["__lm_lang"] for r in rows if r.doc_id in (2, 3, 4)] == ["und"] * 3 and all(0 <= r["__lm_score"] <= 1 for r in rows)
    assert langid.train(df.limit(0)) == {} and langid.predict(odd, {}, ["doc_id"]).filter("__lm_lang = 'und'").count() == 8
    assert langid.accepted(df.union(spark.createDataFrame([(500, None, "aa"), (501, "12 34", "bb")], df.schema))).filter("doc_id >= 500").count() == 0


def test_sizes_equal_the_plain_encoder_at_every_length():
    rnd = random.Random(5)
    stems = {"aa": ["kata", "lumi", "peto"], "bb": ["strov", "grazn", "vlok"]}
    text = lambda lang, n: " ".join(rnd.choice(stems[lang]) + rnd.choice(stems[lang]) for _ in range(n)).encode()
    found = {lang: langid.fill([text(lang, 50) for _ in range(20)]) for lang in stems}
    model = langid.Classifier(found)
    for n in (1, 2, 5, 30, 400, 3000):
        plain = langid.letters(text("bb", n))
        parts = max(1, -(-len(plain) // langid.BLOCK))
        step = -(-len(plain) // parts)
        for k, lang in enumerate(model.langs):
            d = zstandard.ZstdCompressionDict(found[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size = 0
            for at in range(0, len(plain), step):
                fresh = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
                size += len(fresh.compress(plain[at : at + step] + langid.FILLER))
            assert abs(model.sizes(plain)[k] - size) <= 0.02 * size + 2
        assert model(text("bb", n))[0] == "bb"


def test_every_sampled_row_and_every_language_enters_a_dictionary(spark):
    texts = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 4000 for k in range(160)]
    found = langid.fill([langid.letters((t + "end").encode()) + t.encode() for t in texts])
    assert len(found) <= langid.DICTIONARY_BYTES and all(t[:4].encode() in found for t in texts)
    assert len(langid.fill([b"a" * 90_000, b"b" * 100])) > 80_000
    docs = [(i, "7 " * 5000 + "kata lumi peto " * 30, "aa") for i in range(4)] + [(9, "o", "bb")] + [(100 + i, f"x{i}y", f"l{i:03}") for i in range(300)]
    model = langid.train(spark.createDataFrame([*docs, (None, "zu zo", "null id")], DOC + ", lang string"))
    assert len(model) == 303 and b"kata lumi peto" in model["aa"] and len(langid.Classifier(model).langs) == 303


def test_texts_in_no_learned_language_are_rejected(spark):
    rnd = random.Random(7)
    stems = {"aa": ["kata", "lumi", "peto", "sora"], "bb": ["strov", "grazn", "vlok", "dremi"]}
    docs = [(i, " ".join(rnd.choice(stems[lang]) + rnd.choice(stems[lang]) for _ in range(60)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    noise = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    docs += [(1000 + i, noise((20, 100, 400)[i % 3]), None) for i in range(60)]
    found = {r.doc_id for r in langid.accepted(spark.createDataFrame(docs, DOC + ", lang string")).collect()}
    assert found == set(range(200))


# --- op8 -------------------------------------------------------------------------------------


def all_paths(s, text):
    text, found = " " + text, []

    def go(at, score, ids):
        if at == len(text):
            found.append(score)
        for end in range(at + 1, min(len(text), at + s.longest) + 1):
            i = s.ids.get(text[at:end])
            if i is not None:
                go(end, score + s.v.scores[i], [*ids, i])
            elif end == at + 1:
                go(end, score + s.v.byte_score * len(text[at].encode()), ids)

    go(0, 0.0, [])
    return sorted(found, reverse=True)


def test_remembered_chunks_change_no_result(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["the", "token", "zq" * 30, "é漢", "x1\n", "of", ""]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    plain = lambda found: [(list(ids), score, others) for ids, score, others in found]
    alone = [plain(pieces.Segmenter(pieces.load()).encode([t]))[0] for t in texts[:12]]
    s = pieces.Segmenter(pieces.load())
    assert plain(s.encode(texts))[:12] == alone and plain(s.encode(texts[:12])) == alone
    monkeypatch.setattr(pieces, "MEMORY", 2)  # now forgets before each call
    assert [plain(s.encode([t]))[0] for t in texts[:12]] == alone


def test_n_best_equals_all_segmentations_and_decodes(spark, odd):
    s = pieces.Segmenter(pieces.load())
    rnd = random.Random(3)
    for _ in range(40):
        text = "".join(rnd.choice(["a", "th", "the", " ", "  ", "é", "\n", "▁", "z", "in", "漢", "𐍈", "er"]) for _ in range(rnd.randint(1, 5)))
        ids, score, others = s.encode([text], 4)[0]
        assert s.decode(ids) == text
        assert [score, *(o[0] for o in others)] == pytest.approx(all_paths(s, text)[:4])
    long = "abcde" * 2000
    assert s.decode(s.encode([long, ""])[0][0]) == long and len(s.encode([""])[0][0]) == 0
    found = pieces.decode(pieces.segment(odd, ["doc_id", "score"]), ["doc_id", "score"], "__lm_ids")
    assert sorted((r.doc_id or 0, hashlib.md5(r["__lm_text"].encode()).hexdigest()) for r in found.collect()) == sorted((r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest()) for r in odd.collect())


# --- op9 -------------------------------------------------------------------------------------


def spots(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    found = set()
    for i, w in enumerate(words):
        if w in anchors:
            chain = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in anchors][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add((w, *chain))
    return found or ({tuple(words[i : i + 3]) for i in range(len(words) - 2)} or {tuple(words)})


def test_signatures_and_next_documents(spark):
    rnd = random.Random(8)
    vocabulary = ["the", "of", "and", "river", "stone", "light", "garden", "la", "mañana"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(200, None), (201, "river"), (202, "!!")]
    df = spark.createDataFrame(docs, DOC)
    jaccard = lambda a, b: len(a & b) / len(a | b)
    rows = spotsigs.with_next(df).collect()
    assert len(rows) == len(docs)
    order = sorted(docs, reverse=True)
    after = {d: order[(k + 1) % len(order)][1] for k, (d, _) in enumerate(order)}
    text_of = dict(docs)
    for r in rows:
        assert r.next_text == (after[r.doc_id] or "")
        assert len(r.sigs) == len(spots(text_of[r.doc_id]))
        assert len(set(r.sigs) & set(r.next_sigs)) / len(set(r.sigs) | set(r.next_sigs)) == pytest.approx(jaccard(spots(text_of[r.doc_id]), spots(after[r.doc_id])))
    assert spotsigs.with_next(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "x"), (1, "x"), (None, None)], DOC)
    assert spotsigs.with_next(odd).count() == 4


def test_no_word_is_left_out_of_the_signatures(spark):
    rnd = random.Random(9)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(12))]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    opening = "the river stone of light garden "
    texts += [opening + " ".join(f"{k}{i}" for i in range(80)) for k in "xy"]
    anchors = set(spotsigs.ANCHORS)

    def expected(words):
        starts = {}
        for i, w in enumerate(words):
            chain = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in anchors][: spotsigs.CHAIN]
            if w in anchors and len(chain) == spotsigs.CHAIN:
                starts[i] = (w, *chain)
        n = len(words)
        chains = {tuple(words[i : i + 3]) for i in range(n - 2) if i not in starts and (i == n - 3 or not {i - 1, i - 2} & starts.keys())}
        found = {*starts.values()} | chains if n > 2 else {tuple(words)}
        assert all(any(w in x for x in found) for w in words)
        return found

    rows = spotsigs.covering(spark.createDataFrame(list(enumerate(texts)), DOC), "text", "sigs").withColumn("print", spotsigs.fingerprint(F.col("sigs"))).collect()
    assert all(len(r.sigs) == len(expected(r.text.split())) for r in rows)
    x, y = (next(r for r in rows if r.doc_id == i) for i in (40, 41))
    assert x.print != y.print and len(set(x.sigs) & set(y.sigs)) < 0.1 * len(set(x.sigs) | set(y.sigs))


def test_classes_equal_all_pairs(spark, odd):
    rnd = random.Random(1)
    base = [f"the word{i} thing{i}" for i in range(60)]
    docs = [(k, " ".join(base[: 60 - k % 3])) for k in range(20)]  # a chain of near copies, many equal
    docs += [(100 + k, " ".join(f"of a{rnd.random()} b{rnd.random()}" for _ in range(30))) for k in range(5)]
    for g in range(12):  # groups with a common passage, at and around the threshold, of all lengths
        own = [f"the g{g}w{i} g{g}t{i}" for i in range(rnd.randint(2, 40))]
        for k in range(8):
            some = [x if rnd.random() < 0.94 else f"of z{rnd.random()} y{rnd.random()}" for x in own]
            docs.append((1000 + 20 * g + k, " ".join(base[: rnd.choice([0, 0, 3])] + some)))
    docs += [(k, None if k % 2 else "") for k in range(5000, 5004)] + [(None, docs[0][1]), (None, "lone words here")]
    df = spark.createDataFrame(docs, DOC)
    sets = [(r.doc_id, frozenset(r.sigs)) for r in spotsigs.covering(df, "text", "sigs").collect()]
    comp = list(range(len(sets)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if 10 * len(x & y) >= 8 * len(x | y):
                comp[top(i)] = top(j)
    ids = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            ids[top(i)] = min(doc, ids.get(top(i), doc))
    wanted = sorted(((doc, ids.get(top(i))) for i, (doc, _) in enumerate(sets)), key=str)
    found = sorted(((r.doc_id, r.class_id) for r in spotsigs.classes(df).collect()), key=str)
    assert found == wanted and len({c for _, c in wanted}) > 20
    assert spotsigs.classes(odd).count() == odd.count() and spotsigs.classes(df.limit(0)).count() == 0
    a, b = F.array(F.lit(1), F.lit(2)), F.array(*(F.lit(i) for i in range(2, 12)))
    row = spark.range(1).select(spotsigs.likeness(a, b, 0.8).alias("x"), spotsigs.likeness(a, b).alias("y")).first()
    assert row.x == 0 and row.y == pytest.approx(1 / 11)


def test_fold_is_crc32(spark):
    from lanemill.llm.common import fold

    row = spark.range(7, 8).select(fold(F.col("id"), 5).alias("f")).first()
    assert row.f == zlib.crc32(b"7") % 5


def test_margin_counts_all_rows_outside_the_dictionaries(spark):
    """More rows than any sample holds: every one counts, but those in the dictionaries and wrong ones do not."""
    from pyspark.sql import functions as F

    from lanemill.llm import langid

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("aa").alias("lang"))
    found = rows.withColumn("__lm_lang", F.when(F.col("doc_id") < 2000, "aa").otherwise("bb")).withColumn("__lm_margin", F.col("doc_id") / 2000 + 0.1)
    used = rows.filter("doc_id < 100").withColumn("rank", langid.place_of())
    assert abs(langid.least_margin(found, used) - langid.SHARE * (119 / 2000 + 0.1)) < 1e-5
    assert langid.least_margin(found.limit(0), used) == langid.MIN_MARGIN
