"""Substring dedup, SimHash, quality rules, quality classifier, language ID."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import helpers as H
from kindred.llm import language_id, quality_classifier, quality_rules, simhash, substring_dedup
from kindred.llm.texts import held_out


@pytest.fixture(scope="module")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def made_texts(seed=3):
    """Texts with shared passages of every length around the window, copies, edits, nulls and blanks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(120)]
    rows = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "same " * 200)]
    for i in range(40):
        own = [word() for _ in range(rng.randint(0, 90))]
        a = rng.randint(0, 70)
        n = rng.choice([0, 30, 49, 50, 51, 80, 120])
        rows.append((i, " ".join(own + passage[a : a + n] + [word() for _ in range(rng.randint(0, 60))])))
    rows += [(50, rows[10][1]), (51, rows[10][1] + " tail"), (52, "same " * 120), (53, " ".join(passage).replace(" ", "\n"))]
    return rows


def test_substring_dedup_equals_brute_force(spark, sample):
    for rows in (made_texts(), texts_of(sample)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.strip_repeats(H.docs(spark, rows, True), digest_only=True).collect()}
        assert got == H.repeats(rows)


def test_substring_dedup_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (5, text), (5, text), (7, text), (8, text + " x")]
    out = substring_dedup.strip_repeats(H.docs(spark, rows).withColumn("tag", F.lit("t")), keep=["tag"]).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in out) == [(-1, 0), (5, 0), (5, 0), (7, 60), (8, 60)]
    assert {r.text for r in out if r.doc_id == 8} == {"x"} and {r.tag for r in out} == {"t"}
    assert substring_dedup.strip_repeats(H.docs(spark, [])).count() == 0


def test_simhash_equals_brute_force(spark, sample):
    rows = texts_of(sample) + [(i + 5000, t) for i, t in made_texts()]
    fps = {i: H.simhash(t) for i, t in rows}
    roots = H.groups(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(H.docs(spark, rows, True)).collect()}
    assert got == {i: ("%016x" % fps[i], roots[i]) for i in fps}


def test_fingerprint_links_find_every_near_pair(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(30):  # chains of changed bits
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    pairs = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    want = H.groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    linked = {frozenset(p) for p in pairs}
    assert H.groups(fps, lambda a, b: frozenset((a, b)) in linked) == want


def test_postings_tally_and_cut(monkeypatch):
    rng = np.random.default_rng(4)
    choices = simhash.free_positions(2)
    assert all(any(set(two) <= set(c) for c in choices) for two in combinations(range(8), 2)) and len(choices) <= 14
    free = choices[3]
    base = int(rng.integers(0, 1 << 63))
    fps = np.unique(np.array([base ^ sum(int(rng.integers(0, 1 << 3)) << (8 * p) for p in free) for _ in range(300)], "u8"))
    shared = simhash.tally(fps[:5], fps)
    assert all(shared[i, j] == sum((int(fps[i]) >> 8 * p & 255) == (int(fps[j]) >> 8 * p & 255) for p in range(8)) for i in range(5) for j in range(len(fps)))
    want = H.groups(range(len(fps)), lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count() <= 2)
    for limit in (1000, 2):
        monkeypatch.setattr(simhash, "LONG_POSTING", limit)
        links = {frozenset(x) for x in simhash.posting_links(fps, free)}
        assert H.groups(range(len(fps)), lambda a, b: frozenset((a, b)) in links) == want


def test_simhash_cases(spark):
    assert simhash.simhash_groups(H.docs(spark, [])).count() == 0
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, None), (8, " ")]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.simhash_groups(H.docs(spark, rows)).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (8, 8), (9, 8)]


def test_quality_rules_base(spark, sample):
    rows = texts_of(sample) + made_texts()
    got = {r.doc_id: r for r in quality_rules.apply_line_rules(H.docs(spark, made_texts(), True)).collect()}
    for doc_id, text in made_texts():
        w = H.words(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if H.words(x)]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rows and quality_rules.apply_line_rules(H.docs(spark, [])).count() == 0


def test_line_rules():
    fails = lambda s: quality_rules.line_fails(s.encode(), s.encode().split())
    assert fails("home | news | about | contact | help") and fails("BUY!! NOW!! CHEAP!!") and fails("All rights reserved. Example.") and fails("a### b$$$ c*** d%%%")
    assert fails(" ".join(["word"] * 20)) and not fails(" ".join(["word"] * 20) + ".") and not fails("A short title") and not fails("")
    text = ("This is a sentence that stays here for good. " * 8).strip()
    judged, cleaned = quality_rules.judge(f"home | news | about | contact | help\n{text}".encode())
    assert cleaned.decode() == text and judged[6:8] == (1, 9)


def test_kept_columns(spark):
    good = " ".join(f"Alpha{i} beta{i} gamma{i} delta{i}." for i in range(20))
    df = H.docs(spark, [(1, good), (2, None), (3, "x")]).withColumn("n_chars", F.lit(5).cast("long")).withColumn("kept", F.lit("mine"))
    out = quality_rules.keep_good(df)
    assert out.columns == df.columns and [(r.doc_id, r.text, r.n_chars, r.kept) for r in out.collect()] == [(1, good, len(good), "mine")]


def test_language_id_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(df)
    out = language_id.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.98 * len(out) and all(0 <= r.score <= 1 for r in out)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "été"), (None, "the and of the"), (None, "the and of the")]
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(H.docs(spark, rows, True), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and (4, "und") not in got and (None, "en") in got


def test_language_id_without_examples(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.fit(empty)
    assert [r.lang_pred for r in language_id.identify(H.docs(spark, [(1, "the")]), model).collect()] == ["und"]
    one = spark.createDataFrame([(i, "the and of", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(one, language_id.fit(one)).collect()} == {"en"}


def test_codewords():
    for n in (*range(2, 14), 30, 90):
        code = language_id.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
        assert all(abs(col.sum()) < n for col in code.T)
        assert code.shape[1] == 2 ** (n - 1) - 1 if n <= 7 else len({tuple(c) for c in code.T.tolist()}) == code.shape[1]


def invented(n, rng):
    """Vocabularies of n languages with letter habits of their own."""
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    out = {}
    for k in range(n):
        own = rng.sample(syllables, 12)
        out[f"l{k}"] = ["".join(rng.choice(own) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    return out


@pytest.mark.parametrize("n", [2, 6, 8])
def test_language_id_of_many_languages(spark, n):
    rng = random.Random(n)
    words = invented(n, rng)
    say = lambda k, m: " ".join(rng.choice(words[k]) for _ in range(m))
    rows = [(i, say(f"l{i % n}", 80), f"l{i % n}") for i in range(60 * n)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(words)
    tests = [(k, say(k, 80)) for k in words for _ in range(10)]
    lang, score, ambiguous = language_id.predict_texts(model, [t.encode() for _, t in tests])
    assert sum(a == k for a, (k, _) in zip(lang, tests)) > 0.97 * len(tests) and not ambiguous[score > 0.999].any() and ambiguous.mean() < 0.1
    mixed = [" ".join(say(k, 40) + " " + say(other, 40) for _ in range(2)) for k, other in zip(sorted(words), sorted(words)[1:]) for _ in range(20)]
    flags = language_id.predict_texts(model, [t.encode() for t in mixed])[2]
    assert flags.mean() > 5 * ambiguous.mean() and flags.mean() > 0.3


def slow_prediction(model, text):
    """The decoder in plain loops: features by dictionary, a margin for each bit, a loss for each codeword."""
    import math

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()
    b = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in low)
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    b = b" " + b + b" "
    grams = {}
    for i in range(len(b) - 1):
        k = ((b[i] << 8 | b[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 21
        grams[k] = grams.get(k, 0) + 1
    for i in range(len(b) - 2):
        h = (b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2246822519 & 0xFFFFFFFF
        k = language_id.BINS + ((h ^ h >> 15) & language_id.BINS - 1)
        grams[k] = grams.get(k, 0) + 1
    total = 2 * (len(b) - 1)
    margins = [float(model.bias[j]) + sum(math.sqrt(n / total) * float(model.weights[k][j]) for k, n in grams.items()) for j in range(model.code.shape[1])]
    losses = [sum(float(t) * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margins, row)) for row in model.code.tolist()]
    best = min(range(len(losses)), key=losses.__getitem__)
    first, second = sorted(losses)[:2]
    return model.languages[best], 1 / sum(math.exp(losses[best] - x) for x in losses), (second - first) / (second + first)


def test_language_id_equals_slow_decoder(spark, sample):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(df)
    rows = [(i, t) for i, t in texts_of(sample) if t and any(c.isalpha() for c in t)][:120] + [(9000, "x" * 400_000), (9001, "l'été où"), (9002, "a der die das the of and")]
    got = {r.doc_id: r for r in language_id.identify(H.docs(spark, rows), model).collect()}
    for i, t in rows:
        lang, score, gap = slow_prediction(model, t)
        assert got[i].score == pytest.approx(score, abs=2e-3)
        assert got[i].lang_pred == lang or score < 0.51
        assert got[i].ambiguous == (gap < language_id.AMBIGUOUS_GAP) or abs(gap - language_id.AMBIGUOUS_GAP) < 1e-3
    assert language_id.identify(H.docs(spark, []), model).count() == 0


def test_classifier_held_out(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(df, labels)
    out = quality_classifier.classify(df, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum(r.predicted == r.quality for r in out) > 0.95 * len(out)
    got = quality_classifier.classify(H.docs(spark, [(1, None), (2, ""), (None, "x"), (None, "x")], True), model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.fit(H.docs(spark, [(1, "a")]), none)
    assert [r.score for r in quality_classifier.classify(H.docs(spark, [(1, "a")]), model).collect()] == [0.5]
