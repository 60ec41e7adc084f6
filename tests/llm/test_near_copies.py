"""Near copies by shingle similarity, and the pipeline stage that drops them."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
import helpers as H
from kindred.llm import near_copies


def shingle_set(text):
    w = H.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited_texts(seed=5):
    """Copies with edits of every size around the least similarity, and texts that share passages only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 30, 120, 400]))]
        for edits in (0, 0, 1, 2, 3, 5, 8, 12, 20):
            text = base[:]
            for _ in range(edits):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
        rows.append(" ".join(base[: len(base) * 4 // 5]))
        rows.append(" ".join(passage + base[:20]))
    rows += [None, "", " \n", "One two", "one  TWO", rows[0].upper()]
    return list(enumerate(rows))


def members(rows):
    found = {}
    for i, g in rows:
        found.setdefault(g, set()).add(i)
    return sorted(map(sorted, found.values()))


def test_near_copies_equal_brute_force(spark, sf, monkeypatch):
    docs = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = edited_texts() + docs
    sets = {i: shingle_set(t) for i, t in rows}
    want = members(H.groups(list(sets), lambda a, b: similar(sets[a], sets[b])).items())
    df = H.docs(spark, rows, True)
    for one_in, least in ((16, 3), (1, 2)):  # with few and with many common shingles
        monkeypatch.setattr(near_copies, "SAMPLE_ONE_IN", one_in)
        monkeypatch.setattr(near_copies, "COMMON_TEXTS", least)
        assert members((r.doc_id, r.group) for r in near_copies.near_copies(df).collect()) == want
    assert near_copies.near_copies(H.docs(spark, [])).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype="u8"))
        b = np.unique(np.r_[a[n // 5 :], rng.integers(0, 1 << 63, n // 9, dtype="u8")])
        apart = np.bitwise_count(np.frombuffer(near_copies.bitmap(a), "u8") ^ np.frombuffer(near_copies.bitmap(b), "u8")).sum()
        assert apart <= len(np.setxor1d(a, b))
        wide = [near_copies.bitmap(x, near_copies.wide_bits(len(x))) for x in (a, b)]
        assert near_copies.may_be_similar(wide[0], len(a), wide[1], len(b)) or not near_copies.similar(a, b)
        assert near_copies.may_be_similar(wide[0], len(a), wide[0], len(a))
    rare = np.unique(rng.integers(0, 1 << 63, 900, dtype="u8"))
    assert not near_copies.may_be_similar(near_copies.bitmap(a, near_copies.wide_bits(len(a))), len(a), near_copies.bitmap(rare, near_copies.wide_bits(len(rare))), len(rare))


def test_stage_drops_copies_that_fingerprints_miss(spark, sf):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, base), (2, base.replace("w40 ", "x ").replace("w150 ", "y ").replace("w260 ", "z ")), (3, " ".join(f"v{i}" for i in range(300)))]
    assert (H.simhash(rows[0][1]) ^ H.simhash(rows[1][1])).bit_count() > 2 and similar(shingle_set(rows[0][1]), shingle_set(rows[1][1]))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, H.docs(spark, rows), sf).collect()) == [1, 3]


def test_stage_keeps_one_row_of_a_group(spark, sf):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[0]), (3, texts[0]), (5, texts[1]), (5, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (1, texts[3]), (7, texts[3]), (7, "other words")]
    df = H.docs(spark, rows).withColumn("row_0", F.lit("mine"))
    out = corpus_pipeline.drop_near_duplicates(spark, df, sf)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == sorted([(3, texts[0]), (5, texts[1]), (-1, texts[2]), (1, texts[3]), (7, "other words")])


def test_fingerprints_find_near_copies_without_the_index(spark, sf, monkeypatch):
    """SimHash settles what its distance reaches, and the sets of shingles decide on what it finds."""
    rows = [(i, t) for i, t in edited_texts(7) if t]
    sets, fps = {i: shingle_set(t) for i, t in rows}, {i: H.simhash(t) for i, t in rows}
    monkeypatch.setattr(near_copies, "prefix", lambda found, common, counts: found[:0])  # an index without postings
    got = {r.doc_id: r.group for r in near_copies.near_copies(H.docs(spark, rows)).collect()}
    exact = H.groups(list(sets), lambda a, b: similar(sets[a], sets[b]))
    assert len(set(exact.values())) < len(set(got.values()))  # what is further apart needs the index
    near = [(a, b) for a in got for b in got if a < b and (fps[a] ^ fps[b]).bit_count() <= near_copies.PRINT_BITS and similar(sets[a], sets[b])]
    found = {(a, b) for a, b in near if got[a] == got[b]}
    assert sum(fps[a] != fps[b] for a, b in found) > 10 and len(found) > 0.9 * len(near)
    assert all(exact[a] == exact[b] for a in got for b in got if got[a] == got[b])
    stay = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, H.docs(spark, rows), sf).collect()}
    assert len(stay) == len(set(got.values())) < len({t.lower() for _, t in rows})


def test_pairs_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """Copies with few edits, many of them similar to some others only, in one posting after the other."""
    asked, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: (asked.append(pairs.count()), verified(pairs, *more))[1])
    rng, size = random.Random(3), 600
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(size):
        text = base[:]
        for _ in range(1 + i % 3):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    sets = {i: shingle_set(t) for i, t in rows}
    want = members(H.groups(list(sets), lambda a, b: similar(sets[a], sets[b])).items())
    assert members((r.doc_id, r.group) for r in near_copies.near_copies(H.docs(spark, rows)).collect()) == want
    assert sum(asked) < 4 * size, asked


def test_closest_equal_brute_force(monkeypatch):
    """Postings of every size, in pieces and strips, against all pairs."""
    rng = np.random.default_rng(4)
    base, rows = np.unique(rng.integers(0, 1 << 63, 90, dtype="u8")), []
    for shingle, size in enumerate((2, 3, 40, 7, 2)):
        for _ in range(size):
            found = np.unique(np.r_[base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype="u8")])
            rows.append((shingle, 0, int(rng.integers(0, 4)), int(rng.integers(-(1 << 62), 1 << 62)), len(found), np.frombuffer(near_copies.bitmap(found), "i8").tolist(), True))
    names = ["shingle", "strip", "root", "key", "n", "map", "own"]
    spread = [(*r[:1], k, *r[2:6], r[3] % 3 == k) for r in rows for k in range(3)]
    may = lambda a, b: a[0] == b[0] and a[2] != b[2] and 5 * min(a[4], b[4]) >= 4 * max(a[4], b[4]) and 9 * sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[5], b[5])) <= a[4] + b[4]
    want = {(min(a[3], b[3]), max(a[3], b[3])) for a in rows for b in rows if may(a, b)}
    assert 20 < len(want)
    for at_once in (1 << 18, 50, 1):
        monkeypatch.setattr(near_copies, "PAIRS_AT_ONCE", at_once)
        for table in (rows, spread):
            table = pa.table([pa.array(c) for c in zip(*sorted(table, key=lambda r: r[:4]))], names)
            got = {most: set(zip(*(c.to_pylist() for c in near_copies._closest(table, most).columns))) for most in (1, None)}
            assert got[None] == want
            assert got[1] <= want and 0 < len(got[1]) <= len(rows)
