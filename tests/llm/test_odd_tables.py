"""Every operator on tables with nulls in every column, empty and very long texts, repeated rows, ties, extra columns of clashing names, and no rows."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import helpers as H
from kindred.llm import language_id, near_copies, packing, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, token_files
from kindred.llm.queries import PIECE_BPE, WORD_BPE

#: Names that operators use inside.
INSIDE = ("fp", "key", "part", "runs", "shard", "score", "anchor", "cell", "host", "row", "h", "x", "label", "kept", "group", "root", "n_words", "ids", "start", "_tag", "text_hash")
GOOD = " ".join(f"Alpha{i} beta{i} gamma{i} delta{i}." for i in range(30))
LONG = " ".join(f"word{i % 977} näher{i % 31}." for i in range(60_000))  # 1 MB
ROWS = [(None, None, None), (1, GOOD, "en"), (1, GOOD, "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "de"), (None, GOOD, "en"), (5, LONG, "de"), (6, "x" * 200_000, None), (7, "1234 5678", "de"), (8, LONG + " tail", "de")]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in INSIDE if extra else ():
        df = df.withColumn(name, F.lit(None).cast("string") if name < "k" else F.lit("mine"))
    return df


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1), (8, None), (7, 1), (7, 0)], "doc_id long, quality int")


OPERATORS = {
    "decode": lambda spark, d: sentencepiece_codec.round_trip(d, PIECE_BPE),
    "classify": lambda spark, d: quality_classifier.classify(d, quality_classifier.fit(d, labels(spark))),
    "rules": lambda spark, d: quality_rules.apply_line_rules(d),
    "simhash": lambda spark, d: simhash.simhash_groups(d),
    "packing": lambda spark, d: packing.pack_documents(d, WORD_BPE),
    "tokens": lambda spark, d: token_files.read_token_files(spark, token_files.write_token_files(d, WORD_BPE)),
    "language": lambda spark, d: language_id.identify(d, language_id.fit(d)),
    "repeats": lambda spark, d: substring_dedup.strip_repeats(d),
    "near": lambda spark, d: near_copies.near_copies(d).select("doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, name):
    """Extra columns, whatever their names, don't reach the result, every row has its own, and no rows give none."""
    run = OPERATORS[name]
    seen = [sorted(map(str, run(spark, table(spark, ROWS, extra)).collect())) for extra in (False, True)]
    assert seen[0] == seen[1]
    assert len(seen[0]) >= len(ROWS)
    empty = run(spark, table(spark, []))
    assert empty.count() == 0 and empty.columns


def by_id(df, *names):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[n] for n in names))
    return out


def test_defined_results(spark):
    d = table(spark, ROWS)
    rules = by_id(quality_rules.apply_line_rules(d), "n_words", "base_failed", "kept", "cleaned_text")
    assert rules[2] == [(0, True, False, None)] and rules[3] == [(0, True, False, "")] and rules[6][0][:3] == (1, True, False) and rules[5][0][0] == 120_000
    assert rules[1] == [(120, False, True, GOOD)] * 2 and len(rules[None]) == 2
    prints = by_id(simhash.simhash_groups(d), "fingerprint", "component_id")
    assert {prints[i][0] for i in (2, 3, 4)} == {("0" * 16, 2)} and prints[5][0][0] == "%016x" % H.simhash(LONG) and len(prints[1]) == 2 and prints[1][0][1] == 1
    x = "%016x" % xxhash.xxh64_intdigest(b"x" * 200_000, 42)
    assert prints[6][0][0] == x
    lang = by_id(language_id.identify(d, language_id.fit(d)), "lang_pred", "score", "ambiguous")
    # equal texts may differ in the last digits, as products of other sizes are rounded otherwise
    assert all(lang[i] == [("und", 0.0, True)] for i in (2, 3, 4, 7)) and {r[0] for r in lang[1]} == {r[0] for r in lang[None]} - {"und"}
    kept = by_id(substring_dedup.strip_repeats(d), "n_words", "n_removed", "kept_sha256")
    none = hashlib.sha256(b"").hexdigest()
    assert kept[2] == kept[3] == kept[4] == [(0, 0, none)] and kept[1][0][1] == 0 and {r[1] for r in kept[None]} == {0}
    assert kept[8][0][:2] == (120_001, 120_000) and kept[8][0][2] == hashlib.sha256(b"tail").hexdigest()
    assert kept[5][0][1] == 0  # what a text repeats of itself stays


def test_ties_of_ids_and_labels(spark):
    """An id with several labels has the smallest; without words all features are zero, so such texts tie."""
    d = table(spark, ROWS)
    score = by_id(quality_classifier.classify(d, quality_classifier.fit(d, labels(spark))), "score", "predicted")
    assert score[2] == score[3] == score[4] and score[1][0] == score[1][1] and all(0 <= s <= 1 and p == int(s >= 0.3) for rows in score.values() for s, p in rows)


def test_ids_of_odd_texts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    rows = [r for r in ROWS if r[0] not in (5, 8)] + [(9, LONG[:100_000], None)]
    want = sorted((i is None, i or 0, crc(ids := library.encode(t or "", add_special_tokens=False).ids + [1]), len(ids)) for i, t, _ in rows)
    d = table(spark, rows)
    got = token_files.read_token_files(spark, token_files.write_token_files(d, WORD_BPE)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in got) == want
    spans = {}
    for r in packing.pack_documents(d, WORD_BPE).collect():
        spans.setdefault(r.doc_id, []).append(r.length)
    ends = {}
    for i, t, _ in rows:
        ends[i] = ends.get(i, 0) + len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert {i: sum(v) for i, v in spans.items()} == ends
