"""SentencePiece, token files, packing, url filter, embedding dedup, pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

import helpers as H
from kindred.llm import embedding_dedup, packing, sentencepiece_codec, token_files, url_filter
from kindred.llm.queries import PIECE_BPE, URL_RULES, WORD_BPE
from kindred.llm.tokenizing import WordEncoder

ODD = ["", " ", "  a  b ", "\n\n x", "日本語テキスト 🙂 <s> </s> <0x0A>", "aaaaaaaaaaaaa aaaaaaa  bbbbb", "a\tb́ é", "Straße ÀÉÎ ª º µ ×÷ it's I'LL don't", "İstanbul ΣΑΣ σς é café", "<|endoftext|> <|startoftext|>x 12½ ² ٣", "'re 's'S 'tx '' '''d", "\x00\x1c\x85 \ufffe \uffff", "x" * 5000]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD


def test_codec_equals_library(texts):
    codec, lib = sentencepiece_codec.SentencePieceCodec(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == lib.encode(texts)
    assert [codec.decode(x) for x in got] == texts


def test_unigram_has_the_best_sum(texts):
    proto = pb.ModelProto.FromString(open(PIECE_BPE, "rb").read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(0)
    for p in proto.pieces:
        p.score = -rng.uniform(4, 16)
    data = proto.SerializeToString()
    codec, lib = sentencepiece_codec.SentencePieceCodec(model_proto=data), sentencepiece.SentencePieceProcessor(model_proto=data)
    words = sorted({w for t in texts[:200] for w in t.split() if w.isascii() and w.isprintable()})
    total = lambda ids: sum(proto.pieces[i].score for i in ids)
    for a, b in zip(codec.encode(words), lib.encode(words)):
        assert total(np.frombuffer(a, "<u4")) == pytest.approx(total(b), abs=1e-3)  # equal sums may be cut in more ways than one


def test_codec_on_frames(spark):
    rows = [(1, "Hello world"), (2, None), (None, ""), (3, "a  b"), (3, "a  b")]
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(H.docs(spark, rows, True), PIECE_BPE), PIECE_BPE)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == [(-1, ""), (1, "Hello world"), (2, ""), (3, "a  b"), (3, "a  b")]
    assert sentencepiece_codec.round_trip(H.docs(spark, []), PIECE_BPE).count() == 0


def test_round_trip_query_equals_library(spark, texts):
    rows = [*enumerate(texts), (9000, None), (None, "a  b"), (3, "dup"), (3, "dup"), (9001, "längeres Wort " * 40_000)]
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    out = sentencepiece_codec.round_trip(H.docs(spark, rows, True), PIECE_BPE).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = []
    for i, t in rows:
        ids = lib.encode(t or "")
        back = lib.decode(ids)
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32((t or "").encode())))
        assert len(ids) > 0 or not (t or "").strip() or back == ""
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32, r.decoded_crc32) for r in out), key=key) == sorted(want, key=key)
    assert all(r.round_trip for r in out)


def test_word_encoder_equals_library(texts):
    e = WordEncoder(WORD_BPE)
    texts = [*texts, "a<|endoftext|>b c", "x <|EndOfText|> y<|startoftext|>", "<|endoftext|>"]
    want = [x.ids + [2] for x in Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([t.encode() for t in texts], 2)] == want
    assert e.encode([None], 2) == [np.array([2], "<u4").tobytes()]


@pytest.mark.parametrize("high", [1, 2, 1000, 49408, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
def test_blocks_round_trip(high, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
    ids[::97] = min(high * 50, (1 << 32) - 1)
    back = [token_files.unpack_block(b) for b in token_files.pack_blocks(ids)]
    assert np.array_equal(np.concatenate([np.empty(0, "<u4"), *back]), ids)


def test_token_files(spark, texts, tmp_path):
    rows = list(enumerate(texts)) + [(7000, None), (None, "first"), (5, "again"), (5, "again")]
    random.Random(2).shuffle(rows)
    shards = token_files.write_token_files(H.docs(spark, rows, True), WORD_BPE, f"file://{tmp_path}/out", shards=5)
    got = token_files.read_token_files(spark, shards).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    at = 0
    seen = []
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen.append((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32))
    want = [(-1 if i is None else i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in rows]
    assert [s[0] for s in seen] == sorted(s[0] for s in seen)
    assert sorted(seen) == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    reader = token_files.ShardReader(max(shards, key=lambda s: s.n_ids).uri)
    everything = reader.read(0, reader.n_ids)
    assert np.array_equal(reader.read(7, 2000), everything[7:2007])
    assert token_files.write_token_files(H.docs(spark, []), WORD_BPE) == []


def test_token_files_of_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_DOCS", 10)
    rows = [(None, f"text {i}") for i in range(60)] + [(i, "x " * 60_000 if i == 3 else f"word {i}") for i in range(25)]
    shards = token_files.write_token_files(H.docs(spark, rows, True), WORD_BPE)
    got = token_files.read_token_files(spark, shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 60 + list(range(25)) and max(s.n_docs for s in shards) < 40 and got[63].n_tokens == 60_001
    assert [r.start for r in got][1:] == [r.start + r.n_tokens for r in got][:-1]
    assert token_files.read_token_files(spark, []).count() == 0


def test_packing(spark, texts):
    rows = [*enumerate(texts), (9000, None), (None, "x y"), (3, "dup"), (8000, "word " * 30_000)]
    pieces = packing.pack_documents(H.docs(spark, rows, True), WORD_BPE).toPandas()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert pieces.length.sum() == total
    sizes = pieces.groupby("sequence_id").length.sum()
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all() and sizes.max() <= packing.WINDOW
    padded = [packing.WINDOW - s for s in sizes if s & (s - 1)]
    assert sum(padded) <= packing.WINDOW * 4  # one padded window a partition at most
    for i, text in ((8000, "word " * 30_000), (1, texts[1])):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in pieces[pieces.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    whole = pieces[~pieces.sequence_id.isin([s for s, n in sizes.items() if n & (n - 1)])]
    for step in (packing.STEP_TOKENS, 2 * packing.WINDOW):
        again = packing.pack_documents(H.docs(spark, rows, True), WORD_BPE, step_tokens=step).toPandas()
        ends = again.groupby("sequence_id").length.sum()
        per_step = again[~again.sequence_id.isin([s for s, n in ends.items() if n & (n - 1)])].groupby("step_group").length.sum().sort_index()
        # over all tasks and tiers, equal but for the last one
        assert per_step.index.tolist() == list(range(len(per_step))) and set(per_step[:-1]) <= {step} and per_step.iloc[-1] <= step and len(per_step) > 3
    assert whole.length.sum() > 0.98 * total
    assert packing.pack_documents(H.docs(spark, []), WORD_BPE).count() == 0


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def test_url_filter(spark, sf):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "ab", "org", "com", "x-y"])
    rules = {(".".join(label() for _ in range(rng.randint(1, 3))), "/" + "/".join(label() for _ in range(rng.randint(0, 2)))): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [(i, f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/a', '/a/b?q', '/org/ab#x'])}") for i in range(500)]
    urls += [(600, None), (601, ""), (602, "no host"), (603, "x://A.B/"), (604, "HTTP://Org?x"), (605, urls[0][1]), (None, "http://a/")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    for given in (rules, URL_RULES):
        want = sorted(((-1 if i is None else i), *map(str, brute_verdict(u, given))) for i, u in urls)
        table = spark.createDataFrame(given, "host string, path string, verdict string")
        for out in (url_filter.filter_urls(df, given, ["page_id"]), url_filter.filter_urls(df, table, ["page_id"]), url_filter.filter_urls_by_range(df, table, ["page_id"], ranges=7)):
            assert sorted(((-1 if r.page_id is None else r.page_id), str(r.host), str(r.path), str(r.rule), str(r.verdict)) for r in out.collect()) == want
    assert url_filter.filter_urls(df.where("false"), rules, ["page_id"]).count() == 0


def test_url_filter_paths_agree(spark, monkeypatch):
    rows = [(i, u, "mine", "k", "r") for i, u in enumerate(["http://a.org/x", "http://b.a.org/x/y", "http://c.com/", None, "http://a.org/x", "http://" + "long." * 2000 + "org/" + "p" * 20_000])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, _key string, _range string")
    rules = [("a.org", "/x", "review"), ("a.org", "/x", "allow"), ("A.org", "/x", None), ("c.com", None, "block"), ("c.com", "", "allow"), (None, "/", "block"), ("org", "/p", "block")]
    outs = []
    for limit in (32 << 20, 0):
        monkeypatch.setattr(url_filter, "LOCAL_RULE_BYTES", limit)
        out = url_filter.filter_urls(df, rules, ["page_id", "host", "_key", "_range"])
        assert out.columns == ["page_id", "_key", "_range", "host", "path", "rule", "verdict"]
        outs.append(sorted(map(tuple, out.collect())))
        assert url_filter.filter_urls(df.where("false"), rules, ["page_id"]).count() == 0
        assert {r.verdict for r in url_filter.filter_urls(df, spark.createDataFrame([], "host string, path string, verdict string"), ["page_id"]).collect()} == {"allow"}
    assert outs[0] == outs[1] and [r[-1] for r in outs[0]] == ["allow", "allow", "block", "allow", "allow", "block"] and outs[0][0][1:3] == ("k", "r")


def test_embedding_groups_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        base = rng.standard_normal((12, 8))
        for i in range(90):
            v = base[i % 12] + rng.standard_normal(8) * rng.choice([0.0, 0.05, 0.3])
            rows.append((len(rows), v.tolist(), label))
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 1), (903, [1.0, None] * 4, 1), (904, rows[3][1], None), (905, rows[3][1], 0), (906, [x * 3 for x in rows[3][1]], 0), (907, [1.0], 0), (908, [], 0)]
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lb for i, _, lb in rows}
    linked = lambda a, b: a in ok and b in ok and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.93
    roots = H.groups([r[0] for r in rows], linked)
    want = {i: (sum(linked(i, j) for j in roots if j != i), roots[i], roots[i] == i) for i in roots}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("key", "grp", "v", "cell", "home", "copies", "root", "n_links"):  # names that the operator uses inside
        df = df.withColumn(name, F.lit("x"))
    for sizes in ({}, {"cell_rows": 9, "block_rows": 5}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(df, **sizes).collect()}
        assert got == want
    assert embedding_dedup.embedding_groups(df.where("false")).count() == 0


def test_visits_lose_no_link():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    x = base[rng.integers(0, 60, 900)] + rng.standard_normal((900, 16)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embedding_dedup.kmeans(x, 40)
    home, row, cell = embedding_dedup.visits(x, c, 0.93)
    seen = set(zip(row.tolist(), cell.tolist()))
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert all(home[i] == home[j] or (i, home[j]) in seen for i, j in zip(a.tolist(), b.tolist()))
    assert len(seen) < 0.5 * 900 * 39  # and some are spared


def test_pipeline_stages(spark, sf):
    """Every stage against a plain version of its decision, on the stage's own input."""
    import hashlib

    import corpus_pipeline
    from kindred.llm import quality_rules
    from test_near_copies import shingle_set, similar

    docs = first = spark.read.parquet(f"{sf}/documents.parquet").cache()
    ins, outs = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ins[name] = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == first.columns, name
        outs[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(outs[name]) <= set(ins[name])
    assert outs["language_id"] == {i: t for i, t in ins["language_id"].items() if any(c.isalpha() for c in t) and i in outs["language_id"]} and len(outs["language_id"]) > 0.95 * len(ins["language_id"])
    judged = {i: quality_rules.judge(t.encode()) for i, t in ins["quality_rules"].items()}
    assert outs["quality_rules"] == {i: t.decode() for i, (v, t) in judged.items() if v[-1]}
    sets = {i: shingle_set(t) for i, t in ins["simhash_dedup"].items()}
    roots = H.groups(list(sets), lambda a, b: similar(sets[a], sets[b]))
    assert outs["simhash_dedup"] == {i: t for i, t in ins["simhash_dedup"].items() if roots[i] == i}
    want = H.repeats(list(ins["substring_dedup"].items()))
    got = outs["substring_dedup"]
    assert set(got) == set(want)
    for i, (_, removed, digest) in want.items():
        assert got[i] == ins["substring_dedup"][i] if not removed else hashlib.sha256(got[i].encode()).hexdigest() == digest
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert set(pieces.doc_id) == set(got)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for i in sorted(got)[:60]:  # the last stage packs the texts as they are now
        ids = np.array(tokenizer.encode(got[i], add_special_tokens=False).ids + [2], "<u4")
        mine = pieces[pieces.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine.itertuples())


def test_queries_equal_sql(spark, sf):
    import sys

    sys.path.insert(0, "tests")
    from oracle import assert_same

    from kindred.llm.queries import ORACLES, QUERIES

    assert [n for n in QUERIES] == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    for name, sql in ORACLES.items():
        assert_same(QUERIES[name](spark, sf), sql, sf)


def test_pipeline_on_odd_tables(spark, sf):
    """Empty tables, nulls in every column, repeated rows and extra columns with names that operators use inside."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    base = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"Alpha{i} beta{i} gamma{i} delta{i}." for i in range(30))
    rows = [(None, None, None, None, None), (1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, None, "en", None, 0), (3, "", None, "s", 0), (None, good + " tail.", None, None, None), (4, "x" * 300_000, "en", "s", 1)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, base)
        for name in ("part", "fp", "key", "keep_0", "kept", "score", "runs"):
            docs = docs.withColumn(name, F.lit("mine"))
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, sf).cache()
            assert docs.count() >= 0
            if name != "packing":
                assert docs.columns == before and {r.runs for r in docs.collect()} <= {"mine"}
