"""Removal of passages that an earlier document has too: seed and extend.

Seeds are winnowed anchors: of every run of ``window - k + 1`` word k-grams the
one with the smallest hash. The choice depends on the words of the window
alone, so equal windows of any two documents choose the same anchor at the
same place, and joining on anchors finds every repeat. A window belongs to the
anchor it chose; the *reach* of an anchor's occurrence is the text of all its
windows, which is as far as a match through it can extend both ways.

Occurrences of an anchor whose reach is equal match over all of it; they form a
class, and all but the class's earliest document have the whole reach repeated.
Only the earliest occurrences of anchors with several classes (where a passage
ends, or an edit lies) are extended word by word: each of their windows is
looked up by its own digest. So a passage that m documents share costs m rows,
not m squared. The union of the windows found is the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import map_slices, texts_of, words_of
from kindred.sources.storage import discard, materialize, spread_join

WINDOW = 50
ANCHOR_WORDS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    h = xxhash.xxh64_intdigest
    for w in words:
        if w not in seen:
            seen[w] = h(w)
    return np.array([seen[w] for w in words], dtype="u8")


def anchors(words: list[bytes], window: int = WINDOW, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, place of the anchor, first window and number of windows of each occurrence."""
    n = len(words) - window + 1
    h = _word_hashes(words)
    grams = np.zeros(len(words) - k + 1, dtype="u8")
    for i in range(k):
        grams = grams * _BASE + h[i : i + len(grams)]
    grams = _mix(grams)
    # leftmost smallest of every run of `span` grams, by doubling
    span, size = window - k + 1, 1
    at = np.arange(len(grams))
    while size < span:
        step = min(size, span - size)
        right = at[step:]
        at = at[: len(right)]
        at = np.where(grams[right] < grams[at], right, at)
        size += step
    at = at[:n]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[first]], at[first], first, np.diff(np.r_[first, n])


def _offsets(words: list[bytes]) -> list[int]:
    return [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """128-bit digests as two longs each, which Spark aggregates and joins without byte arrays."""
    pairs = np.frombuffer(b"".join(digests), ">i8").astype("i8").reshape(-1, 2)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def _reaches(piece: pa.RecordBatch, window: int, k: int) -> pa.RecordBatch | None:
    digest = xxhash.xxh3_128_digest
    ids, parts, hashes, reach, first, count = [], [], [], [], [], []
    for doc_id, part, text in zip(piece.column("doc_id").to_pylist(), piece.column("part").to_pylist(), texts_of(piece, "text")):
        words = words_of(text) if text else []
        if len(words) < window:
            continue
        a, place, f, c = anchors(words, window, k)
        at, joined = _offsets(words), b" ".join(words)
        # where the anchor lies in the reach is part of the class
        reach += [digest(joined[at[x] : at[y] - 1], p) for x, y, p in zip(f.tolist(), (f + c + window - 1).tolist(), (place - f).tolist())]
        hashes.append(a.view("i8"))
        first.append(f)
        count.append(c)
        ids += [doc_id] * len(a)
        parts += [part] * len(a)
    if not ids:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(np.concatenate(hashes)), *_halves(reach), pa.array(np.concatenate(first).astype("i4")), pa.array(np.concatenate(count).astype("i2"))],
        ["doc_id", "part", "anchor", "r1", "r2", "first", "n"],
    )


def _windows(piece: pa.RecordBatch, window: int) -> pa.RecordBatch:
    digest = xxhash.xxh3_128_digest
    ids, parts, first, key = [], [], [], []
    for doc_id, part, text, runs in zip(piece.column("doc_id").to_pylist(), piece.column("part").to_pylist(), texts_of(piece, "text"), piece.column("runs").to_pylist()):
        words = words_of(text)
        at, joined = _offsets(words), b" ".join(words)
        for r in runs:
            places = range(r["first"], r["first"] + r["n"])
            first += places
            key += [digest(joined[at[i] : at[i + window] - 1]) for i in places]
            ids += [doc_id] * r["n"]
            parts += [part] * r["n"]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(first, pa.int32()), *_halves(key)], ["doc_id", "part", "first", "w1", "w2"])


def repeated_runs(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """Runs (doc_id, part, first, n): windows first..first+n-1 of the document also start in one with a smaller id.

    ``docs`` has columns doc_id (not null), part (tells rows of one id apart)
    and text.
    """
    seen = materialize(map_slices(docs, "text", lambda p: _reaches(p, window, k), "doc_id long, part long, anchor long, r1 long, r2 long, first int, n short"), "anchors")
    # seeds: anchors of two documents at least; with several reaches they are extended
    seeds = seen.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("r1").alias("r0"), F.max("r1").alias("r9")).where("d0 < d1").select("anchor", F.expr("r0 < r9").alias("several"))
    joined = materialize(spread_join(seen, seeds, ["anchor"]), "seeds")
    discard(seen)
    classes = joined.groupBy("r1", "r2").agg(F.min("doc_id").alias("least"))
    found = materialize(spread_join(joined, classes, ["r1", "r2"]).where("doc_id > least or several").select("doc_id", "part", "first", F.col("n").cast("int").alias("n"), F.expr("doc_id > least").alias("late")), "classes")
    discard(joined)
    heads = found.where("not late").groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    opened = materialize(map_slices(docs.join(heads, ["doc_id", "part"]), "text", lambda p: _windows(p, window), "doc_id long, part long, first int, w1 long, w2 long"), "windows")
    least = opened.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w1", "w2", "least")
    extended = spread_join(opened, least, ["w1", "w2"]).where("doc_id > least").select("doc_id", "part", "first", F.lit(1).alias("n"))
    return found.where("late").select("doc_id", "part", "first", "n").union(extended)


def covered(n_words: int, first: np.ndarray, n: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of the runs."""
    steps = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.minimum(first + n + window - 1, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def strip_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Documents without the words that repeated windows cover.

    Returns doc_id, n_words, n_removed, text (kept words joined by one space;
    the text as it was if nothing was removed) and kept_sha256 of the kept
    words joined by one space. With ``digest_only`` the text is left out.
    Columns named in ``keep`` are returned as they are.

    Null and blank texts have no words. Rows without an id, which no other row
    can be said to precede, keep everything. Rows that repeat an id are documents of
    their own that are not earlier than each other. Other columns are not read.
    No rows: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]).withColumn("part", F.xxhash64("text"))
    runs = repeated_runs(rows.select("doc_id", "part", "text").where("doc_id is not null"), window, k).groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *([] if digest_only else ["text"]), *(f"keep_{i}" for i in range(len(keep)))]

    def strip(piece):
        out = []
        for doc_id, text, found in zip(piece.column("doc_id").to_pylist(), texts_of(piece, "text"), piece.column("runs").to_pylist()):
            words = kept = words_of(text) if text else []
            if found:
                gone = covered(len(words), np.array([r["first"] for r in found]), np.array([r["n"] for r in found]), window)
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            joined = b" ".join(kept)
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), (joined if len(kept) < len(words) else text)))
        cols = list(zip(*out))
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3])]
        if not digest_only:
            arrays.append(pa.array(cols[4], pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(arrays + [piece.column(n) for n in names[len(arrays) :]], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ("" if digest_only else ", text string")
    schema += "".join(f", keep_{i} {rows.schema[f'keep_{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = map_slices(rows.join(runs, ["doc_id", "part"], "left"), "text", strip, schema)
    return out.select(*names[: len(names) - len(keep)], *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])
