"""SimHash fingerprints and near-duplicate groups.

Candidates come from an inverted index over the positions of a fingerprint's
bytes, with a count filter. Two fingerprints that differ in at most two bits
share at least six of their eight positional bytes. The index has one posting
for each of eleven choices of five positions with their bytes; the choices are
such that any two positions lie outside one of them, so every such pair meets
in a posting. There the shared positional bytes of each pair are tallied, pairs
that reach six are retained, and their bits are verified.

A posting that is long is cut by its three free bytes: a pair that reaches six
shares one of them at least, so it meets in one of the cuts, which hold at most
65,536 fingerprints whatever the input. Of the links a spanning forest is kept
in place of all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import LOWER_ASCII, map_slices, texts_of, words_of
from kindred.operators.components import components
from kindred.sources.storage import materialize, salted_join, spread_join

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: A posting of more fingerprints is cut by its free bytes; the links are the same.
LONG_POSTING = 2048
#: Fingerprints tallied against a posting at once.
STRIP = 64
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word n-grams (repeats count) of a text with A-Z lower-cased."""
    words = words_of(text.translate(LOWER_ASCII)) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-n].tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())], dtype="<u8")
    # column sums of the bits, in pieces that keep the unpacked bits small
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        counts += np.unpackbits(part.view("u1").reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[counts * 2 > len(hashes)].sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, fp (the fingerprint as a signed long). Null text: fingerprint zero."""

    def run(piece):
        fps = np.array([fingerprint(t) for t in texts_of(piece, "text")], dtype="u8").view("i8")
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return map_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", run, "doc_id long, fp long")


def free_positions(most: int = MAX_BITS) -> list[tuple[int, ...]]:
    """Choices of three byte positions (``most`` + 1 in general) that cover every ``most`` of the eight, greedily few."""
    wanted = set(combinations(range(8), most))
    choices = []
    while wanted:
        best = max(combinations(range(8), min(8, most + 1)), key=lambda c: len(wanted.intersection(combinations(c, most))))
        choices.append(best)
        wanted.difference_update(combinations(best, most))
    return choices


def tally(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of positional bytes that each of ``left`` shares with each of ``right``."""
    apart = (left[:, None] ^ right[None]).view("u1").reshape(len(left), len(right), 8)
    return 8 - np.count_nonzero(apart, axis=2)


def _cuts(fps: np.ndarray, free: tuple[int, ...]) -> list[np.ndarray]:
    """Places in a posting that are compared with each other."""
    if len(fps) <= LONG_POSTING:
        return [np.arange(len(fps))]
    out = []
    for p in free:
        byte = (fps >> np.uint64(8 * p)) & np.uint64(0xFF)
        order = np.argsort(byte, kind="stable")
        out += [c for c in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1) if len(c) > 1]
    return out


def posting_links(fps: np.ndarray, free: tuple[int, ...], most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning forest, as pairs of places, of the fingerprints of a posting that are at most ``most`` bits apart."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for members in _cuts(fps, free):
        own = fps[members]
        for k in range(0, len(own), STRIP):
            shared = tally(own[k : k + STRIP], own)
            i, j = np.nonzero(shared >= 8 - most)  # the least that a link must share
            i += k
            later = i < j
            i, j = i[later], j[later]
            near = np.bitwise_count(own[i] ^ own[j]) <= most
            for x, y in zip(members[i[near]].tolist(), members[j[near]].tolist()):
                a, b = root(x), root(y)
                if a != b:
                    parent[b] = a
                    out.append((x, y))
    return out


def _postings(fp: Column, choices: list[tuple[int, ...]]) -> Column:
    """Array of (free positions, fingerprint with the bytes there set to zero)."""
    out = []
    for k, free in enumerate(choices):
        mask = sum(0xFF << (8 * p) for p in range(8) if p not in free)
        out.append(F.struct(F.lit(k).cast("byte").alias("free"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("kept")))
    return F.array(*out)


def fingerprint_links(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Links (a, b) of the distinct fingerprints in column ``fp``: a spanning forest of each posting's links."""
    choices = free_positions(most)
    # a few MB of fingerprints would be one or two tasks, and each becomes many postings
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    posted = spread.select("fp", F.explode(_postings(F.col("fp"), choices)).alias("p")).groupBy("p.free", "p.kept").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches):
        for batch in batches:
            a, b = [], []
            for k, members in zip(batch.column("free").to_pylist(), batch.column("fps")):
                fp = np.sort(members.values.to_numpy(zero_copy_only=False))
                for i, j in posting_links(fp.view("u8"), choices[k], most):
                    a.append(int(fp[i]))
                    b.append(int(fp[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return posted.mapInArrow(run, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, most: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most ``most`` bits;
    component_id is the smallest doc_id that links reach. Null, empty and
    blank texts have fingerprint zero and link with each other. A row without
    an id gets the component of its fingerprint's other rows (null if none has
    an id). Repeated rows are returned as often as they occur. Other columns
    are not read. No rows: no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = materialize(components(fingerprint_links(classes, most)), "roots")
    # the few fingerprints that have links get their component's smallest id
    linked = classes.join(roots, classes.fp == roots.node).groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = classes.join(salted_join(roots, linked, ["root"], "node").select(F.col("node").alias("fp"), "least_id"), "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return spread_join(rows, named, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
