"""Near-duplicate groups by the exact similarity of word shingles: SimHash, then prefix filtering.

SimHash comes first, by the index and the tally of :mod:`kindred.llm.simhash`
at the widest distance at which two positional bytes must still be shared. A
forest of the fingerprints' links is verified on the sets of shingles, and
what it links is settled. Similar texts may be further apart than any such
index promises; the rest are found by an inverted index of shingles, without a
loss.

Two sets of shingles with a Jaccard similarity of ``t`` at least share ``t`` of
the larger set. So, in any one order of all shingles, the first
``n - ceil(t n) + 1`` of both (their *prefixes*) have a shingle in common, and
an inverted index of the prefixes alone holds every such pair. Shingles common
in a sample come last in the order, which keeps postings short; the order never
changes the result.

Documents of equal sets are one class. In each of some rounds, every class of a
posting that is outside the posting's largest group is compared with all that
are in other groups, and the few closest are verified; what that links is
settled. The last round verifies all that are still in different groups. So a
group of copies makes as many pairs as it has classes, not as it has pairs.
A bitmap of each set (a bit is set if an odd number of shingles falls on
it) bounds from below in how many shingles two sets differ, which rules most
candidates out without a loss; the others are verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.simhash import fingerprint, fingerprint_links
from kindred.llm.substring_dedup import _BASE, _mix, _word_hashes
from kindred.llm.texts import LOWER_ASCII, map_slices, texts_of, words_of
from kindred.operators.components import components
from kindred.sources.storage import discard, materialize, spread_join

SHINGLE_WORDS = 5
#: Least similarity of a link, as a fraction.
SHARE, OF = 4, 5
#: One text in so many is looked at for common shingles; at most so many of these, in so many sampled texts at least, come last.
SAMPLE_ONE_IN, COMMON_SHINGLES, COMMON_TEXTS = 16, 100_000, 3
#: Differing bits of fingerprints that link: the most at which two of the eight positional bytes must be equal.
PRINT_BITS = 6
#: So many of the closest classes in other groups are verified for a class of a posting, round by round; None is all.
CLOSEST = (1, 4, None)
#: About so many classes outside the largest group are compared with a posting in one task; pairs of classes in memory at once.
STRIP, PAIRS_AT_ONCE = 2048, 1 << 18
#: Bitmaps are so many longs.
MAP_LONGS = 8


def shingles(text: bytes | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams of a text with A-Z lower-cased; all words make one if they are fewer."""
    words = words_of(text.translate(LOWER_ASCII)) if text else []
    if not words:
        return np.zeros(1, dtype="u8")
    h = _word_hashes(words)
    n = min(n, len(words))
    grams = np.zeros(len(words) - n + 1, dtype="u8")
    for i in range(n):
        grams = grams * _BASE + h[i : i + len(grams)]
    return np.unique(_mix(grams))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``SHARE / OF`` at least."""
    if OF * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return OF * shared >= SHARE * (len(a) + len(b) - shared)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, and how many have each."""

    def run(piece):
        found = [shingles(t) for t in texts_of(piece, "text")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view("i8"))], ["shingle"])

    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0)
    often = map_slices(part, "text", run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_TEXTS)
    found = often.orderBy(F.col("n").desc(), "shingle").limit(COMMON_SHINGLES).toArrow()  # as numbers, not as rows
    values, counts = found["shingle"].to_numpy().astype("i8").view("u8"), found["n"].to_numpy().astype("i8")
    order = np.argsort(values)
    return values[order], counts[order]


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the order of (times seen in the sample, hash): as many as two similar sets can't both miss."""
    size = len(found) - -(-SHARE * len(found) // OF) + 1
    if not len(common):
        return found[:size]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    seen = np.where(common[at] == found, counts[at], 0)
    return found[np.argsort(seen, kind="stable")[:size]]


def bitmap(found: np.ndarray, bits: int = 64 * MAP_LONGS) -> bytes:
    """Parity of the number of shingles on each of ``bits`` places."""
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(bool)).tobytes()


def wide_bits(n: int) -> int:
    """Places of a set's own bitmap: four for each shingle, at least, and a power of two, so that longer maps fold onto shorter ones."""
    return max(64 * MAP_LONGS, 1 << (4 * n - 1).bit_length())


def may_be_similar(a: bytes, n_a: int, b: bytes, n_b: int) -> bool:
    """False only if two wide bitmaps differ on more places than similar sets can differ in shingles."""
    x, y = sorted((np.frombuffer(m, "u1") for m in (a, b)), key=len)
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(folded ^ x).sum()) * (OF + SHARE) <= (n_a + n_b) * (OF - SHARE)


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs (a, n_a, map_a, b, n_b, map_b) without those whose sizes or bitmaps show that they aren't similar; columns a, b."""
    apart = " + ".join(f"bit_count(map_a[{i}] ^ map_b[{i}])" for i in range(MAP_LONGS))
    # similar sets differ in at most (n_a + n_b) (1 - t) / (1 + t) shingles
    return pairs.where(f"{OF} * least(n_a, n_b) >= {SHARE} * greatest(n_a, n_b) and ({apart}) * {OF + SHARE} <= (n_a + n_b) * {OF - SHARE}").select("a", "b").distinct()


def _kept_pairs(pairs: DataFrame, sets: DataFrame, columns: list[str], test) -> DataFrame:
    """The pairs (a, b) whose sets' ``columns`` pass ``test``."""
    for side in "ab":
        pairs = spread_join(pairs, sets.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), [side])
    names = [f"{c}_{side}" for side in "ab" for c in columns]

    def run(batches):
        for batch in batches:
            hit = [test(*row) for row in zip(*(batch.column(c).to_pylist() for c in names))]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.select("a", "b", *names).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar, as a table; sets are made again from a text of each class that is in a pair.

    Wide bitmaps leave few pairs that aren't similar, so that hardly any set
    travels in vain.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    chosen = classes.select("key", "row").join(asked, "key")

    def again(piece):
        found = [shingles(t) for t in texts_of(piece, "text")]
        wide = [bitmap(x, wide_bits(len(x))) for x in found]
        cols = [piece.column("key"), pa.array([len(x) for x in found], pa.int32()), pa.array(wide, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["key", "n", "wide", "set"])

    sets = materialize(map_slices(docs.join(chosen, "row").select("key", "text"), "text", again, "key long, n int, wide binary, set binary"), "sets")
    left = materialize(_kept_pairs(pairs, sets, ["wide", "n"], may_be_similar), "pairs")
    out = materialize(_kept_pairs(left, sets, ["set"], lambda a, b: similar(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"))), "links")
    discard(sets)
    discard(left)
    return out


def _print_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that may be similar, as a table: a forest of the links of their fingerprints, and the classes of a fingerprint with its smallest."""
    prints = materialize(classes.groupBy("fp").agg(F.min("key").alias("first")), "prints")
    links = fingerprint_links(prints, PRINT_BITS)
    for side in "ab":
        links = spread_join(links, prints.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}")), [side])
    alike = spread_join(classes.select("fp", "key"), prints, ["fp"]).where("key <> first")
    pairs = links.select("first_a", "first_b").union(alike.select("first", "key")).toDF("x", "y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    for side in "ab":
        pairs = spread_join(pairs, classes.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("map").alias(f"map_{side}")), [side])
    out = materialize(_possible(pairs), "tried")
    discard(prints)
    return out


def _grouped(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Groups (node, root) of what ``roots`` and ``links`` connect, as a table; both are used up."""
    out = materialize(components(links if roots is None else roots.toDF("a", "b").union(links)), "roots")
    for used in (roots, links):
        if used is not None:
            discard(used)
    return out


def _still_open(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings whose classes aren't all in one group, with each class's root and the number of classes outside the largest group, as a table."""
    placed = spread_join(postings.select("shingle", "key", "n", "map"), roots.withColumnRenamed("node", "key"), ["key"], "left")
    placed = placed.select("shingle", "key", "n", "map", F.coalesce("root", "key").alias("root"))
    sizes = placed.groupBy("shingle", "root").count().groupBy("shingle").agg((F.sum("count") - F.max("count")).alias("outside"))
    out = materialize(spread_join(placed, sizes.where("outside > 0"), ["shingle"]).select("shingle", "outside", "key", "n", "map", "root"), "open")
    discard(postings)
    return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the number of rows."""
    new = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, len(columns[0])]


def _closest(table: pa.Table, most: int | None) -> pa.RecordBatch:
    """Pairs (a, b) that may be similar, of whole postings sorted by (shingle, strip, root): for each class its ``most`` closest in other groups."""
    shingle, strip, root, key, n, own = (table.column(c).to_numpy() for c in ("shingle", "strip", "root", "key", "n", "own"))
    maps = pa.concat_arrays(table.column("map").chunks).flatten().to_numpy().view("u8").reshape(-1, MAP_LONGS)
    posting = _starts(shingle, strip)
    runs = _starts(shingle, strip, root)
    length, first_run = np.diff(runs), np.searchsorted(runs, posting[:-1])
    longest = np.maximum.reduceat(length, first_run)
    # the first of a posting's largest groups; its classes are compared with, but don't ask
    of = np.searchsorted(posting, runs[:-1], side="right") - 1
    largest = np.zeros(len(length), dtype=bool)
    full = np.flatnonzero(length == longest[of])
    largest[full[np.unique(of[full], return_index=True)[1]]] = True
    settled = np.repeat(largest, length)
    begin, size = (np.repeat(x, np.diff(posting)) for x in (posting[:-1], np.diff(posting)))
    asks = np.flatnonzero(own & ~settled)
    ends = np.cumsum(size[asks])
    found = []
    at = 0
    while at < len(asks):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        part = asks[at:upto]
        at = upto
        x = np.repeat(part, size[part])
        y = np.arange(len(x)) - np.repeat(np.cumsum(size[part]) - size[part], size[part]) + np.repeat(begin[part], size[part])
        # similar sets differ in at most (n_a + n_b) (1 - t) / (1 + t) shingles
        fits = (root[x] != root[y]) & (OF * np.minimum(n[x], n[y]) >= SHARE * np.maximum(n[x], n[y]))
        x, y = x[fits], y[fits]
        apart = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
        both = n[x].astype(np.int64) + n[y]
        may = apart * (OF + SHARE) <= both * (OF - SHARE)
        x, y, far = x[may], y[may], apart[may] / both[may]
        if most and len(x):
            order = np.lexsort((key[y], far, x))
            x, y = x[order], y[order]
            run = _starts(x)
            near = np.arange(len(x)) - np.repeat(run[:-1], np.diff(run)) < most
            x, y = x[near], y[near]
        found.append(np.stack([np.minimum(key[x], key[y]), np.maximum(key[x], key[y])], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype="i8")
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _index_pairs(left: DataFrame, most: int | None) -> DataFrame:
    """Pairs (a, b) of classes of a posting in different groups that may be similar: all, or each asking class's ``most`` closest.

    A posting in which many classes ask goes to several tasks, each with a strip of these.
    """
    strips = F.ceil(F.col("outside") / STRIP).cast("int")
    dealt = left.withColumn("strip", F.explode(F.sequence(F.lit(0), strips - 1))).withColumn("own", F.pmod(F.xxhash64("key"), strips) == F.col("strip"))
    dealt = dealt.select("shingle", "strip", "root", "key", "n", "map", "own").repartition("shingle", "strip").sortWithinPartitions("shingle", "strip", "root", "key")

    def place(batch, i):
        return batch.column("shingle")[i].as_py(), batch.column("strip")[i].as_py()

    def run(batches):
        held = []  # batches from the start of a posting on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if place(held[0], 0) == place(batch, batch.num_rows - 1):
                continue
            table = pa.Table.from_batches(held)
            cut = int(_starts(table.column("shingle").to_numpy(), table.column("strip").to_numpy())[-2])
            yield _closest(table.slice(0, cut), most)
            held = table.slice(cut).to_batches()
        if held:
            yield _closest(pa.Table.from_batches(held), most)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row a document: doc_id, group; with ``row_col``, a long that tells rows apart, also row and text_hash.

    Documents link if the Jaccard similarity of their sets of five-word
    shingles (64-bit hashes, A-Z lower-cased) is 0.8 at least; documents that
    links reach have one group, a number of no meaning. A text of fewer words
    is one shingle; null, empty and blank texts link with each other. Repeated
    rows are returned as often as they occur. Other columns are not read. No
    rows: no rows.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    if not row_col:
        docs = materialize(docs, "rows")  # so that numbers stay with their rows
    common, counts = common_shingles(docs)

    def run(piece):
        found = [shingles(t) for t in texts_of(piece, "text")]
        fps = np.array([fingerprint(t) for t in texts_of(piece, "text")], dtype="u8").view("i8")
        key = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], dtype="u8").view("i8")
        first = [prefix(x, common, counts).view("i8") for x in found]
        ends = np.cumsum([0, *map(len, first)])
        text_hash = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts_of(piece, "text")], dtype="u8").view("i8")
        cols = [piece.column("doc_id"), piece.column("row"), pa.array(text_hash), pa.array(key), pa.array(fps), pa.array([len(x) for x in found], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first)))]
        maps = np.frombuffer(b"".join(map(bitmap, found)), "<i8")
        cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * MAP_LONGS, pa.int32()), pa.array(maps)))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "text_hash", "key", "fp", "n", "prefix", "map"])

    made = materialize(map_slices(docs, "text", run, "doc_id long, row long, text_hash long, key long, fp long, n int, prefix array<long>, map array<long>"), "shingles")
    classes = materialize(made.groupBy("key").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("n", "map", "prefix")]), "classes")
    rows = materialize(made.select("doc_id", "row", "text_hash", "key"), "members")
    discard(made)
    tried = _print_pairs(classes)
    roots = _grouped(None, _verified(tried, classes, docs))
    posted = classes.select(F.explode("prefix").alias("shingle"), "key")
    held = posted.groupBy("shingle").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("shingle")
    met = materialize(spread_join(posted, held, ["shingle"]), "met")
    left = materialize(spread_join(met, classes.select("key", "n", "map"), ["key"]), "postings")
    discard(met)
    for most in CLOSEST:
        left = _still_open(left, roots)
        if left.isEmpty():
            break
        pairs = materialize(_index_pairs(left, most).join(tried, ["a", "b"], "left_anti"), "pairs")
        roots = _grouped(roots, _verified(pairs, classes, docs))
        done, tried = tried, materialize(tried.union(pairs), "tried")
        discard(done)
        discard(pairs)
    named = ["doc_id", "row", "text_hash"] if row_col else ["doc_id"]
    out = spread_join(rows.select(*named, "key"), roots.withColumnRenamed("node", "key"), ["key"], "left").select(*named, F.coalesce("root", "key").alias("group"))
    out = materialize(out, "groups")
    for used in (rows, classes, tried, roots, left, *([] if row_col else [docs])):
        discard(used)
    return out
