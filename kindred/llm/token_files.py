"""Token-ID output in binary files of patched frame-of-reference blocks.

A shard file is ``MAGIC``, block payloads, the block index, the document table
and a fixed footer. A block holds up to :data:`BLOCK` ids: the block minimum is
subtracted, the rest is packed at the width that a percentile of the block's
values needs, and values that need more are kept whole in an exception list.
The index has the byte position of every block, so any run of ids is read by
decoding the blocks that hold it.

Block payload, little-endian: u32 minimum, u16 number of ids, u8 width,
u16 number of exceptions, packed bits (low bit first), u16 places of the
exceptions, u32 their values less the minimum.
"""

from __future__ import annotations

import math
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.texts import drop_tables, slices, texts_of
from kindred.llm.tokenizing import word_encoder
from kindred.sources.storage import new_path

MAGIC = b"KTOKPFR1"
BLOCK = 1024
#: Documents of a shard, at most about, where ids don't repeat; a task holds 24 bytes for each.
SHARD_DOCS = 500_000
#: Rows that a reader sends at once.
READ_ROWS = 10_000
#: Share of a block's values that must fit the packed width.
PERCENTILE = 0.95
_HEAD, _FOOT = struct.Struct("<IHBH"), struct.Struct("<QQQQQ8s")


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Payloads of consecutive blocks of ``ids`` (unsigned 32-bit)."""
    full = len(ids) // BLOCK
    out = _pack(ids[: full * BLOCK].reshape(full, BLOCK)) if full else []
    return out + (_pack(ids[full * BLOCK :].reshape(1, -1)) if len(ids) % BLOCK else [])


def _pack(rows: np.ndarray) -> list[bytes]:
    n = rows.shape[1]
    base = rows.min(axis=1)
    rest = rows - base[:, None]
    k = min(n - 1, int(n * PERCENTILE))
    # log2 of doubles is exact enough here: every value below 2**32 is a double
    width = np.ceil(np.log2(np.partition(rest, k, axis=1)[:, k].astype("f8") + 1)).astype(int)
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        part = rest[at]
        over = (part >> np.uint32(w)) != 0 if w < 32 else np.zeros(part.shape, bool)
        if w in (16, 32):  # whole units: bits are already in place
            packed = part.astype(f"<u{w // 8}").view("u1").reshape(len(at), -1)
        elif w:
            unit = 16 if w <= 16 else 32
            cells = part.astype(f"<u{unit // 8}").view("u1").reshape(len(at), n, unit // 8)
            bits = np.unpackbits(cells, axis=2, bitorder="little")[:, :, :w].reshape(len(at), n * w)
            packed = np.packbits(bits, axis=1, bitorder="little")
        else:
            packed = np.empty((len(at), 0), "u1")
        some = over.any(axis=1).tolist()
        for i, row in enumerate(at.tolist()):
            if not some[i]:
                out[row] = _HEAD.pack(int(base[row]), n, int(w), 0) + packed[i].tobytes()
                continue
            places = np.flatnonzero(over[i])
            out[row] = b"".join((_HEAD.pack(int(base[row]), n, int(w), len(places)), packed[i].tobytes(), places.astype("<u2").tobytes(), part[i][places].astype("<u4").tobytes()))
    return out


def unpack_block(data: bytes) -> np.ndarray:
    base, n, w, extra = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = (n * w + 7) // 8
    values = np.zeros(n, "<u4")
    if w in (16, 32):
        values[:] = np.frombuffer(data, f"<u{w // 8}", n, at)
    elif w:
        unit = 16 if w <= 16 else 32
        bits = np.zeros((n, unit), "u1")
        bits[:, :w] = np.unpackbits(np.frombuffer(data, "u1", size, at), count=n * w, bitorder="little").reshape(n, w)
        values[:] = np.packbits(bits, axis=1, bitorder="little").view(f"<u{unit // 8}").ravel()
    at += size
    if extra:
        values[np.frombuffer(data, "<u2", extra, at)] = np.frombuffer(data, "<u4", extra, at + 2 * extra)
    values += np.uint32(base)
    return values


def _filesystem(uri: str):
    """pyarrow's file system for a URI or plain path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes one shard file; it appears under its name only when complete, so a retried task leaves the same file."""

    def __init__(self, uri: str, attempt: str):
        self.fs, self.path = _filesystem(uri)
        self.tmp = f"{self.path}.{attempt}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.tmp)
        self.out.write(MAGIC)
        self.at, self.starts, self.n = len(MAGIC), [], 0
        self.ids: list[bytes] = []
        self.waiting = 0
        self.docs = array("q")  # three numbers a document

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.extend((doc_id or 0, doc_id is not None, len(ids) // 4))
        self.ids.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * BLOCK * 512:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.ids), "<u4")
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for payload in pack_blocks(ids[:cut]):
            self.starts.append(self.at)
            self.out.write(payload)
            self.at += len(payload)
        self.n += cut
        self.ids = [ids[cut:].tobytes()]
        self.waiting = len(self.ids[0])

    def close(self) -> tuple[int, int]:
        self._flush(True)
        docs = np.frombuffer(self.docs, "i8").astype("<i8").reshape(-1, 3)
        self.out.write(np.array([*self.starts, self.at], "<u8").tobytes())
        self.out.write(docs.tobytes())
        self.out.write(_FOOT.pack(self.at, len(self.starts), len(docs), self.n, BLOCK, MAGIC))
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return len(docs), self.n


class ShardReader:
    def __init__(self, uri: str):
        self.fs, path = _filesystem(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        at, blocks, n_docs, self.n_ids, self.block, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.index = np.frombuffer(self.file.read_at(8 * (blocks + 1), at), "<u8").astype("i8")
        self.docs = np.frombuffer(self.file.read_at(24 * n_docs, at + 8 * (blocks + 1)), "<i8").reshape(-1, 3)

    def read(self, start: int, length: int) -> np.ndarray:
        """Any run of ids, by the blocks that hold it; it ends where the shard ends."""
        length = min(length, self.n_ids - start)
        if length <= 0:
            return np.empty(0, "<u4")
        a, b = start // self.block, (start + length - 1) // self.block
        data = self.file.read_at(int(self.index[b + 1] - self.index[a]), int(self.index[a]))
        cuts = self.index[a : b + 2] - self.index[a]
        ids = np.concatenate([unpack_block(data[x:y]) for x, y in zip(cuts, cuts[1:])])
        return ids[start - a * self.block :][:length]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document's id, first place in the shard and ids, reading a run of blocks at a time."""
        ends = np.cumsum(self.docs[:, 2])
        i, step = 0, self.block * 512
        while i < len(self.docs):
            first = int(ends[i] - self.docs[i, 2])
            j = max(i + 1, int(np.searchsorted(ends, first + step, side="right")))
            ids = self.read(first, int(ends[j - 1]) - first)
            for k in range(i, j):
                start = int(ends[k] - self.docs[k, 2])
                yield (int(self.docs[k, 0]) if self.docs[k, 1] else None), start, ids[start - first : int(ends[k]) - first]
            i = j


@dataclass(frozen=True)
class Shard:
    number: int
    uri: str
    n_docs: int
    n_ids: int
    start: int  # ids in the shards before it


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[Shard]:
    """Encode ``docs`` and write shard files in ascending id order.

    Ids are cut into ``shards`` ranges (by default as many as shuffle
    partitions, more where a shard would have over :data:`SHARD_DOCS` documents)
    at percentiles of the id column alone; each range is one task and one file.
    The list returned has one entry a file.

    Null and empty texts hold the end id alone. Rows without an id come first,
    in shards of their own by ranges of their text's hash. Repeated ids are
    documents of their own, ordered by their text's hash.
    No rows: no files. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = (folder or new_path(spark, "tokens")).rstrip("/")
    none, some = docs.agg(F.count_if(F.col(id_col).isNull()), F.count(id_col)).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = shards or max(parts, math.ceil(some / SHARD_DOCS))
    first = min(shards or parts, none) if none < SHARD_DOCS else max(parts, math.ceil(none / SHARD_DOCS))
    at = [i / count for i in range(1, count)]
    cuts = sorted(set((docs.agg(F.percentile_approx(id_col, at, max(10_000, 10 * count)).alias("c")).first().c if at else None) or []))
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 32))  # 32 bits, not negative
    rows = rows.withColumn("shard", F.when(F.col("doc_id").isNull(), F.shiftright(F.col("h") * first, 32)).otherwise(first + below).cast("int"))
    rows = rows.repartitionById(first + len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "h").drop("h")

    def write(batches):
        from pyspark import TaskContext

        drop_tables("words")
        encoder, attempt = word_encoder(tokenizer), f"tmp-{TaskContext.get().taskAttemptId()}"
        writer, number = None, None
        done = []

        def close():
            done.append((number, uri, *writer.close()))

        for piece in slices(batches, "text"):
            for s, doc_id, ids in zip(piece.column("shard").to_pylist(), piece.column("doc_id").to_pylist(), encoder.encode(texts_of(piece, "text"), end_id)):
                if s != number:
                    if writer:
                        close()
                    number, uri = s, f"{folder}/shard-{s:06d}.tok"
                    writer = ShardWriter(uri, attempt)
                writer.add(doc_id, ids)
        if writer:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["number", "uri", "n_docs", "n_ids"])

    found = sorted(rows.mapInArrow(write, "number long, uri string, n_docs long, n_ids long").collect())
    out, before = [], 0
    for r in found:
        out.append(Shard(r.number, r.uri, r.n_docs, r.n_ids, before))
        before += r.n_ids
    return out


def read_token_files(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32; a task for each file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                rows = ((doc_id, shards[i].start + start, len(ids), zlib.crc32(ids)) for doc_id, start, ids in ShardReader(shards[i].uri).documents())
                while some := list(islice(rows, READ_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(read, schema)
