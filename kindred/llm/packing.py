"""Hierarchical packing of documents into sequences of several context sizes.

Documents are routed to tiers (powers of two up to the window) by what is left
of them after whole windows of their own. Tiers are packed from the longest to
the shortest; the gap of a long window is filled with whole pieces of shorter
tiers, and with a cut piece where none fits.

A task packs the rows of its own partition, so nothing but results leaves it
and a lost task is repeated alone. Only the last few hundred tokens of a
partition can meet a padded window.

Step groups are balanced over all tasks and tiers: sequences are numbered by
the tokens of all sequences before them, longest tier first and padded windows
last, from one sum for each task and tier, and a group is ``step_tokens`` of
that line. Every context divides the step, so groups hold equally many tokens,
but for the last one and those of padded windows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.texts import drop_tables, slices, texts_of
from kindred.llm.tokenizing import word_encoder
from kindred.sources.storage import materialize

WINDOW = 4096
TIERS = (256, 512, 1024, 2048, 4096)
#: Tokens of a step group, that is of one training step.
STEP_TOKENS = 16 * WINDOW
#: Pieces that wait at most before they are packed.
POOL = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, task long, place long"


class Packer:
    """Packs a stream of document lengths; sequences are lists of (document, start, length)."""

    def __init__(self, tiers=TIERS):
        self.tiers, self.window = tiers, tiers[-1]
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), shortest first
        self.ready: list[tuple[int, list[tuple[int, int, int]]]] = []  # (context, pieces)

    def add(self, doc: int, n: int) -> None:
        whole = n // self.window * self.window
        for start in range(0, whole, self.window):
            self.ready.append((self.window, [(doc, start, self.window)]))
        if n > whole:
            insort(self.pool, (n - whole, doc, whole))
        if len(self.pool) > POOL:
            self.pack()

    def pack(self) -> None:
        """Pack what waits; the pieces of the one window that can't be filled wait on."""
        while self.pool:
            length, doc, start = self.pool.pop()
            context = next(t for t in self.tiers if t >= length)
            pieces, gap = [(doc, start, length)], context - length
            while gap and self.pool:
                i = bisect_right(self.pool, (gap, float("inf"), 0)) - 1
                if i >= 0:
                    n, d, s = self.pool.pop(i)
                else:
                    n, d, s = self.pool.pop(0)
                    insort(self.pool, (n - gap, d, s + gap))
                    n = gap
                pieces.append((d, s, n))
                gap -= n
            if gap:
                for d, s, n in pieces:
                    insort(self.pool, (n, d, s))
                return
            self.ready.append((context, pieces))

    def finish(self) -> None:
        """Cut the rest into windows of the tiers; what is below the smallest is one padded window."""
        self.pack()
        rest, self.pool = self.pool, []
        for context in (*reversed(self.tiers), None):
            while rest and sum(n for n, _, _ in rest) >= (context or 1):
                pieces, gap = [], context or sum(n for n, _, _ in rest)
                while gap:
                    n, d, s = rest.pop()
                    if n > gap:
                        rest.append((n - gap, d, s + gap))
                    pieces.append((d, s, min(n, gap)))
                    gap -= min(n, gap)
                self.ready.append((context or self.window, pieces))


def step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """Pieces with step_group in place of task and place (-1 for a padded window, else its sequence's number in task and tier)."""
    padded = F.col("place") < 0
    sums = pieces.groupBy("task", "context", padded.alias("padded")).agg(F.sum("length").alias("tokens"))
    # one row for each task and tier, whatever the documents
    line = Window.orderBy("padded", F.col("context").desc(), "task").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("task", "context", "padded", F.coalesce(F.sum("tokens").over(line), F.lit(0)).alias("before"))
    at = F.col("before") + F.greatest(F.col("place"), F.lit(0)) * F.col("context")
    out = pieces.withColumn("padded", padded).join(first, ["task", "context", "padded"])
    return out.withColumn("step_group", F.floor(at / step_tokens).cast("long")).drop("task", "place", "padded", "before")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    context (the sequence's size) and step_group (0, 1, ...). Null and empty texts are
    documents of the end id alone; rows without an id and repeated rows are
    packed like others, each row as a document of its own. Other columns of
    ``docs`` are not read. No rows: no pieces.
    """

    def run(batches):
        from pyspark import TaskContext

        drop_tables("words")
        part, encoder, packer = TaskContext.get().partitionId(), word_encoder(tokenizer), Packer(tiers)
        held: dict[int, list] = {}  # document: its id, ids, tokens not yet sent
        made, count = dict.fromkeys(tiers, 0), 0
        total = 0

        def send():
            nonlocal total
            rows = []
            for context, pieces in packer.ready:
                sequence, offset = (part << 36) + total, 0
                place = made[context] if sum(n for _, _, n in pieces) == context else -1
                made[context] += 1
                total += 1
                for d, s, n in pieces:
                    doc = held[d]
                    rows.append((doc[0], s, n, zlib.crc32(memoryview(doc[1])[4 * s : 4 * (s + n)]), len(doc[1]) // 4, sequence, offset, context, part, place))
                    offset += n
                    doc[2] -= n
                    if not doc[2]:
                        del held[d]
            packer.ready = []
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k : k + 50_000])], [x.split()[0] for x in SCHEMA.split(", ")])

        for piece in slices(batches, "text"):
            for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(texts_of(piece, "text"), end_id)):
                held[count] = [doc_id, ids, len(ids) // 4]
                packer.add(count, len(ids) // 4)
                count += 1
            yield from send()
        packer.finish()
        yield from send()

    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
    return step_groups(materialize(packed, "pieces"), step_tokens).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group")
