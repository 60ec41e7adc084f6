"""Whole-text kernels shared by the operators.

Texts travel as Arrow batches; a batch is cut into slices of bounded size so
that a worker's memory depends on the longest single text and not on how many
rows a batch holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text handled at once (more only if one text alone is longer).
SLICE_BYTES = 4 << 20

#: The six bytes that separate words: 0x20 and 0x09 to 0x0D. In UTF-8 they
#: never occur inside a longer character.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, the rest unchanged.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: maximal runs of bytes outside :data:`SPACES` (what ``bytes.split`` splits at)."""
    return text.split()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text is 0 modulo 5; rows without an id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of each piece holds about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, text: str) -> list[bytes | None]:
    return batch.column(text).cast(pa.large_binary()).to_pylist()


#: Tables that a worker keeps between tasks, by name, and how to drop them.
TABLES: dict[str, Callable[[], None]] = {}


def drop_tables(but: str | None = None) -> None:
    """Drop what earlier tasks of other operators left in this worker."""
    for name, drop in TABLES.items():
        if name != but:
            drop()


def map_slices(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, table: str | None = None) -> DataFrame:
    """Apply ``fn`` to bounded slices of ``df`` in Arrow form; ``table`` is the kept table that it uses."""

    def run(batches):
        drop_tables(table)
        for piece in slices(batches, text):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)

