"""Embedding of texts by a pluggable encoder, one instance a task.

No model can be fetched here, so the default is a hashing encoder: every word
adds a direction that its hash gives. It stands where a model would stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384
BATCH_ROWS = 32


class HashingEncoder:
    """Unit vectors of texts; the same text has the same vector everywhere."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.known: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        if word not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            self.known[word] = np.random.default_rng(seed).standard_normal(self.dimensions)
        return self.known[word]

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            words = t.lower().split()
            if words:
                v = np.sum([self._word(w) for w in words], axis=0)
                out[i] = v / np.linalg.norm(v)
        return out


def embed(rows: DataFrame, id_col: str, text_col: str, make: Callable[[], HashingEncoder] = HashingEncoder, batch: int = BATCH_ROWS) -> DataFrame:
    """Vectors of texts: id, embedding. Null and blank texts have none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                yield pd.DataFrame({id_col: part["_id"], "embedding": list(encoder.encode(part["_text"].tolist()).astype("f4"))})

    wanted = rows.where(F.col(text_col).isNotNull() & ~F.col(text_col).rlike(r"^\s*$")).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return wanted.mapInPandas(run, f"`{id_col}` {kind}, embedding array<float>")


def embed_missing(organizations: DataFrame, make: Callable[[], HashingEncoder] = HashingEncoder) -> DataFrame:
    """Vectors for organisations that have none: id, embedding."""
    from kindred.functions.documents import organization_text

    todo = organizations.where("embedding is null").select("id", organization_text(F.col("name"), F.col("description")).alias("text"))
    return embed(todo, "id", "text", make)
