"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes round the features in turn; every
turn fits a shallow tree to the residuals of one feature and adds it to that
feature's lookup table, so no feature explains what another already did. The
strongest pairs of features then get tables of their own the same way. A score
is the sigmoid of the sum of the tables' entries at the document's bins.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import held_out, map_slices, texts_of, words_of

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "bang_share", "dot_share", "lone_symbol_share",
    "distinct_share", "top_word_share", "same_next_share", "line_words", "dup_line_share", "punctuated_lines", "short_word_share", "longest_word", "pair_share",
)
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
LEAVES = 3
#: Labelled rows used at most.
SAMPLE_ROWS = 20_000
#: A document is predicted good from this score on.
THRESHOLD = 0.3


def features(text: bytes | None) -> list[float]:
    """Values of :data:`FEATURES` for a whole text; all zero if it has no words."""
    words = words_of(text) if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    c = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    letters = max(1, int(c[65:91].sum() + c[97:123].sum() + c[192:].sum()))
    symbols = int(sum(c[b] for b in b"#*$%&|<>"))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    return [
        math.log1p(n), sum(map(len, words)) / n, float(c[65:91].sum()) / letters, float(c[48:58].sum()) / size, symbols / n, float(c[33]) / n, float(c[46]) / n, sum(counts[s] for s in (b"|", b"#", b"*", b"&", b">", b"<")) / n,
        len(counts) / n, max(counts.values()) / n, same / n, math.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1] in b'.!?"' for x in lines) / max(1, len(lines)), sum(v for w, v in counts.items() if len(w) < 4) / n, math.log1p(max(map(len, counts))), pairs / max(1, n - 1),
    ]


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray]
    base: float
    tables: np.ndarray  # features x BINS
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: np.ndarray  # pairs x PAIR_BINS x PAIR_BINS

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, cuts in enumerate(self.cuts):
            total += self.tables[f][np.searchsorted(cuts, x[:, f], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins with gradient and weight sums g, h."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    ok = (hl > 1) & (hr > 1)
    gain = np.where(ok, gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), -1.0)
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values of a shallow tree over the ordered bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, k, p = max((*_best_cut(g[a:b], h[a:b]), (a, b)) for a, b in parts)
        if gain <= 0:
            break
        parts.remove(p)
        parts += [(p[0], p[0] + k), (p[0] + k, p[1])]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree over two features: the best cut of one, then of the other on either side."""
    best, out = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for k in range(1, len(a)):
            value, fit = 0.0, np.empty_like(a)
            for rows in (slice(0, k), slice(k, len(a))):
                gs, hs = a[rows].sum(axis=0), b[rows].sum(axis=0)
                fit[rows] = leaf = _tree(gs, hs, 2)
                value += float((leaf * gs).sum())
            if value > best:
                best, out = value, (fit.T if turn else fit).copy()
    return best, out


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on the logistic loss; ``y`` is 0 or 1."""
    n, m = x.shape
    cuts = [_cuts(x[:, f], BINS) for f in range(m)]
    at = np.stack([np.searchsorted(cuts[f], x[:, f], side="right") for f in range(m)])
    p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base, tables = math.log(p0 / (1 - p0)), np.zeros((m, BINS + 1))
    total = np.full(n, base)
    for _ in range(ROUNDS):
        for f in range(m):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(at[f], y - p, BINS + 1), np.bincount(at[f], p * (1 - p), BINS + 1))
            tables[f] += step
            total += step[at[f]]
    pair_cuts = [_cuts(x[:, f], PAIR_BINS) for f in range(m)]
    small = np.stack([np.searchsorted(pair_cuts[f], x[:, f], side="right") for f in range(m)])

    def sums(i, j):
        p = 1 / (1 + np.exp(-total))
        cell, size = small[i] * PAIR_BINS + small[j], PAIR_BINS * PAIR_BINS
        return [np.bincount(cell, v, size).reshape(PAIR_BINS, PAIR_BINS) for v in (y - p, p * (1 - p))]

    ranked = sorted(((_tree2(*sums(i, j))[0], (i, j)) for i, j in combinations(range(m), 2)), reverse=True)
    pairs = [p for gain, p in ranked[:PAIRS] if gain > 0]
    pair_tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            step = RATE * _tree2(*sums(i, j))[1]
            pair_tables[k] += step
            total += step[small[i], small[j]]
    return AdditiveModel(cuts, base, tables, pairs, pair_cuts, pair_tables)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on labelled documents that aren't held out: all of them, or the share of ``sample_rows`` by a hash of the id.

    Null labels and null texts are not used, and an id with several labels has
    the smallest. Where ids of documents repeat so often that more than
    ``4 * sample_rows`` rows come, the first by id and features are the sample.
    With no labelled rows every score is 0.5.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    count = chosen.count()
    if count > sample_rows:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * sample_rows / count)
    # at most about sample_rows rows of two numbers: below 1 MB, so it is sent to every task that reads texts
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")

    def run(piece):
        x = np.array([features(t) for t in texts_of(piece, "text")], "f8")
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    found = map_slices(rows, "text", run, "doc_id long, label int, x binary").orderBy("doc_id", "x").limit(4 * sample_rows).collect()
    if not found:
        m = len(FEATURES)
        return AdditiveModel([np.empty(0)] * m, 0.0, np.zeros((m, BINS + 1)), [], [np.empty(0)] * m, np.zeros((0, PAIR_BINS, PAIR_BINS)))
    return train(np.frombuffer(b"".join(bytes(r.x) for r in found), "f8").reshape(len(found), -1), np.array([r.label for r in found], float))


def classify(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, score, predicted.

    Only the text is an input of the score. Null and wordless texts have all
    features zero and get the score that these lead to. Rows without an id and
    repeated rows are scored like others; other columns are not read. No rows:
    no rows.
    """

    def run(piece):
        score = model.score(np.array([features(t) for t in texts_of(piece, "text")], "f8"))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype("i4"))], ["doc_id", "score", "predicted"])

    return map_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", run, "doc_id long, score double, predicted int")
