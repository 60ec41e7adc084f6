"""Language identification by error-correcting output codes.

Every language has a codeword; each bit is predicted by a linear classifier
over hashed character n-grams, and the language whose codeword has the least
margin loss, each bit weighted by how well its classifier did on the sample, is
chosen. A text whose two best codewords have nearly equal loss is flagged.
"""

from __future__ import annotations

import pickle
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import LOWER_ASCII, held_out, map_slices, texts_of

#: Hashed n-grams of 2 and 3 bytes, each in so many bins.
BINS = 2048
#: Training rows at most (about equally many of each language).
SAMPLE_ROWS = 4000
#: Codewords have every split of the languages if these are at most so many (7 languages), else so many at random.
FEW_SPLITS = 63
RANDOM_BITS = 48
#: A text is ambiguous if the second best codeword's loss exceeds the best one's by less than this share of their sum.
AMBIGUOUS_GAP = 0.5
UNKNOWN = "und"
SEED = 17

# letters become themselves in lower case, everything else in ASCII a blank
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in LOWER_ASCII], dtype=np.uint32)


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte 2-grams and 3-grams of a whole text."""
    b = _FOLD[np.frombuffer(text, "u1")]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]] if len(b) else b  # runs of blanks count once
    b = np.concatenate(([32], b, [32])).astype(np.uint32)
    out = np.zeros(2 * BINS)
    two = (b[:-1] << 8 | b[1:]) * np.uint32(2654435761)
    out[:BINS] = np.bincount(two >> np.uint32(21), minlength=BINS)
    three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2246822519)
    out[BINS:] = np.bincount((three ^ three >> np.uint32(15)) & np.uint32(BINS - 1), minlength=BINS)
    return np.sqrt(out / (2 * len(two))).astype("f4")


def has_letter(text: bytes) -> bool:
    if text.isalpha():
        return True
    if text.isascii():
        return len(text.translate(None, _LETTERS)) < len(text)
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """Codewords of n classes, entries -1 and 1, one column a bit; columns are different splits in two.

    A split is named by the classes (all but the first) on its other side, as a
    number. There are ``2**(n-1) - 1``; where these are too many, each class
    against the others is taken, so that any two codewords differ, and a draw
    of the rest.
    """
    if n <= 1:
        return np.ones((n, 1))
    every = (1 << (n - 1)) - 1
    splits = range(1, min(every, FEW_SPLITS) + 1)
    if every > FEW_SPLITS:
        rng, chosen = random.Random(seed), {1 << i for i in range(n - 1)} | {every}
        while len(chosen) < n + RANDOM_BITS:  # of 127 splits at least
            chosen.add(rng.randint(1, every))
        splits = sorted(chosen)
    return np.array([[1] * len(splits), *([-1 if s >> i & 1 else 1 for s in splits] for i in range(n - 1))], dtype=float)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Trust-weighted logistic loss of every codeword."""
        margin = (x @ self.weights + self.bias).astype(float)
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        return (loss * self.trust).sum(axis=2)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the best language, its share in a soft-min over the losses, and the gap to the second best (0 to 1; 1 if there is none)."""
        loss = self.losses(x)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        two = np.partition(loss, 1, axis=1)[:, :2] if loss.shape[1] > 1 else np.c_[np.zeros(len(loss)), np.ones(len(loss))]
        gap = (two[:, 1] - two[:, 0]) / np.maximum(two.sum(axis=1), 1e-12)
        return best, p[np.arange(len(p)), best], gap


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 200, rate: float = 4.0, l2: float = 1e-5) -> LanguageModel:
    """Logistic classifiers of all bits at once, by gradient steps with momentum on the whole sample."""
    code = codewords(len(languages)).astype("f4")
    target = code[y]
    share = np.bincount(y, minlength=len(languages)).astype(float)
    row = ((1 / share[y])[:, None] / len(languages)).astype("f4")  # languages count alike
    w, b = np.zeros((x.shape[1], code.shape[1]), "f4"), np.zeros(code.shape[1], "f4")
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * row  # every factor is a 32-bit float
        vw, vb = 0.9 * vw - rate * (x.T @ g + l2 * w), 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((np.sign(x @ w + b) == target) * row).sum(axis=0)
    trust = np.clip(np.log((right + 1e-3) / (1 - right + 1e-3)), 0.05, 8)
    return LanguageModel(languages, code, w, b, trust / trust.mean())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on a bounded sample of the rows that aren't held out and have text and language.

    The rows taken are those with the smallest hash of their id among each
    language's, up to an equal share of ``sample_rows``: the hash bound of a
    language follows from its count over all documents. Where ids repeat so
    often that this gives more than twice ``sample_rows`` rows, the
    ``2 * sample_rows`` of the smallest hash of id and text are the sample.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = dict(known.groupBy("lang").count().collect())
    languages = sorted(counts)
    untaught = LanguageModel([], np.ones((0, 1)), np.zeros((2 * BINS, 1), "f4"), np.zeros(1), np.ones(1))
    if not languages:
        return untaught
    each = max(1, sample_rows // len(languages))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    drawn = known.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def run(piece):
        x = [features(t).astype("f2").tobytes() for t in texts_of(piece, "text")]
        return pa.RecordBatch.from_arrays([piece.column("lang"), pa.array(x, pa.binary()), piece.column("h")], ["lang", "x", "h"])

    def learn(batches):
        """The one task that has the sample: only the model leaves it."""
        drawn = [b for b in batches if b.num_rows]
        if not drawn:
            return
        table = pa.Table.from_batches(drawn)
        known = sorted(table.column("lang").unique().to_pylist())
        y = np.array([known.index(v) for v in table.column("lang").to_pylist()])
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), "f2").reshape(len(y), -1).astype("f4")
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(x, y, known))], pa.binary())], ["model"])

    sample = map_slices(drawn.withColumn("h", F.xxhash64("doc_id", "text")), "text", run, "lang string, x binary, h long").orderBy("h").limit(2 * sample_rows)
    found = sample.select("lang", "x").mapInArrow(learn, "model binary").first()
    return pickle.loads(bytes(found.model)) if found else untaught


def predict_texts(model: LanguageModel, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    at = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.languages else []
    lang, score, ambiguous = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    for k in range(0, len(at), 512):
        part = at[k : k + 512]
        best, p, gap = model.predict(np.stack([features(texts[i]) for i in part]))
        for i, j in zip(part, best.tolist()):
            lang[i] = model.languages[j]
        score[part], ambiguous[part] = p, gap < AMBIGUOUS_GAP
    return lang, score, ambiguous


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score, ambiguous.

    Null texts and texts without a letter are ``und`` with score 0 and
    ambiguous, as is every text if nothing could be learned. A text is also
    ambiguous if its two best codewords have losses too close to each other, as
    those of a text in two languages. Rows without an id and repeated rows are
    predicted like others; other columns are not read. No rows: no rows.
    """

    def run(piece):
        lang, score, ambiguous = predict_texts(model, texts_of(piece, "text"))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lang), pa.array(score), pa.array(ambiguous)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return map_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language that isn't ambiguous.

    If nothing could be learned no text is rejected for its language, only
    those that are null or have no letter.
    """

    def run(piece):
        texts = texts_of(piece, text_col)
        if not model.languages:
            return piece.filter(pa.array([bool(t) and has_letter(t) for t in texts], pa.bool_()))
        return piece.filter(pa.array(~predict_texts(model, texts)[2]))

    return map_slices(docs, text_col, run, docs.schema)
