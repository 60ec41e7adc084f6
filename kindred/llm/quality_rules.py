"""Line-first quality rules.

Every line is judged by itself (punctuation, navigation, boilerplate), failing
lines are removed, and a document that loses too much of its text is rejected.
Two document rules come before: too few words, and too much repetition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import map_slices, texts_of, words_of

#: Fixed values of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOLS = b"#*$%&|<>"
#: Words that end in one of these close a sentence.
LINE_ENDS = b'.!?:;"'
#: A line of at least so many words fails if its end closes no sentence and fewer than one word in SENTENCE_WORDS does.
LONG_LINE_WORDS = 12
SENTENCE_WORDS = 40
#: A line fails if more than one word in so many ends in an exclamation mark.
SHOUT_WORDS = 3
#: A line is navigation if a separator stands alone more than once in eight words.
NAVIGATION_SEPARATORS = (b"|", b">", b"/")
NAVIGATION_SHARE = 8
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (b"all rights reserved", b"cookie policy", b"enable javascript", b"privacy policy", b"terms of use", b"terms of service", b"sign up for our newsletter", b"lorem ipsum")
#: A document is rejected if the lines removed hold more than this share of its words.
MAX_LOST_PERCENT = 30
#: A line fails if it has more than one symbol for so many words.
SYMBOL_WORDS = 2

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines_removed long, n_words_removed long, kept boolean"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_HEAD = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes


def count_repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more in the text, the first occurrence included."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
    pairs = w[:-1] * len(ids) + w[1:]
    if len(ids) ** 3 >= 1 << 62:
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * len(ids) + w[2:]
    order = np.argsort(triples, kind="stable")
    same = triples[order][1:] == triples[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), dtype=bool)
    for k in range(REPEAT_WINDOW):
        inside[k : k + n] |= twice
    return int(inside.sum())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """The line rules; blank lines pass."""
    n = len(words)
    if not n:
        return False
    if n >= LONG_LINE_WORDS and words[-1][-1] not in LINE_ENDS and sum(w[-1] in LINE_ENDS for w in words) * SENTENCE_WORDS < n:
        return True
    if n > 2 and sum(w[-1] == 0x21 for w in words) * SHOUT_WORDS > n:
        return True
    if sum(w in NAVIGATION_SEPARATORS for w in words) * NAVIGATION_SHARE > n and n > 2:
        return True
    if len(line.translate(None, _NOT_SYMBOL)) * SYMBOL_WORDS > n and n > 2:
        return True
    low = line.lower()
    return any(p in low for p in BOILERPLATE)


def judge(text: bytes | None) -> tuple:
    """Values of :data:`COLUMNS` for one text, and the text without failing lines."""
    if text is None:
        return (0, 0, 0, 0, 0, True, 0, 0, False), None
    words = words_of(text)
    dup = lost = lost_lines = 0
    seen: set[bytes] = set()
    kept_lines = []
    for line in text.split(b"\n"):
        own = words_of(line)
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
        if line_fails(line, own):
            lost += len(own)
            lost_lines += 1
        else:
            kept_lines.append(line)
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).translate(None, _NOT_HEAD))
    repeat = count_repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    kept = not failed and 100 * lost <= MAX_LOST_PERCENT * len(words)
    return (len(words), chars, len(text.translate(None, _NOT_SYMBOL)), dup, repeat, failed, lost_lines, lost, kept), b"\n".join(kept_lines)


def apply_line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = True) -> DataFrame:
    """One row a document: doc_id, the columns of :data:`COLUMNS` and, if asked for, ``cleaned_text``.

    ``kept`` is the verdict; ``cleaned_text`` is the text without failing
    lines. Null texts have no words and fail; so do empty ones. Rows without an
    id and repeated rows are judged like others. Other columns of ``docs`` are
    not read. No rows: no rows.
    """
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
    types = [pa.int64(), *({"long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in COLUMNS.split(", "))]

    def run(piece):
        judged = [judge(t) for t in texts_of(piece, "text")]
        cols = [piece.column("doc_id").to_pylist(), *zip(*(j[0] for j in judged))]
        arrays = [pa.array(c, t) for c, t in zip(cols, types)]
        if cleaned:
            arrays.append(pa.array([j[1] for j in judged], pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names + ["cleaned_text"] * cleaned)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(rows, "text", run, f"doc_id long, {COLUMNS}" + ", cleaned_text string" * cleaned)


def keep_good(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns, with failing lines gone from the text (and ``size_col`` its length)."""

    def run(piece):
        judged = [judge(t) for t in texts_of(piece, text_col)]
        text = pa.array([j[1] for j in judged], pa.binary()).cast(pa.string())
        at = piece.schema.get_field_index(text_col)
        piece = piece.set_column(at, piece.schema.field(at), text.cast(piece.schema.field(at).type))
        if size_col in piece.schema.names:
            at = piece.schema.get_field_index(size_col)
            piece = piece.set_column(at, piece.schema.field(at), pc.utf8_length(text).cast(piece.schema.field(at).type))
        return piece.filter(pa.array([j[0][-1] for j in judged]))

    return map_slices(docs, text_col, run, docs.schema)
