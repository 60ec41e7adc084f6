"""SentencePiece encoding and decoding with shared-prefix forward passes.

A text is cut at its word marks: no piece holds a mark after another character,
so the pieces of a marked word don't depend on its neighbours. Distinct marked
words are sorted, which is a depth-first walk of their trie: what two
neighbours have in common keeps its forward states, and only the rest of a word
is computed. A state is the best way to cut the prefix that ends there.

For a unigram model the best way has the largest sum of scores (Viterbi). A
byte-pair model doesn't choose by a sum: its cut is the one that merging in
order of scores leads to. That cut is found in the same forward pass, because
the pieces of a prefix are decided by its last piece: a cut is the model's if
any two neighbouring pieces, merged on their own, stay as they are. Every
prefix has exactly one last piece of that kind.
"""

from __future__ import annotations

import functools
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import TABLES, drop_tables, map_slices

MARK = "▁"
#: Words held per worker; the table is emptied when it is full.
TABLE_WORDS = 500_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNIGRAM, BPE = 1, 2
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
# stand between words and between their parts; texts that have them are cut word by word
_BREAK, _SEAM = "\ufffe", "\uffff"
#: Taken off the smallest score for a character that the model lacks, as the library does.
UNKNOWN_PENALTY = 10.0


class SentencePieceCodec:
    """Encodes and decodes as the model file says, for unigram and byte-pair models."""

    def __init__(self, model_file: str | None = None, model_proto: bytes | None = None):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        if model_proto is None:
            with open(model_file, "rb") as f:
                model_proto = f.read()
        proto = pb.ModelProto.FromString(model_proto)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        self.normalizer = sp.SentencePieceNormalizer(model_proto=model_proto) if proto.normalizer_spec.name != "identity" else None
        self.spec = proto.normalizer_spec
        self.fallback = proto.trainer_spec.byte_fallback
        self.unk = proto.trainer_spec.unk_id
        kinds = pb.ModelProto.SentencePiece
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes = [self.unk] * 256
        self.texts: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            self.scores.append(p.score)
            self.texts.append(b"")
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids[p.piece] = i
                self.texts[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.texts[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.texts[i] = (proto.trainer_spec.unk_surface or " ⁇ ").encode()
        # every ending of a piece: the id where it is itself a piece, else -1
        self.tails: dict[str, int] = {}
        for piece, i in self.ids.items():
            for k in range(len(piece) - 1, 0, -1):
                self.tails.setdefault(piece[k:], -1)
            self.tails[piece] = i
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.table: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.seams = self._find_seams()
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    # -- normalisation ---------------------------------------------------
    def normalize(self, text: str) -> str:
        if self.normalizer is not None:
            return self.normalizer.normalize(text).replace(" ", MARK)
        if self.spec.remove_extra_whitespaces:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return ((" " if self.spec.add_dummy_prefix else "") + text).replace(" ", MARK)

    def _find_seams(self) -> re.Pattern:
        """Places inside a word that no piece spans: between an ASCII letter and a mark that no piece has in this order.

        Unless unknown characters are merged, what lies on either side of a
        seam is cut on its own.
        """
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        letters = [c for c in map(chr, range(128)) if c.isalpha()]
        marks = [c for c in map(chr, range(1, 128)) if not c.isalnum() and c != " "]
        after = "".join(m for m in marks if not any(x + m in pairs for x in letters))
        before = "".join(m for m in marks if not any(m + x in pairs for x in letters))
        if not self.fallback or not after or not before:
            return re.compile(r"(?!)")
        return re.compile(f"(?<=[A-Za-z])(?=[{re.escape(after)}])|(?<=[{re.escape(before)}])(?=[A-Za-z])")

    # -- byte-pair neighbours --------------------------------------------
    def _merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours by the best score, leftmost first."""
        ids, scores = self.ids, self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = ids.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stays(self, a: str, b: str) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            found = self._merged(list(a + b)) == [a, b]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[a, b] = found
        return found

    def _reached(self, piece: str) -> bool:
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = self._merged(list(piece)) == [piece]
        return found

    # -- forward pass ----------------------------------------------------
    def cut_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Pieces of each word, by a depth-first walk of the words' trie."""
        out: dict[str, list[str]] = {}
        last: list[str] = []  # of the prefix that ends at i: its last piece
        score: list[float] = [0.0]  # and, for a unigram model, its best sum
        before = ""
        forward = self._forward_unigram if self.kind == UNIGRAM else self._forward_bpe
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared:], score[shared + 1 :]
            forward(word, last, score)
            pieces, end = [], len(word)
            while end:
                piece = last[end - 1]
                pieces.append(piece)
                end -= len(piece)
            pieces.reverse()
            out[word] = pieces
            before = word
        return out

    def _forward_unigram(self, word: str, last: list[str], score: list[float]) -> None:
        tails, scores = self.tails, self.scores
        for end in range(len(last) + 1, len(word) + 1):
            best, piece = None, word[end - 1]
            for start in range(end - 1, -1, -1):
                found = tails.get(word[start:end])
                if found is None:  # no longer piece ends like this
                    if start < end - 1:
                        break
                    best = score[start] + self.low
                elif found >= 0:
                    s = score[start] + scores[found]
                    if best is None or s >= best:
                        best, piece = s, word[start:end]
                elif start == end - 1:
                    best = score[start] + self.low
            last.append(piece)
            score.append(best)

    def _forward_bpe(self, word: str, last: list[str], score: list[float]) -> None:
        tails, fits = self.tails, self.fits
        for end in range(len(last) + 1, len(word) + 1):
            ways = []
            for start in range(end - 2, -1, -1):
                piece = word[start:end]
                found = tails.get(piece)
                if found is None:
                    break
                if found >= 0:
                    ways.append((start, piece))
            for start, piece in reversed(ways):
                if start:
                    ok = fits.get((last[start - 1], piece))
                    if ok is None:
                        ok = self._stays(last[start - 1], piece)
                    if not ok:
                        continue
                if self._reached(piece):
                    last.append(piece)
                    break
            else:
                last.append(word[end - 1])
            score.append(0.0)

    # -- texts -----------------------------------------------------------
    def _pack(self, pieces: Sequence[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            found = self.ids.get(p)
            if found is not None:
                out.append(found)
            elif self.fallback:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return array("I", out).tobytes() if LITTLE else np.array(out, "<u4").tobytes()

    def _add_words(self, words: list[str]) -> None:
        """Ids of new words, from those of their parts."""
        if len(self.parts) > TABLE_WORDS:
            self.parts.clear()
        parts = self.parts
        text = "".join(words)
        if _SEAM in text or _BREAK in text:
            cut = [self.seams.split(w) for w in words]
        else:  # all at once
            cut = [w.split(_SEAM) for w in self.seams.sub(_SEAM, _BREAK.join(words)).split(_BREAK)]
        for part, pieces in self.cut_words({p for ps in cut for p in ps if p not in parts}).items():
            parts[part] = self._pack(pieces)
        self.table.update((w, parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps])) for w, ps in zip(words, cut))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text, packed little-endian in 32 bits. A null text is an empty one."""
        split = [_WORDS.findall(self.normalize(t)) if t else () for t in texts]
        if len(self.table) > TABLE_WORDS:
            self.table.clear()
        table = self.table
        new = list(set().union(*split).difference(table))
        if new:
            self._add_words(new)
        return [b"".join([table[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        texts = self.texts
        out = b"".join([texts[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return (out[1:] if self.spec.add_dummy_prefix and out[:1] == b" " else out).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(model_file: str) -> SentencePieceCodec:
    return SentencePieceCodec(model_file)


TABLES["pieces"] = codec.cache_clear
#: Documents decoded at once.
DECODED_ROWS = 256


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, ids (array of int).

    Null and empty texts have no ids. Rows without an id and repeated rows are
    encoded like others; other columns are not read. No rows: no rows.
    """

    def run(piece):
        ids = [np.frombuffer(x, "<i4") for x in codec(model_file).encode(piece.column("text").to_pylist())]
        offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype("i4")
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else [], pa.int32()))], ["doc_id", "ids"])

    return map_slices(_rows(docs, id_col, text_col), "text", run, "doc_id long, ids array<int>", "pieces")


def decode_documents(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a document: doc_id, text.

    Null ids have a null text, no ids an empty one. Rows without an id and
    repeated rows are decoded like others; other columns are not read. No rows:
    no rows.
    """

    def run(batches):
        drop_tables("pieces")
        c = codec(model_file)
        for batch in batches:
            for k in range(0, batch.num_rows, DECODED_ROWS):  # the ids of few documents are Python lists at once
                part = batch.slice(k, DECODED_ROWS)
                ids = part.column("ids")
                texts = [c.decode(ids[i].values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) if ids[i].is_valid else None for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_crc32, decoded_crc32 (of the decoded UTF-8), round_trip.

    The last tells whether the decoded text equals the text; null texts count
    as empty. Rows without an id and repeated rows are coded like others; other
    columns are not read. No rows: no rows.
    """

    def run(piece):
        c = codec(model_file)
        texts = [t or "" for t in piece.column("text").to_pylist()]
        ids = c.encode(texts)
        decoded = [c.decode(x) for x in ids]
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()), pa.array([d == t for d, t in zip(decoded, texts)])],
            ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"],
        )

    return map_slices(_rows(docs, id_col, text_col), "text", run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean", "pieces")
