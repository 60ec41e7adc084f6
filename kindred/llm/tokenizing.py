"""Encoding by the tokenizers library, one encoding for each distinct word part.

The word-end BPE vocabulary drops white space and never merges across it, so a
text's ids are its words' ids in order. Each worker keeps a bounded table of
words it has met. A new word of ASCII and Latin-1 letters and marks is cut
into its parts here, as the file's own pre-tokenizer would, and only parts not
met before are given to the library's model, many at once. Any other new word,
and any text that spells an added token, goes through the library's whole chain.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Sequence

import numpy as np

from kindred.llm.texts import TABLES, words_of

#: Words, and word parts, held per worker; a table is emptied when it is full.
TABLE_WORDS = 400_000
TABLE_PARTS = 600_000

_BREAK = b"\xff" * 4

# words that NFC leaves alone and whose lower case is character by character
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the file's split pattern, for lower-case words of these characters, one on a line.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")
WORD_END = "</w>"


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it prints, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Texts to little-endian unsigned 32-bit ids, equal to encoding each whole text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # a text that spells an added token gets its id, as the plain call of the library does
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        self.parts_only = Tokenizer(self.tokenizer.model)
        self.parts_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith(WORD_END)]] = True
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode_parts(self, parts: list[str], run: int = 256) -> None:
        """Add the ids of word parts; every part ends in a word-end piece, which tells where the next begins."""
        spelt = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in parts]
        found = self.parts_only.encode_batch_fast([" ".join(spelt[k : k + run]) for k in range(0, len(spelt), run)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in found])
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(parts):
            raise ValueError("the vocabulary doesn't mark word ends")
        packed = ids.tobytes()
        self.parts.update(zip(parts, [packed[a:b] for a, b in zip([0, *ends], ends)]))

    def _encode_words(self, words: list[bytes]) -> None:
        lone, marked, other = ([], []), ([], []), ([], [])
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        for w, t, plain in zip(words, texts, map(_PLAIN.fullmatch, texts)):
            into = other if plain is None else lone if t.isalpha() else marked
            into[0].append(w)
            into[1].append(t)
        if other[0]:
            found = self.tokenizer.encode_batch(other[1], add_special_tokens=False)
            self.words.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(other[0], found))
        if len(self.parts) > TABLE_PARTS:
            self.parts.clear()
        parts = self.parts
        parts["\n"] = _BREAK  # between words, where no id is
        single = "\n".join(lone[1]).lower().split("\n") if lone[0] else []
        cut = _PARTS.findall("\n".join(marked[1]).lower() + "\n") if marked[0] else []
        new = list({*single, *cut}.difference(parts))
        if new:
            self._encode_parts(new)
        self.words.update(zip(lone[0], [parts[p] for p in single]))
        packed = b"".join([parts[p] for p in cut])
        ends = (4 * np.flatnonzero(np.frombuffer(packed, "<u4") == 0xFFFFFFFF)).tolist()
        self.words.update(zip(marked[0], [packed[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]))

    def encode(self, texts: Sequence[bytes | None], end_id: int) -> list[bytes]:
        """Packed ids of each text, ``end_id`` appended; a null text is an empty one."""
        spelt = {i for i, t in enumerate(texts) if t and self.added.search(t)}
        split = [words_of(t) if t and i not in spelt else () for i, t in enumerate(texts)]
        if len(self.words) > TABLE_WORDS:
            self.words.clear()
        table = self.words
        new = list(set().union(*split).difference(table))
        if new:
            self._encode_words(new)
        end = np.array([end_id], dtype="<u4").tobytes()
        out = [b"".join([table[w] for w in ws]) + end for ws in split]
        for i in spelt:  # tokens may be spelt inside or across words: the library's whole chain
            ids = self.tokenizer.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids
            out[i] = np.array([*ids, end_id], dtype="<u4").tobytes()
        return out


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


TABLES["words"] = word_encoder.cache_clear
