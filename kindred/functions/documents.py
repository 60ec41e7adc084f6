"""Texts for embedding: building, counting tokens and shortening them."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKENS = 384
STRATEGIES = ("simple", "intelligent", "start_only", "end_only", "sliding_window")
#: Beyond so many times the limit only the outline of a document is kept.
OUTLINE_FROM = 5
DOTS = "..."

_NAME = re.compile(r"Service:\s*(.+?)\n\n")
_DESCRIPTION = re.compile(r"Description:\s*(.+?)\n\n")
_FIRST_SENTENCE = re.compile(r"Description:\s*(.+?)(?:\.|;|!|\?)")
_CATEGORIES = re.compile(r"Categories:\s*(.+?)\n\n")
_SECTION = re.compile(r"([^:]+):\s*(.+?)\n")
_URL = re.compile(r"URL:\s*(.+?)\n\n")
_SENTENCE_END = re.compile(r"[.!?]\s+")
_COMMA = re.compile(r",\s+")


def document_text(name: Column, description: Column, taxonomies: Column, url: Column | None = None) -> Column:
    """Sections ``Service``, ``Description`` and ``Categories``, then each category's description, then a url.

    ``taxonomies`` is an array of (id, name, description). Sections without
    content are left out.
    """
    none = F.lit("")
    terms = F.array_join(F.transform(taxonomies, lambda t: t["name"]), ", ")
    described = F.filter(taxonomies, lambda t: t["description"].isNotNull() & (t["description"] != ""))
    lines = F.array_join(F.transform(described, lambda t: F.concat(t["name"], F.lit(": "), t["description"], F.lit("\n"))), "")
    blank = F.when(F.exists(taxonomies, lambda t: t["description"].isNotNull()), F.lit("\n")).otherwise(none)
    categories = F.when(F.size(taxonomies) > 0, F.concat(F.lit("Categories: "), terms, F.lit("\n\n"), lines, blank)).otherwise(none)
    about = F.when(F.coalesce(description, none) != "", F.concat(F.lit("Description: "), description, F.lit("\n\n"))).otherwise(none)
    link = F.when(F.coalesce(url, none) != "", F.concat(F.lit("URL: "), url, F.lit("\n\n"))).otherwise(none) if url is not None else none
    return F.concat(F.lit("Service: "), F.coalesce(name, none), F.lit("\n\n"), about, F.coalesce(categories, none), link)


def organization_text(name: Column, description: Column) -> Column:
    return F.concat_ws(" ", name, description)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def fallback_tokens(text: Column) -> Column:
    """Words plus a quarter of the bytes."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(word_count(text) + F.floor(F.octet_length(text) / 4).cast("int"))


def approximate_tokens(text: Column) -> Column:
    """Words, half the punctuation, 20 for a url and two fifths of the words for splits; a fifth more for safety."""
    words = word_count(text)
    marks = F.length(text) - F.length(F.regexp_replace(text, r"""[,.!?;:()\[\]{}"']""", ""))
    link = F.when(text.contains("http") | text.contains("www."), 20).otherwise(0)
    n = words + F.floor(marks / 2) + link + F.floor(words.cast("float") * F.lit(0.4).cast("float"))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(n + F.floor(n / 5)).cast("int")


def count_tokens(text: str) -> int:
    """What the fallback counts, for one text: words plus a quarter of the bytes."""
    return len(text.split()) + len(text.encode()) // 4 if text else 0


def _section(pattern: re.Pattern, text: str) -> str:
    found = pattern.search(text)
    return found[1] if found else ""


def _fill(parts, room: int, count) -> tuple[str, bool]:
    """Parts, in order, as long as their tokens fit; and whether some were left out."""
    out, used = [], 0
    for p in parts:
        n = count(p)
        if used + n > room:
            return "".join(out), True
        out.append(p)
        used += n
    return "".join(out), False


def cut_end(text: str, limit: int, count=count_tokens) -> str:
    """Leading words that fit, then dots."""
    words, room = text.split(), max(0, limit - count(DOTS))
    out = _fill((w + " " for w in words), room, count)[0] + DOTS
    if count(out) > limit:
        out = out[: max(0, min((limit - count(DOTS)) * 4, len(out) - 1))] + DOTS
        if count(out) > limit:
            out = " ".join(words[: limit // 2]) + DOTS
    return out


def cut_start(text: str, limit: int, count=count_tokens) -> str:
    """Dots, then the trailing words that fit."""
    if count(text) <= limit:
        return text
    kept, used = [], count(DOTS)
    for w in reversed(text.split()):
        n = count(" " + w)
        if used + n > limit:
            break
        kept.append(w)
        used += n
    out = " ".join([DOTS, *reversed(kept)])
    if count(out) > limit:
        out = " ".join([DOTS, *out.split()[: max(limit // 2, 3)]])
    return out


def outline(text: str, limit: int, count=count_tokens) -> str:
    """Name, three categories and the first sentence."""
    out = f"Service: {_section(_NAME, text)}\n\n"
    if names := _section(_CATEGORIES, text):
        items = names.split(", ")
        out += f"Categories: {', '.join(items[:3]) + DOTS if len(items) > 3 else names}\n\n"
    if limit - count(out) > 20 and (sentence := _section(_FIRST_SENTENCE, text)):
        out += f"Description: {sentence}.\n\n"
    return cut_end(out, limit, count) if count(out) > limit else out


def _description_that_fits(text: str, room: int, count) -> tuple[str, bool]:
    """Whole sentences, then clauses, then words of the first sentence that doesn't fit."""
    out, used = "", 0
    for sentence in filter(None, (s.strip() for s in _SENTENCE_END.split(text))):
        n = count(sentence + ". ")
        if used + n <= room:
            out += sentence + ". "
            used += n
            continue
        if room <= used + 5:
            return out, False
        added = False
        for clause in (c for c in _COMMA.split(sentence) if c.strip()):
            n = count(clause.strip() + ", ")
            if used + n <= room - 3:
                out += clause.strip() + ", "
                used += n
                added = True
                continue
            words = _fill((w + " " for w in clause.split()), room - 3 - used, count)[0]
            out += words
            added = added or bool(words)
            break
        return out + DOTS * added, added
    return out, False


def cut_by_value(text: str, limit: int, count=count_tokens) -> str:
    """Sections in order of value: name, categories, description, url, the shortest three other sections."""
    room = max(0, limit - count(DOTS))
    out, cut = f"Service: {_section(_NAME, text)}\n\n", False
    used = count(out)
    if names := _section(_CATEGORIES, text):
        whole, left = f"Categories: {names}\n\n", room - used - count("Categories: ") - 3
        if used + count(whole) <= room:
            out, used = out + whole, used + count(whole)
        elif left > 10:
            items = names.split(", ")
            some, missing = _fill([*(i + ", " for i in items[:-1]), items[-1]], left, count)
            cut = cut or missing
            if some:
                out, used = out + f"Categories: {some}{DOTS}\n\n", used + count(f"Categories: {some}{DOTS}\n\n")
    if about := _section(_DESCRIPTION, text):
        whole, left = f"Description: {about}\n\n", room - used - count("Description: ") - 3
        if used + count(whole) <= room:
            out, used = out + whole, used + count(whole)
        elif left > 10:
            some, missing = _description_that_fits(about, left, count)
            cut = cut or missing
            if some:
                out += f"Description: {some}\n\n"
                used = count(out)
    if (link := _section(_URL, text)) and used + count(f"URL: {link}\n\n") <= room:
        out, used = out + f"URL: {link}\n\n", used + count(f"URL: {link}\n\n")
    others = [(a.strip(), b.strip()) for a, b in _SECTION.findall(text) if a.strip() != "Categories"]
    for title, body in sorted(others, key=lambda s: len(s[1].encode()))[:3]:
        whole = f"{title}: {body}\n"
        if used + count(whole) <= room:
            out, used = out + whole, used + count(whole)
            continue
        left = room - used - count(f"{title}: ") - 3
        if left > 5:
            some, missing = _fill((w + " " for w in body.split()), left - 3, count)
            cut = cut or missing
            if some:
                out += f"{title}: {some}{DOTS}\n"
        break
    if cut and DOTS not in out:
        out += DOTS
    return cut_end(text, limit, count) if count(out) > limit else out


def shorten(text: str | None, strategy: str = "intelligent", limit: int = MAX_TOKENS, count=count_tokens) -> str | None:
    """A text of at most ``limit`` tokens by a strategy; unknown strategies cut the end."""
    if text is None:
        return None
    n = count(text)
    if n <= limit:
        return text
    if n > OUTLINE_FROM * limit:
        return outline(text, limit, count)
    if strategy in ("intelligent", "sliding_window"):
        return cut_by_value(text, limit, count)
    return cut_start(text, limit, count) if strategy == "end_only" else cut_end(text, limit, count)


@functools.lru_cache(maxsize=16)
def _shorten(strategy: str, limit: int):
    @F.pandas_udf("string")
    def udf(text: pd.Series) -> pd.Series:
        return pd.Series([shorten(t, strategy, limit) for t in text], dtype=object)

    return udf


#: Everything that ends a word when a text is split at blanks.
_BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def shortened(text: Column, strategy: str = "intelligent", limit: int = MAX_TOKENS) -> Column:
    """Texts cut to ``limit`` tokens. Those that can't have more, by their blanks and bytes, never leave the JVM."""
    words = 1 + F.length(text) - F.length(F.regexp_replace(text, _BLANK, ""))
    fits = words + F.floor(F.octet_length(text) / 4) <= limit
    return F.when(fits, text).otherwise(_shorten(strategy, limit)(F.when(~fits, text)))
