"""Postal addresses, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import constants as K


def full_address(address_1: Column, address_2: Column, city: Column, state: Column, postal_code: Column, country: Column) -> Column:
    """``a1[, a2], city, state zip, country``, parts trimmed; a missing part leaves an empty one."""
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    second = F.when(part(address_2) != "", F.concat(F.lit(", "), part(address_2))).otherwise("")
    return F.concat(part(address_1), second, F.lit(", "), part(city), F.lit(", "), part(state), F.lit(" "), part(postal_code), F.lit(", "), part(country))


def normalize_address(address: Column, glue: bool = False) -> Column:
    """Lower case words without punctuation, street words spelt out, units gone.

    Street words are replaced between two spaces only. A unit word goes with the
    word after it. What is left is joined by a space; ``glue`` joins without
    one and lets unit words match inside other words.
    """
    a = F.regexp_replace(F.lower(address), r"[^\p{L}\p{N}\s#]", "")
    for short, long in K.STREET_WORDS:
        a = F.replace(a, F.lit(f" {short} "), F.lit(f" {long} "))
    a = F.regexp_replace(a, r"\s*#\s[\p{L}\p{N}]\S*\s*", "" if glue else " ")
    for word in K.UNIT_WORDS:
        opening = "#+" if word == "#" else f"{re.escape(word)} "
        edge = "" if glue or word == "#" else r"(?<!\S)"
        a = F.regexp_replace(a, rf"\s*{edge}{opening}\S*\s*", "" if glue else " ")
    return F.trim(F.regexp_replace(a, r"\s+", " "))


def extract_unit(address: Column, anywhere: bool = False) -> Column:
    """The unit part, from the first unit word of the list that occurs up to a comma, a semicolon or the next word's end.

    Unit words are whole words before one with a digit; with ``anywhere`` they
    may stand anywhere, even inside another word.
    """
    a = F.lower(address)
    found = []
    for word in K.UNIT_PATTERNS:
        start = re.escape(word) if anywhere or word == "#" else rf"\b{word}(?=\s+\S*\d)"
        to_mark, one_word = F.regexp_extract(a, rf"({start}[^,;]*)[,;]", 1), F.regexp_extract(a, rf"({start}\S*(?:\s+\S+)?)", 1)
        if anywhere:
            one_word = F.regexp_extract(a, rf"({start}\S*)", 1)
        unit = F.trim(F.when(to_mark != "", to_mark).otherwise(one_word))
        found.append(F.when(unit != "", unit))
    return F.coalesce(*found, F.lit(""))


def address_confidence(unit_1: Column, unit_2: Column) -> Column:
    """0.95, less where two units are given and differ."""
    return F.when((unit_1 != "") & (unit_2 != "") & (unit_1 != unit_2), 0.95 * 0.85).otherwise(0.95)
