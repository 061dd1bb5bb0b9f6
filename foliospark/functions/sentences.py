"""Sentence splitting by regular expression for Korean, Japanese and English; other languages take the Korean way."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import strip

# End marks of the Korean and Japanese patterns, and English abbreviations that end no sentence.
KOREAN = r"""([^.?!~。？！]+[.?!~。？！]+(?:\s*['"」』]*)?)"""
JAPANESE = r"([^。？！．]+[。？！．]*)"
ENGLISH_ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "vs", "etc", "e.g", "i.e", "cf", "al", "et", "fig", "eq", "no", "vol", "pp", "ch", "sec",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "am", "pm", "a.m", "p.m",
)


def _pieces(c: Column, pattern: str) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), strip), lambda x: F.length(x) > 0)
    return F.when(F.size(found) > 0, found).when(F.length(strip(c)) > 0, F.array(strip(c))).otherwise(F.array().cast("array<string>"))


def korean(c: Column, keep_tail: bool = True) -> Column:
    """Pieces up to end marks; a rest without one is kept unless ``keep_tail`` is false."""
    found = _pieces(c, KOREAN)
    if not keep_tail:
        return found
    tail = strip(F.regexp_extract(c, r"[.?!~。？！](?:\s*['\"」』]*)?([^.?!~。？！]*)\z", 1))
    return F.when(F.length(tail) > 0, F.concat(found, F.array(tail))).otherwise(found)


def japanese(c: Column) -> Column:
    return _pieces(c, JAPANESE)


def english(c: Column) -> Column:
    """Split after end marks and white space, not after an abbreviation; a fold that joins pieces to the next."""
    parts = F.split(F.regexp_replace(c, r"([.?!]+)(\s+|\z)", "$1$2\x00"), "\x00")
    abbreviations = F.array(*[F.lit(x) for x in ENGLISH_ABBREVIATIONS])
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        text = F.concat(acc["open"], part)
        last = F.regexp_replace(F.lower(F.regexp_extract(strip(text), r"(\S+)\z", 1)), r"[.!?]+\z", "")
        joined = F.array_contains(abbreviations, last) | (F.length(strip(text)) == 0)
        return F.struct(
            F.when(joined, acc["done"]).otherwise(F.concat(acc["done"], F.array(strip(text)))).alias("done"),
            F.when(joined, text).otherwise(F.lit("")).alias("open"),
        )

    def finish(acc: Column) -> Column:
        rest = strip(acc["open"])
        return F.when(F.length(rest) > 0, F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    return F.aggregate(parts, start, step, finish)


Splitter = Callable[[Column], Column]


def split_sentences(c: Column, language: Column, keep_tail: bool = True, splitters: dict[str, Splitter] | None = None) -> Column:
    """Sentences by language; blank or null text gives an empty array.

    ``splitters`` adds or replaces the way of a language, named by its first two letters.
    """
    base = F.lower(F.substring(F.coalesce(language, F.lit("ko")), 1, 2))
    split = korean(c, keep_tail)
    for name, way in ({"en": english, "ja": japanese} | (splitters or {})).items():
        split = F.when(base == name, way(c)).otherwise(split)
    return F.when(F.length(strip(c)) > 0, split).otherwise(F.array().cast("array<string>"))


def split_plain(text: str, language: str | None) -> list[str]:
    """The same in Python, for small values on the driver and for tests."""
    if not text or not text.strip():
        return []
    if language == "en":
        out, start = [], 0
        for m in re.finditer(r"[.?!]+(?:\s+|$)", text):
            piece = text[start : m.end()].strip()
            if piece and piece.split()[-1].lower().rstrip(".!?") not in ENGLISH_ABBREVIATIONS:
                out.append(piece)
                start = m.end()
        return out + [x for x in [text[start:].strip()] if x]
    found = [x.strip() for x in re.findall(JAPANESE if language == "ja" else KOREAN, text) if x.strip()]
    return found or [text.strip()]
