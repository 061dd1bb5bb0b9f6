"""Text functions as Spark columns: cleaning, counting, tables, locations, citations, screening."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that str.strip() removes, as one character class for Java and RE2.
SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Control and zero-width characters that cleaning drops.
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{200B}\x{200C}\x{200D}\x{FEFF}]"
# The screening patterns for instructions hidden in a question.
INJECTION_PATTERNS = [
    r"(?i)ignore\s+(all\s+|previous\s+|above\s+)?(instructions|rules|system|prompts)",
    r"(?i)disregard\s+(all\s+|previous\s+|above\s+)?(instructions|rules|system)",
    r"(?i)forget\s+(all\s+|everything\s+|previous\s+)?(instructions|rules)",
    r"(?i)system\s+override",
    r"(?i)you\s+are\s+now\s+(DAN|jailbroken|unrestricted|free)",
    r"(?i)developer\s+mode\s+(on|enabled)",
    r"(?i)bypass\s+(safety|security|filter|guardrails)",
    r"(?i)output\s+the\s+system\s+prompt",
    r"(?i)reveal\s+your\s+(initial\s+)?instructions",
    r"\[SYSTEM\]",
    r"\[SYSTEM_PROMPT\]",
    r"(?i)<\|im_start\|>\s*system",
    r"(?i)<\|system\|>",
]


def strip(c: Column) -> Column:
    """Without white space at either end, in Python's sense."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def is_blank(c: Column) -> Column:
    """Null or white space only."""
    return c.isNull() | (F.length(strip(c)) == 0)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composition NFC; null stays null."""
    return texts.str.normalize("NFC")


def clean_line_ends(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normalize_text(c: Column) -> Column:
    """Line ends, NFC, control characters, runs of blanks, line trimming, runs of empty lines, ends; in this order."""
    c = F.regexp_replace(nfc(clean_line_ends(c)), CONTROL, "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?md)^[ \t]+|[ \t]+$", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def token_count(c: Column) -> Column:
    """Approximate tokens: Hangul syllables / 1.3 plus other characters / 4, cut to an integer; null counts 0."""
    hangul = F.length(F.regexp_replace(c, "[^가-힣]", ""))
    return F.coalesce((hangul / F.lit(1.3) + (F.length(c) - hangul) / F.lit(4.0)).cast("int"), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Non-blank parts between empty lines, trimmed."""
    return F.filter(F.transform(F.split(clean_line_ends(c), "\n\n"), strip), lambda p: F.length(p) > 0)


def linearize_table(c: Column) -> Column:
    """A pipe table as ``[Header] a | b`` and ``[Row n] c | d`` lines.

    Unchanged: text that has such marks already, fewer than two non-blank lines, or no pipe in the first.
    """
    lines = F.filter(F.transform(F.split(strip(c), r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), strip), lambda x: F.length(x) > 0)

    def cells(line: Column) -> Column:
        return F.array_join(F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: F.length(x) > 0), " | ")

    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.rlike(f"^[|{SPACE}:\\-]+$"))
    rows = F.transform(body, lambda x, i: F.concat(F.lit("[Row "), (i + 1).cast("string"), F.lit("] "), cells(x)))
    made = F.array_join(F.concat(F.array(F.concat(F.lit("[Header] "), cells(F.get(lines, F.lit(0))))), rows), "\n")
    marked = c.contains("[Header]") | c.contains("[Row")
    return F.when(~marked & (F.size(lines) > 1) & F.get(lines, F.lit(0)).contains("|"), made).otherwise(c)


def injection_matches(c: Column, extra: list[str] | None = None) -> Column:
    """The screening patterns found in the text, as an array; null gives an empty one."""
    patterns = F.array(*[F.lit(p) for p in INJECTION_PATTERNS + (extra or [])])
    return F.filter(patterns, lambda p: F.coalesce(F.regexp(c, p), F.lit(False)))


def hit_location(file_name: Column, page: Column, sheet: Column, slide: Column, section: Column) -> Column:
    """File, then the first known of page, sheet and slide, then the section; joined by `` | ``."""
    place = (
        F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string")))
        .when(sheet.isNotNull(), F.concat(F.lit("sheet "), sheet))
        .when(slide.isNotNull(), F.concat(F.lit("slide "), slide.cast("string")))
    )
    return F.concat_ws(" | ", file_name, place, section)


def block_location(page: Column, sheet: Column, slide: Column, section_path: Column) -> Column:
    """Page, sheet, slide and section path, as far as known; else ``unknown``."""
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("page "), page.cast("string")),
        F.concat(F.lit("sheet "), sheet),
        F.concat(F.lit("slide "), slide.cast("string")),
        F.when(F.size(section_path) > 0, F.array_join(section_path, " > ")),
    )
    return F.when(parts == "", "unknown").otherwise(parts)


def citation_location(page: Column, sheet: Column, slide: Column) -> Column:
    """Page, sheet and slide for a reader, as far as known; an empty sheet name is unknown."""
    parts = F.concat_ws(
        ", ",
        F.concat(page.cast("string"), F.lit("페이지")),
        F.when(sheet != "", F.concat(sheet, F.lit(" 시트"))),
        F.concat(slide.cast("string"), F.lit(" 슬라이드")),
    )
    return F.when(parts == "", "위치 정보 없음").otherwise(parts)


def citation_line(mark: Column, path: Column, file_name: Column, location: Column, section: Column) -> Column:
    """``[S1] file (location), "section"``; the file's name is taken from the path if not given, a plain body is no section."""
    name = F.coalesce(F.when(file_name != "", file_name), F.element_at(F.split(path, "/"), -1), F.lit(""))
    title = F.when(F.coalesce(section, F.lit("")).isin("", "본문"), "").otherwise(F.concat(F.lit(', "'), section, F.lit('"')))
    return F.concat(F.lit("["), mark, F.lit("] "), name, F.lit(" ("), location, F.lit(")"), title)


def joined_text(texts: Column) -> Column:
    """The full text of a document from the array of its texts: those that are not blank, with an empty line between."""
    return F.array_join(F.filter(texts, lambda t: ~is_blank(t)), "\n\n")


def normalize_extension(c: Column) -> Column:
    """Lower case with a leading dot."""
    return F.when(F.startswith(c, F.lit(".")), F.lower(c)).otherwise(F.concat(F.lit("."), F.lower(c)))


def is_score(c: Column) -> Column:
    """Whether a score lies between 0 and 1; null, a score not given, does."""
    return F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(True))


def map_with(m: Column, added: Column) -> Column:
    """A map with the entries of another, which win; null maps are empty."""
    m, added = F.coalesce(m, F.create_map().cast("map<string,string>")), F.coalesce(added, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(added, k)), added)


def map_value(m: Column, key: str, default: str | None = None) -> Column:
    """The value of a key, or the default where the map, the key or the value is missing."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def citations(c: Column) -> Column:
    """Distinct ``Sn`` marks of an answer in the order they appear."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: F.concat(F.lit("S"), x)))


def without_citations(c: Column, invalid: Column) -> Column:
    """The text without the marks in ``invalid``; blanks around them stay."""
    return F.aggregate(invalid, c, lambda acc, x: F.replace(acc, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))


def word_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the sets of lower-cased words; two empty sets give 1, one empty set 0."""

    def words(c: Column) -> Column:
        return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), f"[{SPACE}]+")), lambda x: x != "")

    x, y = words(a), words(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / both)
