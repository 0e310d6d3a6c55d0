"""Character classes as Java regular expressions, and line and strip functions as Columns, with Python's semantics.

Java's own \\s and \\R differ from Python's isspace and splitlines in a few characters, so the sets are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, and those that end a line.
SPACE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
#: Ranges of CJK ideographs and Hangul.
HANGUL = "\\x{ac00}-\\x{d7a3}\\x{1100}-\\x{11ff}"
CJK = "\\x{4e00}-\\x{9fff}" + HANGUL
ALNUM = "\\p{L}\\p{N}"
#: Digits besides decimal ones for which Python's isdigit holds: superscripts, subscripts, circled and similar.
DIGIT = "\\p{Nd}\\x{b2}\\x{b3}\\x{b9}\\x{1369}-\\x{1371}\\x{19da}\\x{2070}\\x{2074}-\\x{2079}\\x{2080}-\\x{2089}\\x{2460}-\\x{2468}\\x{2474}-\\x{247c}\\x{2488}-\\x{2490}\\x{24ea}\\x{24f5}-\\x{24fd}\\x{24ff}\\x{2776}-\\x{277e}\\x{2780}-\\x{2788}\\x{278a}-\\x{2792}\\x{10a40}-\\x{10a43}\\x{10e60}-\\x{10e68}\\x{11052}-\\x{1105a}\\x{1f100}-\\x{1f10a}"
LATIN = "A-Za-z\\x{130}\\x{212a}"
HIDDEN = "[\\p{C}\\p{Z}&&[^ ]]"


def count(text: Column, inside: str) -> Column:
    """The number of characters of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{inside}]", ""))


def visible(text: Column) -> Column:
    return F.length(text) - count(text, SPACE)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$(?![\\s\\S])", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]++(?![\\s\\S])", "")


def splitlines(text: Column) -> Column:
    """Lines without their ends; an end after the last line adds none, and an empty text has none."""
    parts = F.split(text, LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_cjk_or_digit(text: Column) -> Column:
    """Every character is CJK, Hangul or a digit (so is every character of an empty text)."""
    return F.regexp_replace(text, f"[{CJK}{DIGIT}]", "") == ""
