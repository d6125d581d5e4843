"""Whitespace with the Unicode meaning: 29 code points, ZWNJ not among them.

Java's plain ``\\s`` knows six of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace code points.
_CODE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE_CHARS = "".join(map(chr, _CODE_POINTS))

# Runs of the same set. With (?U), \s looks up the Unicode category, several times faster than a class that lists the
# ranges (and than one that leaves out lone spaces); the four separators 1C-1F are not in it.
RUN = r"(?U)[\s\x1C-\x1F]+"


def strip(text: Column) -> Column:
    """Drop whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    """Turn each run of whitespace into one space, then strip."""
    return F.btrim(F.regexp_replace(text, RUN, " "))


def normalize_entity(text: Column) -> Column:
    """Entity text as the rules see it: null is empty, whitespace collapsed."""
    return collapse_whitespace(F.coalesce(text, F.lit("")))
