"""Counts and ratios over entity text that has been through ``normalize_entity``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nomenroll import constants as K


def _one_of(characters: str) -> str:
    """Character class of these characters, none of them special inside it."""
    return "[" + "".join(f"\\{c}" if c in "\\[]^-&" else c for c in characters) + "]"


def _occurrences(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(_one_of(characters)))


def dense_length(text: Column) -> Column:
    """Characters apart from the ordinary space."""
    return F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def token_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.char_length(text) - dense_length(text) + 1)


def separator_count(text: Column) -> Column:
    return _occurrences(text, K.LIST_SEPARATORS)


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9۰-۹]"))


def non_digit_count(text: Column) -> Column:
    return F.char_length(text) - digit_count(text)


def punct_ratio(text: Column) -> Column:
    """Share of punctuation among all characters; 0 for empty text."""
    return F.when(text == "", 0.0).otherwise(_occurrences(text, K.PUNCTUATION) / F.char_length(text))


def distinct_ratio(text: Column) -> Column:
    """Distinct characters over all characters, ordinary spaces apart; 0 for empty text."""
    dense = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(dense == "", 0.0).otherwise(
        F.size(F.array_distinct(F.split(dense, ""))) / F.char_length(dense)
    )


def padded(text: Column) -> Column:
    """The text with a space at each end, so that a connector is found there, too."""
    return F.concat(F.lit(" "), text, F.lit(" "))


def connector_hits(padded_text: Column, connectors: tuple[str, ...]) -> Column:
    """How many different connectors occur."""
    return reduce(lambda a, b: a + b, [padded_text.contains(c).cast("int") for c in connectors], F.lit(0))


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes], F.lit(False))


def first_token(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def last_token(text: Column) -> Column:
    return F.substring_index(text, " ", -1)


def is_year(text: Column) -> Column:
    return text.rlike(K.YEAR_PATTERN)
