"""Entity spans: ``array<struct<text, type, start_char, end_char>>``, offsets in code points.

Folds over an array close a block every ``_BLOCK`` elements and flatten at the end: appending to one
long array copies it each time, which would be quadratic in the number of spans of a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def span_type(offset: T.DataType) -> T.StructType:
    """A span with offsets of a type: INTEGER will do for any text in one row, a text in pieces may need BIGINT."""
    return T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("start_char", offset),
            T.StructField("end_char", offset),
        ]
    )


SPAN_TYPE = span_type(T.IntegerType())
SPANS_TYPE = T.ArrayType(SPAN_TYPE)
_BLOCK = 256
MARK = "\x01"


def span(text: Column, kind: Column, start: Column, end: Column, offset: T.DataType = T.IntegerType()) -> Column:
    return F.struct(
        text.cast("string").alias("text"),
        kind.cast("string").alias("type"),
        start.cast(offset).alias("start_char"),
        end.cast(offset).alias("end_char"),
    )


def no_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def fold_to_array(items: Column, state, step, item_type: str) -> Column:
    """Fold ``items`` with a one-value state, emitting zero or one element per item.

    ``step(state, item)`` gives ``(new_state, element)``; a null element emits nothing.
    """
    empty = F.array().cast(f"array<{item_type}>")
    start = F.struct(
        state.alias("state"),
        F.array().cast(f"array<array<{item_type}>>").alias("closed"),
        empty.alias("open"),
    )

    def merge(acc: Column, item: Column) -> Column:
        new_state, element = step(acc["state"], item)
        full = F.size(acc["open"]) >= _BLOCK
        skip = element.isNull()
        return F.struct(
            new_state.alias("state"),
            F.when(full & ~skip, F.array_append(acc["closed"], acc["open"])).otherwise(acc["closed"]).alias("closed"),
            F.when(skip, acc["open"])
            .when(full, F.array(element))
            .otherwise(F.array_append(acc["open"], element))
            .alias("open"),
        )

    return F.aggregate(items, start, merge, lambda acc: F.flatten(F.array_append(acc["closed"], acc["open"])))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an integer array.

    Appending copies what is there, so sums are made in blocks: the cube root of twice the length makes the copies
    within blocks and of blocks as cheap as they get, some four per element for a thousand, twenty for a million.
    """

    def append(sums: Column, number: Column) -> Column:
        return F.array_append(sums, F.element_at(sums, -1) + number)

    def blocks(bound: Column) -> Column:
        # each block starts with the last sum of the block before it
        length = F.greatest(F.size(bound), F.lit(1))
        return let(
            F.greatest(F.lit(8), F.ceil(F.cbrt(length * 2)).cast("int")),
            lambda size: F.aggregate(
                F.sequence(F.lit(1), length, size),
                F.array(F.array(F.lit(0))),
                lambda done, cut: F.array_append(
                    done,
                    F.aggregate(F.slice(bound, cut, size), F.array(F.element_at(F.element_at(done, -1), -1)), append),
                ),
            ),
        )

    return F.flatten(F.transform(let(numbers, blocks), lambda block: F.slice(block, 2, 1 << 30)))


def pattern_spans(text: Column, pattern: str, kind: str) -> Column:
    """Spans of one pattern, left to right, from one pass over the text.

    Each match is put between two marks, so that a split gives gaps and matches in turn; positions add up the lengths
    before them. Where the text holds the mark itself, gaps and matches are looked for apart. The pattern must not
    match empty text.
    """

    def from_pieces(pieces: Column) -> Column:
        # gap and match number i are pieces 2 i and 2 i + 1
        numbers = F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int") - 1)
        piece = lambda i: F.char_length(F.get(pieces, i))
        ends = running_sums(F.transform(numbers, lambda i: piece(i * 2) + piece(i * 2 + 1)))

        def placed(end: Column, i: Column) -> Column:
            match = F.get(pieces, i * 2 + 1)
            return span(match, F.lit(kind), end - F.char_length(match), end)

        return F.when(F.size(pieces) > 1, F.transform(ends, placed)).otherwise(no_spans())

    def pieces_apart(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)  # one more than matches
        pairs = F.zip_with(gaps, matches, lambda gap, m: F.when(m.isNull(), F.array(gap)).otherwise(F.array(gap, m)))
        return F.when(F.size(matches) > 0, F.flatten(pairs)).otherwise(F.array(text))

    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    apart = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pieces_apart)
    return let(F.when(F.contains(text, F.lit(MARK)), apart).otherwise(marked), from_pieces)


def entities_json(spans: Column) -> Column:
    """Spans as JSON text: non-ASCII kept, keys in the order of the type, ``[]`` for none."""
    return F.coalesce(F.to_json(spans), F.lit("[]"))


def parse_entities(json: Column) -> Column:
    """The inverse of ``entities_json``."""
    return F.coalesce(F.from_json(json, SPANS_TYPE), no_spans())
