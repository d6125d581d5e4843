"""Composite order keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed_order(*parts: tuple[Column, int]) -> Column:
    """One decimal that sorts like the tuple of its parts.

    Each part is an integer column with the number of digits it may have; all but the first must not
    be negative, and all digits together are at most 38. A minimum over a decimal is kept in place by
    a hash aggregate, while one over a struct has the rows sorted first.
    """
    total = sum(digits for _, digits in parts)
    if total > 38:
        raise ValueError(f"{total} digits don't fit into a decimal")
    below = total
    packed = None
    for column, digits in parts:
        below -= digits
        shifted = column.cast("decimal(38,0)") * F.lit("1" + "0" * below).cast("decimal(38,0)")
        packed = shifted if packed is None else packed + shifted
    return packed.cast("decimal(38,0)")
