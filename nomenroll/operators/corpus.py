"""The corpus contract: ``title``, ``content``, ``link`` plus the caller's key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenroll.functions.html import strip_html
from nomenroll.functions.persian import NormalizeConfig, normalize_fa
from nomenroll.operators.selection import comparable, nth_smallest

TEXT_FIELDS = {"title": ("title",), "content": ("content",), "both": ("title", "content")}


def fields_of(text_field: str) -> tuple[str, ...]:
    if text_field not in TEXT_FIELDS:
        raise ValueError(f"text_field must be one of {sorted(TEXT_FIELDS)}, not {text_field!r}")
    return TEXT_FIELDS[text_field]


def standardize(
    df: DataFrame,
    title: str = "title",
    content: str = "content",
    link: str = "link",
    key: Sequence[str] = (),
    null_text: str = "",
) -> DataFrame:
    """Map the caller's columns to the contract; a missing link is empty, nulls are ``null_text``.

    Only key and contract columns are kept, so a scan below reads nothing else.
    """
    missing = [c for c in (title, content, *key) if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; available: {df.columns[:20]}")

    def as_text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(null_text))

    return df.select(
        *key,
        as_text(title).alias("title"),
        as_text(content).alias("content"),
        (as_text(link) if link in df.columns else F.lit("")).alias("link"),
    )


def clean_text(df: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """Add ``norm_title`` and ``norm_content``: markup out, then Persian normalization.

    Unused ones cost nothing, the optimizer drops them.
    """
    return df.withColumns(
        {f"norm_{field}": normalize_fa(strip_html(F.col(field)), config) for field in ("title", "content")}
    )


def after_key(df: DataFrame, key: str, last) -> DataFrame:
    """Rows after the last finished key; the comparison reaches the scan."""
    return df.filter(F.col(key) > F.lit(last))


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest (unique) keys; none for ``n`` of zero or less, and no row without a key.

    The n-th key is found by counting, so no row is sorted or moved, whatever ``n`` is; rows are then compared with it.
    """
    cutoff = nth_smallest(df, key, n) if n > 0 else None
    return df.filter(F.lit(False) if cutoff is None else comparable(df, key) <= F.lit(cutoff))
