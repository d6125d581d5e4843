"""SHA-256 of text, bytes and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON keeps milliseconds unless told otherwise; a fingerprint has to see microseconds.
_EXACT_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def sha256_hex(content: Column) -> Column:
    """Upper-case hexadecimal SHA-256."""
    return F.upper(F.sha2(content, 256))


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the named columns; field names are part of it, so values can't run together."""
    return sha256_hex(F.to_json(F.struct(*[F.col(c) for c in columns]), _EXACT_JSON))
