"""Visible text of HTML, without a parser.

One left-to-right pass removes all markup: because the alternatives compete at each position, a
``<!--`` inside a script or a tag inside a comment is never read as markup of its own. No separator
is put where a tag was. Character references are then decoded once, so ``&amp;lt;`` gives ``&lt;``.

Well-formed markup gives what a parser gives. For broken markup: an unclosed comment, script, style
template, CDATA section or ruby text runs to the end; a ``<`` that opens no tag stays text; from an unclosed tag on,
everything stays text.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hidden(element: str) -> str:
    return rf"{element}(?:[\s/][^>]*+)?>.*?(?:</{element}[^>]*+(?:>|\z)|\z)"


# Everything that is not text. CDATA is: its content is the first group. Each alternative that looks for its end runs to
# the end of the text if there is none; what is left open there is text again, as the second group. So no part of a
# text is searched again and again, however broken it is.
MARKUP = (
    r"(?is)<(?:"
    r"!--.*?(?:-->|\z)"
    rf"|{_hidden('script')}|{_hidden('style')}|{_hidden('template')}"
    r"|(?:rt|rp)(?:[\s/][^>]*+)?>.*?(?:</(?:rt|rp)[^>]*+(?:>|\z)|(?=<(?:rt|rp)[\s/>])|(?=</ruby)|\z)"
    r"|!\[CDATA\[(.*?)(?:\]\]>|\z)"
    r"|[!?/][^>]*+>"
    r"|[a-z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
    r")|(<[a-z!?/].*\z)"
)

REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?"

# Names that make up nearly all references; they skip the search through the whole table.
_FREQUENT = {"amp": "&", "nbsp": "\u00a0", "quot": '"', "lt": "<", "gt": ">", "apos": "'", "zwnj": "\u200c"}
_PAIR, _BIND = "\u0001", "\u0002"


def _named_table() -> Column:
    """All HTML 5 names as one folded map literal, taken from the standard library."""
    entries = (f"{name[:-1]}{_BIND}{text}" for name, text in sorted(html5.items()) if name.endswith(";"))
    return F.str_to_map(F.lit(_PAIR.join(entries)), F.lit(_PAIR), F.lit(_BIND))


def _windows_1252() -> tuple[str, str]:
    """Numbers 128-159 mean Windows-1252 characters, where that set has one."""
    controls = [chr(n) for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return "".join(controls), "".join(controls).encode("latin-1").decode("cp1252")


def _code_point(number: Column) -> Column:
    """Character of a code point; U+FFFD where there is none. Null counts as none."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(valid, F.translate(character, *_windows_1252())).otherwise("\ufffd")


def _decode_reference(reference: Column) -> Column:
    body = F.rtrim(F.substring(reference, 2, 1 << 30), F.lit(";"))
    hexadecimal = F.ltrim(F.substring(body, 3, 1 << 30), F.lit("0"))
    decimal = F.ltrim(F.substring(body, 2, 1 << 30), F.lit("0"))
    from_hex = F.when(F.char_length(hexadecimal) <= 6, F.conv(hexadecimal, 16, 10).cast("bigint"))
    from_decimal = F.when((F.char_length(decimal) <= 7) & (decimal != ""), decimal.cast("bigint"))
    decoded = F.when(body.startswith("#x") | body.startswith("#X"), _code_point(from_hex)).when(
        body.startswith("#"), _code_point(from_decimal)
    )
    for name, text in _FREQUENT.items():
        decoded = decoded.when(body == name, F.lit(text))
    return decoded.otherwise(F.coalesce(F.element_at(_named_table(), body), reference))


def strip_markup(html: Column) -> Column:
    return F.regexp_replace(html, F.lit(MARKUP), F.lit("$1$2"))


def decode_references(text: Column) -> Column:
    """Named, decimal and hexadecimal references to characters; unknown ones stay as they are."""
    decoded = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _decode_reference)
    between = F.split(text, REFERENCE, -1)
    joined = F.array_join(F.zip_with(between, decoded, lambda gap, char: F.concat(gap, F.coalesce(char, F.lit("")))), "")
    return F.when(F.instr(text, "&") > 0, joined).otherwise(text)


def strip_html(html: Column) -> Column:
    """Visible text of ``html``; null is empty."""
    return decode_references(strip_markup(F.coalesce(html, F.lit(""))))
