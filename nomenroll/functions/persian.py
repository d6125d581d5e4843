"""Persian text normalization: eight switches, each a stage of its own.

The order of stages is fixed: single characters first (one ``translate``), then the patterns that
look at neighbours, then runs of spaces. Offsets of all annotations count in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from nomenroll import constants as K
from nomenroll.functions.spans import let
from nomenroll.functions.whitespace import collapse_whitespace

# --- Fixed values: characters and patterns of the stages --------------------------------------
ZWNJ = "\u200c"
TATWEEL = "\u0640"
LETTER_FORMS = ("يىك“”„‟", 'ییک""""')
NUMBER_FORMS = (K.ASCII_DIGITS + K.ARABIC_DIGITS + "%", K.PERSIAN_DIGITS + K.PERSIAN_DIGITS + "٪")
DIACRITICS = "".join(map(chr, range(0x064B, 0x0653))) + "\u0670"
ORNAMENTS = r"[\x{0610}-\x{061A}\x{06D6}-\x{06ED}\x{FD3E}\x{FD3F}\x{FDF0}-\x{FDFD}]"
DIGITS = "0-9۰-۹"
CLOSING = r".:!،؛؟»\])}"
OPENING = r"«\[({"

# Steps are (needle, pattern, replacement): where the needle does not occur, neither does the pattern,
# and a byte search is far cheaper than a regular expression. What most texts hold has no needle.
STYLE_STEPS = (
    ('"', r'"([^\n"]+)"', "«$1»"),
    ("", rf"([{DIGITS}])\.([{DIGITS}])", "$1٫$2"),
    ("...", r" ?\.\.\.", " …"),
)
SPACING_STEPS = (
    # ZWNJ beside a space or an end of the text, and all but one of a run
    (ZWNJ, rf"{ZWNJ}+(?=[ \n\t]|\z)|(?<=[ \n\t]|^){ZWNJ}+|(?<={ZWNJ}){ZWNJ}+", ""),
    # spaces before closing and after opening marks
    ("", rf" (?:(?<=[{OPENING}] ) *| *(?=[{CLOSING}]))", ""),
    # a missing space after closing and before opening marks; one too many is collapsed at the end
    (
        "",
        rf"(?=[{CLOSING}{OPENING}])(?:([.:](?=[^ \n{CLOSING}{DIGITS}])|[!،؛؟»\])}}](?=[^ \n{CLOSING}]))"
        rf"|([{OPENING}])(?<=[^ \n{OPENING}][{OPENING}]))",
        "$1 $2",
    ),
)
MI_STEP = ("", r"(^| )(ن?می) ", f"$1$2{ZWNJ}")


@dataclass(frozen=True)
class NormalizeConfig:
    """Which stages run. The names are a fixed contract."""

    correct_spacing: bool = True
    remove_diacritics: bool = True
    remove_specials_chars: bool = False
    persian_style: bool = True
    persian_numbers: bool = True
    remove_extra_spaces: bool = True
    unify_chars: bool = True
    separate_mi: bool = True


def _character_map(config: NormalizeConfig) -> tuple[str, str]:
    """Source and target characters of the one-pass stage; sources without a target are deleted."""
    source, target = "", ""
    for wanted, (old, new) in ((config.unify_chars, LETTER_FORMS), (config.persian_numbers, NUMBER_FORMS)):
        if wanted:
            source, target = source + old, target + new
    if config.remove_diacritics:
        source += DIACRITICS
    if config.correct_spacing:
        source += TATWEEL
    return source, target


def pattern_steps(config: NormalizeConfig) -> list[tuple[str, str, str]]:
    """The steps a configuration runs, in order.

    ``remove_extra_spaces`` adds none: all whitespace is collapsed at the end in any case.
    """
    steps: list[tuple[str, str, str]] = []
    if config.remove_specials_chars:
        steps.append(("", ORNAMENTS, ""))
    if config.persian_style:
        steps.extend(STYLE_STEPS)
    if config.correct_spacing:
        steps.extend(SPACING_STEPS)
    if config.separate_mi:
        steps.append(MI_STEP)
    return steps


def _replace_where(text: Column, needle: str, pattern: str, replacement: str) -> Column:
    if not needle:
        return F.regexp_replace(text, pattern, replacement)
    return let(
        text, lambda t: F.when(t.contains(needle), F.regexp_replace(t, pattern, replacement)).otherwise(t)
    )


def normalize_fa(text: Column, config: NormalizeConfig = NormalizeConfig()) -> Column:
    """Normalized Persian text with single spaces; null is empty."""
    result = F.translate(F.coalesce(text, F.lit("")), *_character_map(config))
    for needle, pattern, replacement in pattern_steps(config):
        result = _replace_where(result, needle, pattern, replacement)
    return collapse_whitespace(result)
