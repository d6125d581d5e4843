"""Names, word lists and limits that results must agree on."""

from __future__ import annotations

# --- Fixed values: entity classes, their inventory names and column names -------------------
ENTITY_CLASSES = ("PER", "LOC", "ORG", "FAC", "PRO", "EVENT")

INVENTORY_NAMES = {
    "PER": "pers",
    "LOC": "loc",
    "ORG": "org",
    "FAC": "fac",
    "PRO": "pro",
    "EVENT": "event",
}

INVENTORY_COLUMNS = {
    "PER": "pers_entities",
    "LOC": "loc_entities",
    "ORG": "org_entities",
    "FAC": "fac_entities",
    "PRO": "pro_entities",
    "EVENT": "event_entities",
}

# --- Fixed values: rule words ---------------------------------------------------------------
LIST_CONNECTORS = (" و ", " یا ", " & ", " and ", " or ")
LIST_SEPARATORS = "،,/|"
GENERIC_NOUNS = (
    "شهر",
    "استان",
    "کشور",
    "منطقه",
    "روستا",
    "بندر",
    "فرودگاه",
    "دانشگاه",
    "سازمان",
    "شرکت",
)
DIRECTIONS = ("شمال", "جنوب", "شرق", "غرب")
CITY_NOUN = "شهر"
REGION_NOUNS = ("شهر", "استان")
PRONOUNS = ("او", "این")

# --- Fixed values: characters ---------------------------------------------------------------
ASCII_DIGITS = "0123456789"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
PUNCTUATION = ".,;:!?-()[]{}«»\"'…ـ،"
YEAR_PATTERN = "^(?:[12][0-9]{3}|[۱۲][۰-۹]{3})$"

# --- Fixed values: report sizes -------------------------------------------------------------
EXAMPLES_PER_RULE = 8
TOP_ENTITIES = 30
