"""Quality rules: each is a name, a condition on the entity text, and the classes it covers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenroll import constants as K
from nomenroll.functions import features as X
from nomenroll.functions.whitespace import normalize_entity


@dataclass(frozen=True)
class Thresholds:
    """Names and defaults of the limits. ``max_separators`` is accepted, but no rule reads it."""

    max_tokens: int = 7
    max_chars: int = 60
    max_digits_ratio: float = 0.65
    max_separators: int = 3
    max_punct_ratio: float = 0.18
    min_arabic_commas_for_list: int = 2
    min_and_connectors_for_list: int = 3
    min_non_digit_chars_when_digits_present: int = 3
    low_diversity_min_len: int = 14
    low_diversity_uniq_ratio: float = 0.25

    @classmethod
    def merged(cls, overrides: dict | None = None) -> Thresholds:
        """Defaults with some limits replaced; an unknown name is an error."""
        unknown = set(overrides or {}) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown threshold(s): {sorted(unknown)}")
        return replace(cls(), **(overrides or {}))


@dataclass(frozen=True)
class Lexicon:
    """The word lists of the rules."""

    connectors: tuple[str, ...] = K.LIST_CONNECTORS
    generic_nouns: tuple[str, ...] = K.GENERIC_NOUNS
    directions: tuple[str, ...] = K.DIRECTIONS
    city: str = K.CITY_NOUN
    regions: tuple[str, ...] = K.REGION_NOUNS
    pronouns: tuple[str, ...] = K.PRONOUNS


@dataclass(frozen=True)
class RuleSettings:
    thresholds: Thresholds = field(default_factory=Thresholds)
    lexicon: Lexicon = field(default_factory=Lexicon)


@dataclass(frozen=True)
class EntityView:
    """What a rule may look at. Each column is computed once per row, not once per rule."""

    text: Column
    padded: Column
    tokens: Column
    length: Column
    digits: Column
    dense: Column
    first: Column
    last: Column


@dataclass(frozen=True)
class Rule:
    """``condition(view, settings)`` flags an entity; ``classes`` None means every class."""

    name: str
    condition: Callable[[EntityView, RuleSettings], Column]
    classes: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if "," in self.name or not self.name:
            raise ValueError(f"a rule needs a name without commas, not {self.name!r}")


def _near_digits(e: EntityView, s: RuleSettings) -> Column:
    limits = s.thresholds
    few_others = e.length - e.digits < limits.min_non_digit_chars_when_digits_present
    return (e.digits > 0) & (few_others | (e.digits / e.length >= F.lit(float(limits.max_digits_ratio))))


def _list_like(e: EntityView, s: RuleSettings) -> Column:
    limits = s.thresholds
    return (X.separator_count(e.text) >= limits.min_arabic_commas_for_list) | (
        X.connector_hits(e.padded, s.lexicon.connectors) >= limits.min_and_connectors_for_list
    )


def _low_diversity(e: EntityView, s: RuleSettings) -> Column:
    limits = s.thresholds
    ratio = X.distinct_ratio(e.text)
    long_enough = e.dense >= limits.low_diversity_min_len
    # the ratio splits the text into characters, so it is only reached by long text
    return F.when(long_enough, ratio < F.lit(float(limits.low_diversity_uniq_ratio))).otherwise(F.lit(False))


def _pair(e: EntityView, firsts: Sequence[str]) -> Column:
    return (e.tokens == 2) & e.first.isin(*firsts)


def _begins(words: Sequence[str]) -> tuple[str, ...]:
    return tuple(f"{w} " for w in words)


DIRECTION_CLASSES = ("loc",)

# In evaluation order: the first one that holds is the row's first rule.
RULES: tuple[Rule, ...] = (
    Rule("too_many_tokens", lambda e, s: e.tokens > s.thresholds.max_tokens),
    Rule("too_long", lambda e, s: e.length > s.thresholds.max_chars),
    Rule("digits_only_or_near", _near_digits),
    Rule("year_only", lambda e, s: (e.length == 4) & X.is_year(e.text)),
    Rule("list_and_connectors", _list_like),
    Rule("generic_template_phrase", lambda e, s: X.starts_with_any(e.text, _begins(s.lexicon.generic_nouns))),
    Rule("low_char_diversity", _low_diversity),
    Rule("direction_duplication", lambda e, s: _pair(e, s.lexicon.directions) & (e.first == e.last)),
    Rule("loc_direction_plus_country", lambda e, s: _pair(e, s.lexicon.directions), DIRECTION_CLASSES),
    Rule("loc_city_placeholder", lambda e, s: _pair(e, (s.lexicon.city,)), ("loc",)),
    Rule("loc_city_plus_country", lambda e, s: _pair(e, s.lexicon.regions), ("loc",)),
    Rule("loc_bare_direction", lambda e, s: e.text.isin(*s.lexicon.directions), DIRECTION_CLASSES),
    Rule("pro_template_pronoun", lambda e, s: X.starts_with_any(e.text, _begins(s.lexicon.pronouns)), ("pro",)),
)

# Not among the defaults; add it to use the punctuation limit.
PUNCT_RATIO_RULE = Rule("punct_ratio", lambda e, s: X.punct_ratio(e.text) > F.lit(float(s.thresholds.max_punct_ratio)))

# Report order, which differs from evaluation order in two places.
REPORT_ORDER = (
    "too_many_tokens",
    "too_long",
    "digits_only_or_near",
    "year_only",
    "list_and_connectors",
    "generic_template_phrase",
    "low_char_diversity",
    "direction_duplication",
    "loc_direction_plus_country",
    "loc_city_plus_country",
    "loc_city_placeholder",
    "loc_bare_direction",
    "pro_template_pronoun",
)


def rule_rank(rule: Column) -> Column:
    """Place in the report; rules of the caller's own rank last and are told apart by name."""
    rank = F.lit(len(REPORT_ORDER))
    for position, name in enumerate(REPORT_ORDER):
        rank = F.when(rule == name, position).otherwise(rank)
    return rank


def with_rules(
    df: DataFrame,
    entity: str = "entity",
    context: str = "context",
    settings: RuleSettings = RuleSettings(),
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """Normalize the entity and add ``_qc_rules``, ``_qc_flag`` and ``_qc_first_rule``.

    ``context`` holds the lower-case inventory name. There is no shuffle. Shared counts are columns of
    their own and so are computed once. The list of rules passes through a one-row generator: a later
    filter on it can't be pushed below, where it would repeat all of the rules' work.
    """
    counts = {
        "_padded": X.padded(F.col(entity)),
        "_tokens": X.token_count(F.col(entity)),
        "_length": F.char_length(entity),
        "_digits": X.digit_count(F.col(entity)),
        "_dense": X.dense_length(F.col(entity)),
        "_first": X.first_token(F.col(entity)),
        "_last": X.last_token(F.col(entity)),
    }
    view = EntityView(F.col(entity), *[F.col(c) for c in counts])
    names = []
    for rule in rules:
        holds = rule.condition(view, settings)
        if rule.classes is not None:
            holds = F.col(context).isin(*rule.classes) & holds
        names.append(F.when(holds, F.lit(rule.name)))
    listed = F.concat_ws(",", *names)
    kept = [F.col(c) for c in df.columns]
    return (
        df.withColumn(entity, normalize_entity(F.col(entity)))
        .withColumns(counts)
        .select(*kept, F.inline(F.array(F.struct(listed.alias("_listed")))))
        .withColumns(
            {
                "_qc_rules": F.when(F.col("_listed") == "", F.array().cast("array<string>")).otherwise(
                    F.split("_listed", ",")
                ),
                "_qc_flag": F.col("_listed") != "",
                "_qc_first_rule": F.substring_index("_listed", ",", 1),
            }
        )
        .drop("_listed")
    )


def clean_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(~F.col("_qc_flag")).drop("_qc_rules", "_qc_flag", "_qc_first_rule")


def flagged_rows(checked: DataFrame) -> DataFrame:
    return checked.filter("_qc_flag").drop("_qc_flag")
