import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nomenroll import constants as K
from nomenroll.operators.rules import (
    PUNCT_RATIO_RULE,
    RULES,
    Lexicon,
    Rule,
    RuleSettings,
    Thresholds,
    clean_rows,
    flagged_rows,
    with_rules,
)

GOLDEN = [
    ("pers", "علی رضایی", ""),
    ("pers", "", ""),
    ("pers", "  علی \t رضایی ", ""),
    ("pers", "NA", ""),
    ("pers", "a1", "digits_only_or_near"),
    ("pers", "abc12345", ""),
    ("pers", "abc123456", "digits_only_or_near"),
    ("loc", "۱۹۹۸", "digits_only_or_near,year_only"),
    ("loc", "1998", "digits_only_or_near,year_only"),
    ("loc", "3998", "digits_only_or_near"),
    ("loc", "19۹۸", "digits_only_or_near"),
    ("org", "تهران، شیراز، اصفهان", "list_and_connectors"),
    ("org", "A, B", ""),
    ("org", "A/B|C", "list_and_connectors"),
    ("org", "او یا این و آن and ها", "list_and_connectors"),
    ("org", "او یا این و آن", ""),
    ("org", "دانشگاه تهران", "generic_template_phrase"),
    ("org", "دانشگاه", ""),
    ("loc", "شهر تهران", "generic_template_phrase,loc_city_placeholder,loc_city_plus_country"),
    ("loc", "استان فارس", "generic_template_phrase,loc_city_plus_country"),
    ("loc", "شهر بزرگ تهران", "generic_template_phrase"),
    ("loc", "شمال ایران", "loc_direction_plus_country"),
    ("fac", "شمال ایران", ""),
    ("loc", "شمال شمال", "direction_duplication,loc_direction_plus_country"),
    ("fac", "شمال شمال", "direction_duplication"),
    ("loc", "غرب", "loc_bare_direction"),
    ("fac", "غرب", ""),
    ("pro", "این کتاب", "pro_template_pronoun"),
    ("pers", "این کتاب", ""),
    ("pro", "او رفت", "pro_template_pronoun"),
    ("pers", "a b c d e f g", ""),
    ("pers", "a b c d e f g h", "too_many_tokens"),
    ("event", "x" * 60, "low_char_diversity"),
    ("event", "x" * 61, "too_long,low_char_diversity"),
    ("event", "a" * 14, "low_char_diversity"),
    ("event", "a" * 13, ""),
    ("event", "abc" * 5, "low_char_diversity"),
    ("event", "aaaaabbbbbccccc", "low_char_diversity"),
    ("event", "می‌رود", ""),
    ("event", "😀" * 14, "low_char_diversity"),
    ("event", "abcd" * 4, ""),
]


def check(spark, pairs, **options):
    rows = spark.createDataFrame([(i, c, e) for i, (c, e) in enumerate(pairs)], "i int, context string, entity string")
    return with_rules(rows, **options).orderBy("i").collect()


def test_golden_rows(spark):
    got = check(spark, [(c, e) for c, e, _ in GOLDEN])
    assert [(r.context, ",".join(r._qc_rules)) for r in got] == [(c, rules) for c, _, rules in GOLDEN]
    for row in got:
        assert row._qc_flag == bool(row._qc_rules)
        assert row._qc_first_rule == (row._qc_rules[0] if row._qc_rules else "")
    assert got[2].entity == "علی رضایی"


def test_null_entity_is_clean_and_empty(spark):
    (row,) = check(spark, [("loc", None)])
    assert (row.entity, row._qc_rules, row._qc_flag, row._qc_first_rule) == ("", [], False, "")


# An independent statement of the rules: one predicate each, over facts gathered once.
def expected_rules(context, text):
    text = " ".join(text.split())
    words = text.split(" ") if text else []
    digits = sum(c in K.ASCII_DIGITS + K.PERSIAN_DIGITS for c in text)
    solid = [c for c in text if c != " "]
    pair = words if len(words) == 2 else ["", ""]
    is_year = len(text) == 4 and (
        (text[0] in "12" and all(c in K.ASCII_DIGITS for c in text))
        or (text[0] in "۱۲" and all(c in K.PERSIAN_DIGITS for c in text))
    )
    facts = {
        "too_many_tokens": len(words) > 7,
        "too_long": len(text) > 60,
        "digits_only_or_near": digits > 0 and (len(text) - digits < 3 or digits / len(text) >= 0.65),
        "year_only": is_year,
        "list_and_connectors": sum(map(text.count, "،,/|")) >= 2
        or sum(f" {w} " in f" {text} " for w in ("و", "یا", "&", "and", "or")) >= 3,
        "generic_template_phrase": len(words) > 1 and words[0] in K.GENERIC_NOUNS,
        "low_char_diversity": len(solid) >= 14 and 4 * len(set(solid)) < len(solid),
        "direction_duplication": pair[0] in K.DIRECTIONS and pair[0] == pair[1],
        "loc_direction_plus_country": context == "loc" and pair[0] in K.DIRECTIONS,
        "loc_city_placeholder": context == "loc" and pair[0] == "شهر",
        "loc_city_plus_country": context == "loc" and pair[0] in ("شهر", "استان"),
        "loc_bare_direction": context == "loc" and text in K.DIRECTIONS,
        "pro_template_pronoun": context == "pro" and len(words) > 1 and words[0] in ("او", "این"),
    }
    return [name for name, holds in facts.items() if holds]


WORDS = st.sampled_from(
    [*K.GENERIC_NOUNS, *K.DIRECTIONS, "او", "این", "و", "یا", "&", "and", "or", "ایران", "a", "x1", "1998", "۱۳۹۸",
     "12", "،", ",", "a/b|c", "ab" * 9, "zzzzzzz", "می‌رود", "😀", " ", "\t", ""]
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from(list(K.INVENTORY_NAMES.values())), st.lists(WORDS, max_size=9).map(" ".join)),
        min_size=300,
        max_size=300,
    )
)
def test_rules_agree_with_an_independent_statement(spark, pairs):
    got = check(spark, pairs)
    assert [r._qc_rules for r in got] == [expected_rules(c, e) for c, e in pairs]


def test_thresholds_and_lexicon_are_parameters(spark):
    settings_ = RuleSettings(
        Thresholds.merged({"max_tokens": 1, "max_digits_ratio": 0.5}), Lexicon(directions=("north",), city="city")
    )
    got = check(spark, [("loc", "north land"), ("loc", "city x"), ("pers", "ab12cd34ef")], settings=settings_)
    assert [r._qc_rules for r in got] == [
        ["too_many_tokens", "loc_direction_plus_country"],
        ["too_many_tokens", "loc_city_placeholder"],
        [],
    ]
    with pytest.raises(ValueError, match="unknown threshold"):
        Thresholds.merged({"max_words": 3})


def test_own_rules_come_after_the_fixed_ones(spark):
    shouting = Rule("shouting", lambda e, s: e.text == F.upper(e.text), ("org",))
    got = check(spark, [("org", "A.B.C.D"), ("pers", "A.B.C.D")], rules=(*RULES, PUNCT_RATIO_RULE, shouting))
    assert [r._qc_rules for r in got] == [["punct_ratio", "shouting"], ["punct_ratio"]]
    with pytest.raises(ValueError):
        Rule("a,b", lambda e, s: e.text == "")


def test_split_is_a_partition_of_the_rows(spark):
    rows = spark.createDataFrame([(c, e) for c, e, _ in GOLDEN], "context string, entity string")
    checked = with_rules(rows)
    clean, flagged = clean_rows(checked), flagged_rows(checked)
    assert clean.columns == ["context", "entity"]
    assert flagged.columns == ["context", "entity", "_qc_rules", "_qc_first_rule"]
    both = clean.unionByName(flagged.select("context", "entity"))
    everything = checked.select("context", "entity")
    assert both.exceptAll(everything).isEmpty() and everything.exceptAll(both).isEmpty()


def test_a_filter_does_not_repeat_the_rules(spark):
    rows = spark.createDataFrame([("loc", "a")], "context string, entity string").repartition(2)
    plan = clean_rows(with_rules(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") == 1
