import html
import re
import sys
import time
from html.parser import HTMLParser

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nomenroll.functions.html import strip_html
from nomenroll.functions.persian import NormalizeConfig, normalize_fa, pattern_steps
from nomenroll.functions.whitespace import WHITESPACE_CHARS, collapse_whitespace, strip

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def apply(spark, function, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def test_whitespace_is_the_set_python_knows(spark):
    every = [chr(n) for n in range(sys.maxunicode + 1) if not 0xD800 <= n < 0xE000]
    assert set(WHITESPACE_CHARS) == {c for c in every if c.isspace()}
    bmp = [c for c in every if ord(c) < 0x10000 and c != "\0"]
    collapsed = apply(spark, collapse_whitespace, [f"a{c}b" for c in bmp])
    assert [c for c, x in zip(bmp, collapsed) if x == "a b"] == [c for c in bmp if c.isspace()]
    stripped = apply(spark, strip, [f"{c}a{c}" for c in bmp])
    assert [c for c, x in zip(bmp, stripped) if x == "a"] == [c for c in bmp if c.isspace()]


@FEW
@given(st.lists(st.text(alphabet=st.sampled_from("ab \t\n ‌　\x1c😀"), max_size=12), min_size=60, max_size=60))
def test_collapse_matches_python(spark, texts):
    assert apply(spark, collapse_whitespace, texts) == [re.sub(r"\s+", " ", t).strip() for t in texts]


class VisibleText(HTMLParser):
    """Text outside scripts, styles and templates, as a parser sees it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        if self.hidden and tag in ("script", "style", "template"):
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible(markup):
    parser = VisibleText()
    parser.feed(markup)
    parser.close()
    return "".join(parser.parts)


HTML_CASES = {
    "<p>a</p><p>b</p>": "ab",
    "&amp;lt;": "&lt;",
    "<script>var a='<!-- x';</script>y<!-- <script> -->z<style>p{}</style>": "yz",
    'a < b > c <a title="x>y" b=\'>\'>t</a>': "a < b > c t",
    "x<br/>y<hr>z": "xyz",
    "<!DOCTYPE html><?xml version='1.0'?>t": "t",
    "<SCRIPT type='a'>no</SCRIPT >yes": "yes",
    "<template><p>no</p></template>yes": "yes",
    "a<!-- one --><!-- two -->b": "ab",
    "<b>bold": "bold",
    "<scripted>yes</scripted>": "yes",
    "1 &lt; 2 &amp;&amp; 3 &gt; 2": "1 < 2 && 3 > 2",
    "": "",
}


def test_strip_html_cases(spark):
    assert dict(zip(HTML_CASES, apply(spark, strip_html, list(HTML_CASES)))) == HTML_CASES
    for markup, text in HTML_CASES.items():
        assert visible(markup) == text
    assert apply(spark, strip_html, [None]) == [""]


def test_cdata_ruby_and_unclosed(spark):
    cases = {
        "<![CDATA[raw <b> x]]>": "raw <b> x",
        "<ruby>x<rp>(</rp><rt>y</rt><rp>)</rp></ruby>z": "xz",
        "a<!-- never closed <p>b</p>": "a",
        "a<script>never closed": "a",
        "a <p unclosed": "a <p unclosed",
        "<rt><b>x</b></rt>y": "y",
        "<ruby>x<rt>a<rt>b</ruby>z": "xz",
        "a<![CDATA[never <b> closed": "anever <b> closed",
        "a<script>x</script never": "a",
        "a</b never": "a</b never",
    }
    assert dict(zip(cases, apply(spark, strip_html, list(cases)))) == cases


@pytest.mark.parametrize("part", ["<a 0", "</a", "<script ", "<![CDATA[", "<!-- ", "<rt>x</rt", "<a b='"])
def test_broken_markup_takes_time_in_proportion(spark, part):
    def seconds(n):
        frame = spark.createDataFrame([(part * n,)], "t string").select(strip_html(F.col("t")))
        begin = time.perf_counter()
        frame.collect()
        return time.perf_counter() - begin

    seconds(2_000)
    assert min(seconds(80_000) for _ in range(2)) <= 2.5 * max(min(seconds(40_000) for _ in range(2)), 0.4)


def test_references_agree_with_the_standard_library(spark):
    known = [n for n in html.entities.html5 if n.endswith(";")]
    texts = [f"a&{n}b" for n in known]
    texts += ["&#233;", "&#xe9;", "&#XE9;", "&#128;", "&#x99;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999999;"]
    texts += ["&#000065;", "&nosuch;", "&", "a & b", "&#;", "&#x;", "&copy 1", "x&amp;y&amp;#65;", "&#128512;"]
    assert apply(spark, strip_html, texts) == [html.unescape(t) for t in texts]


@FEW
@given(
    st.lists(
        st.lists(
            st.sampled_from(
                ["<p>", "</p>", "<b class='x'>", "text", " ", "&amp;", "&lt;", "<br>", "<!-- c -->", "é", "<i>q</i>",
                 "<script>var x = '<p>';</script>", "<style>a{}</style>", "😀", "\n"]
            ),
            max_size=12,
        ).map("".join),
        min_size=60,
        max_size=60,
    )
)
def test_strip_html_agrees_with_a_parser(spark, texts):
    assert apply(spark, strip_html, texts) == [visible(t) for t in texts]


PERSIAN_CASES = {
    "كتاب علي": "کتاب علی",
    "1.5%": "۱٫۵٪",
    "٣٤": "۳۴",
    'گفت "سلام دنيا" و': "گفت «سلام دنیا» و",
    "رفت...": "رفت …",
    "می روم و نمی روم": "می‌روم و نمی‌روم",
    "آدمی روم": "آدمی روم",
    "کتـــاب": "کتاب",
    "مُحَمَّد": "محمد",
    "می‌‌رود": "می‌رود",
    "الف‌ ب": "الف ب",
    "یک ، دو،سه": "یک، دو، سه",
    "( الف )ب": "(الف) ب",
    "12:30": "۱۲:۳۰",
    "الف(ب)": "الف (ب)",
    "  a \t b ": "a b",
}


def test_persian_cases(spark):
    assert dict(zip(PERSIAN_CASES, apply(spark, normalize_fa, list(PERSIAN_CASES)))) == PERSIAN_CASES
    assert apply(spark, normalize_fa, [None]) == [""]


@pytest.mark.parametrize(
    "switch, text, on, off",
    [
        ("unify_chars", "يك", "یک", "يك"),
        ("persian_numbers", "12", "۱۲", "12"),
        ("remove_diacritics", "بَ", "ب", "بَ"),
        ("remove_specials_chars", "ب۝", "ب", "ب۝"),
        ("persian_style", '"ب"', "«ب»", '"ب"'),
        ("correct_spacing", "ب ،", "ب،", "ب ،"),
        ("separate_mi", "می رود", "می‌رود", "می رود"),
        ("remove_extra_spaces", "ب  ب", "ب ب", "ب ب"),
    ],
)
def test_each_switch(spark, switch, text, on, off):
    nothing = NormalizeConfig(*[False] * 8)
    only = NormalizeConfig(**{**{f: False for f in nothing.__dataclass_fields__}, switch: True})
    assert apply(spark, lambda c: normalize_fa(c, only), [text]) == [on]
    assert apply(spark, lambda c: normalize_fa(c, nothing), [text]) == [off]
    assert pattern_steps(nothing) == []


@FEW
@given(st.lists(st.text(alphabet="اب12.،( )»«می‌كـَ\" ", max_size=14), min_size=80, max_size=80))
def test_normalized_text_has_single_spaces_and_one_digit_script(spark, texts):
    for result in apply(spark, normalize_fa, texts):
        assert result == re.sub(r"\s+", " ", result).strip()
        assert not re.search("[0-9كيـً-ْ]", result)
