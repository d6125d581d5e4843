"""The registered queries in ANSI SQL, for DuckDB on the same tables.

Written on its own: it shares the derived inputs' word lists and the example patterns with the Spark
side, and nothing that computes a result.
"""

from __future__ import annotations

from nomenroll.catalog import inputs as I

ZWNJ = "‌"
SPACE_RUN = (
    r"[\x09-\x0D\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
CLASS_ROWS = (
    "(VALUES ('PER','pers','pers_entities'),('LOC','loc','loc_entities'),('ORG','org','org_entities'),"
    "('FAC','fac','fac_entities'),('PRO','pro','pro_entities'),('EVENT','event','event_entities'))"
    " AS k(entity_class, inventory, entity_column)"
)
RULE_RANKS = (
    "['too_many_tokens','too_long','digits_only_or_near','year_only','list_and_connectors',"
    "'generic_template_phrase','low_char_diversity','direction_duplication','loc_direction_plus_country',"
    "'loc_city_plus_country','loc_city_placeholder','loc_bare_direction','pro_template_pronoun']"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement)}, 'g')"


def ws(text: str) -> str:
    return f"trim({sub(text, SPACE_RUN, ' ')})"


def html(text: str) -> str:
    hidden = "|".join(rf"{t}(?:[\s/][^>]*)?>.*?(?:</{t}[^>]*(?:>|\z)|\z)" for t in ("script", "style", "template"))
    markup = (
        rf"(?is)<(?:!--.*?(?:-->|\z)|{hidden}|(?:rt|rp)(?:[\s/][^>]*)?>.*?(?:</(?:rt|rp)[^>]*(?:>|\z)|\z)|!\[CDATA\[(.*?)(?:\]\]>|\z)|[!?/][^>]*>"
        r"""|[a-z](?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*>)|(<[a-z!?/].*\z)"""
    )
    out = sub(f"coalesce({text}, '')", markup, r"\1\2")
    for name, char in (
        ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
        ("&amp;", "&"),
    ):
        out = f"replace({out}, {quoted(name)}, {quoted(char)})"
    return out


def fa(text: str) -> str:
    source = "يىك“”„‟0123456789٠١٢٣٤٥٦٧٨٩%" + "".join(map(chr, range(0x64B, 0x653))) + "ٰـ"
    target = 'ییک""""۰۱۲۳۴۵۶۷۸۹۰۱۲۳۴۵۶۷۸۹٪'
    out = f"translate(coalesce({text}, ''), {quoted(source)}, {quoted(target)})"
    steps = [
        (r'"([^\n"]+)"', r"«\1»"),
        (r"([0-9۰-۹])\.([0-9۰-۹])", r"\1٫\2"),
        (r" ?\.\.\.", " …"),
        (ZWNJ + r"+([ \n\t])", r"\1"),
        (r"([ \n\t])" + ZWNJ + "+", r"\1"),
        ("^" + ZWNJ + "+|" + ZWNJ + r"+\z", ""),
        (ZWNJ + "{2,}", ZWNJ),
        (r" +([.:!،؛؟»\])}])", r"\1"),
        (r"([«\[({]) +", r"\1"),
        (r"([.:])([^ \n.:!،؛؟»\])}0-9۰-۹])", r"\1 \2"),
        (r"([!،؛؟»\])}])([^ \n.:!،؛؟»\])}])", r"\1 \2"),
        (r"([^ \n«\[({])([«\[({])", r"\1 \2"),
        (r"(^| )(ن?می) ", r"\1\2" + ZWNJ),
        (" {2,}", " "),
    ]
    for pattern, replacement in steps:
        out = sub(out, pattern, replacement)
    return ws(out)


def persian(text: str, number: str) -> str:
    out = f"lower({text})"
    for old, new in I.PERSIAN_WORDS:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    return f"translate({out}, {quoted(I.LETTERS[0])}, {quoted(I.LETTERS[1])}) || ' ' || {number} || '.5% ...'"


DOCS = f"SELECT doc_id, {ws('text')} AS text FROM documents"


def spans(source: str, key: str, patterns: dict[str, str] | None = None) -> str:
    """CTEs ending in ``spans``: key, field, text, type, start_char, end_char.

    ``source`` gives key, field and text.
    """
    patterns = patterns or I.PATTERNS
    parts = " UNION ALL ".join(
        f"SELECT {key}, field, {quoted(kind)} AS type, {rank} AS rank, regexp_extract_all(text, {quoted(rx)}) AS ms, "
        f"string_split_regex(text, {quoted(rx)}) AS gs FROM texts"
        for rank, (kind, rx) in enumerate(patterns.items())
    )
    return (
        f"texts AS ({source}), found AS ({parts}), "
        f"pieces AS (SELECT {key}, field, type, rank, unnest(ms) AS text, unnest(gs[1:len(ms)]) AS gap, "
        f"unnest(range(1, len(ms) + 1)) AS i FROM found), "
        f"ends AS (SELECT {key}, field, type, rank, text, CAST(sum(length(gap) + length(text)) OVER "
        f"(PARTITION BY {key}, field, type ORDER BY i) AS INTEGER) AS end_char FROM pieces), "
        f"spans AS (SELECT {key}, field, text, type, rank, CAST(end_char - length(text) AS INTEGER) AS start_char, "
        f"end_char FROM ends)"
    )


DOC_SPANS = spans(f"SELECT doc_id, 'content' AS field, text FROM ({DOCS})", "doc_id")
PLAIN_CONTENT = f"SELECT doc_id, 'content' AS field, {ws(html('text'))} AS text FROM documents"
PLAIN_TITLE = f"SELECT doc_id, 'title' AS field, {ws(html('source'))} AS text FROM documents"
FIELD_SPANS = spans(f"{PLAIN_TITLE} UNION ALL {PLAIN_CONTENT}", "doc_id")
IN_CLASSES = "upper(type) IN ('PER','LOC','ORG','FAC','PRO','EVENT')"


def inventory(key: str = "doc_id") -> str:
    return (
        f"inventory AS (SELECT upper(type) AS entity_class, trim(text) AS entity, {key}, field, start_char, end_char "
        f"FROM spans WHERE {IN_CLASSES} AND trim(text) <> '')"
    )


MENTIONS = f"{DOC_SPANS}, {inventory()}"
JSON_SPANS = (
    "coalesce(CAST(to_json(list({'text': text, 'type': type, 'start_char': start_char, 'end_char': end_char} "
    "ORDER BY start_char, end_char DESC, rank)) AS VARCHAR), '[]')"
)

_UNEVEN_CONTENT = f"CASE WHEN lang IN ('es', 'fr', 'de') THEN '' ELSE {ws(html('text'))} END"
UNEVEN_SPANS = spans(
    "SELECT doc_id, 'title' AS field, upper(source[1]) || lower(source[2:]) AS text FROM documents UNION ALL "
    f"SELECT doc_id, 'content', {_UNEVEN_CONTENT} FROM documents",
    "doc_id",
    I.PADDED_PATTERNS,
)
CLASS_SPANS = spans(f"SELECT doc_id, 'content' AS field, text FROM ({DOCS})", "doc_id", I.CLASS_PATTERNS)

# --- gazetteer --------------------------------------------------------------------------------
GAZETTEER = (
    f"docs AS ({DOCS}), surfaces AS (SELECT unnest(regexp_extract_all(text, {quoted(I.CAPITALIZED)})) AS surface FROM "
    f"docs UNION ALL SELECT unnest(regexp_extract_all(text, {quoted(I.CAPITALIZED + ' [a-zß-öø-ÿ]+')})) FROM docs), "
    "gazetteer AS (SELECT DISTINCT surface, ['PER','LOC','ORG','FAC','PRO','EVENT'][length(surface) % 6 + 1] AS type "
    "FROM surfaces), "
    "words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, "
    "unnest(range(0, len(string_split(text, ' ')))) AS i FROM docs WHERE text <> ''), "
    "placed AS (SELECT doc_id, word, lead(word) OVER w AS after, coalesce(sum(length(word) + 1) OVER "
    "(PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos "
    "FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)), "
    "ngrams AS (SELECT doc_id, word AS surface, pos FROM placed UNION ALL "
    "SELECT doc_id, word || ' ' || after, pos FROM placed WHERE after IS NOT NULL), "
    "matches AS (SELECT doc_id, surface AS text, type, CAST(pos AS INTEGER) AS start_char, "
    "CAST(pos + length(surface) AS INTEGER) AS end_char FROM ngrams JOIN gazetteer USING (surface)), "
    "longest AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id, start_char "
    "ORDER BY end_char DESC) = 1), "
    "hops AS (SELECT a.doc_id, a.text, a.type, a.start_char, a.end_char, b.start_char AS hop FROM longest a "
    "ASOF LEFT JOIN longest b ON a.doc_id = b.doc_id AND a.end_char <= b.start_char), "
    "kept AS (SELECT h.* FROM hops h JOIN (SELECT doc_id, min(start_char) AS start_char FROM hops GROUP BY doc_id) f "
    "USING (doc_id, start_char) UNION ALL SELECT h.* FROM kept k JOIN hops h ON h.doc_id = k.doc_id "
    "AND h.start_char = k.hop)"
)

# --- candidates and rules ---------------------------------------------------------------------


def _swapped(text: str) -> str:
    out = f"('  ' || replace({text}, ' ', '  ') || '  ')"
    for old, new in I.WORD_SWAPS:
        out = f"replace({out}, {quoted(f' {old} ')}, {quoted(f' {new} ')})"
    return out


CANDIDATES = (
    "phrases AS (SELECT doc_id, regexp_extract_all(lower(text), '[^.,\n]+') AS found FROM documents), "
    "raw_candidates AS ("
    "SELECT 0 AS src, doc_id AS id, CAST(pos AS BIGINT) AS pos, "
    "['pers','loc','org','fac','pro','event'][doc_id % 6 + 1] AS context, "
    f"{_swapped('phrase')} AS entity FROM (SELECT doc_id, unnest(found) AS phrase, "
    "unnest(range(0, len(found))) AS pos FROM phrases) "
    "UNION ALL SELECT 1, p_partkey, 0, 'pro', p_name FROM part "
    "UNION ALL SELECT 2, c_custkey, 0, 'pers', c_name FROM customer "
    "UNION ALL SELECT 3, s_suppkey, 0, 'org', s_name FROM supplier "
    "UNION ALL SELECT 4, n_nationkey, 0, 'loc', n_name FROM nation "
    "UNION ALL SELECT 5, o_orderkey, 0, 'event', CAST(year(o_orderdate) AS VARCHAR) FROM orders "
    "UNION ALL SELECT 6, o_orderkey, 0, 'fac', translate(CAST(year(o_orderdate) AS VARCHAR), "
    f"'{I.YEAR_DIGITS[0]}', '{I.YEAR_DIGITS[1]}') FROM orders "
    "UNION ALL SELECT 7, r_regionkey, 0, 'org', repeat(r_name, 4) FROM region), "
    f"candidates AS (SELECT src, id, pos, context, {ws('entity')} AS entity FROM raw_candidates)"
)


def features(source: str) -> str:
    """CTE ``measured``: ``source`` with the counts that the rules read."""
    return (
        "measured AS (SELECT *, CASE WHEN entity = '' THEN 0 ELSE len(string_split(entity, ' ')) END AS tokens, "
        "length(entity) AS chars, len(regexp_extract_all(entity, '[،,/|]')) AS separators, "
        "len(regexp_extract_all(entity, '[0-9۰-۹]')) AS digits, "
        """len(regexp_extract_all(entity, '[\\.,;:!\\?\\-\\(\\)\\[\\]\\{\\}«»"''…ـ،]')) AS puncts, """
        "length(replace(entity, ' ', '')) AS dense, "
        "CASE WHEN replace(entity, ' ', '') = '' THEN 0 ELSE "
        "len(list_distinct(string_split(replace(entity, ' ', ''), ''))) END AS uniques, "
        f"string_split(entity, ' ') AS parts FROM {source})"
    )


def rules(
    tokens: int, chars: int, connectors: list[str], nouns: list[str], directions: list[str], city: str,
    regions: list[str], pronouns: list[str], more: str = "",
) -> str:
    """CTE ``checked``: ``measured`` with the list of rules that hold."""
    hits = " + ".join(f"(CASE WHEN contains(' ' || entity || ' ', {quoted(c)}) THEN 1 ELSE 0 END)" for c in connectors)
    begins = " OR ".join(f"starts_with(entity, {quoted(n + ' ')})" for n in nouns)
    says = " OR ".join(f"starts_with(entity, {quoted(p + ' ')})" for p in pronouns)
    among = ", ".join(map(quoted, directions))
    areas = ", ".join(map(quoted, regions))
    cases = [
        ("too_many_tokens", f"tokens > {tokens}"),
        ("too_long", f"chars > {chars}"),
        (
            "digits_only_or_near",
            "digits > 0 AND (chars - digits < 3 OR CAST(digits AS DOUBLE) / chars >= CAST(0.65 AS DOUBLE))",
        ),
        ("year_only", "regexp_full_match(entity, '[12][0-9]{3}|[۱۲][۰-۹]{3}')"),
        ("list_and_connectors", f"separators >= 2 OR ({hits}) >= 3"),
        ("generic_template_phrase", begins),
        ("low_char_diversity", "dense >= 14 AND CAST(uniques AS DOUBLE) / dense < CAST(0.25 AS DOUBLE)"),
        ("direction_duplication", f"tokens = 2 AND parts[1] IN ({among}) AND parts[1] = parts[2]"),
        ("loc_direction_plus_country", f"context = 'loc' AND tokens = 2 AND parts[1] IN ({among})"),
        ("loc_city_placeholder", f"context = 'loc' AND tokens = 2 AND starts_with(entity, {quoted(city + ' ')})"),
        ("loc_city_plus_country", f"context = 'loc' AND tokens = 2 AND parts[1] IN ({areas})"),
        ("loc_bare_direction", f"context = 'loc' AND entity IN ({among})"),
        ("pro_template_pronoun", f"context = 'pro' AND ({says})"),
    ]
    listed = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in cases)
    return (
        f"checked AS (SELECT *, list_filter([{listed}{more}], lambda r: r IS NOT NULL) AS rules FROM measured)"
    )


def default_rules(tokens: int = 7, chars: int = 60) -> str:
    return rules(
        tokens, chars, [" و ", " یا ", " & ", " and ", " or "],
        ["شهر", "استان", "کشور", "منطقه", "روستا", "بندر", "فرودگاه", "دانشگاه", "سازمان", "شرکت"],
        ["شمال", "جنوب", "شرق", "غرب"], "شهر", ["شهر", "استان"], ["او", "این"],
    )


DEFAULT_RULES = default_rules()
OWN_RULES = rules(
    4, 30, [" the ", " of ", " and ", " a "], ["la", "le", "que"], ["in", "on", "red", "blue"], "small",
    ["small", "large"], ["it", "he"],
    ", CASE WHEN chars > 0 AND CAST(puncts AS DOUBLE) / chars > CAST(0.1 AS DOUBLE) THEN 'punct_ratio' END",
)
CHECKED = f"{CANDIDATES}, {features('candidates')}, {DEFAULT_RULES}"
COUNTED = (
    "hits AS (SELECT *, unnest(rules) AS rule FROM checked), "
    "rule_counts AS (SELECT context, grouping(context) = 1 AS overall, rule, "
    f"list_position({RULE_RANKS}, rule) - 1 AS rank, count(*) AS rows FROM hits "
    "GROUP BY GROUPING SETS ((context, rule), (rule)))"
)
EXAMPLES = (
    "firsts AS (SELECT context, rule, entity, min((src, id, pos)) AS first_seen FROM hits GROUP BY ALL), "
    "examples AS (SELECT context, rule, entity, row_number() OVER (PARTITION BY context, rule ORDER BY first_seen) "
    "AS nth FROM firsts QUALIFY nth <= 8)"
)


def tops(k: int) -> str:
    return (
        "tops AS (SELECT context, entity, count(*) AS count, row_number() OVER (PARTITION BY context "
        f"ORDER BY count(*) DESC, entity) AS nth FROM checked WHERE len(rules) = 0 GROUP BY context, entity "
        f"QUALIFY nth <= {k})"
    )


TOTALS = (
    "SELECT context, grouping(context) = 1 AS overall, count(*) AS rows_total, "
    "count(*) FILTER (WHERE len(rules) > 0) AS rows_flagged, count(*) FILTER (WHERE len(rules) = 0) AS rows_clean "
    "FROM checked GROUP BY ROLLUP (context)"
)
CONTEXT_OF_CLASS = (
    "CASE entity_class WHEN 'PER' THEN 'pers' WHEN 'LOC' THEN 'loc' WHEN 'ORG' THEN 'org' "
    "WHEN 'FAC' THEN 'fac' WHEN 'PRO' THEN 'pro' ELSE 'event' END"
)


def checked_mentions(content: str, which: str = DEFAULT_RULES) -> str:
    source = spans(content, "doc_id")
    return (
        f"{source}, {inventory()}, of_context AS (SELECT {CONTEXT_OF_CLASS} AS context, {ws('entity')} AS entity "
        f"FROM inventory), {features('of_context')}, {which}"
    )


# --- verification -----------------------------------------------------------------------------
STATUS = (
    "CASE WHEN f = 0 THEN 'missing' WHEN e = 0 THEN 'extra' WHEN differs THEN 'mismatch' ELSE 'ok' END AS status"
)
LATER_ORDERS = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' "
    "THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, "
    "CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN CAST(o_orderdate AS TIMESTAMP) "
    "+ INTERVAL 1 MICROSECOND ELSE CAST(o_orderdate AS TIMESTAMP) END AS o_orderdate, o_orderpriority FROM orders "
    "WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW' UNION ALL SELECT -o_orderkey - 1, o_custkey, "
    "o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP), o_orderpriority FROM orders "
    "WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"
)
LATER_LINES = (
    "SELECT * REPLACE (CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 49 THEN 0.5 ELSE l_tax END "
    "AS l_tax) FROM lineitem WHERE l_returnflag <> 'R' OR l_linestatus <> 'O'"
)


def table_status(before: str, after: str, key: str, values: str) -> str:
    return (
        f"SELECT {key}, CASE WHEN sum(f) = 0 THEN 'missing' WHEN sum(e) = 0 THEN 'extra' "
        f"WHEN bool_or(e <> f) THEN 'mismatch' ELSE 'ok' END AS status FROM ("
        f"SELECT {key}, sum(e) AS e, sum(1 - e) AS f FROM (SELECT {key}, {values}, 1 AS e FROM ({before}) UNION ALL "
        f"SELECT {key}, {values}, 0 AS e FROM ({after})) GROUP BY {key}, {values}) GROUP BY {key}"
    )


ORDERS_STATUS = table_status(
    "SELECT * REPLACE (CAST(o_orderdate AS TIMESTAMP) AS o_orderdate) FROM orders",
    LATER_ORDERS,
    "o_orderkey",
    "o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
)
_PLAIN_ORDERS = "SELECT * REPLACE (CAST(o_orderdate AS TIMESTAMP) AS o_orderdate) FROM orders"
CORRECTED_ORDERS = (
    f"SELECT * REPLACE (CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderstatus = 'F' THEN o_totalprice + 1 "
    f"ELSE o_totalprice END AS o_totalprice) FROM ({_PLAIN_ORDERS}) WHERE o_orderdate < TIMESTAMP '2001-01-01' "
    f"OR o_orderstatus <> 'P' UNION ALL SELECT * FROM ({_PLAIN_ORDERS}) WHERE o_orderdate >= TIMESTAMP '2001-01-01' "
    f"AND o_orderpriority = '1-URGENT'"
)
LINE_REST = (
    "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
)
PAGE_LIST = (
    "listed AS (SELECT 'pages/' || page_id || '.html' AS path, "
    "upper(sha256(CASE WHEN contains(url, 'ref=') THEN url ELSE html END)) AS digest FROM pages), "
    "on_disk AS (SELECT 'pages/' || page_id || '.html' AS path, CASE WHEN length(html) <= 9000 THEN "
    "upper(sha256(CASE WHEN contains(url, '/fr/') OR contains(url, 'ref=') THEN url ELSE html END)) END AS digest "
    "FROM pages WHERE NOT ends_with(url, '#top') UNION ALL SELECT 'pages/' || page_id || '.html.tmp', "
    "upper(sha256(CASE WHEN contains(url, '/fr/') OR contains(url, 'ref=') THEN url ELSE html END)) FROM pages "
    "WHERE contains(url, '//m.')), "
    "compared AS (SELECT coalesce(l.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing' "
    "WHEN d.digest IS NULL THEN 'unreadable' WHEN l.path IS NULL THEN 'extra' WHEN l.digest <> d.digest THEN 'mismatch' "
    "ELSE 'ok' END AS status, l.digest AS expected, d.digest AS found FROM listed l FULL JOIN on_disk d "
    "ON l.path = d.path)"
)


def verdict_of(source: str) -> str:
    return (
        "SELECT count(*) AS checked, count(*) FILTER (WHERE status = 'missing') AS missing, "
        "count(*) FILTER (WHERE status = 'extra') AS extra, count(*) FILTER (WHERE status = 'mismatch') AS mismatch, "
        "count(*) FILTER (WHERE status = 'unreadable') AS unreadable, "
        f"count(*) FILTER (WHERE status <> 'ok') = 0 AS ok FROM {source}"
    )


PAGE_SPANS = spans(
    f"SELECT page_id, 'title' AS field, {fa(html('url'))} AS text FROM pages UNION ALL "
    f"SELECT page_id, 'content', {fa(html('html'))} FROM pages",
    "page_id",
)

ORACLES: dict[str, str] = {
    "standardize_documents": (
        "SELECT doc_id, coalesce(source, '') AS title, coalesce(text, '') AS content, '' AS link FROM documents"
    ),
    "standardize_nulls": (
        "SELECT doc_id, coalesce(lang, 'nan') AS title, coalesce(CAST(quality AS VARCHAR), 'nan') AS content, "
        "coalesce(source, 'nan') AS link FROM documents LEFT JOIN labels USING (doc_id)"
    ),
    "first_n_most_keys": (
        "SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= "
        "(SELECT count(*) * 9 // 10 FROM orders)"
    ),
    "first_n_by_key": (
        "SELECT doc_id, source AS title, text AS content, '' AS link FROM documents WHERE doc_id > 99 "
        "ORDER BY doc_id LIMIT 500"
    ),
    "corpus_csv_roundtrip": "SELECT url AS title, html AS content, url AS link FROM pages",
    "normalize_ws": DOCS,
    "strip_html_pages": f"SELECT page_id, {html('html')} AS text FROM pages",
    "strip_html_broken": "SELECT page_id, "
    + html(r"regexp_replace(html, '>[^>]*\z', '') || repeat('<a 0', 50)")
    + " AS text FROM pages",
    "normalize_fa_default": f"SELECT doc_id, {fa(persian('text', 'n_chars'))} AS text FROM documents",
    "normalize_fa_letters_only": (
        "SELECT doc_id, "
        + ws(
            sub(
                f"translate({persian('text', 'n_chars')}, 'يىك“”„‟', 'ییک\"\"\"\"')",
                r"[\x{0610}-\x{061A}\x{06D6}-\x{06ED}\x{FD3E}\x{FD3F}\x{FDF0}-\x{FDFD}]",
                "",
            )
        )
        + " AS text FROM documents"
    ),
    "text_features": (
        f"WITH {CANDIDATES}, {features('candidates')} SELECT src, id, pos, CAST(tokens AS BIGINT) AS tokens, "
        "CAST(chars AS BIGINT) AS length, CAST(separators AS BIGINT) AS separators, CAST(digits AS BIGINT) AS digits, "
        "CAST(chars - digits AS BIGINT) AS non_digits, CAST("
        + " + ".join(
            f"(CASE WHEN contains(' ' || entity || ' ', '{c}') THEN 1 ELSE 0 END)"
            for c in (" و ", " یا ", " & ", " and ", " or ")
        )
        + " AS BIGINT) AS connectors, CASE WHEN chars = 0 THEN 0.0 ELSE round(CAST(puncts AS DOUBLE) / chars, 6) END "
        "AS punct_ratio, CASE WHEN dense = 0 THEN 0.0 ELSE round(CAST(uniques AS DOUBLE) / dense, 6) END "
        "AS distinct_ratio, regexp_full_match(entity, '[12][0-9]{3}|[۱۲][۰-۹]{3}') AS is_year FROM measured"
    ),
    "text_digests": "SELECT doc_id, upper(sha256(text)) AS digest FROM documents",
    "mentions_pattern": f"WITH {MENTIONS} SELECT * FROM inventory",
    "mentions_model": (
        "WITH "
        + spans(f"SELECT doc_id, 'content' AS field, text FROM ({DOCS})", "doc_id", {"Per": I.CAPITALIZED})
        + f", {inventory()} SELECT * FROM inventory"
    ),
    "matches_gazetteer": f"WITH RECURSIVE {GAZETTEER} SELECT doc_id, text, type, start_char, end_char FROM matches",
    "matches_gazetteer_joined": f"WITH RECURSIVE {GAZETTEER} SELECT doc_id, text, type, start_char, end_char FROM matches",
    "matches_gazetteer_filtered": f"WITH RECURSIVE {GAZETTEER} SELECT doc_id, text, type, start_char, end_char FROM matches",
    "mentions_one_text": (
        f"WITH docs AS ({DOCS}), surfaces AS (SELECT DISTINCT unnest(regexp_extract_all(text, {quoted(f'{I.WORD} {I.WORD}')})) "
        "AS surface FROM docs), all_text AS (SELECT string_split(string_agg(text, ' ' ORDER BY doc_id), ' ') AS ws FROM docs), "
        "words AS (SELECT unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM all_text), "
        "placed AS (SELECT i, word || ' ' || lead(word) OVER w AS surface, coalesce(sum(length(word) + 1) OVER (ORDER BY i "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM words WINDOW w AS (ORDER BY i)), "
        "matches AS (SELECT i, surface, pos, i - row_number() OVER (ORDER BY i) AS island FROM placed JOIN surfaces USING (surface)) "
        "SELECT 0 AS doc_id, surface AS text, ['PER','LOC','ORG','FAC','PRO','EVENT'][length(surface) % 6 + 1] AS type, "
        "CAST(pos AS INTEGER) AS start_char, CAST(pos + length(surface) AS INTEGER) AS end_char FROM matches "
        "QUALIFY row_number() OVER (PARTITION BY island ORDER BY i) % 2 = 1"
    ),
    "mentions_gazetteer": f"WITH RECURSIVE {GAZETTEER} SELECT doc_id, text, type, start_char, end_char FROM kept",
    "processed_gazetteer": (
        f"WITH RECURSIVE {GAZETTEER}, arrays AS (SELECT doc_id, CAST(to_json(list({{'text': text, 'type': type, "
        "'start_char': start_char, 'end_char': end_char} ORDER BY start_char)) AS VARCHAR) AS spans FROM kept "
        "GROUP BY doc_id) SELECT doc_id, source AS title, '' AS link, coalesce(spans, '[]') AS entities_content "
        "FROM documents LEFT JOIN arrays USING (doc_id)"
    ),
    "processed_both_fields": (
        f"WITH {FIELD_SPANS}, arrays AS (SELECT doc_id, field, {JSON_SPANS} AS spans FROM spans GROUP BY doc_id, field) "
        "SELECT d.doc_id, source AS title, '' AS link, coalesce(t.spans, '[]') AS entities_title, "
        "coalesce(c.spans, '[]') AS entities_content FROM documents d "
        "LEFT JOIN arrays t ON t.doc_id = d.doc_id AND t.field = 'title' "
        "LEFT JOIN arrays c ON c.doc_id = d.doc_id AND c.field = 'content'"
    ),
    "processed_title_only": (
        f"WITH {FIELD_SPANS}, arrays AS (SELECT doc_id, {JSON_SPANS} AS spans FROM spans WHERE field = 'title' "
        "GROUP BY doc_id) SELECT d.doc_id, source AS title, '' AS link, coalesce(spans, '[]') AS entities_title "
        "FROM documents d LEFT JOIN arrays USING (doc_id)"
    ),
    "mentions_both_fields": f"WITH {FIELD_SPANS}, {inventory()} SELECT * FROM inventory",
    "mentions_padded": f"WITH {UNEVEN_SPANS}, {inventory()} SELECT * FROM inventory",
    "spans_by_field": (
        f"WITH {UNEVEN_SPANS} SELECT t.field, count(DISTINCT s.doc_id) AS with_spans, "
        "count(DISTINCT t.doc_id) - count(DISTINCT s.doc_id) AS without, "
        "CAST(sum(CASE WHEN trim(s.text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_spans, "
        "CAST(sum(CASE WHEN trim(s.text) <> '' AND trim(s.text) <> s.text THEN 1 ELSE 0 END) AS BIGINT) AS padded_spans "
        "FROM texts t LEFT JOIN spans s ON s.doc_id = t.doc_id AND s.field = t.field GROUP BY t.field"
    ),
    "mentions_from_processed": (
        f"WITH {FIELD_SPANS} SELECT CASE WHEN type = 'DATE' THEN 'EVENT' ELSE upper(type) END AS entity_class, "
        "text AS entity, doc_id, field, start_char, end_char FROM spans"
    ),
    "inventory_counts": (
        f"WITH {MENTIONS} SELECT entity_class, inventory, entity_column, "
        f"(SELECT count(*) FROM inventory i WHERE i.entity_class = k.entity_class) AS mentions FROM {CLASS_ROWS}"
    ),
    "inventory_names": (
        f"WITH {MENTIONS} SELECT doc_id, start_char, end_char, entity, k.inventory, k.entity_column "
        f"FROM inventory i JOIN {CLASS_ROWS} ON i.entity_class = k.entity_class"
    ),
    "inventory_single_class": f"WITH {MENTIONS} SELECT entity AS org_entities FROM inventory WHERE entity_class = 'ORG'",
    "inventory_csv_roundtrip": f"WITH {MENTIONS} SELECT * FROM inventory",
    "inventory_class_files": (
        f"WITH {CLASS_SPANS}, {inventory()} SELECT k.inventory AS context, entity FROM inventory i JOIN {CLASS_ROWS} "
        "ON i.entity_class = k.entity_class WHERE i.entity_class <> 'FAC'"
    ),
    "inventory_file_sizes": (
        f"WITH {CLASS_SPANS}, {inventory()} SELECT entity_class, count(*) AS mentions, true AS sized FROM inventory GROUP BY 1"
    ),
    "dropped_span_types": (
        f"WITH {DOC_SPANS} SELECT upper(type) AS type, count(*) AS spans FROM spans WHERE NOT {IN_CLASSES} GROUP BY 1"
    ),
    "inventory_classes_present": (
        f"WITH {MENTIONS} SELECT k.inventory, k.entity_column FROM {CLASS_ROWS} "
        "WHERE k.entity_class IN (SELECT entity_class FROM inventory)"
    ),
    "extraction_run": f"WITH {PAGE_SPANS}, {inventory('page_id')} SELECT * FROM inventory",
    "extraction_metrics": (
        f"WITH {FIELD_SPANS}, {inventory()} SELECT 'title+content' AS text_field, "
        "(SELECT count(*) FROM documents) AS rows_in, (SELECT count(*) FROM documents) AS observed_rows, true AS agrees, "
        + ", ".join(
            f"(SELECT count(*) FROM inventory WHERE entity_class = '{c}') AS mentions_{c.lower()}"
            for c in ("PER", "LOC", "ORG", "FAC", "PRO", "EVENT")
        )
        + ", (SELECT '{' || string_agg('\"' || type || '\":' || n, ',' ORDER BY type) || '}' FROM (SELECT upper(type) "
        f"AS type, count(*) AS n FROM spans WHERE NOT {IN_CLASSES} GROUP BY 1)) AS dropped_types"
    ),
    "qc_rules": (
        f"WITH {CHECKED} SELECT src, id, pos, context, entity, array_to_string(rules, ',') AS rules, "
        "len(rules) > 0 AS flag, coalesce(rules[1], '') AS first_rule FROM checked"
    ),
    "qc_rules_own": (
        f"WITH {CANDIDATES}, {features('candidates')}, {OWN_RULES} SELECT src, id, pos, "
        "array_to_string(rules, ',') AS rules FROM checked"
    ),
    "qc_raw_copy": f"WITH {CANDIDATES} SELECT context, entity FROM candidates",
    "qc_clean": f"WITH {CHECKED} SELECT context, entity FROM checked WHERE len(rules) = 0",
    "qc_flagged": (
        f"WITH {CHECKED} SELECT context, entity, rules[1] AS first_rule, array_to_string(rules, ',') AS rules "
        "FROM checked WHERE len(rules) > 0"
    ),
    "qc_split_tables": (
        f"WITH {CHECKED} SELECT context, entity, CASE WHEN len(rules) > 0 THEN 'flagged' ELSE 'clean' END AS split "
        "FROM checked"
    ),
    "qc_split_totals": f"WITH {CHECKED} {TOTALS}",
    "qc_rule_counts": f"WITH {CHECKED}, {COUNTED} SELECT context, overall, rank, rule, rows FROM rule_counts",
    "qc_examples": f"WITH {CHECKED}, {COUNTED}, {EXAMPLES} SELECT context, rule, nth, entity FROM examples",
    "qc_top_entities": f"WITH {CHECKED}, {tops(30)} SELECT context, nth, entity, count FROM tops",
    "qc_rule_count_maps": (
        f"WITH {CHECKED}, {COUNTED} SELECT context, overall, '{{' || string_agg('\"' || rule || '\":' || rows, ',' "
        "ORDER BY rank) || '}' AS rule_counts FROM rule_counts GROUP BY context, overall"
    ),
    "qc_example_maps": (
        f"WITH {CHECKED}, {COUNTED}, {EXAMPLES}, lists AS (SELECT context, rule, list_position({RULE_RANKS}, rule) AS "
        "rank, CAST(to_json(list(entity ORDER BY nth)) AS VARCHAR) AS entities FROM examples GROUP BY context, rule) "
        "SELECT context, '{' || string_agg('\"' || rule || '\":' || entities, ',' ORDER BY rank) || '}' "
        "AS examples_by_rule FROM lists GROUP BY context"
    ),
    "qc_top_lists": (
        f"WITH {CHECKED}, {tops(5)} SELECT context, CAST(to_json(list({{'entity': entity, 'count': count}} "
        "ORDER BY nth)) AS VARCHAR) AS top_entities_clean FROM tops GROUP BY context"
    ),
    "qc_report": (
        f"WITH {CHECKED}, {COUNTED}, {EXAMPLES}, {tops(30)}, totals AS ({TOTALS}), maps AS (SELECT context, overall, "
        "'{' || string_agg('\"' || rule || '\":' || rows, ',' ORDER BY rank) || '}' AS rule_counts FROM rule_counts "
        "GROUP BY context, overall) SELECT t.context, t.overall, rows_total, rows_flagged, rows_clean, "
        "coalesce(rule_counts, '{}') AS rule_counts, "
        "(SELECT count(DISTINCT rule) FROM examples e WHERE e.context = t.context) AS rules_with_examples, "
        "(SELECT count(*) FROM tops p WHERE p.context = t.context) AS top_listed, CAST(7 AS DOUBLE) AS max_tokens "
        "FROM totals t LEFT JOIN maps m ON t.overall = m.overall AND t.context IS NOT DISTINCT FROM m.context"
    ),
    "mentions_quality": (
        "WITH " + checked_mentions(f"SELECT doc_id, 'content' AS field, text FROM ({DOCS})", default_rules(2, 13)) + f" {TOTALS}"
    ),
    "table_verify": ORDERS_STATUS,
    "table_verify_repeated_keys": table_status(
        "SELECT * FROM lineitem", LATER_LINES, "l_orderkey, l_linenumber", f"l_returnflag, l_linestatus, {LINE_REST}"
    ),
    "table_verify_hot_keys": table_status(
        "SELECT * FROM lineitem", LATER_LINES, "l_returnflag, l_linestatus", f"l_orderkey, l_linenumber, {LINE_REST}"
    ),
    "table_verify_by_ranges": "SELECT * FROM ("
    + table_status(_PLAIN_ORDERS, CORRECTED_ORDERS, "o_orderdate, o_orderkey", "o_custkey, o_orderstatus, o_totalprice, o_orderpriority")
    + ") WHERE status <> 'ok'",
    "table_verdict": verdict_of(f"({ORDERS_STATUS})"),
    "checksum_parse": f"WITH {PAGE_LIST} SELECT path, digest FROM listed",
    "checksum_list_roundtrip": (
        "SELECT source || '/' || lang || '/doc ' || doc_id || '.txt' AS path, upper(sha256(text)) AS digest FROM documents"
    ),
    "checksum_verify": f"WITH {PAGE_LIST} SELECT path, status, expected, found FROM compared",
    "checksum_verdict": f"WITH {PAGE_LIST} {verdict_of('compared')}",
    "paths_listed_only": (
        f"WITH {PAGE_LIST} SELECT path FROM listed WHERE path NOT IN (SELECT path FROM on_disk)"
    ),
    "paths_on_both_sides": f"WITH {PAGE_LIST} SELECT path FROM listed WHERE path IN (SELECT path FROM on_disk)",
    "excluded_globs": (
        "WITH p AS (SELECT regexp_extract(url, '^[a-z]+://(.*)$', 1) AS path FROM pages) SELECT path FROM p WHERE NOT "
        "(regexp_matches(path, '(^|/)[^/]*[0-4]$') OR regexp_matches(path, '(^|/)fr/[^/]*$') "
        "OR regexp_matches(path, '(^|/)[^/]*\\.com/[^/][^/]/[^/]*top$') OR regexp_matches(path, '(^|/)[^/a-z][^/]*$'))"
    ),
    "stream_mentions": "WITH " + spans(PLAIN_CONTENT, "doc_id") + f", {inventory()} SELECT * FROM inventory",
    "stream_mentions_restarted": "WITH " + spans(PLAIN_CONTENT, "doc_id") + f", {inventory()} SELECT * FROM inventory",
    "stream_run_metrics": (
        "WITH " + spans(PLAIN_CONTENT, "doc_id") + f", {inventory()}, rows AS (SELECT count(*) AS n FROM documents), "
        "mentions AS (SELECT count(*) AS m FROM inventory) SELECT CAST(3 AS BIGINT) AS batches, n AS rows_observed, n AS rows_committed, "
        "n AS input_rows, m AS mentions_observed, m AS mentions_committed, true AS agrees FROM rows, mentions"
    ),
    "stream_qc_counts": (
        f"WITH {checked_mentions(PLAIN_CONTENT, default_rules(2, 13))}, {COUNTED} SELECT context, overall, rank, rule, rows FROM rule_counts"
    ),
    "file_hashes": (
        "SELECT s_suppkey, CAST(length(s_name) + 1 AS BIGINT) AS length, upper(sha256(s_name || chr(10))) AS digest FROM supplier"
    ),
    "stream_qc_counts_compacted": (
        f"WITH {checked_mentions(PLAIN_CONTENT, default_rules(2, 13))}, {COUNTED} SELECT context, overall, rank, rule, rows FROM rule_counts"
    ),
    "file_hashes": (
        "SELECT s_suppkey, CAST(length(s_name) + 1 AS BIGINT) AS length, upper(sha256(s_name || chr(10))) AS digest FROM supplier"
    ),
    "named_file_hashes": "SELECT s_suppkey, upper(sha256(s_name || chr(10))) AS digest FROM supplier",
    "files_verified": "SELECT s_suppkey, 'ok' AS status FROM supplier",
    "stream_qc_totals": (
        f"WITH {checked_mentions(PLAIN_CONTENT, default_rules(2, 13))} SELECT context, count(*) AS rows_total, "
        "count(*) FILTER (WHERE len(rules) > 0) AS rows_flagged, count(*) FILTER (WHERE len(rules) = 0) AS rows_clean "
        "FROM checked GROUP BY context"
    ),
}
