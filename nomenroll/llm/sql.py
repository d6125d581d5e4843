"""The corpus queries in DuckDB SQL, where SQL can express them and is fast enough on whole tables."""

from __future__ import annotations

from nomenroll.llm.queries import CONTROL_TEXT, URL_RULES

_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in URL_RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A leaf's digest in SQL, of the number of characters given.
_FIELDS = [
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END"
    for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({n_chars} AS VARCHAR)", "text")
]
_LEAF = "sha256(" + " || ".join(_FIELDS) + ")"
#: crc32 of the decimal id, bit by bit over the reversed polynomial.
_CRC32 = """xor(4294967295, list_reduce(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1))),
    CAST(4294967295 AS BIGINT)))"""

ORACLES: dict[str, str] = {
    "op5_url_filters": f"""
        WITH rules(rule_host, rule_path, action) AS (VALUES {_RULE_ROWS}),
        cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parts AS (
            SELECT page_id, url, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM cut
        ),
        fits AS (
            SELECT page_id, host, path, rule_host || rule_path AS rule, action,
                   row_number() OVER (PARTITION BY page_id, host, path, url ORDER BY length(rule_host || rule_path) DESC) AS n
            FROM parts LEFT JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE n = 1
    """,
    "op6_line_dedup": """
        WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        placed AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM cut),
        filled AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS line FROM placed WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
        wins AS (
            SELECT * FROM (
                SELECT doc_id, i AS first, lead(i, 2) OVER w AS last, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
                FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
            ) WHERE last IS NOT NULL
        ),
        later AS (
            SELECT doc_id, first, last FROM (
                SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) AS n FROM wins
            ) WHERE n > 1
        ),
        covered AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
        marked AS (SELECT p.doc_id, p.i, p.line, c.i IS NOT NULL AS gone FROM placed p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i),
        merged AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN m.text END AS text,
               coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN merged m USING (doc_id)
    """,
    "op11_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT * FROM (VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))
        ),
        cut AS (
            SELECT *, sha256(role || chr(10) || text) AS tie,
                   length('<|im_start|>' || regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '<(\\\\*)\\|', '<\\1\\\\|', 'g')
                          || chr(10) || regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') || '<|im_end|>' || chr(10)) AS size
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(size) AS BIGINT) AS formatted_chars
        FROM cut GROUP BY conv_id
    """,
    "op12_filter_audit": """
        WITH RECURSIVE letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders(filter_order, used) AS (
            SELECT '', 0
            UNION ALL
            SELECT filter_order || letter, used + bit FROM orders, letters WHERE used & bit = 0
        ),
        steps AS (
            SELECT filter_order, CAST(i AS INTEGER) AS step, l.bit AS own,
                   (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE strpos(filter_order, p.letter) < i) AS prior
            FROM orders, range(1, 6) r(i), letters l WHERE length(filter_order) = 5 AND l.letter = substr(filter_order, i, 1)
        ),
        graded AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        facts AS (
            SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                   min(doc_id) OVER (PARTITION BY text) AS first FROM texts
        ),
        failed AS (
            SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
                   CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN f.doc_id > first THEN 16 ELSE 0 END AS mask
            FROM facts f LEFT JOIN graded g ON f.doc_id = g.doc_id
        ),
        counts AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, mask
        )
        SELECT part, filter_order, step,
               CAST(coalesce(sum(n) FILTER (mask & (own + prior) = 0), 0) AS BIGINT) AS kept,
               CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS removed,
               CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior <> 0), 0) AS BIGINT) AS redundant,
               CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS good_lost,
               CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior = 0), 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM counts, steps GROUP BY part, filter_order, step, own
    """,
    "op13_merkle": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, coalesce('+' || lang, '') AS grp, {_LEAF.format(n_chars="n_chars")} AS leaf,
                   CASE WHEN {_CRC32} % 7 = 0 THEN {_LEAF.format(n_chars="(n_chars + 1)")} ELSE {_LEAF.format(n_chars="n_chars")} END AS presented
            FROM documents
        ),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM leaves
        ),
        nodes(grp, level, i, n, digest) AS (
            SELECT grp, 0, i, n, leaf FROM numbered
            UNION ALL
            SELECT grp, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY grp, level, i // 2, n
        ),
        tops AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
        upper(level, i, n, digest) AS (
            SELECT 0, i, n, digest FROM tops
            UNION ALL
            SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 2, n
        ),
        folds(doc_id, grp, leaf, i, n, level, node, proof) AS (
            SELECT doc_id, grp, leaf, i, n, 0, presented, '' FROM numbered
            UNION ALL
            SELECT doc_id, f.grp, leaf, f.i // 2, (f.n + 1) // 2, f.level + 1,
                   sha256(CASE WHEN f.i % 2 = 1 THEN s.digest || node ELSE node || coalesce(s.digest, '') END), proof || coalesce(s.digest, '')
            FROM folds f LEFT JOIN nodes s ON s.grp = f.grp AND s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1
        ),
        ends(doc_id, grp, leaf, subroot, i, n, level, node, proof) AS (
            SELECT doc_id, f.grp, leaf, t.digest, t.i, t.n, 0, node, proof FROM folds f JOIN tops t ON f.grp = t.grp WHERE f.n = 1
            UNION ALL
            SELECT doc_id, e.grp, leaf, subroot, e.i // 2, (e.n + 1) // 2, e.level + 1,
                   sha256(CASE WHEN e.i % 2 = 1 THEN s.digest || node ELSE node || coalesce(s.digest, '') END), proof || coalesce(s.digest, '')
            FROM ends e LEFT JOIN upper s ON s.level = e.level AND s.i = xor(e.i, 1) WHERE e.n > 1
        )
        SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = u.digest AS verified
        FROM ends JOIN upper u ON u.n = 1 WHERE ends.n = 1
    """,
}
