"""Line windows against a plain statement of the rule."""

import random

from nomenroll.llm.line_dedup import dedup_lines


def brute(rows):
    """rows: distinct (id, text) in order; text without covered lines."""
    first, result = {}, {}
    for key, text in rows:
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(filled) - 2):
            window = tuple(lines[i].strip(" \t\r") for i in filled[k : k + 3])
            if first.setdefault(window, (key, k)) != (key, k):
                gone |= set(range(filled[k], filled[k + 2] + 1))
        result[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return result


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["a", "b", " c\t", "", "d"]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_lines int, first string").repartition(5)
    rows = {r.doc_id: r for r in dedup_lines(table).collect()}
    expected = brute(list(enumerate(texts)))
    assert {i: r.text for i, r in rows.items()} == expected
    assert all(r.n_lines == len(texts[i].split("\n")) and r["first"] == "x" for i, r in rows.items())
    assert sum(r.n_removed for r in rows.values()) > 50


def test_nulls_repeats_and_empty(spark):
    text = "a\nb\nc\nd"
    rows = [(None, text), (1, None), (1, ""), (2, text), (2, text), (3, "x\n\na\nb\n \nc\ny"), (4, "a\nb")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in dedup_lines(table).collect()), key=str)
    assert found == sorted([(True, 0, "", 4, 4), (False, 1, None, 0, 0), (False, 1, "", 1, 0), (False, 2, text, 4, 0), (False, 2, text, 4, 0), (False, 3, "x\n\ny", 7, 4), (False, 4, "a\nb", 2, 0)], key=str)
    assert dedup_lines(table.limit(0)).count() == 0
