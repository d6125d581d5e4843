"""Filter audit and Merkle manifest against plain statements of their rules."""

import random
from hashlib import sha256
from itertools import permutations

import pytest

from nomenroll.llm import filter_audit, merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, mask int, block string"


def enc(value):
    text = None if value is None else str(value).encode()
    return "-" if text is None else f"{len(text)}:{text.decode()}"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def up(level):
    return [h(*level[i : i + 2]) for i in range(0, len(level), 2)]


def proof(leaves, at, start):
    """(siblings, fold of start) up to the single node over ``leaves``."""
    siblings, node, level = [], start, leaves
    while len(level) > 1:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        other = run[1 - at % 2 :][:1] if at % 2 == 0 else run[:1]
        siblings += other
        node = h(*(other + [node] if at % 2 else [node] + other))
        level, at = up(level), at // 2
    return siblings, node


def top(level):
    while len(level) > 1:
        level = up(level)
    return level[0]


def manifest_brute(rows, wrong):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(enc, r[:5])), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        tops[g] = top([x[2] for x in groups[g]])
    subroots = [tops[g] for g in order]
    root = top(subroots)
    result = []
    for at, g in enumerate(order):
        leaves = [x[2] for x in groups[g]]
        for i, (_, _, leaf, r) in enumerate(groups[g]):
            shown = h(enc(r[0]), enc(r[1]), enc(r[2]), enc(r[3] + 1), enc(r[4])) if wrong(r[0]) and r[3] is not None else leaf
            own, node = proof(leaves, i, shown)
            more, node = proof(subroots, at, node)
            result.append((r[0], leaf, tops[g], root, h(*own, *more), node, node == root))
    return sorted(result, key=str)


def manifest_spark(spark, rows, wrong):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, DOCS).repartition(3)
    changed = F.when(F.coalesce(wrong(F.col("doc_id")), F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    shown = merkle.leaf_digest(*[changed if c == "n_chars" else F.col(c) for c in FIELDS])
    found = merkle.verified(merkle.manifest(table, "doc_id", "lang", FIELDS, shown), "doc_id").collect()
    return sorted([tuple(r) for r in found], key=str)


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rng = random.Random(bits)
    rows = [(i, rng.choice(["s", None]), rng.choice(["de", "fr", "é", None, "hot", "hot", "hot"]), rng.choice([5, None]), "é" * rng.randint(0, 3), "x", 1, "y") for i in range(61)]
    rows += [(7, None, "one", 1, None, "x", 1, "y"), (None, None, None, None, None, None, None, None), (None, "s", "hot", 2, "z", "", 0, "")]
    rows += [(3, "s", "hot", 4, "same", "a", 1, "b")] * 9 + [(3, "s", "hot", 5, "other", "a", 1, "b")]
    wrong = lambda i: i is not None and i % 3 == 0
    expected = manifest_brute(rows, wrong)
    assert manifest_spark(spark, rows, lambda c: c % 3 == 0) == expected
    assert {r[-1] for r in expected} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 257])
def test_sizes(spark, n):
    rows = [(i, "s", "en", 1, "t", None, None, None) for i in range(n)]
    assert manifest_spark(spark, rows, lambda c: c < 0) == manifest_brute(rows, lambda i: False)


def test_empty(spark):
    table = spark.createDataFrame([], DOCS)
    found = merkle.verified(merkle.manifest(table, "doc_id", "lang", FIELDS), "doc_id")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and found.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(table, labels).count() == 0


def test_manifest_joins_counts_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = [(i % 50, "s", "ab"[i % 2], 1, "t", None, None, None) for i in range(90)]
    assert manifest_spark(spark, rows, lambda c: c < 0) == manifest_brute(rows, lambda i: False)


def fails(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def audit_brute(rows, labels):
    marks = {}
    for i, q, t in labels:
        a = marks.setdefault(i, [0, 0])
        a[0], a[1] = max(a[0], q or 0), max(a[1], t or 0)
    marked = []
    for r in rows:
        text = r[4] or ""
        f = fails(text)
        f["E"] = r[0] is not None and any(x[0] is not None and x[0] < r[0] and (x[4] or "") == text for x in rows)
        marked.append((r[1] or "", f, *(marks.get(r[0], [0, 0]) if r[0] is not None else [0, 0])))
    result, removed_by = [], {}
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order):
                out = [m for m in left if m[1][letter]]
                left_after = [m for m in left if not m[1][letter]]
                redundant = sum(m[1][letter] for m in own) - len(out)
                unique = sum(m[1][letter] and sum(m[1].values()) == 1 for m in own)
                result.append([part, "".join(order), step + 1, len(left_after), len(out), redundant, unique, sum(m[2] == 1 for m in out), sum(m[3] == 1 for m in out), letter])
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(out)
                left = left_after
    return sorted([*r[:-1], removed_by[r[0], r[-1]]] for r in result)


@pytest.mark.parametrize("broadcast_blocks", [1 << 17, 0])
def test_audit(spark, broadcast_blocks):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "c#", "ünder", "x"] + [f"w{i}" for i in range(90)]
    texts = [rng.choice([" ", "\n\t", "  ", " "]).join(rng.choices(vocabulary, k=rng.choice([3, 49, 50, 51, 80, 80]))) for _ in range(25)]
    texts += ["ABC " * 60, "", None, " \t", "long " * 30_000, " a" * 50]
    rows = [(i, rng.choice(["s", "t", None, ""]), None, None, rng.choice(texts), None, None, None) for i in range(110)]
    rows += [(None, "s", None, None, texts[0], None, None, None)] * 2 + [(5, "t", None, None, texts[1], None, None, None)] * 3 + [(5, "t", None, None, texts[2], None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    marks = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, source string")
    counts = filter_audit.masks(table, marks, broadcast_blocks=broadcast_blocks)
    found = filter_audit.interactions(counts, "ABCDE")
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(list(r) for r in found.collect()) == audit_brute(rows, labels)


def test_sketch_clears_unique_texts(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select((F.col("id") % 3900).cast("string").alias("text"))
    keyed = rows.select("text", *[c.alias(n) for n, c in filter_audit.sketch_keys(F.col("text"), filter_audit.block_count(4000)).items()])
    left = filter_audit.possible_repeats(keyed, filter_audit.sketch(keyed)).groupBy("text").count().collect()
    assert sum(r["count"] == 2 for r in left) == 100 and len(left) < 140
    assert [filter_audit.block_count(n) for n in (0, 1, 256, 257, 513, 1024, 1025)] == [1, 1, 1, 2, 4, 4, 8]
