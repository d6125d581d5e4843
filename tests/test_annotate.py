import random
import re

import pytest
from pyspark.sql import functions as F

from nomenroll.functions.spans import entities_json, parse_entities, running_sums
from nomenroll.operators import gazetteer as G
from nomenroll.operators.annotate import model_annotator, pattern_annotator
from nomenroll.operators.mentions import (
    classes_present,
    dropped_types,
    explode_spans,
    mention_counts,
    mentions,
    mentions_from_json,
    single_class,
    with_inventory_names,
)

ORDER = {"PER": 0, "LOC": 1, "ORG": 2, "FAC": 3, "PRO": 4, "EVENT": 5}


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def as_tuples(spans):
    return [tuple(s) for s in spans]


@pytest.mark.parametrize("length", [0, 1, 255, 256, 257, 1000, 5000])
def test_running_sums_across_blocks(spark, length):
    numbers = [(i * 7) % 13 for i in range(length)]
    frame = spark.createDataFrame([(numbers,)], "n array<int>")
    totals, sums = 0, []
    for n in numbers:
        totals += n
        sums.append(totals)
    assert frame.select(running_sums(F.col("n"))).first()[0] == sums


def test_pattern_spans_agree_with_finditer(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("Ab c1😀ی") for _ in range(rng.randrange(200))) for _ in range(200)] + ["", "A" * 3000]
    patterns = {"PER": "A[b1]*", "DATE": "[0-9]+", "loc": "c"}
    got = docs(spark, texts).select("doc_id", pattern_annotator(patterns)("text").alias("s")).orderBy("doc_id").collect()
    for text, row in zip(texts, got):
        want = [
            (m.group(), kind, m.start(), m.end()) for kind, rx in patterns.items() for m in re.finditer(rx, text)
        ]
        want.sort(key=lambda s: (s[2], -s[3], list(patterns).index(s[1])))
        assert as_tuples(row.s) == want


def test_spans_are_sorted_without_a_comparator(spark):
    frame = docs(spark, ["ab a b", "", None, "ba" * 700])
    found = frame.select("doc_id", pattern_annotator({"PER": "a", "LOC": "ab?", "ORG": "b"})("text").alias("s"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan  # which evaluates an expression for each two spans
    rows = {r.doc_id: as_tuples(r.s) for r in found.collect()}
    assert rows[0] == [("ab", "LOC", 0, 2), ("a", "PER", 0, 1), ("b", "ORG", 1, 2), ("a", "PER", 3, 4), ("a", "LOC", 3, 4), ("b", "ORG", 5, 6)]
    assert rows[1] == rows[2] == [] and [s[2] for s in rows[3]] == sorted(s[2] for s in rows[3]) and len(rows[3]) == 2100


def test_null_text_has_no_spans(spark):
    frame = docs(spark, [None])
    assert frame.select(pattern_annotator({"PER": "a"})("text").alias("s")).first().s == []
    assert frame.select(pattern_annotator({"PER": "a", "LOC": "b"})("text").alias("s")).first().s == []


def upper_words():
    """A model factory; local functions travel to the workers by value."""

    def factory():
        rx = re.compile(r"[A-Z]\w*")

        def run(text):
            if not text:
                raise AssertionError("empty text must not reach the model")
            return [(m.group(), "PER", m.start(), m.end()) for m in rx.finditer(text)]

        return run

    return factory


def test_model_annotator(spark):
    frame = docs(spark, ["Ada and Bo", "", None, "x", "😀 Cy"]).repartition(3)
    got = frame.select("doc_id", model_annotator(upper_words())("text").alias("s")).orderBy("doc_id").collect()
    assert [as_tuples(r.s) for r in got] == [
        [("Ada", "PER", 0, 3), ("Bo", "PER", 8, 10)],
        [],
        [],
        [],
        [("Cy", "PER", 2, 4)],
    ]


def test_batches_and_one_model_per_process(spark, path):
    import os

    os.makedirs(path)

    def factory():
        import uuid

        open(f"{path}/{os.getpid()}-{uuid.uuid4()}", "w").close()

        def run(texts):
            assert 0 < len(texts) <= 3 and all(texts)
            return [[(t, "PER", 0, len(t))] for t in texts]

        return run

    frame = docs(spark, ["a", None, "bb", "", *["c"] * 20]).repartition(12)
    annotate = model_annotator(factory, batch_size=3, batched=True)
    rows = frame.select("text", annotate("text").alias("s")).collect()
    assert [[s.text for s in r.s] for r in rows] == [[r.text] if r.text else [] for r in rows]
    processes = [name.split("-")[0] for name in os.listdir(path)]
    assert len(processes) == len(set(processes)) < 12


def test_model_annotator_sends_only_the_text_to_python(spark):
    frame = docs(spark, ["Ada"]).withColumn("other", F.upper("text"))
    plan = frame.select("doc_id", "other", model_annotator(upper_words())("text").alias("s"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [annotate(text" in text


def greedy(text, entries):
    """Leftmost, then longest, at word boundaries, one character at a time."""
    out, at = [], 0
    while at < len(text):
        fits = [
            s for s in entries
            if text.startswith(s, at) and (at == 0 or text[at - 1] == " ") and text[at + len(s):][:1] in ("", " ")
        ]
        if fits:
            best = max(fits, key=len)
            out.append((best, entries[best], at, at + len(best)))
            at += len(best)
        else:
            at += 1
    return out


def test_gazetteer_agrees_with_brute_force(spark, monkeypatch):
    # small windows, so that surfaces cross every kind of border
    monkeypatch.setattr(G, "WINDOWS", (256, 64, 16))
    rng = random.Random(5)
    words = ["a", "b", "ab", "ba", "cc", "😀", "شهر", "longerword"]
    surfaces = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(25)}
    entries = {s: rng.choice(list(ORDER)) for s in surfaces}
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += ["", "a", " ".join(["a b"] * 500)]
    book = G.build_gazetteer(spark.createDataFrame(list(entries.items()), "surface string, type string"))
    got = {i: [] for i in range(len(texts))}
    for row in G.gazetteer_spans(docs(spark, texts), ["doc_id"], "text", book).collect():
        got[row.doc_id].append((row.text, row.type, row.start_char, row.end_char))
    for i, text in enumerate(texts):
        assert sorted(got[i], key=lambda s: s[2]) == greedy(text, entries)


def test_texts_in_pieces_have_the_spans_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "WINDOWS", (256, 64, 16))
    rng = random.Random(8)
    words = ["a", "b", "ab", "cc", "😀", "longerword"]
    entries = {" ".join(rng.choice(words) for _ in range(n)): "PER" for n in (1, 2, 2, 3, 4, 4, 6)}
    book = G.build_gazetteer(spark.createDataFrame(list(entries.items()), "surface string, type string"))
    wholes, rows = [], []
    for i in range(4):
        pieces = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 3, 90]))) for _ in range(60)]
        starts = [sum(len(p) + 1 for p in pieces[:n]) for n in range(len(pieces))]
        rows += [(i, at, piece) for at, piece in zip(starts, pieces)]
        wholes.append(" ".join(pieces))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id int, at long, text string")
    got = {tuple(r) for r in G.gazetteer_spans(frame, ["doc_id"], "text", book, at="at").collect()}
    assert got == {tuple(r) for r in G.gazetteer_spans(docs(spark, wholes), ["doc_id"], "text", book).collect()}
    assert got == {(i, *s) for i, whole in enumerate(wholes) for s in greedy(whole, entries)}


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}])
def test_offsets_beyond_integers(spark, limits):
    """Pieces of a text behind its first 2^31 characters: overlaps are resolved there as anywhere."""
    first, fill = 1 << 31, "- " * 400
    pieces = [fill + "New York Ada", "Lovelace in New York City", fill + "Ada"]
    starts = [first + sum(len(p) + 1 for p in pieces[:n]) for n in range(len(pieces))]
    book = {"New York": "LOC", "York Ada": "PER", "Ada": "PER", "Ada Lovelace": "PER", "New York City": "LOC"}
    entries = G.build_gazetteer(spark.createDataFrame(list(book.items()), "surface string, type string"), **limits)
    frame = spark.createDataFrame(list(zip([0] * 3, starts, pieces)), "doc_id int, at long, text string")
    spans = G.gazetteer_spans(frame, ["doc_id"], "text", entries, at="at")
    assert dict(spans.dtypes)["start_char"] == dict(spans.dtypes)["end_char"] == "bigint"
    got = sorted(tuple(r)[1:] for r in spans.collect())
    assert got == sorted((t, k, first + b, first + e) for t, k, b, e in greedy(" ".join(pieces), book))


def test_only_words_that_begin_a_surface_meet_a_large_gazetteer(spark):
    book = G.build_gazetteer(spark.createDataFrame([("New York", "LOC"), ("Ada", "PER")], "surface string, type string"), broadcast_bytes=0, filter_bytes=0)
    words = G._words(docs(spark, ["in New York Ada met a new friend"]), ["doc_id"], F.col("text"), book.max_chars + 2)
    assert (words.count(), G._with_known_heads(words, book).count()) == (9, 2)  # with the empty one after the last space


def test_one_text_is_never_in_one_row(spark, path, monkeypatch):
    from nomenroll.catalog import inputs

    monkeypatch.setattr(inputs, "DOCUMENTS_PER_PART", 5)
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(20)]), rng.choice([None, "", " a  b ", "c", "longer text\nof four"])) for _ in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = inputs.one_text(spark, path).orderBy("at").collect()
    kept = sorted(((-1 if k is None else k), " ".join(t.split())) for k, t in rows if t is not None)
    assert len(got) == len(kept) and " ".join(r.text for r in got) == " ".join(t for _, t in kept)
    assert [r.at for r in got] == [sum(len(t) + 1 for _, t in kept[:n]) for n in range(len(kept))]


@pytest.mark.parametrize("limit", [0, 60, 10**9])
def test_gazetteer_is_the_same_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(G, "BROADCAST_BYTES", limit)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries = [("New York", "LOC"), ("York", "PER"), ("New York Times", "ORG"), (" York ", "LOC"), ("", "PER")]
        book = G.build_gazetteer(spark.createDataFrame(entries, "surface string, type string"))
        assert (book.token_counts, book.max_chars) == ((1, 2, 3), 14)
        frame = docs(spark, ["The New York Times of New York", "York York"])
        spans = G.gazetteer_spans(frame, ["doc_id"], "text", book)
        got = sorted(tuple(r) for r in spans.collect())
        assert got == [
            (0, "New York", "LOC", 22, 30),
            (0, "New York Times", "ORG", 4, 18),
            (1, "York", "PER", 0, 4),
            (1, "York", "PER", 5, 9),
        ]
        plan = spans._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin [surface" in plan) == (limit > 1000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_gazetteer(spark):
    book = G.build_gazetteer(spark.createDataFrame([], "surface string, type string"))
    assert G.gazetteer_spans(docs(spark, ["a b"]), ["doc_id"], "text", book).count() == 0


def test_overlap_golden(spark):
    found = [("a", "LOC", 0, 5), ("b", "ORG", 0, 9), ("c", "PER", 6, 9), ("d", "PER", 10, 12)]
    rows = spark.createDataFrame([(1, *f) for f in found], "k int, text string, type string, start_char int, end_char int")
    got = sorted(tuple(r)[1:] for r in G.resolve_overlaps(rows, ["k"]).collect())
    assert got == [("b", "ORG", 0, 9), ("d", "PER", 10, 12)]


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 16])
def test_overlaps_agree_with_plain_greedy(spark, part):
    rng = random.Random(11)
    rows = []
    for k in range(120):
        for _ in range(rng.randrange(40)):
            start = rng.randrange(150)
            rows.append((k, "t", rng.choice(list(ORDER)), start, start + rng.randrange(1, 15)))
    rows += [(999, "t", "PER", i, i + 2) for i in range(3000)]  # one island of 3000 matches
    frame = spark.createDataFrame(rows, "k int, text string, type string, start_char int, end_char int")
    got = sorted((r.k, r.type, r.start_char, r.end_char) for r in G.resolve_overlaps(frame, ["k"], part).collect())
    want = []
    for k in {r[0] for r in rows}:
        free = 0
        for _, _, kind, start, end in sorted((r for r in rows if r[0] == k), key=lambda r: (r[3], -r[4], ORDER[r[2]])):
            if start >= free:
                want.append((k, kind, start, end))
                free = end
    assert got == sorted(want)


def test_parts_of_a_document_are_resolved_apart(spark, path):
    # one document; every hundred characters an island of three matches, every tenth of them across two parts
    start = F.floor(F.col("id") / 3) * 100 + 97 + F.col("id") % 3 * 2
    rows = spark.range(30_000).select(
        (F.col("id") * 0).cast("int").alias("k"), F.lit("t").alias("text"), F.lit("PER").alias("type"), start.cast("int").alias("start_char"), (start + 3).cast("int").alias("end_char")
    )
    rows.write.parquet(path)
    resolved = G.resolve_overlaps(spark.read.parquet(path), ["k"], 1000)
    assert len(resolved.collect()) == 20_000
    plan = resolved._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the matches are shuffled once, by document and part; what goes on by document alone are open islands
    assert len(re.findall(r"- Exchange hashpartitioning\(k#\d+, part#", plan)) == 1 and "ReusedExchange" in plan
    assert rows.groupBy("k", F.floor(F.col("start_char") / 1000)).count().agg(F.max("count")).first()[0] <= 32


@pytest.mark.parametrize("text", ["", "a", "ab 12 cd", "12", "12 34", "x\x0112 y\x01", "\x01", "é😀12", "12 " * 3000, None])
def test_pattern_spans_in_one_pass(spark, text):
    found = docs(spark, [text]).select(pattern_annotator({"N": "[0-9]+"})(F.col("text")).alias("s")).first().s
    want = [(m.group(), "N", m.start(), m.end()) for m in re.finditer("[0-9]+", text or "")]
    assert [tuple(s) for s in found] == want


@pytest.mark.parametrize("limit", [200, 1000, None])
def test_membership_filter(spark, limit):
    rng = random.Random(8)
    known = [f"w{i} v{i}" for i in range(300)]
    book = G.build_gazetteer(spark.createDataFrame([(x, "PER") for x in known], "surface string, type string"), broadcast_bytes=0, filter_bytes=limit)
    assert G.filter_blocks(book) == {200: 1, 1000: 5, None: 8}[limit]
    other = [f"w{i} v{i + 1}" for i in range(5000)]
    ngrams = spark.createDataFrame([(x,) for x in known + other], "surface string")
    left = {r.surface for r in G.possible_surfaces(ngrams, book).collect()}
    assert set(known) <= left and (limit is not None or len(left) < 300 + 150)
    texts = [" ".join(rng.choice(known + other) for _ in range(30)) for _ in range(40)]
    entries = dict.fromkeys(known, "PER")
    found = sorted(tuple(r) for r in G.gazetteer_spans(docs(spark, texts), ["doc_id"], "text", book).collect())
    assert found == sorted((i, *s) for i, text in enumerate(texts) for s in greedy(text, entries))


def spans_frame(spark):
    rows = [
        (1, [("Ada", "per", 0, 3), (" ", "PER", 4, 5), ("x", "DATE", 6, 7)], [("Rome ", "LOC", 0, 5)]),
        (2, [], [("Ada", "PER", 2, 5), ("Acme", "Company", 9, 13)]),
    ]
    kind = "array<struct<text:string,type:string,start_char:int,end_char:int>>"
    return spark.createDataFrame(rows, f"doc_id int, entities_title {kind}, entities_content {kind}")


FIELDS = {"title": "entities_title", "content": "entities_content"}


def test_mentions_keep_known_classes_and_strip(spark):
    got = sorted(tuple(r) for r in mentions(spans_frame(spark), ["doc_id"], FIELDS).collect())
    assert got == [
        ("LOC", "Rome", 1, "content", 0, 5),
        ("PER", "Ada", 1, "title", 0, 3),
        ("PER", "Ada", 2, "content", 2, 5),
    ]


def test_aliases_and_dropped_types(spark):
    frame = spans_frame(spark)
    found = mentions(frame, ["doc_id"], FIELDS, aliases={"company": "ORG"})
    assert found.filter("entity_class = 'ORG'").count() == 1
    long = explode_spans(frame, ["doc_id"], FIELDS)
    assert {tuple(r) for r in dropped_types(long).collect()} == {("DATE", 1), ("COMPANY", 1)}
    assert {tuple(r) for r in dropped_types(long, {"company": "ORG"}).collect()} == {("DATE", 1)}


def test_json_round_trip(spark):
    frame = spans_frame(spark)
    text = frame.select(entities_json(F.col("entities_title")).alias("j")).collect()
    assert text[1].j == "[]"
    assert text[0].j.startswith('[{"text":"Ada","type":"per","start_char":0,"end_char":3}')
    back = frame.select(parse_entities(entities_json(F.col("entities_title"))).alias("s"), "entities_title").collect()
    assert all(r.s == r.entities_title for r in back)
    jsons = frame.select("doc_id", *[entities_json(F.col(c)).alias(c) for c in FIELDS.values()])
    assert sorted(map(tuple, mentions_from_json(jsons, ["doc_id"], FIELDS).collect())) == sorted(
        map(tuple, mentions(frame, ["doc_id"], FIELDS).collect())
    )


def test_counts_names_and_presence(spark):
    found = mentions(spans_frame(spark), ["doc_id"], FIELDS)
    assert {r.entity_class: r.mentions for r in mention_counts(found).collect()} == {
        "PER": 2, "LOC": 1, "ORG": 0, "FAC": 0, "PRO": 0, "EVENT": 0,
    }
    assert [r.inventory for r in classes_present(found).collect()] == ["loc", "pers"]
    assert {r.entity_column for r in with_inventory_names(found).collect()} == {"pers_entities", "loc_entities"}
    assert single_class(found, "PER").columns == ["pers_entities"]
    with pytest.raises(ValueError, match="unknown class"):
        single_class(found, "DATE")
    with pytest.raises(ValueError, match="entity_class"):
        classes_present(found.drop("entity"))


def test_offsets_of_one_text_widen_when_it_is_long(spark, path, monkeypatch):
    from nomenroll.catalog import inputs, queries

    rows = [(i, f"some words stand here {i} and there") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    length = sum(len(t) + 1 for _, t in rows) - 1
    found = {}
    for last in (length - 1, length):
        monkeypatch.setattr(inputs, "LAST_INTEGER", last)
        found[last] = queries.mentions_one_text(spark, path)
    narrow, wide = found[length], found[length - 1]
    assert [dict(x.dtypes)["end_char"] for x in (narrow, wide)] == ["int", "bigint"]
    assert sorted(narrow.collect()) == sorted(wide.collect()) and narrow.count() > 12
