"""The pipeline's stages against plain statements, with repeated ids and columns named like the operators' own."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from nomenroll.llm import quality, toxicity
from nomenroll.llm.common import read

DATA = "/root/testdata/sf0.001"
CLASHING = {"score": 7.0, "predicted": False, "held_out": "mine", "n_lines": -3, "n_removed": "r", "component_id": 1}


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_clashing_columns_pass_through(spark):
    docs = read(spark, DATA, "documents").withColumns({k: F.lit(v) for k, v in CLASHING.items()}).cache()
    labels = read(spark, DATA, "labels")
    toxic = {r.doc_id for r in toxicity.classify(docs.select("doc_id", "text"), labels).filter("predicted = 1").collect()}
    good = {r.doc_id for r in quality.classify(docs.select("doc_id", "text"), labels).filter("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES[:4]:
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns
        for r in found.collect():
            kept = [c for c in docs.columns if name != "line_dedup" or c not in ("text", "n_chars")]
            assert all(r[c] == rows[r.doc_id][c] for c in kept)
    assert {r.doc_id for r in P.drop_toxic(spark, docs, DATA).collect()} == set(rows) - toxic
    assert {r.doc_id for r in P.keep_quality(spark, docs, DATA).collect()} == good


def test_groups_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda a, n=60: " ".join(words[a : a + n])
    rows = [(5, text(0)), (3, text(0) + " tail"), (5, text(100)), (5, text(100)), (9, text(200)), (2, ""), (2, None), (None, text(0)), (None, text(0)), (7, text(0, 59)), (1, text(300))]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    found = sorted(((r.doc_id, r.text) for r in P.one_of_each_group(spark, docs, DATA).collect()), key=str)
    # brute force over all rows with an id
    known = [r for r in rows if r[0] is not None]
    sets = [shingles(t) for _, t in known]
    group = list(range(len(known)))
    for _ in known:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    expected = [min((r for r, g in zip(known, group) if g == k), key=lambda r: r[0]) for k in set(group)]
    assert found == sorted(expected + [r for r in rows if r[0] is None], key=str)
    assert len(found) == 8
