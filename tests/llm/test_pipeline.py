"""The pipeline's stages, each on its own input."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from nomenroll.llm import ngram_join
from nomenroll.llm.common import read, written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = read(spark, DATA, "documents").unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "a b", "en", "s", 3)], read(spark, DATA, "documents").schema))
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], DATA), name))
    return found


def test_stages(spark, results):
    docs, clean, good, lines, single, packed = results
    assert all(r.columns == docs.columns for r in results[:-1])
    assert docs.count() >= clean.count() >= good.count() == lines.count() >= single.count() > 0
    assert all(r.filter("doc_id is null").count() for r in results[:3])
    before = {r.doc_id: r.text for r in good.collect() if r.doc_id is not None}
    for r in lines.collect():
        if r.doc_id is not None:
            assert r.n_chars == len(r.text) or r.text == before[r.doc_id]
    groups = {r.doc_id: r.component_id for r in ngram_join.similar_sets(lines, size=5, num=80).collect() if r.doc_id is not None}
    assert {r.doc_id for r in single.collect() if r.doc_id is not None} == set(groups.values())
    pieces = packed.toPandas().sort_values(["sequence_id", "offset"])
    sizes = pieces.groupby("sequence_id").length
    assert (sizes.sum() <= 2048).all() and (pieces.offset == sizes.cumsum() - pieces.length).all()
    assert pieces.doc_id.nunique(dropna=False) == single.select("doc_id").distinct().count()


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] for n in names}


def test_empty(spark):
    docs = read(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        assert docs.count() == 0
