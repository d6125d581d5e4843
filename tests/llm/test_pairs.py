"""Joins on pairs against brute force over all pairs: shingle sets, vectors, components."""

import random

import numpy as np
import pytest

from nomenroll.llm import embedding_dedup, ngram_join
from nomenroll.llm.common import components


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def shingle_set(text, size):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5040)]
    table = spark.createDataFrame(links + links[:5] + [(None, 1), (7, 7)], "a long, b long")
    nodes = {x for a, b in links if a != b for x in (a, b)}
    found = {r.node: r.component for r in components(table).collect()}
    assert found == closure(nodes, links)
    assert components(table.limit(0)).count() == 0


def near_copies(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 7, 15, 40, 120]))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("size, num", [(4, 85), (5, 80)])
def test_similar_sets(spark, size, num):
    rng = random.Random(size)
    texts = [None, "", " \t", "One\x0btwo", "one TWO", "É é", "a\x1cb", "a b"] + near_copies(rng, 70)
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(6)
    sets = [shingle_set(t, size) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    expected = closure(range(len(sets)), links)
    degree = np.bincount([x for pair in links for x in pair], minlength=len(sets))
    rows = ngram_join.similar_sets(table, size=size, num=num).collect()
    assert len(links) > 10 and len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.n_links) == (len(sets[r.doc_id]), expected[r.doc_id], degree[r.doc_id]), texts[r.doc_id]


@pytest.mark.parametrize("deletions", [False, True])
def test_signatures_miss_no_pair(deletions):
    rng = np.random.default_rng(3)
    bands = ngram_join.Bands(85, 100, 5000)
    bands.deletions = [deletions] * len(bands.deletions)
    missed = checked = 0
    for _ in range(1500):
        n = int(rng.integers(6, 400))
        whole = rng.integers(0, 1 << 63, n + 60, dtype=np.uint64)
        a = np.unique(whole[:n])
        gone = rng.integers(0, max(1, int(n * 0.17)) + 1)
        extra = rng.integers(0, int(n * 0.17) + 1)
        b = np.unique(np.concatenate([a[gone:], whole[n : n + extra]]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
            checked += 1
            missed += not len(np.intersect1d(bands.signatures(a), bands.signatures(b)))
    assert checked > 300 and missed == 0


def test_blocks_and_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(ngram_join, "BUCKET_SIGNATURES", 500)
    monkeypatch.setattr(ngram_join, "CHUNK_SIGNATURES", 300)
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnop") * 2 for _ in range(50)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(50)] = rng.choice("xyz")
        texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[0]) for i in range(20)] + [(None, texts[0]), (3, texts[3])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: shingle_set(t, 4) for i, t in rows if i is not None}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    expected = closure(sets, links)
    found = ngram_join.similar_sets(table).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
    assert ngram_join.similar_sets(table.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((30, 16))
    rows = []
    for i in range(700):
        v = centres[i % 30] + rng.standard_normal(16) * (0.12 if i % 3 else 0.6)
        rows.append((i, [float(x) for x in v.astype(np.float32)], "x"))
    rows += [(1000 + i, rows[5][1], "x") for i in range(150)]  # copies beyond any window
    good = list(rows)
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (2005, [None] + [1.0] * 15), (None, rows[0][1])]
    other = [(3000, [1.0, 2.0]), (3001, [2.0, 4.0]), (3002, [-1.0, 0.0])]
    table = spark.createDataFrame(rows + [(*r, "x") for r in odd + other], "vec_id long, embedding array<float>, n_links string").repartition(5)
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, window=16, block=64).collect()}
    assert len(found) == table.count()
    ids = [i for i, _, _ in good]
    u = np.array([v for _, v, _ in good], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    exact = closure(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near)))])
    pairs = near.sum()
    counted = sum(found[i].n_links for i in ids)
    assert 0.95 * pairs <= counted <= pairs
    assert all(found[i].n_links <= near[k].sum() for k, i in enumerate(ids))
    assert sum(found[i].component_id == exact[i] for i in ids) >= 0.95 * len(ids)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found.values())
    for i, _ in odd:
        assert (found[i].n_links, found[i].component_id) == (0, i)
    assert [found[i].component_id for i, _ in other] == [3000, 3000, 3002] and found[3001].n_links == 1
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_pairs_in_dense_regions_are_found(spark):
    rng = np.random.default_rng(11)
    n, size = 12_000, 64

    def direction(shape):
        x = rng.standard_normal(shape)
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    vectors = direction((n, size))
    centre = direction(size)
    dense = slice(0, n // 3)  # mutual cosine of 0.8
    vectors[dense] = np.sqrt(0.8) * centre + np.sqrt(0.2) * direction((n // 3, size))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    pairs = []
    for k in range(200):
        a, b = 2 * k, n - 1 - k  # the partner replaces an evenly spread vector
        off = direction(size)
        off -= (off @ vectors[a]) * vectors[a]
        vectors[b] = 0.905 * vectors[a] + np.sqrt(1 - 0.905**2) * off / np.linalg.norm(off)
        pairs.append((a, b))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    found = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(table).collect()}
    assert np.mean([found[a] == found[b] for a, b in pairs]) >= 0.95


def test_vectors_that_share_an_id(spark):
    rng = np.random.default_rng(4)
    near = lambda v: (v + rng.normal(0, 0.02, 16)).tolist()
    a, b, c = (rng.normal(0, 1, 16) for _ in range(3))
    rows = [(5, near(a)), (5, near(a)), (9, near(a)), (5, b.tolist()), (7, b.tolist()), (5, c.tolist()), (2, near(a))]
    rows += [(100 + i, rng.normal(0, 1, 16).tolist()) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vectors = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    linked = [[i != j and float(x @ y) >= 0.9 for j, y in enumerate(vectors)] for i, x in enumerate(vectors)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in range(len(rows)) if linked[i][j])]) for i in range(len(rows))]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    want = sorted((rows[i][0], sum(linked[i]), least[group[i]], rows[i][0] == least[group[i]]) for i in range(len(rows)))
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(table).collect()) == want
    assert want.count((5, 3, 2, False)) == 2 and (5, 1, 5, True) in want and (5, 0, 5, True) in want


def test_word_hashes_are_of_words():
    rng, seen = random.Random(6), {}
    texts = ["", " \t\n\x0b\x0c\r", "a", " a ", "A b\u00a0c \u2003 É é", "x\x1fy \x1c", "ab ba a b", "z" * 70_000, "z" * 16_384 + "a", "z" * 32_768 + "a"]
    texts += ["".join(rng.choice("abAB é\n漢") for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in texts:
        words = text.encode().lower().split()
        found = ngram_join.word_hashes(text.encode()).tolist()
        assert len(found) == len(words)
        for word, number in zip(words, found):
            assert seen.setdefault(word, number) == number
    assert len(set(seen.values())) == len(seen) > 300
