"""Trained operators: held-out accuracy, normalisation, exact base figures; fingerprints against their definition."""

import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from nomenroll.llm import fingerprints, maxent_lm, quality, toxicity
from nomenroll.llm.calibration import Isotonic, Logistic
from nomenroll.llm.common import read, words

DATA = "/root/testdata/sf0.01"


def auc(rows, label):
    pairs = [(r.score, y) for r, y in ((r, label.get(r.doc_id)) for r in rows if r.held_out) if y is not None]
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


def labelled(spark, label):
    return {r.doc_id: r[label] for r in read(spark, DATA, "labels").collect()}


def odd_docs(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "word " * 50_000, 0.5), (None, "a b", 0.5), (4, "x퟿ y", 0.5), (4, "other", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double")


@pytest.mark.parametrize("module, label, modulus, held, cut", [(quality, "quality", 5, 0, 0.3), (toxicity, "toxic", 3, 1, 0.7)])
def test_classifiers(spark, module, label, modulus, held, cut):
    rows = module.classify(read(spark, DATA, "documents"), read(spark, DATA, "labels")).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    truth = labelled(spark, label)
    assert auc(rows, truth) > (0.97 if label == "quality" else 0.9)
    if label == "toxic":
        caught = [truth[r.doc_id] for r in rows if r.held_out and r.predicted and truth.get(r.doc_id) is not None]
        assert sum(caught) >= 12 and len(caught) - sum(caught) <= 1
    labels = spark.createDataFrame([(1, None, None), (9, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    odd = module.classify(odd_docs(spark), labels, keep=["doc_id", "score"])
    assert odd.columns == ["doc_id", "held_out", "score", "predicted"]
    assert odd.count() == 6 and odd.filter("score is null or isnan(score)").count() == 0
    assert module.classify(odd_docs(spark).limit(0), labels.limit(0)).count() == 0


def test_toxic_words_and_unseen_spellings(spark):
    rng = np.random.default_rng(1)
    common = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = []
    for i in range(900):
        text = list(rng.choice(common, 60))
        if i % 3 == 0:
            text[:4] = [f"zorkamat{x}" for x in rng.choice(list("abcdefgh"), 4)]
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model, _ = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    clean, unseen = " ".join(common[:60]), " ".join(common[:56] + ["zorkamatzz", "zorkamatt", "xzorkamat", "zorkamaty"])
    scores = model.calibration(model.raw([clean, unseen, unseen + " " + clean * 20]))
    assert scores[0] < 0.5 and scores[1] > 0.7 and scores[2] > 0.7


@pytest.mark.parametrize("words", [[b"a"], [b"ab"], [b"7", b"b"], [b"abc"], [b"a", b"longer", b"\xc3\xa9"]])
def test_ngrams_of_short_words(words):
    buckets, owners = toxicity.ngrams(words)
    sizes = [len(w) + 2 for w in words]
    assert np.bincount(owners).tolist() == [1 + sum(max(0, s - n + 1) for n in toxicity.SIZES) for s in sizes]
    beside = toxicity.ngrams([*words, b"another"])
    for i in range(len(words)):  # a word has its n-grams whatever stands beside it
        assert sorted(buckets[owners == i]) == sorted(beside[0][beside[1] == i])


def test_texts_that_bring_one_short_word(spark):
    """A single word of one or two bytes, as all of a text or as the only one that a task hasn't seen, in labelled texts and others."""
    base = [f"words of a text with number{i % 7} and more" for i in range(80)]
    texts = [t if i % 4 else f"{t} {'zq' if i % 8 else 'zorka'}{i}" for i, t in enumerate(base)]
    rows = list(enumerate([*texts, "a", "7$", "é", *(f"{base[i]} {c}" for i, c in enumerate("7$xé"))]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 8 == 4)) for i in range(len(rows))], "doc_id long, toxic int")
    found = toxicity.classify(docs, labels)
    assert found.count() == len(rows) and found.filter("score is null or isnan(score)").count() == 0
    kept = toxicity.classify(docs, labels, keep=["doc_id", "text"])
    assert {(r.doc_id, r.text) for r in kept.collect()} == set(rows)


def test_calibration():
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(-3, 3, 4000))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x))).astype(float)
    bins = np.stack([x, y, np.ones_like(x)], axis=1)
    for fitted in (Isotonic(bins), Logistic(bins)):
        p = fitted(x)
        assert (np.diff(p) >= 0).all() and 0 < p.min() and p.max() < 1
        assert np.abs(p - 1 / (1 + np.exp(-2 * x))).mean() < 0.05
    assert Isotonic(np.zeros((0, 3)))(np.array([0.3]))[0] == pytest.approx(0.5, abs=0.01)


@pytest.mark.parametrize("head", [50, 100_000])
def test_language_model(spark, head):
    texts = ["The cat sat.", "the dog sat on the mat", None, "", "the cat\x0bsat\x1fon", "é É zebra"] * 12
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(3, texts[3], 1.0), (None, "the cat", 1.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    found = maxent_lm.scores(table, head_limit=head).collect()
    split = [(i, (t or "").encode().lower().split() + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t, _ in rows]
    counts = Counter(w for _, ws, held in split if not held for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), held, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 9)) for i, ws, held in split
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in found) == expected
    assert all(r.score < 0 for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert maxent_lm.scores(table.limit(0)).count() == 0


def test_language_model_is_a_distribution(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    counts = maxent_lm.word_counts(docs).persist()
    head = maxent_lm.head_of(counts, 20_000)
    model = maxent_lm.train(maxent_lm.encoded(docs, head), counts, head)
    rng = np.random.default_rng(0)
    p = np.exp(model.logits([rng.integers(0, maxent_lm.FEATURES, 50) for _ in range(4)]))
    assert np.isfinite(p).all()
    for last in range(maxent_lm.CLASSES):
        inside = np.bincount(model.classes, weights=np.exp(model.unit_logs[last].astype(np.float64)) * (np.arange(maxent_lm.UNITS + 2) != maxent_lm.START), minlength=maxent_lm.CLASSES)
        assert np.allclose(inside, 1, atol=1e-3)
    own = set(head.lookup()) and {w for w, i in head.lookup().items() if i < maxent_lm.OWN}
    sums = np.ones(maxent_lm.UNITS)
    for r in counts.collect():
        if r.word and bytes(r.word) not in own:
            sums[maxent_lm.ending_unit(bytes(r.word))] += r.n + 1
    assert np.allclose(np.log10(sums), model.inside_logs[: maxent_lm.UNITS])
    counts.unpersist()


@pytest.mark.parametrize("limit", [0, 200, 1_000_000])
def test_language_model_follows_the_words_before(spark, limit):
    rng = np.random.default_rng(5)
    order = rng.permutation(600)
    texts = [" ".join(f"a{i} b{order[i]}" for i in rng.integers(0, 600, 30)) for _ in range(420)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = maxent_lm.scores(table, feature_limit=limit).filter("held_out").collect()
    per_pair = np.mean([r.score for r in found]) / 30
    assert per_pair > -math.log10(600) - 1.2  # a word of 600, then one that is certain; the fixed part alone is 2.4 below


def test_exact_features_of_all_texts(spark):
    texts = ["a b c a b", "a b", None, "zz a b c"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string").repartition(2)
    counts = maxent_lm.word_counts(docs)
    found = maxent_lm.feature_counts(maxent_lm.encoded(docs, maxent_lm.head_of(counts, 2))).collect()
    expected = Counter()
    for t in texts * 3:
        ws = ["<s>"] * 3 + (t or "").split() + ["</s>"]
        for i in range(3, len(ws)):
            for kind, c in enumerate((ws[i - 1], (ws[i - 2], ws[i - 1]), ws[i - 2], ws[i - 3])):
                expected[kind, c] += 1
                expected[kind, c, ws[i]] += 1
            expected[ws[i]] += 1
    assert sorted(r.n for r in found) == sorted(expected.values())


@pytest.mark.parametrize("bits", [0, 3])
def test_packed_features_have_the_counts_of_plain_ones(spark, bits, tmp_path):
    texts = ["a b c a b", "a b", None, "zz a b c", ""] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = maxent_lm.encoded(docs, maxent_lm.head_of(maxent_lm.word_counts(docs), 2))
    maxent_lm.chunked(rows).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    counted = maxent_lm.feature_counts(rows.filter("NOT held_out")).collect()
    plain = {(r.kind, r.key % (1 << 64) >> 64 - maxent_lm.KEY_BITS): r.n for r in counted}
    for kind in range(maxent_lm.KINDS):
        asks = maxent_lm.asked(chunks, kind, bits)
        keys = {(r.chunk, r.part): r["keys"] for r in asks.collect()}
        found = {}
        for r in maxent_lm.answered(asks).collect():
            inside = maxent_lm.unpacked(bytes(keys.pop((r.chunk, r.part))))
            found |= {(kind, (r.part << maxent_lm.KEY_BITS - bits) + int(k)): int(n) for k, n in zip(inside, maxent_lm.unplaned(bytes(r.n), np.uint32))}
        assert not keys
        assert {k: n for k, n in found.items() if n} == {k: n for k, n in plain.items() if k[0] == kind}


def test_numbers_are_packed_without_loss():
    rng = np.random.default_rng(8)
    for top in (1, 200, 1 << 33, 1 << 50):
        keys = np.unique(rng.integers(0, top, 300).astype(np.uint64))
        assert (maxent_lm.unpacked(maxent_lm.packed(keys)) == keys).all()
    for numbers in (np.arange(-5, 5, dtype=np.int32), rng.integers(0, 1 << 62, 9), np.zeros(0, np.float32), rng.random(7).astype(np.float32)):
        assert (maxent_lm.unplaned(maxent_lm.planes(numbers), numbers.dtype) == numbers).all()


@pytest.mark.parametrize("bits, n", [(0, 5), (12, 5000), (50, 5000), (64, 300), (50, 0)])
def test_keys_are_grouped_by_one_sort(bits, n):
    rng = np.random.default_rng(11)
    keys = rng.integers(0, 1 << bits, n, dtype=np.uint64) if bits < 64 else rng.integers(0, 1 << 63, n).astype(np.uint64)
    keys[: n // 2] ^= np.uint64(bits > 0)  # neighbours that differ in the last bit alone
    keys = np.concatenate([keys, keys[::2], keys[::3] ^ np.uint64(bits > 0)])
    order, group = maxent_lm.grouped(keys, bits)
    found = np.empty(len(keys), dtype=np.int64)
    found[order] = group
    assert sorted(order) == list(range(len(keys))) and (found == np.unique(keys, return_inverse=True)[1]).all()


def test_words_of_all_texts_at_once():
    texts = ["The CAT\x0bsat.", None, "", "  a\x1fb \u00c9t\u00c9\u0085\u00a0x\n", " ", "\t\r\x0c", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    lengths, found = maxent_lm.words_of(batch.slice(1))
    expected = [words((t or "").encode()) for t in texts[1:]]
    assert lengths.tolist() == [len(x) for x in expected] and found.to_pylist() == [w for x in expected for w in x]


def test_groups_read_their_own_files_and_ask_for_no_context_that_follows(spark, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(40)) for i in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asks, files, ask, write = [], {}, maxent_lm.asked, maxent_lm.written

    def noted_ask(*given):
        asks.append((given[1], sum(len(r.n) // 4 for r in ask(*given).collect()), sum(len(r.n) // 4 for r in ask(*given[:3]).collect())))
        return ask(*given)

    def noted_write(df, label, *given):
        files.setdefault(label, []).append(write(df, label, *given))
        return files[label][-1]

    monkeypatch.setattr(maxent_lm, "asked", noted_ask)
    monkeypatch.setattr(maxent_lm, "written", noted_write)
    maxent_lm.scores(table)
    for kind, n, with_contexts in asks:
        assert n < with_contexts if kind in maxent_lm.FOLLOWS else n == with_contexts
    for label, column in (("chunks", "slice"), ("answers", "group")):
        assert all(f"{column}=" in f for f in files[label][0].inputFiles())


def test_sums_by_row():
    rng = np.random.default_rng(9)
    rows = np.concatenate([rng.integers(0, 1 << 15, 3000), np.repeat([5, 77, 9], [400, 31, 32])])
    values = rng.random((len(rows), 3))
    expected = np.zeros((1 << 15, 3))
    np.add.at(expected, rows, values)
    found, sums = maxent_lm.sums_by_row(rows, values)
    assert sorted(found) == sorted(set(rows)) and np.allclose(sums, expected[found])


def test_language_model_keeps_little_on_disk(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 300) % 20_000) for _ in range(1200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    kept, write = [], maxent_lm.written

    def noted(*given):
        kept.append(write(*given))
        return kept[-1]

    monkeypatch.setattr(maxent_lm, "written", noted)
    size = lambda df: sum(Path(f.removeprefix("file:")).stat().st_size for f in df.inputFiles())
    maxent_lm.scores(table)
    assert sum(map(size, kept)) < 4 * size(table)


def test_mixture_parts_are_distributions():
    rng = np.random.default_rng(6)
    fixed = rng.dirichlet(np.ones(9))
    both = rng.integers(0, 5, (9, maxent_lm.KINDS))
    counts = np.zeros((9, maxent_lm.SLOTS), dtype=np.int64)
    counts[:, 0:-1:2], counts[:, 1::2] = both.sum(axis=0), both
    assert np.allclose(maxent_lm.parts(fixed, counts).sum(axis=0), 1)


def test_fingerprints(spark):
    rng = np.random.default_rng(3)
    long = ["".join(rng.choice(list("abcdefghijkl mnop qrstuv"), 3000)) for _ in range(30)]
    texts = [None, "", "short", "é" * 40, long[0], *long]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (7, texts[7], "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(4)
    for size in (1 << 30, 9000):
        fingerprints.RANGE_BYTES, old = size, fingerprints.RANGE_BYTES
        found = fingerprints.with_edits(table).collect()
        fingerprints.RANGE_BYTES = old
        ordered = sorted(((-i if i is not None else 1 << 60), i, t or "") for i, t, _ in rows)
        expected = []
        for k, (_, i, t) in enumerate(ordered):
            after = ordered[(k + 1) % len(ordered)][2]
            n = len(t) // 3
            expected.append((str(i), len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(expected)
        by = {r.doc_id: r for r in found}
        assert by[4].fingerprint == by[5].fingerprint and by[5].near_next == 1.0
        assert by[0].fingerprint == by[1].fingerprint == "" and by[1].near_next == 1.0 and by[2].near_next == 0.0
        for i in range(6, len(texts)):
            assert 0.5 < by[i].near_edited < 0.85 and (by[i].near_next < 0.2 or i == 7)
    assert fingerprints.with_edits(table.limit(0)).count() == 0
    chain = fingerprints.decode(by[9].fingerprint)
    assert fingerprints.encode(chain) == by[9].fingerprint and fingerprints.likeness(chain, chain) == 1.0


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def test_features_are_the_rarest_windows_of_each_stretch():
    rng = np.random.default_rng(7)
    texts = [bytes(rng.choice(list(b"abc d"), n)) for n in (0, 3, 8, 9, 31, 64, 200, 700)] + [b"ab" * 60, b"=" * 300]
    every = [fingerprints._laid_out([t], 0) for t in texts]
    bins = [fingerprints._bins(d, len(v))[v] for d, v, _ in every]
    for t, found in zip(texts, bins):
        padded = t.ljust(8, b"\0") if t else b""
        want = [entropy(padded[i : i + 8]) for i in range(len(padded) - 7)] if t else []
        assert np.allclose(found, np.array(want) * 1023 / 3, atol=1)
    ranks = rng.permutation(fingerprints.ENTROPY_BINS)
    for reach in fingerprints.REACHES:
        number, hashes = fingerprints._features(texts, ranks, reach)
        for i, (t, own) in enumerate(zip(texts, bins)):
            padded = np.frombuffer((t.ljust(8, b"\0") if t else b"") + bytes(8), dtype=np.uint8)
            h = fingerprints._hashes(padded, len(own))
            key = [(int(ranks[b]), int(x) >> 16) for b, x in zip(own, h)]
            chosen = [
                h[k] for k in range(len(key)) if all(key[j] > key[k] for j in range(max(0, k - reach), k)) and all(key[j] >= key[k] for j in range(k + 1, min(len(key), k + reach + 1)))
            ]
            assert hashes[number == i].tolist() == chosen
            assert not t or chosen  # every stretch has one
    # a longer reach chooses among what a shorter one chooses
    sets = [set(zip(*(x.tolist() for x in fingerprints._features(texts, ranks, r)))) for r in fingerprints.REACHES]
    assert all(b <= a for a, b in zip(sets, sets[1:]))


@pytest.mark.parametrize("size", [40, 80, 400])
def test_one_changed_character_of_a_short_text(spark, size):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    ranks = fingerprints.rarity(docs)
    rng = np.random.default_rng(size)
    texts = [r.text.encode() for r in docs.select("text").collect() if len(r.text.encode()) >= size]
    alike = 0
    for _ in range(200):
        text = texts[rng.integers(len(texts))]
        begin = rng.integers(len(text) - size + 1)
        one = bytearray(text[begin : begin + size])
        other = bytearray(one)
        at = rng.integers(size)
        other[at] = 97 + (other[at] + 5) % 26
        a, b = fingerprints.filters([bytes(one), bytes(other)], ranks)
        alike += fingerprints.likeness(a, b) > 0.5
    assert alike >= 180
    far = [fingerprints.likeness(*fingerprints.filters([a, b], ranks)) for a, b in zip(texts, texts[7:])]
    assert np.median(far) < 0.15
