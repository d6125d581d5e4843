"""Toxicity: averaged subword vectors and a linear softmax, trained jointly in numpy.

A word is the bag of hashed byte n-grams of ``<word>``: the mean of their vectors. A window of ``WINDOW`` words is the
mean of its words, and a softmax of two classes reads it; windows overlap by half, cover the whole text, and the most
toxic one decides, so neither long texts nor many clean words dilute a few bad ones. A misspelling shares most n-grams,
hence vectors, with the word it hides.

Which n-grams get vectors is counted on Spark, over all labelled texts that may teach: those whose share of toxic
texts stands out (``LEAST_Z`` standard deviations), so rare toxic words teach too; others have the zero vector. Their
log odds are where vectors start. Vectors and softmax are then trained together on each text's most toxic window, of a
bounded sample of texts (``SAMPLE`` for each class, those with the smallest hashes; documented bound). Isotonic
calibration on labelled documents that taught neither counts nor vectors turns a window's logit into a probability.

Null text counts as empty and has no words: its raw score is 0. Null labels and ids take no part;
an id with several labels is toxic if one of them is. Without labelled rows of both classes every score is the
smoothed share of toxic ones. Empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from nomenroll.llm.calibration import Isotonic, histogram
from nomenroll.llm.common import released, remainder, slices, written

SIZES = (4, 5, 6)
BUCKETS = 1 << 18
DIMENSION = 4
#: Words of a window, of which every second half overlaps the next; a shorter text counts as so many words at least.
WINDOW, LEAST_WORDS = 64, 32
#: Standard deviations by which an n-gram's count in toxic texts exceeds what its count in all texts lets expect.
LEAST_Z = 4.0
#: And the least log odds, so that words which are only somewhat commoner there, in long texts, count for nothing.
LEAST_ODDS = 2.0
#: A word that matters is a few in a hundred of its window.
SCALE = 20.0
RATE, EPOCHS = 0.05, 20
#: Texts of each class whose most toxic windows train vectors and softmax.
SAMPLE = 4000
#: Of so many parts of the labelled texts, all but one teach and one calibrates.
PARTS = 5
REJECT = 0.7
#: Words that the memo holds at most, some 15 MB; it starts anew beyond that and goes with its task.
MEMO_WORDS = 100_000


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of all byte n-grams of ``<word>`` and of the whole of it, by a rolling polynomial over all
    words at once."""
    data = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(data))
    buckets, owners = [_bucket(np.array([zlib.crc32(w) for w in words], dtype=np.uint64) << np.uint64(8))], [np.arange(len(words))]
    for n in SIZES:
        begins = max(0, len(data) - n + 1)  # none where all words together are shorter
        h = np.full(begins, n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + data[j : begins + j]
        at = np.flatnonzero(left[:begins] >= n)
        buckets.append(_bucket(h[at]))
        owners.append(word[at])
    return np.concatenate(buckets), np.concatenate(owners)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def counted(owners: np.ndarray, telling: np.ndarray, words: int) -> np.ndarray:
    """By how many n-grams a word's sum is divided: those with vectors, half of all at least."""
    every, known = np.bincount(owners, minlength=words), np.bincount(owners[telling], minlength=words)
    return np.maximum(np.maximum(known, every / 2), 1)


@dataclass
class Toxicity:
    """A word's logit is the mean of ``values[bucket]`` over its n-grams that have vectors, or half of them all if those are
    fewer, which is what vectors and softmax amount to once trained."""

    values: np.ndarray
    calibration: Isotonic | None = None
    _memo: dict = field(default_factory=dict)

    def word_values(self, words: list[bytes]) -> np.ndarray:
        memo = self._memo
        if new := [w for w in dict.fromkeys(words) if w not in memo]:
            if len(memo) > MEMO_WORDS:
                memo.clear()
                new = list(dict.fromkeys(words))
            buckets, owners = ngrams(new)
            found = self.values[buckets]
            means = np.bincount(owners, weights=found, minlength=len(new)) / counted(owners, found != 0, len(new))
            memo.update(zip(new, means.tolist()))
        return np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))

    def windows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and logit of each window of a text's words."""
        n = len(words)
        sums = np.concatenate([[0.0], np.cumsum(self.word_values(words))])
        begins = np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)
        ends = np.minimum(begins + WINDOW, n)
        return begins, ends, SCALE * (sums[ends] - sums[begins]) / np.maximum(ends - begins, LEAST_WORDS)

    def worst(self, words: list[bytes]) -> list[bytes]:
        begins, ends, logits = self.windows(words)
        at = logits.argmax()
        return words[begins[at] : ends[at]]

    def raw(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.windows(w)[2].max() if (w := words_of(x)) else 0.0 for x in texts], dtype=np.float64)

    def __getstate__(self) -> dict:
        return {"values": self.values, "calibration": self.calibration, "_memo": {}}


def train(windows: list[list[bytes]], labels: np.ndarray, start: np.ndarray, seed: int = 10) -> Toxicity:
    """Adam on vectors and softmax together, with all windows of the sample in each step and equal classes.

    ``start``: log odds of the n-grams that get vectors, else 0.
    """
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    at = np.array([number.setdefault(w, len(number)) for part in windows for w in part], dtype=np.int64)
    sizes = np.array([len(part) for part in windows])
    starts, word_rows = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(windows)), sizes)
    buckets, owners = ngrams(list(number))
    telling = start[buckets] != 0
    share = 1 / counted(owners, telling, len(number))[:, None]
    buckets, owners = buckets[telling], owners[telling]
    used, index = np.unique(buckets, return_inverse=True)
    if not len(used):
        return Toxicity(start.astype(np.float32))
    order = np.argsort(owners, kind="stable")
    index, owners = index[order], owners[order]
    holders, word_starts = np.unique(owners, return_index=True)
    by_bucket, by_word = np.argsort(index, kind="stable"), np.argsort(at, kind="stable")
    bucket_starts = np.searchsorted(index[by_bucket], np.arange(len(used)))
    at_starts = np.searchsorted(at[by_word], np.arange(len(number)))
    direction = rng.normal(0, 1, DIMENSION)
    direction /= np.linalg.norm(direction)
    vectors = start[used][:, None] * direction / 2 + rng.normal(0, 0.01, (len(used), DIMENSION))
    softmax, bias = np.stack([-direction, direction], axis=1), np.zeros(2)
    scale = (SCALE / np.maximum(sizes, LEAST_WORDS))[:, None]
    target = np.stack([1 - labels, labels], axis=1)
    weight = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))[:, None]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    words = np.zeros((len(number), DIMENSION))
    for step in range(1, EPOCHS + 1):
        words[holders] = np.add.reduceat(vectors[index], word_starts, axis=0)
        mean = np.add.reduceat((words * share)[at], starts, axis=0) * scale
        logits = mean @ softmax + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) * weight
        back = (error @ softmax.T) * scale
        word_gradient = np.add.reduceat(back[word_rows[by_word]], at_starts, axis=0) * share
        gradient = np.add.reduceat(word_gradient[owners[by_bucket]], bucket_starts, axis=0)
        for (m, v), weights, g in zip(moments, (vectors, softmax, bias), (gradient, mean.T @ error, error.sum(axis=0))):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    values = start.astype(np.float32)  # of n-grams that no window of the sample holds
    values[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Toxicity(values)


def known_labels(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, modulus: int, held_out: int) -> DataFrame:
    """id, y, part of labelled documents that may be learned from; no text is read."""
    known = labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max(F.col(label)) > 0).cast("int").alias("y"))
    there = docs.select(F.col(doc_id).cast("long").alias("id"))
    return written(known.join(there, "id", "left_semi").withColumn("part", F.pmod(F.xxhash64(F.lit(10), "id"), F.lit(PARTS))), "known")


def class_counts(texts: DataFrame) -> np.ndarray:
    """Texts of each class that hold each n-gram's bucket, and texts of each class in the last column. ``texts``: y, text.

    A task sends the buckets that it has seen, added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in slices(batches):
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                if own := list(dict.fromkeys(words_of(text))):
                    counts[y, np.unique(ngrams(own)[0])] += 1
                counts[y, BUCKETS] += 1
        ys, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ys), pa.array(at), pa.array(counts[ys, at])], ["y", "bucket", "n"])

    found = texts.mapInArrow(released(run), "y long, bucket long, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BUCKETS + 1))
    counts[found.column("y").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Of each bucket that stands out in toxic texts; 0 for all others."""
    clean, toxic = counts[:, :-1]
    share = counts[1, -1] / counts[:, -1].sum()
    expected = (clean + toxic) * share
    z = (toxic - expected) / np.sqrt(expected * (1 - share) + 0.25)
    odds = np.log((toxic + 2 * share) / (clean + 2 * (1 - share))) - np.log(share / (1 - share))
    return np.where((z > LEAST_Z) & (odds > LEAST_ODDS), odds, 0.0)


def teach(docs: DataFrame, known: DataFrame, doc_id: str, text: str, sample: int) -> Toxicity | None:
    """Vectors and softmax from the labelled documents but the calibrating part; None without both classes.

    The sampled documents' windows of ``WINDOW`` words come to the driver, at most ``sample`` of each class.
    """
    taught = known.filter(F.col("part") < PARTS - 1)
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = written(named.join(taught, "id").select("id", F.col("y").cast("long").alias("y"), "text"), "labelled")
    counts = class_counts(texts.select("y", "text"))
    if not counts[:, -1].all():
        return None
    start = log_odds(counts)
    shared = docs.sparkSession.sparkContext.broadcast(start.astype(np.float32))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxicity(shared.value)
        for batch in slices(batches):
            found = [" ".encode().join(model.worst(w)) if (w := words_of(t)) else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], ["id", "y", "window"])

    windows = written(texts.mapInArrow(released(cut), "id long, y long, window binary"), "windows")
    parts, ys = [], []
    for y in (0, 1):
        some = windows.filter((F.col("y") == y) & (F.octet_length("window") > 0)).orderBy(F.xxhash64("id"), "id", "window").limit(sample)
        for row in some.select("window").toLocalIterator():
            parts.append(bytes(row["window"]).split(b" "))
            ys.append(y)
    return train(parts, np.array(ys, dtype=np.float64), start) if len(set(ys)) == 2 else Toxicity(start.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 3, held_out: int = 1, sample: int = SAMPLE) -> tuple[Toxicity, DataFrame]:
    """The model, and id and raw score of every document. Rows whose crc32(id) mod ``modulus`` is ``held_out`` teach
    nothing; of the others, one part in ``PARTS`` calibrates and the rest teaches."""
    known = known_labels(docs, labels, doc_id, label, modulus, held_out)
    taught = teach(docs, known, doc_id, text, sample)
    model = taught or Toxicity(np.zeros(BUCKETS, np.float32))
    raws = written(scored(docs, model.raw, "__raw", [doc_id], text), "raw")
    rest = known.filter(F.col("part") == PARTS - 1) if taught else known
    model.calibration = Isotonic(histogram(raws.join(rest, F.col(doc_id) == F.col("id")), "__raw", "y", -40.0, 40.0))
    return model, raws


def scored(docs: DataFrame, function, name: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and one double of ``function(texts)``."""
    schema = StructType([docs.schema[c] for c in keep]).add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            values = pa.array(function(batch.column(text).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], [*keep, name])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(released(run), schema)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` (default: the id), held_out, score, predicted."""
    keep = [c for c in keep or [doc_id] if c not in ("held_out", "score", "predicted")]
    model, raws = fit(docs, labels, doc_id, text)
    if keep == [doc_id]:
        result = scored(raws, lambda values: model.calibration(np.array(values, dtype=np.float64)), "score", keep, "__raw")
    else:  # scored again: a table of raw scores with all columns would be a copy of the texts
        result = scored(docs, lambda texts: model.calibration(model.raw(texts)), "score", list(dict.fromkeys([*keep, doc_id])), text)
    held = F.coalesce(remainder(F.col(doc_id), 3) == 1, F.lit(False))
    return result.select(*keep, held.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
