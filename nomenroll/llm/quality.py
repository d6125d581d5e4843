"""Document quality: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of whole texts (never label, language, source or id) are standardised with means and deviations over all
documents. Cosine features approximate a Gaussian kernel on them; each partition sums its part of the normal
equations, cells are added up with map-side combine, and one small system gives the weights. Ridge scores of the
labelled rows are counted in bins, and isotonic regression over the bins turns scores into probabilities.

Null text counts as empty. Labels are averaged for an id that has several; null labels and ids take no part. With
no labelled rows every score is 0.5. Rows without an id are never held out. Empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from nomenroll.llm.calibration import Isotonic, histogram
from nomenroll.llm.common import released, remainder, slices, text_bytes, written

FEATURES = 192
RIDGE = 1e-3
#: Width of the kernel, in standard deviations and times the root of their number.
WIDTH = 1.0
KEEP = 0.3

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 mark, 6 not ASCII, 7 line end, 8 full stop or comma
for _bytes, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b"\t\x0b\x0c\r ", 4), (b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", 5), (range(128, 256), 6), (b"\n", 7), (b".,", 8)):
    _CLASS[list(_bytes)] = _kind
STATISTICS = 20


def statistics(text: bytes) -> list[float]:
    """Shape of a text: size, characters, words, repetition."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data) or 1
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=9) / n
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    words = text.lower().split()
    w = len(words) or 1
    distinct = set(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    lines = text.split(b"\n")
    turns = int(np.count_nonzero(data[1:] == data[:-1])) / n if len(data) > 1 else 0.0
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    packed = len(zlib.compress(text, 1)) / (n + 16)
    marked = sum(1 for x in words if x[-1] in b"!#$%&*|~@^_+=<>") / w
    return [
        float(np.log1p(len(data))), *kinds[1:].tolist(), entropy, float(lengths.mean()), float(lengths.std()),
        len(distinct) / w ** 0.8, pairs, packed, turns, marked, float(np.log1p(w / len(lines))), len(set(lines)) / len(lines), float(counts.max()) / n,
    ]


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``__stats``."""
    schema = StructType([docs.schema[c] for c in keep]).add("__stats", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = pa.array([statistics(x) for x in text_bytes(batch, text)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), stats], [*keep, "__stats"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(released(run), schema)


@dataclass
class Quality:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray | None = None
    calibration: Isotonic | None = None
    seed: int = 8
    planes: np.ndarray = field(init=False)
    phases: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.planes = rng.standard_normal((len(self.mean), FEATURES)) / (WIDTH * np.sqrt(len(self.mean)))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines, the standardised statistics themselves, and one."""
        z = np.clip((stats - self.mean) / self.deviation, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.planes + self.phases), z / 6, np.ones((len(z), 1))], axis=1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if self.weights is not None else np.full(len(stats), 0.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.calibration(self.ridge(stats)) if self.calibration else np.full(len(stats), 0.5)


def stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("__stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def scored(stats: DataFrame, function, name: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and one double of ``function(statistics)``."""
    schema = StructType([stats.schema[c] for c in keep]).add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(function(stats_of(batch)), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], [*keep, name])

    return stats.mapInArrow(released(run), schema)


def moments(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations over all rows."""
    at = F.posexplode("__stats").alias("i", "x")
    rows = stats.select(at).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    mean, deviation = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in rows:
        mean[r["i"]], deviation[r["i"]] = r["m"], max(r["s"], 1e-6)
    return mean, deviation


def normal_equations(train: DataFrame, model: Quality) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y: one row for each cell and partition, added up by key."""
    size = FEATURES + STATISTICS + 1
    upper = np.flatnonzero(np.triu(np.ones((size, size + 1), dtype=bool)).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            f, y = model.features(stats_of(batch)), np.array(batch.column("y"))
            total += f.T @ np.concatenate([f, y[:, None]], axis=1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(upper), pa.array(total.ravel()[upper])], ["cell", "value"])

    cells = train.select("__stats", "y").mapInArrow(released(run), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    full = np.zeros(size * (size + 1))
    full[np.array(cells.column("cell"), dtype=np.int64)] = np.array(cells.column("value"))
    full = full.reshape(size, size + 1)
    square = np.triu(full[:, :-1])
    return square + np.triu(square, 1).T, full[:, -1]


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", modulus: int = 5, held_out: int = 0) -> Quality:
    """``stats``: ids and statistics of all documents; rows whose crc32(id) mod ``modulus`` is ``held_out`` teach nothing."""
    model = Quality(*moments(stats))
    known = labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    train = written(stats.join(known, F.col(doc_id) == F.col("__id")).select("__stats", "y"), "labelled")
    square, target = normal_equations(train, model)
    n = square[-1, -1]
    if n:
        model.weights = np.linalg.solve(square + RIDGE * n / len(target) * np.eye(len(target)), target)
        model.calibration = Isotonic(histogram(scored(train, model.ridge, "s", ["y"]), "s", "y", -0.5, 1.5))
    return model


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` (default: the id), held_out, score, predicted."""
    keep = [c for c in keep or [doc_id] if c not in ("held_out", "score", "predicted")]
    stats = written(with_statistics(docs, list(dict.fromkeys([*keep, doc_id])), text), "statistics")
    model = fit(stats, labels, doc_id)
    result = scored(stats, model.score, "score", list(dict.fromkeys([*keep, doc_id])))
    held = F.coalesce(remainder(F.col(doc_id), 5) == 0, F.lit(False))
    return result.select(*keep, held.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
