"""Fingerprints of improbable features.

Every window of ``WINDOW`` bytes is ranked by how rare its entropy is in the whole corpus (a bounded histogram over all
windows of all texts), a hash deciding ties. A window that is the rarest within ``reach`` bytes on both sides is a
feature, so each stretch of text has one; the reach grows with the text, from 2 to 27 bytes, so that short texts
have a dozen features too, and what a longer reach chooses a shorter one chooses as well. Features go, in order, into
Bloom filters of 2048 bits with five hashes; a filter takes 160 and then the next one is chained. Two fingerprints
are compared filter by filter: common bits beyond those expected by chance, as a share of the most that were
possible; each filter of the shorter chain takes its best partner.

A text shorter than a window is one padded window. Null text counts as empty: no features and an empty fingerprint.
Two empty fingerprints have likeness 1, an empty and another one 0. For ``with_edits``, rows are ordered by
descending id, rows without id last and rows of one id by a hash of their text; every row gets a result, repeated
rows too. A lone row is its own next document. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenroll.llm.common import slices, text_bytes

WINDOW = 8
#: Bytes on both sides within which a feature is the rarest window, by the size of the text: a sixteenth, rounded down.
REACHES = (2, 4, 8, 16, 27)
BITS, HASHES, PER_FILTER = 2048, 5, 160
ENTROPY_BINS = 1024
#: Bytes of text that one range of ids holds, about.
RANGE_BYTES = 4 << 20
RANGES_MOST = 10_000
CHUNK_BYTES = 1 << 20


def reach_of(size: int) -> int:
    return max((r for r in REACHES if r * 16 <= size), default=REACHES[0])


def _laid_out(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, with a gap after each text; whether a window of a text begins at each place; the text's number there."""
    padded = [t.ljust(WINDOW, b"\0") if t else b"" for t in texts]
    data = np.frombuffer((b"\0" * gap).join([*padded, b"\0" * WINDOW]), dtype=np.uint8)
    sizes = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    number = np.repeat(np.arange(len(padded)), sizes + gap)
    begins = np.cumsum(sizes + gap) - sizes - gap
    place = np.arange(len(number)) - begins[number]
    return data, place <= (sizes - WINDOW)[number], number


def _bins(data: np.ndarray, n: int) -> np.ndarray:
    """Entropy bin of the window at each of the first ``n`` places.

    The sum of c log c over the counts of a window's bytes is a sum of steps, one for each byte, by how many equal ones
    come before it in the window.
    """
    equal = [data[: n + WINDOW - 1 - d] == data[d : n + WINDOW - 1] for d in range(1, WINDOW)]
    total = np.zeros(n, dtype=np.uint16)
    for j in range(1, WINDOW):
        earlier = np.zeros(n, dtype=np.uint8)
        for d in range(1, j + 1):
            earlier += equal[d - 1][j - d : j - d + n]
        total += _STEPS[earlier]
    return _BINS[total]


#: c log c - (c - 1) log (c - 1) in thousandths of a bit, and the entropy bin of each sum of them.
_LOGS = np.arange(WINDOW + 1) * np.log2(np.maximum(1, np.arange(WINDOW + 1)))
_STEPS = np.rint(np.diff(_LOGS) * 1000).astype(np.uint16)
_BINS = np.rint((1 - np.minimum(1, np.arange(1000 * WINDOW * int(np.log2(WINDOW)) + WINDOW) / (1000 * _LOGS[-1]))) * (ENTROPY_BINS - 1)).astype(np.int64)


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the window at each of the first ``n`` places."""
    h = np.ndarray(n, dtype="<u8", buffer=data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _least_of_next(x: np.ndarray, length: int) -> np.ndarray:
    """Minimum of ``length`` values from each place on; the last ``length`` - 1 places have none."""
    size = 1
    while size * 2 <= length:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = length - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _features(texts: list[bytes], ranks: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each feature, in order."""
    data, valid, number = _laid_out(texts, reach + WINDOW)
    n = len(valid)
    hashes = _hashes(data, n)
    highest = np.uint64(0xFFFFFFFFFFFFFFFF)
    key = np.where(valid, (ranks[_bins(data, n)].astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)), highest)
    least = _least_of_next(np.concatenate([np.full(reach, highest), key, np.full(reach, highest)]), reach)
    # of equal windows the first one counts
    chosen = valid & (key < least[:n]) & (key <= least[reach + 1 : reach + 1 + n])
    return number[chosen], hashes[chosen]


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy bin over all windows of all texts: 0 is the rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ENTROPY_BINS, dtype=np.int64)
        for batch in slices(batches, 128):
            data, valid, _ = _laid_out(text_bytes(batch, text), 0)
            total += np.bincount(_bins(data, len(valid))[valid], minlength=ENTROPY_BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])

    counts = np.zeros(ENTROPY_BINS, dtype=np.int64)
    for row in docs.select(text).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[row["bin"]] = row["n"]
    ranks = np.empty(ENTROPY_BINS, dtype=np.int64)
    ranks[np.lexsort((np.arange(ENTROPY_BINS), counts))] = np.arange(ENTROPY_BINS)
    return ranks


def filters(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's chain: filters x 256 bytes."""
    by_reach: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        by_reach.setdefault(reach_of(len(t)), []).append(i)
    found = []
    for reach, members in by_reach.items():
        number, own = _features([texts[i] for i in members], ranks, reach)
        found.append((np.array(members, dtype=np.int64)[number], own))
    text, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    in_order = np.argsort(text, kind="stable")
    text, hashes = text[in_order], hashes[in_order]
    counts = np.bincount(text, minlength=len(texts))
    chains = -(-counts // PER_FILTER)
    first = np.cumsum(chains) - chains
    order = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    bits = np.zeros((int(chains.sum()), BITS), dtype=bool)
    row = first[text] + order // PER_FILTER
    for j in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + n] for a, n in zip(first, chains)]


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    n, m = x.sum(axis=1), y.sum(axis=1)
    common, chance, most = x @ y.T, n[:, None] * m[None, :] / BITS, np.minimum(n[:, None], m[None, :])
    score = np.where(most > chance, (common - chance) / np.maximum(most - chance, 1e-9), 0).max(axis=1)
    return float(min(1.0, max(0.0, (score * n).sum() / n.sum())))


def compared(texts: list[str], ranks: np.ndarray) -> list[tuple]:
    """For each text but the last, with the one after it as next: code points, hash of the edited text, both
    fingerprints and likenesses."""
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:])]
    raw = [t.encode() for t in edited]
    chains = filters([t.encode() for t in texts] + raw, ranks)
    own, other = chains[: len(texts)], chains[len(texts) :]
    return [
        (len(t), hashlib.sha256(r).hexdigest(), encode(a), encode(e), likeness(a, e), likeness(a, after))
        for t, r, a, e, after in zip(texts, raw, own, other, own[1:])
    ]


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ranges of ids, so that a text is shuffled once; the first row of a range also goes to the range before it.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    ranges = min(RANGES_MOST, max(1, (size or 0) // RANGE_BYTES))
    cuts = F.percentile_approx(F.col("doc_id").cast("double"), [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges)
    found = rows.agg(cuts.alias("cuts")).first()["cuts"]
    bounds = sorted(set(found), reverse=True) if found and ranges > 1 else []
    ranks = rarity(rows)
    steps = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    below = F.size(F.filter(steps, lambda b: F.col("doc_id") < b))  # descending: the highest ids are range 0
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(below)).withColumn("tie", F.xxhash64("text"))
    first = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), (-F.col("doc_id")).alias("down"), "tie")).alias("f"))
    heads = [(r["range"], None if r["f"]["unknown"] else -r["f"]["down"], r["f"]["tie"]) for r in first.orderBy("range").collect()]
    spark = docs.sparkSession
    before = [heads[i - 1][0] for i in range(len(heads))]  # whose lookahead it is; of the first, the last range's
    heads = spark.createDataFrame([(a, i, t) for a, (_, i, t) in zip(before, heads)], "to int, head long, head_tie long")
    ahead = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")))
    ahead = ahead.select("doc_id", "text", F.col("to").alias("range"), "tie", F.lit(True).alias("ahead"))
    every = rows.select("doc_id", "text", "range", "tie", F.lit(False).alias("ahead")).unionByName(ahead)
    order = ["range", "ahead", F.col("doc_id").desc_nulls_last(), "tie"]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (id, text, range, ahead) in order; the last one waits for its next

        def results() -> pa.RecordBatch:
            found = compared([r[1] for r in held], ranks)
            columns = zip(*[(r[0], *f) for r, f in zip(held, found)])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        size = 0
        for batch in slices(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "ahead"))):
                if held and (held[-1][3] or held[-1][2] != row[2]):
                    if row[2] == held[-1][2]:
                        continue  # a repeated lookahead
                    if len(held) > 1:
                        yield results()
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
                if size > CHUNK_BYTES and len(held) > 1:
                    yield results()
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield results()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return every.repartition("range").sortWithinPartitions(*order).select("doc_id", "text", "range", "ahead").mapInArrow(run, schema)
