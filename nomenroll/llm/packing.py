"""Best-fit packing of token sequences by linear grouping.

Lengths are integers up to the capacity, so their histogram (at most ``capacity`` rows) is all that planning needs.
Large lengths are sorted, cut into groups of equal cardinality and rounded up to the longest of their group; with so
few sizes, configurations of one sequence are optimised one after the other, each led by the largest size left and
filled by a bounded subset-sum over the others, and used as often as counts allow. Actual lengths then take the
places of their group's size. What rounding left free, and new sequences where nothing fits, is given to small
lengths in descending order, each to the fullest sequence it fits.

The plan maps ranks within a length to places, in runs; its size depends on the capacity and not on the rows. Rows get
their rank from a window over (length, bucket), with enough buckets that no window grows with the table, and counts
of earlier buckets.

Null texts are empty documents, which hold the end token only. Every row is packed, repeated rows too. Lengths that
are null, below 1 or above the capacity are an error. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomenroll.llm.bpe import Bpe, little_endian
from nomenroll.llm.common import slices, written

CAPACITY = 2048
#: Groups of equal cardinality for large lengths.
GROUPS = 1024
#: Lengths up to this share of the capacity are small.
SMALL_SHARE = 1 / 16
#: Rows of one (length, bucket) window, about.
BUCKET_ROWS = 200_000


class LibraryBpe(Bpe):
    """The same ids, with words merged by a library."""

    def __init__(self, path: str):
        super().__init__(path)
        special = set(self.special.values())
        ranks = {token: i for i, token in self.bytes_of.items() if i not in special}
        self._encode = tiktoken.Encoding("words", pat_str=r"[^\r]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def word(self, text: str) -> tuple[int, ...]:
        return tuple(self._encode(text.encode()))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> LibraryBpe:
    return LibraryBpe(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id; longer ones in pieces of ``capacity``
    of which the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = bpe.encode(text)
                ids.append(end)
                data, n = little_endian(ids), len(ids)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs (length, first rank, end rank, first sequence, items a sequence, first offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # residual -> (first sequence, how many)
        self._mask = 0
        small = int(capacity * SMALL_SHARE)
        self._large({n: c for n, c in histogram.items() if n > small and c}, groups)
        self._small({n: c for n, c in histogram.items() if n <= small and c})

    def _large(self, counts: dict[int, int], groups: int) -> None:
        per_group, queues, left = -(-sum(counts.values()) // groups) or 1, defaultdict(list), 0
        for length in sorted(counts, reverse=True):
            rank, rest = 0, counts[length]
            while rest:
                if not left:
                    size, left = length, per_group
                n = min(left, rest)
                queues[size].append([length, rank, n])
                rank, rest, left = rank + n, rest - n, left - n
        remaining = {size: sum(n for _, _, n in queue) for size, queue in queues.items()}
        sizes = sorted(remaining, reverse=True)
        while sizes:
            pattern = self._configuration(sizes, remaining)
            times = min(remaining[size] // k for size, k in pattern.items())
            self._use(pattern, times, queues)
            for size, k in pattern.items():
                remaining[size] -= k * times
            sizes = [size for size in sizes if remaining[size]]

    def _configuration(self, sizes: list[int], remaining: dict[int, int]) -> dict[int, int]:
        """The largest size, and those others that leave the least room; larger ones are preferred."""
        lead = sizes[0]
        room = self.capacity - lead
        whole, reach, steps = (1 << (room + 1)) - 1, 1, []
        for size in sizes:
            most, k = min(remaining[size] - (size == lead), room // size), 1
            while most > 0 and not reach >> room:
                k = min(k, most)
                steps.append((size, k, reach))
                reach |= (reach << (size * k)) & whole
                most, k = most - k, 2 * k
            if reach >> room:
                break
        total, pattern = reach.bit_length() - 1, defaultdict(int, {lead: 1})
        for size, k, before in reversed(steps):
            if not before >> total & 1:
                pattern[size] += k
                total -= size * k
        return dict(pattern)

    def _use(self, pattern: dict[int, int], times: int, queues: dict[int, list]) -> None:
        """``times`` sequences of this configuration, with actual lengths in place of rounded ones."""
        slots, breaks = [], {0, times}
        for size, k in pattern.items():
            for _ in range(k):
                at, slot, queue = 0, [], queues[size]
                while at < times:
                    length, rank, n = queue[0]
                    take = min(n, times - at)
                    slot.append((at, at + take, length, rank))
                    at += take
                    breaks.add(at)
                    if take == n:
                        queue.pop(0)
                    else:
                        queue[0] = [length, rank + take, n - take]
                slots.append(slot)
        edges = sorted(breaks)
        for a, b in zip(edges, edges[1:]):
            used = 0
            for slot in slots:
                begin, _, length, rank = next(x for x in slot if x[0] <= a < x[1])
                self.runs.append((length, rank + a - begin, rank + b - begin, self.sequences + a, 1, used))
                used += length
            self._release(self.capacity - used, self.sequences + a, b - a)
        self.sequences += times

    def _release(self, room: int, first: int, n: int) -> None:
        if room and n:
            self._free[room].append((first, n))
            self._mask |= 1 << room

    def _small(self, counts: dict[int, int]) -> None:
        for length in sorted(counts, reverse=True):
            rank, rest = 0, counts[length]
            while rest:
                if fitting := self._mask >> length:
                    room = length + (fitting & -fitting).bit_length() - 1
                    first, n = self._free[room].pop()
                    if not self._free[room]:
                        self._mask &= ~(1 << room)
                else:
                    room = self.capacity
                    first, n = self.sequences, -(-rest // (room // length))
                    self.sequences += n
                k = min(room // length, rest)
                take = min(n, rest // k)
                self.runs.append((length, rank, rank + take * k, first, k, self.capacity - room))
                self._release(room - k * length, first, take)
                self._release(room, first + take, n - take)
                rank, rest = rank + take * k, rest - take * k

    def arrays(self) -> list[np.ndarray]:
        return [np.array(c, dtype=np.int64) for c in zip(*sorted(self.runs))] or [np.zeros(0, np.int64)] * 6


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` (with ``length``) with sequence_id and offset; as few sequences as the plan finds."""
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    pieces = written(pieces, "pieces")
    if bad := pieces.filter(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity)).limit(1).collect():
        raise ValueError(f"length must be from 1 to {capacity}: {bad[0]}")
    buckets = max(1, pieces.count() // bucket_rows)
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    counts = written(dealt.groupBy("length", "__bucket").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, capacity, groups).arrays()
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__bucket").orderBy(*names)
    ranked = dealt.withColumn("__row", F.row_number().over(within)).join(offsets, ["length", "__bucket"])
    ranked = ranked.select(*names, (F.col("__before") + F.col("__row") - 1).alias("__rank"))
    lengths, begins, _, firsts, per, offs = plan
    keys = lengths * (1 << 44) + begins

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("__rank").to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, length.astype(np.int64) * (1 << 44) + rank, side="right") - 1
            at = rank - begins[run]
            places = [firsts[run] + at // per[run], offs[run] + at % per[run] * length]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(x, pa.int64()) for x in places)], [*names, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)
