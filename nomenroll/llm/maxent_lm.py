"""Language-model scores from a hashed maximum-entropy model.

A token's probability has three factors: its class given the text so far, its unit given the class and the class
before, and the word given its unit. Frequent words are units of their own; all others, unseen ones too, belong to
the unit of their ending, in which words have add-one probabilities, so the model is a distribution over all words.
Classes group units that have like neighbours. The class is a softmax over hashed n-gram and skip features
(previous unit, previous two, second and third before); its weights start from smoothed log ratios of counts and are
then trained by distributed gradient updates, each over another slice of all training texts. Units follow a
softmax whose weights are smoothed log counts.

That part has a fixed size. What grows with the corpus is a table of exact counts of every n-gram and skip context of
actual words (previous word, previous two, second and third before) and of every word in each of them, with as many
rows as the training texts have such features. Texts lie in chunks of bounded size; for one kind after the other, each
chunk sends its distinct features, packed by ranges of their hash, each range is counted in one place, and the totals go
back in the order in which they were asked for. Shuffle files are removed when a step ends. Each kind gives a distribution over all words that falls back on the part above; a token's probability is a mixture of them, whose
shares are trained by one step for each slice of the training texts, with the token itself left out of the counts.

The base score (add-one unigram) uses exact counts of all training tokens. The most frequent words, whose number is
bounded, are looked up in a broadcast table; all other words meet their counts in a join.

Tables of fixed size (features x classes, units x contexts) are what tasks send; they are added up in a stream by
block. Null text counts as empty and holds the end token only. Rows without an id are training rows. Repeated rows are
scored alike. With no training rows the base score is 0 and the model nearly uniform. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenroll.llm.common import keep_memory, planes, released, remainder, shuffles_removed, slices, trim, unplaned, written

#: Words that are broadcast with their counts at most.
HEAD = 500_000
#: Features that are counted together, about.
PART_FEATURES = 1 << 21
#: Tokens of a chunk, about; bits of a feature's hash, each kind by itself; the kind of words alone, asked outside the head.
CHUNK, KEY_BITS, ALONE = 1 << 18, 50, 4
#: Words that are units of their own; units by ending; context words for classes; classes; rows of features.
OWN, ENDINGS, CONTEXTS, CLASSES, FEATURES = 8192, 2048, 64, 48, 1 << 15  # a power of two, up to 1 << 16
UNITS = OWN + ENDINGS
END, START = UNITS, UNITS + 1
#: Gradient updates; each sees the training texts of one slice, and all slices together all of them.
UPDATES, RATE = 4, 0.5
#: How much each kind of feature starts with, of its log ratio.
START_SHARE = np.array([0.5, 0.35, 0.15, 0.15], dtype=np.float32)
#: Kinds of exact features. A token has keys for the context and itself in it, by kind, and for itself alone.
KINDS = 4
SLOTS = 2 * KINDS + 1
#: Kinds whose contexts need not be asked for: each word but the end has one token after it, so the previous word occurs as
#: often as it is a context, and the previous two as often as the last of them comes after the first.
FOLLOWS = (0, 1)
#: With how many tokens of the fixed part each kind is smoothed: two distributions for each.
STRENGTHS = (2.0, 32.0)
PARTS = 1 + KINDS * len(STRENGTHS)
END_NUMBER, START_NUMBER = -1, -2
#: Tasks that send tables at most, for each core, and floats of one block.
TASKS, BLOCK = 4, 1 << 15
#: Tokens of a run, where classes are predicted, where these are summed up, and where parts are mixed.
TOKENS, SUMMED, MIXED = 1 << 11, 1 << 16, 1 << 13
#: Words, with their bytes as eighths of one, that a task counts at a time, about.
COUNTED = 1 << 23


def ending_unit(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % ENDINGS


def far_number(word: bytes) -> int:
    """Of a word outside the head: above all ids."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "big") >> 2 | 1 << 62


def gathered(df: DataFrame, size: int, function: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """Sum over all tasks of a table of ``size`` floats to which ``function(batch, table)`` adds."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        table, some = np.zeros(size, dtype=np.float64), False
        for batch in slices(batches):
            function(batch, table)
            some = True
        for k in range(0, size if some else 0, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK]), pa.array([table[k : k + BLOCK].astype(np.float32).tobytes()], pa.binary())], ["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                values = np.frombuffer(data.as_py(), dtype=np.float32).astype(np.float64)
                if number != block:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "data"])
                    block, total = number, values
                else:
                    total = total + values
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "data"])

    context = df.sparkSession.sparkContext
    sent = df.coalesce(TASKS * context.defaultParallelism).mapInArrow(released(send), "block long, data binary")
    result = np.zeros(size, dtype=np.float32)
    for row in sent.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, data binary").collect():
        values = np.frombuffer(row["data"], dtype=np.float32)
        result[row["block"] * BLOCK : row["block"] * BLOCK + len(values)] = values
    return result


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all of them: what ``words`` finds in each text, for all at once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
    found, lengths = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy()
    some = pc.binary_length(found).to_numpy() > 0  # there are empty ones at the ends of texts
    if not some.all():
        found, lengths = found.filter(pa.array(some)), np.bincount(np.repeat(np.arange(len(lengths)), lengths)[some], minlength=len(lengths))
    return lengths, found


def word_counts(docs: DataFrame) -> DataFrame:
    """word (empty for the end), n: added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(waiting, pa.binary()))
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

        for batch in slices(batches):
            lengths, found = words_of(batch)
            waiting += [found, pa.array([b""] * len(lengths), pa.binary())]
            size += len(found) + found.nbytes // 8
            if size > COUNTED:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()

    return docs.select("text").mapInArrow(released(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent words in order, and their counts."""

    key: str
    blob: object  # broadcast: words joined by line ends
    counts: np.ndarray

    def lookup(self) -> dict[bytes, int]:
        if self.key not in _LOOKUPS:
            _LOOKUPS.clear()
            value = self.blob.value
            _LOOKUPS[self.key] = {w: i for i, w in enumerate(value.split(b"\n"))} if value else {}
        return _LOOKUPS[self.key]

    def forget(self) -> None:
        _LOOKUPS.clear()


_LOOKUPS: dict[str, dict[bytes, int]] = {}


def head_of(counts: DataFrame, limit: int) -> Head:
    """All words that occur so often that at most ``limit`` do; a bounded number of rows comes to the driver."""
    found = most_frequent(counts.filter("word <> X''"), limit)
    if found is None or not found.num_rows:
        return Head("none", counts.sparkSession.sparkContext.broadcast(b""), np.zeros(0, np.int64))
    found = found.sort_by([("n", "descending"), ("word", "ascending")])
    blob = b"\n".join(found.column("word").to_pylist())
    key = f"{zlib.crc32(blob)}-{len(blob)}"
    return Head(key, counts.sparkSession.sparkContext.broadcast(blob), found.column("n").to_numpy())


def most_frequent(counts: DataFrame, limit: int) -> pa.Table | None:
    level = F.floor(F.log2("n") * 64).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for row in bins:
        total += row["n"]
        if total > limit:
            break
        least = row["level"]
    return counts.filter(level >= least).toArrow() if least is not None else None


def held_out_and_slice(docs: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64(F.lit(2), "text", "doc_id"), F.lit(UPDATES)).cast("int")
    held = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out"), part.alias("slice"))


def encoder(head: Head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "held_out", "slice", "ids", "tail", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = head.lookup()
        for batch in slices(batches, 512):
            lengths, found = words_of(batch)
            coded = found.dictionary_encode()
            distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            known = np.fromiter((lookup.get(w, -1) for w in distinct), dtype=np.int32, count=len(distinct))
            others = np.flatnonzero(known < 0)
            far = np.zeros(len(distinct), dtype=np.int64)
            far[others] = [far_number(distinct[i]) for i in others]
            known[others] = [-1 - ending_unit(distinct[i]) for i in others]
            numbers, ends = known[at], np.cumsum(lengths)
            outside = numbers < 0
            far, tail_ends = far[at[outside]], np.append(0, np.cumsum(outside))[ends]
            ids = [planes(numbers[b - n : b]) for n, b in zip(lengths, ends)]
            fars = [planes(x) for x in np.split(far, tail_ends[:-1])]
            tails = pa.ListArray.from_arrays(pa.array(np.append(0, tail_ends).astype(np.int32)), found.filter(pa.array(outside)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(ids, pa.binary()), tails, pa.array(fars, pa.binary())], names)
        head.forget()

    return run


def encoded(docs: DataFrame, head: Head) -> DataFrame:
    """doc_id, held_out, slice, ids, tail, far: ids of head words, or minus 1 minus the unit of others, which
    ``tail`` holds in order, and ``far`` their 64-bit hashes. Numbers are kept in byte planes."""
    return held_out_and_slice(docs).mapInArrow(encoder(head), "doc_id long, held_out boolean, slice int, ids binary, tail array<binary>, far binary")


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``chunked`` makes of the rows of ``encoded`` in one task."""
    names = ["doc_id", "lengths", "ids", "tail", "far"]
    made, first = 0, TaskContext.get().partitionId() << 32
    waiting: dict[int, list] = {}
    size: Counter[int] = Counter()

    def chunk(group: int) -> pa.RecordBatch:
        nonlocal made
        made += 1
        size[group] = 0
        (rows,) = pa.Table.from_batches(waiting.pop(group)).combine_chunks().to_batches()
        lengths, ids, far = token_arrays(rows)
        one = np.array([0, rows.num_rows], dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(one), rows.column(c)) for c in ("doc_id", "tail")]
        data = [pa.array([planes(x)], pa.binary()) for x in (lengths.astype(np.int32), ids, far)]
        number = (first + made) * (UPDATES + 1) + group
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([group == UPDATES]), pa.array([group % UPDATES], pa.int32()), lists[0], *data[:2], lists[1], data[2]],
            ["chunk", "held_out", "slice", *names],
        )

    for batch in slices(batches):
        groups = np.where(batch.column("held_out").to_numpy(zero_copy_only=False), UPDATES, batch.column("slice").to_numpy())
        lengths = pc.binary_length(batch.column("ids")).to_numpy() // 4 + 1
        for group in np.unique(groups).tolist():
            at = np.flatnonzero(groups == group)
            while len(at):
                k = int(np.searchsorted(np.cumsum(lengths[at]), CHUNK - size[group])) + 1  # up to the row that fills the chunk
                waiting.setdefault(group, []).append(batch.take(pa.array(at[:k])))
                size[group] += int(lengths[at[:k]].sum())
                at = at[k:]
                if size[group] >= CHUNK:
                    yield chunk(group)
    for group in sorted(waiting):
        yield chunk(group)


CHUNK_COLUMNS = "chunk long, held_out boolean, slice int, doc_id array<long>, lengths binary, ids binary, tail array<array<binary>>, far binary"


def chunked(texts: DataFrame) -> DataFrame:
    """chunk, held_out, slice, doc_id, lengths, ids, tail, far: rows of ``encoded`` in lists of about ``CHUNK`` tokens, whose
    texts agree in held_out and slice; numbers of all texts lie together, ``lengths`` has how many ids each text has. A chunk's
    number modulo ``UPDATES + 1`` is its slice, or ``UPDATES`` where held out. Numbers are those of the run that made them, so
    the table has to be written."""
    return texts.mapInArrow(released(chunk_rows), CHUNK_COLUMNS)


def encoded_chunks(docs: DataFrame, head: Head) -> DataFrame:
    """``chunked`` rows of ``encoded``, made in one go."""
    encode = encoder(head)
    return held_out_and_slice(docs).mapInArrow(released(lambda batches: chunk_rows(encode(batches))), CHUNK_COLUMNS)


def token_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of ``encoded``, or of one of ``chunked``: how many ids each text has, all ids, and all ``far`` if it is there."""
    join = lambda column, kind: np.concatenate([np.zeros(0, kind), *(unplaned(x, kind) for x in batch.column(column).to_pylist())])
    ids, far = join("ids", np.int32), join("far", np.int64) if "far" in batch.schema.names else np.zeros(0, np.int64)
    if "lengths" in batch.schema.names:
        return join("lengths", np.int32).astype(np.int64), ids, far
    return pc.binary_length(batch.column("ids")).to_numpy().astype(np.int64) // 4, ids, far


def with_ends(lengths: np.ndarray, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and value of each token, each text with its end."""
    result = np.empty(len(values) + len(lengths), dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(result), dtype=bool)
    inside[ends] = False
    result[inside], result[ends] = values, end
    return np.repeat(np.arange(len(lengths)), lengths + 1), result


def units_of(batch: pa.RecordBatch, own_units: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk, or all rows of ``encoded``: text number, ids and units, each text with its end (id -1, unit ``END``)."""
    for rows in slices([batch], 1 if "lengths" in batch.schema.names else max(1, batch.num_rows)):
        lengths, ids, _ = token_arrays(rows)
        text, ids = with_ends(lengths, ids, -1 - END)
        yield text, ids, np.where(ids < 0, -1 - ids, own_units[np.maximum(ids, 0)] if len(own_units) else 0)


def before(text: np.ndarray, units: np.ndarray, n: int, start: int = START) -> np.ndarray:
    """The unit ``n`` tokens earlier in the same text, or the start."""
    result = np.full(len(units), start)
    if n < len(units):
        same = text[n:] == text[:-n]
        result[n:][same] = units[:-n][same]
    return result


def hashed(key: np.ndarray, kind: int) -> np.ndarray:
    h = (key.astype(np.uint64) + np.uint64(kind + 1) * np.uint64(0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(40) & np.uint64(FEATURES - 1)).astype(np.int64)


#: The rows of the kinds that have one unit for a context.
BY_UNIT = {kind: hashed(np.arange(UNITS + 2), kind) for kind in (0, 2, 3)}


def features(text: np.ndarray, units: np.ndarray) -> list[np.ndarray]:
    """Rows of the weight table for each token."""
    one, two, three = (before(text, units, n) for n in (1, 2, 3))
    return [BY_UNIT[0][one], hashed(two * (UNITS + 2) + one, 1), BY_UNIT[2][two], BY_UNIT[3][three]]


def numbers_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text number and word number of each token, each text with its end."""
    lengths, ids, far = token_arrays(batch)
    ids = ids.astype(np.int64)
    ids[ids < 0] = far
    return with_ends(lengths, ids, END_NUMBER)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    z = x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def exact_features(text: np.ndarray, numbers: np.ndarray, kind: int) -> np.ndarray:
    """Keys of a kind: 2 x tokens, the context and the token in it; for ``ALONE`` 1 x tokens."""
    own = mixed(numbers.astype(np.uint64), 5)
    if kind == ALONE:
        return own[None]
    earlier = lambda n: before(text, numbers, n, START_NUMBER).astype(np.uint64)
    if kind == 0:
        context = mixed(earlier(1), 1)
    elif kind == 1:
        context = mixed(mixed(earlier(2), 2) ^ earlier(1), 2)
    else:
        context = mixed(earlier(kind), kind + 1)
    return np.stack([context, mixed(context ^ own, 6)])


def chunk_keys(text: np.ndarray, numbers: np.ndarray, kind: int) -> np.ndarray:
    """The ``KEY_BITS`` of all keys of a kind; of words alone, only those outside the head, as all others are known."""
    if kind == ALONE:
        text, numbers = text[numbers >> 62 == 1], numbers[numbers >> 62 == 1]
    return exact_features(text, numbers, kind) >> np.uint64(64 - KEY_BITS)


def feature_counts(texts: DataFrame) -> DataFrame:
    """kind, key, n: every feature of the training rows of ``encoded``, as a plain table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for kind in (*range(KINDS), ALONE):
                keys, n = np.unique(exact_features(*numbers_of(batch), kind), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    return texts.select("ids", "far").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def packed(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences in byte planes, as many as there must be."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + planes(steps, width)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data[1:], np.uint64, data[0]), dtype=np.uint64)


def asked(chunks: DataFrame, kind: int, bits: int, contexts: bool = True) -> DataFrame:
    """part, chunk, keys, n: the distinct features of each chunk by the first ``bits`` of their keys, and how often training
    texts have them. Without ``contexts``, those with a token in them only."""
    shift = np.uint64(KEY_BITS - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in slices(batches, 1):
            keys, n = np.unique(chunk_keys(*numbers_of(batch), kind)[0 if contexts else 1 :], return_counts=True)
            if batch.column("held_out")[0].as_py():
                n[:] = 0
            cuts = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << shift)
            some = np.flatnonzero(np.diff(cuts))
            ranges = [(int(k), int(cuts[k]), int(cuts[k + 1])) for k in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch.column("chunk")[0].as_py(), np.int64)),
                    pa.array([packed(keys[a:b] - (np.uint64(k) << shift)) for k, a, b in ranges], pa.binary()),
                    pa.array([planes(n[a:b].astype(np.uint32)) for _, a, b in ranges], pa.binary()),
                ],
                ["part", "chunk", "keys", "n"],
            )

    return chunks.select("chunk", "held_out", "lengths", "ids", "far").mapInArrow(released(run), "part int, chunk long, keys binary, n binary")


def grouped(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An ascending order of keys below ``1 << bits``, and the number of each one's distinct key in it. Keys are sorted along
    with their places in one number, without the last bits if there is no room; where those decide, the order is made anew."""
    places = max(len(keys) - 1, 1).bit_length()
    left_out = max(bits + places - 64, 0)
    order = np.sort((keys >> np.uint64(left_out)) << np.uint64(places) | np.arange(len(keys), dtype=np.uint64))
    order = (order & np.uint64((1 << places) - 1)).astype(np.int64)
    ascending = keys[order]
    if left_out and (ascending[1:] < ascending[:-1]).any():
        order = np.argsort(keys)
        ascending = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return order, np.cumsum(new) - 1


def answered(asks: DataFrame) -> DataFrame:
    """chunk, part, n: how often all training texts have the features that were asked for, in their order."""

    def total(table: pa.Table) -> pa.Table:
        keep_memory()
        keys = [unpacked(x) for x in table.column("keys").to_pylist()]
        n = np.concatenate([unplaned(x, np.uint32) for x in table.column("n").to_pylist()])
        joined = np.concatenate(keys)
        order, group = grouped(joined, int(joined.max()).bit_length())
        sums = np.empty(len(n), dtype=np.uint32)
        sums[order] = np.minimum(np.bincount(group, weights=n[order]), 0xFFFFFFFF).astype(np.uint32)[group]
        ends = np.cumsum([len(x) for x in keys])
        data = [planes(sums[b - len(x) : b]) for x, b in zip(keys, ends)]
        trim()
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "n": pa.array(data, pa.binary())})

    return asks.groupBy("part").applyInArrow(total, "chunk long, part int, n binary")


def counts_of(keys: np.ndarray, answers: pa.Table, kind: int) -> np.ndarray:
    """Counts of the ``chunk_keys`` of a chunk, from its rows of ``answered``."""
    data = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("part").column("n").to_pylist()
    n = np.concatenate([np.zeros(0, np.uint32), *(unplaned(x, np.uint32) for x in data)])
    order, group = grouped(keys.ravel(), KEY_BITS)
    result = np.empty(keys.size, dtype=np.uint32)
    result[order] = n[group]
    return result.reshape(keys.shape)


def parts(fixed: np.ndarray, counts: np.ndarray, seen: bool = False) -> np.ndarray:
    """Tokens x ``PARTS`` probabilities: of the fixed part, then of each kind and strength. ``seen``: leave the tokens
    themselves out of the counts."""
    result = np.empty((PARTS, len(fixed)))
    result[0] = fixed
    smooth = [s * fixed for s in STRENGTHS]
    for kind in range(KINDS):
        context, both = (counts[:, 2 * kind + j].astype(np.float64) for j in (0, 1))
        if seen:
            context, both = np.maximum(context - 1, 0), np.maximum(both - 1, 0)
        for j, s in enumerate(STRENGTHS):
            np.divide(both + smooth[j], context + s, out=result[1 + kind * len(STRENGTHS) + j])
    return result.T


def classes_of(neighbours: np.ndarray, frequency: np.ndarray, seed: int = 2) -> np.ndarray:
    """Class of each unit by weighted k-means on the square roots of its neighbour shares; the end has its own."""
    rows = neighbours[:UNITS]
    shares = np.sqrt((rows + 0.5 * rows.sum(axis=0) / max(1.0, rows.sum())) / (rows.sum(axis=1, keepdims=True) + 0.5))
    weight = frequency[:UNITS] + 1e-3
    k = CLASSES - 1
    centres = shares[np.argsort(-weight, kind="stable")[:k]].copy()
    label = np.zeros(UNITS, dtype=np.int64)
    for _ in range(12):
        distance = (centres**2).sum(axis=1)[None, :] - 2 * shares @ centres.T
        label = distance.argmin(axis=1)
        for c in range(k):
            mine = label == c
            if mine.any():
                centres[c] = np.average(shares[mine], axis=0, weights=weight[mine])
    return np.concatenate([label, [k, k]])  # the end, and the start, which is never predicted


def sums_by_row(rows: np.ndarray, values: np.ndarray, often: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in ``rows``, below 1 << 16, and the sums of their ``values``: frequent rows one by one, all others
    together, first their first values, then their second ones, and so on."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # of small numbers, a radix sort
    begins = np.flatnonzero(np.diff(rows[order], prepend=-1))
    lengths = np.diff(begins, append=len(rows))
    by_length = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[by_length], lengths[by_length]
    sums = np.take(values, order[begins], axis=0)
    frequent = int(np.count_nonzero(lengths >= often))
    for i in range(frequent):
        sums[i] = np.take(values, order[begins[i] : begins[i] + lengths[i]], axis=0).sum(axis=0)
    for k in range(1, often - 1):
        longer = int(np.count_nonzero(lengths > k))
        sums[frequent:longer] += np.take(values, order[begins[frequent:longer] + k], axis=0)
    return rows[order[begins]], sums


@dataclass
class MaxEnt:
    own_units: np.ndarray  # unit of each head word
    head_logs: np.ndarray  # log10 (count + 1) of head words that share a unit, else 0
    classes: np.ndarray
    unit_logs: np.ndarray  # natural log of P(unit | class before, class), classes x units
    inside_logs: np.ndarray  # log10 of each unit's denominator
    weights: np.ndarray  # features x classes
    bias: np.ndarray

    def logits(self, rows: list[np.ndarray], out: np.ndarray | None = None) -> np.ndarray:
        """Their size is bounded by the priors and the number of updates, so that their exponentials are finite: a class's
        share is at least 1e-9 of all, and a ratio at most its inverse."""
        total = np.take(self.weights, rows[0], axis=0, out=out, mode="clip")
        for r in rows[1:]:
            total += np.take(self.weights, r, axis=0)
        total += self.bias
        return total

    def token_logs(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token, without the log10 (count + 1) of words outside the head, and where those are."""
        found, outside = [np.zeros(0)], [np.zeros(0, bool)]
        hold, ones = np.empty((TOKENS, CLASSES), dtype=np.float32), np.ones(CLASSES, dtype=np.float32)
        for text, ids, units in units_of(batch, self.own_units):
            label, rows = self.classes[units], features(text, units)
            chosen = np.empty(len(units), dtype=np.float32)
            for a in range(0, len(units), TOKENS):  # in runs that stay in the cache
                some = self.logits([r[a : a + TOKENS] for r in rows], hold[: len(units) - a])
                own = some[np.arange(len(some)), label[a : a + TOKENS]]
                chosen[a : a + TOKENS] = own - np.log(np.exp(some, out=some) @ ones)
            chosen = chosen + self.unit_logs[self.classes[before(text, units, 1)], units]
            tokens = chosen / math.log(10) - self.inside_logs[units]
            if len(self.head_logs):
                tokens = tokens + np.where(ids >= 0, self.head_logs[np.maximum(ids, 0)], 0.0)
            found.append(tokens)
            outside.append((ids < 0) & (units != END))
        return np.concatenate(found), np.concatenate(outside)

    def gradient(self, batch: pa.RecordBatch, table: np.ndarray) -> None:
        """Adds observed minus expected class counts of each feature, and expected ones, to ``table``."""
        size, ones = FEATURES * CLASSES, np.ones(CLASSES, dtype=np.float32)
        expected, hold = table[size:].reshape(FEATURES, CLASSES), np.empty((SUMMED, CLASSES), dtype=np.float32)
        for text, _, units in units_of(batch, self.own_units):
            rows, label = features(text, units), self.classes[units]
            for r in rows:
                np.add.at(table[:size], r * CLASSES + label, 1.0)
            for a in range(0, len(units), SUMMED):
                p = hold[: len(units) - a]
                for b in range(0, len(p), TOKENS):
                    some = p[b : b + TOKENS]
                    self.logits([r[a + b : a + b + len(some)] for r in rows], some)
                    np.exp(some, out=some)
                    some /= (some @ ones)[:, None]
                for r in rows:
                    found, sums = sums_by_row(r[a : a + len(p)], p)
                    expected[found] = np.take(expected, found, axis=0) + sums

    def update(self, table: np.ndarray) -> None:
        observed, expected = table.reshape(2, FEATURES, CLASSES)
        step = np.clip((observed - expected) / (observed + expected + 8.0) * 2, -1, 1)
        self.weights = (self.weights + RATE * step).astype(np.float32)


def train(texts: DataFrame, counts: DataFrame, head: Head) -> MaxEnt:
    """texts: training rows of ``encoded`` or ``chunked``."""
    ids_columns = [c for c in ("lengths", "ids") if c in texts.columns]
    spark = texts.sparkSession
    own = min(OWN, len(head.counts))
    words_of_head = enumerate(head.blob.value.split(b"\n") if len(head.counts) else [])
    own_units = np.fromiter((i if i < own else ending_unit(w) for i, w in words_of_head), dtype=np.int32, count=len(head.counts))

    own_words = pa.array(head.blob.value.split(b"\n")[:own] if own else [], pa.binary())

    def inside(batch: pa.RecordBatch, table: np.ndarray) -> None:
        rest = batch.filter(pc.invert(pc.is_in(batch.column("word"), pc.unique(pa.concat_arrays([own_words, pa.array([b""], pa.binary())])))))
        endings = pc.binary_slice(rest.column("word"), -3).dictionary_encode()
        if len(endings):
            units = np.array([ending_unit(w) for w in endings.dictionary.to_pylist()], dtype=np.int64)
            table += np.bincount(units[endings.indices.to_numpy()], weights=rest.column("n").to_numpy() + 1.0, minlength=UNITS)

    denominators = 1 + gathered(counts, UNITS, inside).astype(np.float64)  # words' counts, one for each, and one for unseen words
    inside_logs = np.append(np.log10(denominators), [0.0, 0.0])
    head_logs = np.where(np.arange(len(head.counts)) < own, 0.0, np.log10(head.counts + 1.0))
    ids_only = texts.select(*ids_columns)

    def near(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for text, _, units in units_of(batch, own_units):
            same = text[1:] == text[:-1]
            left, right = units[:-1][same], units[1:][same]
            for at, other, shift in ((right, left, 0), (left, right, CONTEXTS)):
                frequent = other < CONTEXTS
                np.add.at(table, at[frequent] * 2 * CONTEXTS + other[frequent] + shift, 1.0)

    neighbours = gathered(ids_only, (UNITS + 2) * 2 * CONTEXTS, near).astype(np.float64).reshape(UNITS + 2, -1)
    classes = classes_of(neighbours, neighbours.sum(axis=1))
    pairs, sizes = CLASSES * (UNITS + 2), FEATURES * CLASSES

    def count(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for text, _, units in units_of(batch, own_units):
            label, last = classes[units], classes[before(text, units, 1)]
            np.add.at(table, last * (UNITS + 2) + units, 1.0)
            for kind, r in enumerate(features(text, units)):
                np.add.at(table, pairs + kind * sizes + r * CLASSES + label, 1.0)

    table = gathered(ids_only, pairs + 4 * sizes, count)
    grid = table[:pairs].astype(np.float64).reshape(CLASSES, UNITS + 2)
    member = np.zeros((CLASSES, UNITS + 2), dtype=bool)
    member[classes, np.arange(UNITS + 2)] = True
    member[:, START] = False
    unigram = (grid.sum(axis=0) + 0.1) * (np.arange(UNITS + 2) != START)
    by_class = member @ unigram
    plain = unigram / by_class[classes]
    totals = grid @ member.T.astype(np.float64)  # class before x class
    unit_logs = np.log(np.maximum((grid + 50 * plain) / (totals[:, classes] + 50), 1e-300)).astype(np.float32)
    prior = np.maximum(by_class, 1e-9 * by_class.sum()) / by_class.sum()  # a class that got no units is all but impossible
    weights = np.zeros((FEATURES, CLASSES), dtype=np.float32)
    for kind in range(4):
        seen = table[pairs + kind * sizes : pairs + (kind + 1) * sizes].reshape(FEATURES, CLASSES)
        ratio = (seen + 5 * prior) / ((seen.sum(axis=1, keepdims=True) + 5) * prior)
        weights += START_SHARE[kind] * np.log(ratio).astype(np.float32)
    model = MaxEnt(own_units, head_logs, classes, unit_logs, inside_logs, weights, np.log(prior).astype(np.float32))
    for k in range(UPDATES):
        shared = spark.sparkContext.broadcast(model)
        model.update(gathered(texts.filter(F.col("slice") == k).select(*ids_columns), 2 * sizes, lambda batch, out, m=shared: m.value.gradient(batch, out)))
        shared.destroy()
    return model


def with_counts(chunks: DataFrame, answers: DataFrame, model, function: Callable[[pa.RecordBatch, Iterator], pa.Table], kinds: str) -> DataFrame:
    """``function(chunk, runs)`` of each chunk and its answers; a run holds, of some tokens, the probabilities by the fixed
    part and the counts of each kind's context and of the token in it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keep_memory()
        (batch,) = left.combine_chunks().to_batches()
        fixed, known, texts = model.value
        text, numbers = numbers_of(batch)
        logs, outside = fixed.token_logs(batch)
        alone = np.zeros(len(numbers), dtype=np.uint32)  # of ends it isn't needed
        alone[numbers >= 0] = known[np.where(outside, 0, numbers)[numbers >= 0]] if len(known) else 0
        alone[outside] = counts_of(chunk_keys(text, numbers, ALONE), right, ALONE)[0]
        logs[outside] += np.log10(alone[outside] + 1.0)
        logs = logs.astype(np.float32)
        counts = np.empty((2 * KINDS, len(numbers)), dtype=np.uint32)
        for kind in range(KINDS):
            asked_for = 1 if kind in FOLLOWS else 0
            counts[2 * kind + asked_for : 2 * kind + 2] = counts_of(chunk_keys(text, numbers, kind)[asked_for:], right, kind)
        counts[0], counts[2] = before(text, alone, 1, texts), before(text, counts[1], 1, texts)
        runs = ((np.exp(logs[a : a + MIXED].astype(np.float64) * math.log(10)), counts[:, a : a + MIXED].T) for a in range(0, len(logs), MIXED))
        result = function(batch, runs)
        trim()
        return result

    chunks = chunks.select("chunk", "held_out", "doc_id", "lengths", "ids", "far")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, kinds)


def next_shares(chunks: DataFrame, answers: DataFrame, model, shares: np.ndarray) -> np.ndarray:
    """One step of the shares of the parts, over chunks of training texts."""

    def expected(batch: pa.RecordBatch, runs: Iterator) -> pa.Table:
        total = np.zeros(PARTS)
        for fixed, counts in runs:
            weighted = parts(fixed, counts, seen=True) * shares
            total += (weighted / np.maximum(weighted.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
        return pa.table({f"s{i}": [x] for i, x in enumerate(total)})

    columns = [f"s{i}" for i in range(PARTS)]
    found = with_counts(chunks, answers, model, expected, ", ".join(f"{c} double" for c in columns))
    added = shares + [x or 0.0 for x in found.agg(*[F.sum(c) for c in columns]).first()]
    return added / added.sum()


def scored(chunks: DataFrame, answers: DataFrame, model, shares: np.ndarray, base_logs: np.ndarray, end_log: float, base_unit: float) -> DataFrame:
    """chunk, at, held_out, doc_id, n_tokens, n_head, base_head, score: a row for each text, ``at`` its place in the chunk."""

    def run(batch: pa.RecordBatch, runs: Iterator) -> pa.Table:
        lengths, ids, _ = token_arrays(batch)
        n, known = lengths + 1, ids >= 0
        text = np.repeat(np.arange(len(n)), lengths)[known]
        logs = np.bincount(text, weights=base_logs[ids[known]], minlength=len(n))
        tokens = np.concatenate([np.log10(np.maximum(parts(fixed, counts) @ shares, 1e-300)) for fixed, counts in runs])
        return pa.table(
            {
                **{c: pa.array(batch.column(c).to_pylist() * len(n)) for c in ("chunk", "held_out")},
                "at": pa.array(np.arange(len(n), dtype=np.int32)), "doc_id": batch.column("doc_id").flatten(), "n_tokens": n, "n_head": np.bincount(text, minlength=len(n)),
                "base_head": logs + end_log - n * base_unit,
                "score": np.bincount(np.repeat(np.arange(len(n)), n), weights=tokens, minlength=len(n)),
            }
        ).select(["chunk", "at", "held_out", "doc_id", "n_tokens", "n_head", "base_head", "score"])

    return with_counts(chunks, answers, model, run, "chunk long, at int, held_out boolean, doc_id long, n_tokens long, n_head long, base_head double, score double")


def scores(table: DataFrame, doc_id: str = "doc_id", text: str = "text", head_limit: int = HEAD, feature_limit: int = PART_FEATURES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``table``.

    ``feature_limit``: features that are counted together, about."""
    docs = table.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    context = table.sparkSession.sparkContext
    with shuffles_removed(table.sparkSession):
        counts = written(word_counts(docs.filter(~held)), "counts", "zstd")
        sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == F.lit(b""), F.col("n"))).alias("ends")).first()
        total, distinct, ends = sums["n"] or 0, sums["v"], sums["ends"] or 0
        head = head_of(counts, head_limit)
        chunks = written(encoded_chunks(docs, head), "chunks", "zstd", "held_out", "slice")
        known = np.minimum(head.counts, 0xFFFFFFFF).astype(np.uint32)
        model = context.broadcast((train(chunks.filter("NOT held_out"), counts, head), known, min(ends, 0xFFFFFFFF)))
        bits = min(max(math.ceil(math.log2(max(total, 1) * 2 / max(feature_limit, 256))), 6), 20)
        group = F.pmod("chunk", F.lit(UPDATES + 1)).cast("int").alias("group")
        answers = [answered(asked(chunks, kind, bits, kind not in FOLLOWS)).select("*", group) for kind in (*range(KINDS), ALONE)]
        answers = [written(x, "answers", "zstd", "group").withColumn("kind", F.lit(kind)) for kind, x in enumerate(answers)]
        answers = reduce(DataFrame.unionByName, answers)
        groups = [[chunks.filter("held_out" if k == UPDATES else f"NOT held_out AND slice = {k}"), answers.filter(F.col("group") == k)] for k in range(UPDATES + 1)]
        shares = np.full(PARTS, 1 / PARTS)
        for group in groups[:UPDATES]:
            shares = next_shares(*group, model, shares)
        base = np.log10(head.counts + 1.0), math.log10(ends + 1), math.log10(total + distinct + 1)
        found = [written(scored(*group, model, shares, *base), "scored", "zstd") for group in groups]  # in turn: a group is shuffled at once
    tails = chunks.select("chunk", F.posexplode("tail").alias("at", "words")).select("chunk", "at", F.explode("words").alias("word")).join(counts, "word", "left")
    sums = tails.groupBy("chunk", "at").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("tail_log"), F.count("n").alias("tail_known"))
    return reduce(DataFrame.unionByName, found).join(sums, ["chunk", "at"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("tail_log", F.lit(0.0))).alias("base_score"),
        "score",
    )
