"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector the concatenated signs of random projections as its key, orders all vectors of the pass by
key, and compares each with the next ``window`` ones; pairs at the threshold are verified in double precision and
united across passes. Equal vectors are one class beforehand, so groups of copies never fill windows. The number of
passes follows from the number of classes: keys of two vectors at the threshold agree on a bit with probability
1 - angle / pi, about log2(classes / window) leading bits must agree, and passes are added until the wanted share of
such pairs meets in at least one. Closer pairs meet more often.

That number suits vectors that are spread evenly. So each pass also measures, for each vector, how long a key prefix it
shares with the one a window away, on both sides: what a window can't reach there adds to its chance to have missed a
pair. Vectors whose chance stays above the wanted one meet again among themselves, in as many passes as their density
asks for, or, where that costs no more, all with all in blocks. Pairs that have an end elsewhere have met by that end.
Vectors near the edge of a task count as not measured there.

Windows give the components. Direct links are then counted exactly inside each component, in blocks of bounded size:
a clique larger than a window loses no link. Counts leave a block, pairs don't.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, link with
nothing. Vectors of different lengths are never compared. Repeated rows are copies of each other. Rows that share an id
and not the vector are vectors of their own, which may link with each other, and are counted as such; each row is in the
component of its own vector. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenroll.llm.common import components, written

THRESHOLD = 0.9
WINDOW = 48
#: Share of pairs right at the threshold that should meet.
RECALL = 0.97
KEY_BITS = 60
#: Vectors on each side of a block of the exact count.
BLOCK = 1024


def passes_for(classes: int, window: int = WINDOW, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    agree = 1 - math.acos(threshold) / math.pi
    meet = agree ** max(1.0, math.log2(max(2, classes) / window))
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def missed(keys: np.ndarray, groups: np.ndarray, window: int, threshold: float) -> np.ndarray:
    """Log of the chance that a pair at the threshold didn't meet in this pass, for each row but ``window`` at both ends."""
    n = len(keys)
    agree = 1 - math.acos(threshold) / math.pi
    apart = (keys[window:] ^ keys[: n - window]) >> 10
    shared = np.where(apart == 0, KEY_BITS, KEY_BITS - 10 - np.frexp(apart.astype(np.float64))[1])
    meet = np.where((groups[window:] == groups[: n - window]).all(axis=1), agree ** (shared + 1.0), 1.0)
    meet = (meet[window:] + meet[: len(meet) - window]) / 2
    return np.log(np.maximum(1 - meet, 1e-20))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # very long and very short vectors keep their direction
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one length each."""
    sizes = np.array(batch.column(column).value_lengths())
    for size in np.unique(sizes):
        yield batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))


def keyed(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """rep, vector -> pass, size, key, rep, vector: one row for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)
        for whole in batches:
            for batch in by_length(whole, "vector"):
                vectors = matrix(batch.column("vector"))
                size = vectors.shape[1]
                for p in range(passes):
                    planes = np.random.default_rng([seed, p, size]).standard_normal((size, KEY_BITS))
                    keys = ((vectors @ planes) > 0) @ weights
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(keys), batch.column("rep"), batch.column("vector")],
                        ["pass", "size", "key", "rep", "vector"],
                    )

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("rep", "vector").mapInArrow(run, f"pass int, size int, key long, rep long, vector {kind}")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, by label spreading with pointer jumps."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def window_links(ordered: DataFrame, window: int, threshold: float) -> DataFrame:
    """a, b, miss: for each vector of a run, the smallest index it is connected with by pairs inside windows; with null b,
    what ``missed`` says of a."""
    names = ["a", "b", "miss"]

    def compare(keys: np.ndarray, reps: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        vectors, n, found = unit(vectors), len(reps), []
        for d in range(1, min(window, n - 1) + 1):
            same = (keys[d:] == keys[:-d]).all(axis=1) & (np.einsum("ij,ij->i", vectors[d:], vectors[:-d]) >= threshold)
            at = np.flatnonzero(same)
            found.append(np.stack([at, at + d]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        label = roots(n, a, b)
        at = np.flatnonzero(label != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(reps[label[at]]), pa.nulls(len(at), pa.float64())], names)

    def measure(keys: np.ndarray, reps: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        inner = reps[window : len(reps) - window]
        return pa.RecordBatch.from_arrays([pa.array(inner), pa.nulls(len(inner), pa.int64()), pa.array(missed(places, keys, window, threshold))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            cuts = np.flatnonzero(np.diff(np.array(whole.column("size")))) + 1
            for begin, end in zip([0, *cuts], [*cuts, whole.num_rows]):
                batch = whole.slice(begin, end - begin)
                keys = np.stack([np.array(batch.column(c)) for c in ("pass", "size")], axis=1)
                parts = [keys, np.array(batch.column("rep")), matrix(batch.column("vector")), np.array(batch.column("key"))]
                if held is not None and held[2].shape[1] == parts[2].shape[1]:
                    parts = [np.concatenate(x) for x in zip(held, parts)]
                if len(parts[1]):
                    yield compare(*parts[:3])
                    if len(parts[1]) > 2 * window:
                        yield measure(parts[0], parts[1], parts[3])
                    held = [x[-2 * window :] for x in parts]

    return ordered.mapInArrow(run, "a long, b long, miss double")


def in_blocks(members: DataFrame, function: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``function`` of each two parts i <= j of a component, from component, part, parts, rep, copies, vector."""
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = members.select("component", "rep", "copies", "vector", "part", F.explode(other).alias("o")).select(
        "component", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "rep", "copies", "vector"
    )
    keys = ["component", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = np.stack([np.array(batch.column(k)) for k in keys], axis=1)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                key = tuple(at[begin]) if end > begin else last
                if held and key != last:
                    yield function(pa.Table.from_batches(held))
                    held = []
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
                    last = key
        if held:
            yield function(pa.Table.from_batches(held))

    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """component, part, parts, rep, copies, vector -> rep, links: to other classes, each counted with its copies."""

    def count(rows: pa.Table) -> pa.RecordBatch:
        i, j, part = rows.column("i")[0].as_py(), rows.column("j")[0].as_py(), np.array(rows.column("part"))
        reps, copies = np.array(rows.column("rep")), np.array(rows.column("copies"))
        vectors = unit(matrix(rows.column("vector").combine_chunks()))
        if i == j:
            near = vectors @ vectors.T >= threshold
            np.fill_diagonal(near, False)
            links = near @ copies
        else:
            first, second = np.flatnonzero(part == i), np.flatnonzero(part == j)
            near, links = vectors[first] @ vectors[second].T >= threshold, np.zeros(len(reps), np.int64)
            links[first], links[second] = near @ copies[second], copies[first] @ near
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(links.astype(np.int64))], ["rep", "links"])

    return in_blocks(members, count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def all_links(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """a, b: links that connect what any two vectors of one length connect."""

    def unite(rows: pa.Table) -> pa.RecordBatch:
        reps, part = np.array(rows.column("rep")), np.array(rows.column("part"))
        vectors = unit(matrix(rows.column("vector").combine_chunks()))
        first, second = np.flatnonzero(part == rows.column("i")[0].as_py()), np.flatnonzero(part == rows.column("j")[0].as_py())
        a, b = np.nonzero(vectors[first] @ vectors[second].T >= threshold)
        label = roots(len(reps), first[a], second[b])
        at = np.flatnonzero(label != np.arange(len(reps)))
        return pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(reps[label[at]])], ["a", "b"])

    members = classes.select(F.size("vector").cast("long").alias("component"), "rep", F.lit(1).cast("long").alias("copies"), "vector")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    members = members.join(F.broadcast(sizes), "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
    return in_blocks(members, unite, "a long, b long")


def all_rounds(classes: DataFrame, window: int, threshold: float, recall: float, block: int, seed: int) -> DataFrame:
    """a, b: links of all classes, by as many passes as each vector's neighbourhood asks for."""
    left, passes, links, wanted = classes.select("rep", "vector"), passes_for(classes.count(), window, threshold, recall), None, math.log(1 - recall)
    state, number = None, 0
    while True:
        order = ["pass", "size", "key"]
        ordered = keyed(left, passes, seed + 1000 * number).repartitionByRange(*order).sortWithinPartitions(*order)
        found = written(window_links(ordered, window, threshold), "windows")
        some = found.filter("b IS NOT NULL").select("a", "b")
        links = some if links is None else links.unionByName(some)
        miss = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("miss").alias("now"))
        state = left.select("rep") if state is None else state
        before = F.col("miss") if "miss" in state.columns else F.lit(0.0)
        state = state.join(miss, "rep", "left").withColumn("now", F.coalesce("now", F.lit(0.0))).select("rep", (before + F.col("now")).alias("miss"), (F.col("now") / passes).alias("each"))
        state = written(state.filter(F.col("miss") > wanted), "state")
        asked = F.when(F.col("each") < 0, (F.lit(wanted) - F.col("miss")) / F.col("each")).otherwise(1e9)
        sums = state.agg(F.count("*").alias("n"), F.percentile_approx(asked, 0.9).alias("passes")).first()
        if not sums["n"]:
            return links
        left = written(classes.select("rep", "vector").join(state.select("rep"), "rep", "left_semi"), "left")
        passes, number = max(1, math.ceil(sums["passes"])), number + 1
        if sums["n"] <= max(block, passes * min(block, 8 * window)):
            return links.unionByName(all_links(left, threshold, block))


def near_duplicates(
    table: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    window: int = WINDOW,
    recall: float = RECALL,
    block: int = BLOCK,
    seed: int = 9,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``table``."""
    vector = F.col(embedding)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector"))
    fine = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    digest = F.struct(F.xxhash64(F.lit(1), "vector").alias("h1"), F.xxhash64("vector", F.lit(2)).alias("h2"))
    good = rows.filter(fine).select("vec_id", "vector", digest.alias("digest")).select("vec_id", "vector", "digest.*")
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # a class has a number of its own, since one id may have several vectors; fixed, as it is written
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    links = all_rounds(classes, window, threshold, recall, block, seed)
    joined = written(components(written(links.distinct(), "links")), "joined").withColumnRenamed("node", "rep")
    sizes = joined.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    members = classes.select("rep", "copies", "vector").join(joined.join(sizes, "component"), "rep")
    members = members.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
    counted = count_links(members, threshold)
    smallest = joined.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.select("h1", "h2", "rep", "least", "copies").join(joined, "rep", "left").join(smallest, "component", "left").join(counted, "rep", "left")
    linked = good.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
