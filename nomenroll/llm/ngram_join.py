"""Exact Jaccard self-join of shingle sets by a partitioned universe.

Two sets at the threshold whose smaller one has r elements differ in at most H = r (1 - t) / t of them. For each
size band, tokens are hashed into groups of the universe, so many that one group differs in one token at most.
Such a group is found either by segment subsets (its tokens are dealt to three segments; of the three signatures
that leave one segment out, one has no differing token) or by the one-deletion neighbourhood (the group's signature
and those with one token left out). Which of the two a band uses is decided by cost: signatures to move against pairs
that a signature of so few tokens lets through among the band's documents. Bands also get spare groups, by which each
document leaves out its smallest, least telling ones, half of those that its size doesn't need, and the pigeonhole
still holds for every pair.

Equal sets are one class from the start. Signatures travel as packed arrays; equal ones of one chunk are linked there
and sent on once, so a signature shared by a third of all rows is one row of a chunk. Buckets link each signature's
documents in a star, which yields candidate clusters; inside clusters all intersections are counted exactly, in
blocks of bounded size from which only sums and spanning links come out. No link between sets is lost, and no list
of pairs is ever made.

Null, empty and blank texts have an empty set and link with nothing. Rows without an id link with nothing and have no
component. Rows that share an id are one node. Empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenroll.llm.common import components, released, slices, text_bytes, written

#: Signatures of one bucket, about, and of a chunk that is packed at once.
BUCKET_SIGNATURES = 500_000
CHUNK_SIGNATURES = 400_000
#: A block of the exact count holds so many documents and bytes of sets at most, on average.
BLOCK_DOCS, BLOCK_BYTES = 4096, 16 << 20
#: For the choice by cost: the chance, for each token that a signature covers, that unrelated documents agree in it
#: (measured: about 6e-8 for subsets of 5.6 tokens), and a pair's cost in signatures.
SHARED, PAIR_COST = 0.05, 0.1

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that part words, A-Z in lower case, a random number for each byte, and odd powers for places in a word.
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8) + 32 * np.isin(np.arange(256), range(65, 91)).astype(np.uint8)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _K[1])
_POWERS = np.cumprod(np.full(1 << 14, _K[0], dtype=np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased: a sum over its bytes, at all words at once."""
    data = np.frombuffer(text, dtype=np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(~blank)
    place = at - np.repeat(starts, sizes)
    powers = _POWERS[place % len(_POWERS)] + (place // len(_POWERS)).astype(np.uint64) * _K[2]  # the latter in words beyond 16 KB
    sums = np.add.reduceat(_BYTES[_LOWER[data[at]]] * powers, np.cumsum(sizes) - sizes)
    return mix(sums + sizes.astype(np.uint64) * _K[3])


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of all words, if they are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        h = mix(h * _K[1] + w[j : len(w) - n + 1 + j])
    return np.unique(h)


class Bands:
    """Size bands of a threshold ``num`` / ``den``, and how each finds its pairs."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * den / num)))
        self.edges = np.array(edges)
        self.differ = [(den - num) * (hi - 1) // num for hi in edges[1:]]
        least = [(h + 2) // 2 for h in self.differ]
        self.dropped = [g // 8 for g in least]
        self.groups = [g + 2 * d for g, d in zip(least, self.dropped)]
        self.deletions = [False] * len(least)

    def of(self, size: int) -> range:
        """Bands in which a set meets those of its own size and smaller ones."""
        low, high = np.searchsorted(self.edges, [max(1, -(-self.num * size // self.den)), size], side="right") - 1
        return range(int(low), int(high) + 1)

    def allocate(self, counts: dict[int, int]) -> int:
        """Decide by cost for each band, from the number of sets in it; the number of signatures to come."""
        total = 0
        for band, n in counts.items():
            if not self.differ[band]:
                continue
            size = (self.edges[band] + self.edges[band + 1]) / 2
            groups = self.groups[band] - self.dropped[band]
            each = size / self.groups[band]
            kinds = {False: (3 * groups, each * 2 / 3), True: (size + groups, max(0.0, each - 1))}
            cost = {k: s * (1 + PAIR_COST * n * SHARED**covered) for k, (s, covered) in kinds.items()}
            # without spare groups, a set's nearly empty groups would have all but empty deletion signatures
            self.deletions[band] = self.dropped[band] > 0 and cost[True] < cost[False]
            total += int(2 * n * kinds[self.deletions[band]][0])
        return total

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        found = [self._band(tokens, band) for band in self.of(len(tokens)) if self.differ[band]]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def _band(self, tokens: np.ndarray, band: int) -> np.ndarray:
        groups, seed = self.groups[band], np.full(1, band + 1, dtype=np.uint64)
        m = mix(tokens + seed * _K[0])
        group = ((m >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        cell = group * 3 + ((m & np.uint64(0xFFFFFF)) % np.uint64(3)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        bounds = np.searchsorted(cell[order], np.arange(3 * groups + 1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m[order], dtype=np.uint64)])
        cells = (sums[bounds[1:]] - sums[bounds[:-1]]).reshape(groups, 3)
        sizes = np.diff(bounds).reshape(groups, 3)
        total = cells[:, 0] + cells[:, 1] + cells[:, 2]
        kept = np.ones(groups, dtype=bool)
        # the pigeonhole needs fewer groups for smaller sets; the larger of a pair never leaves out more than the smaller
        differ = (self.den - self.num) * min(len(tokens), int(self.edges[band + 1]) - 1) // self.num
        if d := (groups - (differ + 2) // 2) // 2:
            telling = sizes.sum(axis=1) - sizes.max(axis=1)
            kept[np.argsort(telling, kind="stable")[:d]] = False
        place = mix(np.arange(groups, dtype=np.uint64) * np.uint64(4) + seed * _K[2])
        if self.deletions[band]:
            one = kept[group]
            return np.concatenate([mix(total + place)[kept], mix((total[group] - m + place[group])[one])])
        subsets = total[:, None] - cells + place[:, None] + np.arange(1, 4, dtype=np.uint64)[None, :]
        return mix(subsets[kept].ravel())


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2: each text's set, by size and 128-bit key; null keys for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, keys = [], []
            for text in text_bytes(batch):
                tokens = shingles(text, size)
                sizes.append(len(tokens))
                keys.append(blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
            halves = [[None if k is None else int.from_bytes(k[i : i + 8], "little", signed=True) for k in keys] for i in (0, 8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(h, pa.int64()) for h in halves)], ["doc_id", "n_shingles", "k1", "k2"]
            )

    return docs.mapInArrow(released(run), "doc_id long, n_shingles long, k1 long, k2 long")


def _stars(signatures: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One node of each signature, with the signature's index, and links to its other nodes."""
    order = np.lexsort((nodes, signatures))
    signatures, nodes = signatures[order], nodes[order]
    new = np.append(True, signatures[1:] != signatures[:-1])
    head = nodes[np.maximum.accumulate(np.where(new, np.arange(len(nodes)), 0))]
    other = head != nodes
    links = np.stack([head[other], nodes[other]], axis=1)
    return np.stack([signatures[new].view(np.int64), nodes[new]], axis=1), np.unique(links, axis=0) if len(links) else links


def _packed(at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Pairs of longs as one binary for each bucket."""
    order = np.argsort(at, kind="stable")
    found, begins = np.unique(at[order], return_index=True)
    parts = [rows[order[a:b]].tobytes() for a, b in zip(begins, [*begins[1:], len(order)])]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(parts, pa.binary())], ["bucket", "data"])


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with all its pairs, from rows in order of buckets."""
    held: list[bytes] = []
    bucket = None
    for batch in batches:
        for number, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
            if held and number != bucket:
                yield bucket, np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2)
                held = []
            bucket = number
            held.append(data.as_py())
    if held:
        yield bucket, np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2)


def candidate_links(docs: DataFrame, size: int, bands: Bands, buckets: int) -> DataFrame:
    """a, b: stars over the nodes of each signature. Pairs that meet in many buckets are united before they are rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            heads, links = _stars(*(np.concatenate(x) for x in zip(*held)))
            at = (heads[:, 0].view(np.uint64) >> np.uint64(20)).astype(np.int64) % buckets
            made = -1 - np.arange(len(links)) % buckets  # links that are already made go along
            return _packed(np.concatenate([at, made]), np.concatenate([heads, links]))

        count = 0
        for batch in slices(batches):
            for node, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch)):
                tokens = shingles(text, size)
                key = blake2b(tokens.tobytes(), digest_size=16).digest()
                if key in seen or not len(found := bands.signatures(tokens)):
                    continue
                seen.add(key)
                held.append((found, np.full(len(found), node, dtype=np.int64)))
                count += len(found)
            if count > CHUNK_SIGNATURES:
                yield flush()
                held, count = [], 0
                seen.clear()
        if held:
            yield flush()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _blobs(batches):
            links = rows if bucket < 0 else _stars(rows[:, 0].view(np.uint64), rows[:, 1])[1]
            at = (mix(links[:, 0].view(np.uint64) * _K[0] + links[:, 1].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            yield _packed(at, links)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blobs(batches):
            links = np.unique(rows, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, i])) for i in (0, 1)], ["a", "b"])

    blobs = "bucket long, data binary"
    gather = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    return gather(gather(docs.mapInArrow(released(pack), blobs)).mapInArrow(released(link), blobs)).mapInArrow(released(unite), "a long, b long")


def exact_links(members: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """members: cluster, part, parts, rep, copies, text. Rows (a, links, null) with a share of a's links, and
    (a, null, b) with links that span what a block connects."""
    names = ["cluster", "part", "parts", "rep", "copies", "tokens"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = pa.array([shingles(x, size).tobytes() for x in text_bytes(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), tokens], names)

    made = members.mapInArrow(released(sets), "cluster long, part int, parts int, rep long, copies long, tokens binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    pairs = made.select("*", other).withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o")}).drop("o", "parts")
    keys = ["cluster", "i", "j"]

    def count(rows: list[tuple]) -> pa.RecordBatch:
        i, j = rows[0][0][1:]
        first = [r for r in rows if r[1] == i]
        second = first if i == j else [r for r in rows if r[1] == j]
        tokens = [np.frombuffer(r[4], dtype=np.uint64) for r in second]
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        reps, copies = np.array([r[2] for r in second], dtype=np.int64), np.array([r[3] for r in second], dtype=np.int64)
        every = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(second)), sizes)[order]
        sums: dict[int, int] = {}
        parent: dict[int, int] = {}
        span: list[tuple[int, int]] = []

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for number, row in enumerate(first if len(second) else []):
            mine = np.frombuffer(row[4], dtype=np.uint64)
            low, high = np.searchsorted(every, mine, side="left"), np.searchsorted(every, mine, side="right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(second))
            near = den * common >= num * (len(mine) + sizes - common)
            if i == j:
                near[number] = False
            found = np.flatnonzero(near)
            if len(found):
                sums[row[2]] = sums.get(row[2], 0) + int(copies[found].sum())
                for k in found:
                    b = int(reps[k])
                    if i != j:
                        sums[b] = sums.get(b, 0) + row[3]
                    x, y = root(row[2]), root(b)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        span.append((row[2], b))
        a = [*sums, *(x for x, _ in span)]
        links = [*sums.values(), *[None] * len(span)]
        b = [*[None] * len(sums), *(y for _, y in span)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, links, b)], ["a", "links", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches, 64):
            columns = [batch.column(c).to_pylist() for c in (*keys, "part", "rep", "copies", "tokens")]
            for c, i, j, part, rep, copies, tokens in zip(*columns):
                if held and held[0][0] != (c, i, j):
                    yield count(held)
                    held = []
                held.append(((c, i, j), part, rep, copies, tokens))
        if held:
            yield count(held)

    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(run), "a long, links long, b long")


def similar_sets(table: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents linked directly): a row for each row of ``table``."""
    docs = table.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = written(set_table(docs, size), "sets")
    full = sets.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    largest = classes.agg(F.max("n_shingles").alias("n")).first()["n"] or 1
    bands = Bands(num, den, largest)
    edges = F.array(*[F.lit(int(e)) for e in bands.edges])
    band = F.size(F.filter(edges, lambda e: e <= F.col("n_shingles"))) - 1
    counts = {r["band"]: r["n"] for r in classes.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    buckets = max(1, bands.allocate(counts) // BUCKET_SIGNATURES)
    candidates = candidate_links(docs.filter("doc_id IS NOT NULL"), size, bands, buckets)
    own = full.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    clusters = written(components(written(candidates.unionByName(own), "candidates")), "clusters")
    chosen = clusters.withColumnRenamed("node", "rep").join(classes, "rep")
    sums = chosen.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).filter("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    chosen = chosen.join(sums.select("component", parts.alias("parts")), "component").select(
        "rep", "copies", F.col("component").alias("cluster"), "parts", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int").alias("part"), "k1", "k2"
    )
    members = docs.join(chosen, F.col("doc_id") == F.col("rep")).select("cluster", "part", "parts", "rep", "copies", "text")
    found = written(exact_links(members, size, num, den), "exact")
    linked = found.filter("links IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(written(found.filter("b IS NOT NULL").select("a", "b"), "spans"))
    known = classes.select("k1", "k2", "rep", "copies").join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(linked, "rep", "left")
    result = full.join(known, ["k1", "k2"]).select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "rep").alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    alone = sets.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return result.unionByName(alone)
