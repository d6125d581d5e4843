"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text state machine.

Merges are applied by rank. Whether some merge ever crosses a position depends on the bytes to its right only as
far as the merge list lets information travel left, and each such step needs a merge of lower rank. ``lookahead``
computes that distance from the list; a token that ends at least so many bytes before the end of what has been read
is final, is emitted, and its bytes are dropped. So any run of bytes is encoded with a buffer of constant size.
Words are short, so nearly all of them are encoded in one step; a bounded memo keeps the frequent ones. Texts come in
chunks: a splitter settles the words that no later character can change, and hands on a word that fills its buffer to
the transducer bit by bit, so a text of any length takes constant memory.

Null and empty texts give no ids. The special token's string in a text becomes its id, as in the library.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from nomenroll.llm.common import slices

# The public pattern that splits text before merges, for texts of these characters only. Other texts
# are split by the library, whose own tables say what a letter or a number is.
LATIN = "A-Za-zÀ-ÖØ-öø-ƺ"
MARKS = "¡-©«-±´¶-¸»¿×÷\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
PLAIN = rf"'(?:[stmd]|re|ve|ll)| ?(?:[{LATIN}]+|[0-9]+|[^\t-\r 0-9{LATIN}]+)|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters of a chunk, and of text that the splitter holds before it settles some.
CHUNK_CHARS = BUFFER_CHARS = 1 << 16
#: Words that the memo holds at most, some 80 MB; it starts anew beyond that.
MEMO_WORDS = 400_000
#: A run up to this length is merged by rescanning; a heap serves longer ones.
SHORT = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the vocabulary file: a byte that is a visible Latin-1 character stands for itself,
    the others follow from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a position that decide whether a merge crosses it.

    ``reach`` of a merge (u, v): bytes from the start of v that decide whether it happens where u stands. It needs v
    itself, and that no earlier merge takes a token at v's right edge away; such a merge starts with a token on the
    right spine of v's derivation while that token stands there.
    """
    rank = {u + v: i for i, (u, v) in reversed(list(enumerate(merges)))}
    ranks: dict[bytes, list[int]] = {}
    best: dict[bytes, list[int]] = {}
    longest = 0
    for i, (u, v) in enumerate(merges):
        extra, token, limit = 0, v, i
        while True:
            if token in ranks and (k := bisect_left(ranks[token], limit)):
                extra = max(extra, best[token][k - 1])
            if token not in rank:
                break
            limit = rank[token]
            token = merges[limit][1]
        reach = len(v) + extra
        ranks.setdefault(u, []).append(i)
        best.setdefault(u, []).append(max(reach, best[u][-1] if best.get(u) else 0))
        longest = max(longest, reach)
    return longest


class Bpe:
    """A vocabulary file of the ``tokenizers`` library with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(token): i for token, i in data["model"]["vocab"].items() if all(c in alphabet for c in token)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bytes_of = {i: token for token, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.merged = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in reversed(list(enumerate(merges)))}
        self.rank_of, self.none = {pair: i for pair, (i, _) in self.merged.items()}.get, len(merges)
        self.made = [vocab[a + b] for a, b in merges]
        self.lookahead = lookahead(merges)
        self.window = self.lookahead + max(map(len, self.bytes_of.values())) + 4096
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._library, self._plain, self._other = ByteLevel(add_prefix_space=False), re.compile(PLAIN), re.compile(rf"[^\t-\r -~{LATIN}{MARKS}]")
        self._memo = _Memo(self)

    def merge(self, data: bytes) -> list[int]:
        """Ids of a run of bytes without any split."""
        if len(data) > SHORT:
            return self._merge_long(data)
        ids, rank_of, none = [self.single[b] for b in data], self.rank_of, self.none
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i : i + 2] = [self.made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        ids = [self.single[b] for b in data]
        n, merged = len(ids), self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := merged.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merged.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merged.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one run of bytes that comes in chunks; the buffer never exceeds the window and one chunk."""
        buffer = b""
        for chunk in chunks:
            buffer += chunk
            while len(buffer) > self.window:
                stable, done = self.window - self.lookahead, 0
                for token in self.merge(buffer[: self.window]):
                    size = len(self.bytes_of[token])
                    if done + size > stable:
                        break
                    done += size
                    yield token
                buffer = buffer[done:]
        yield from self.merge(buffer)

    def word(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        if len(data) <= self.window:
            return tuple(self.merge(data))
        return tuple(self.stream(data[i : i + 4096] for i in range(0, len(data), 4096)))

    def pieces(self, text: str) -> list[str]:
        """The words that merges don't cross."""
        if text.isascii():
            plain = not re.search(r"[\x1c-\x1f]", text)
        else:
            plain = self._other.search(text) is None
        if plain:
            return self._plain.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo = self._memo
        if self._split is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(memo.__getitem__, self.pieces(text))))
        ids: list[int] = []
        for part in self._split.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids.extend(chain.from_iterable(map(memo.__getitem__, self.pieces(part))))
        return ids

    def _settled(self, buffer: str) -> tuple[list[int], int]:
        """Ids that nothing after ``buffer`` can change, and how many of its characters they stand for."""
        held = len(buffer)
        if self._split is not None:
            if ends := [m.end() for m in self._split.finditer(buffer)]:
                return self.encode(buffer[: ends[-1]]), ends[-1]
            longest = max(map(len, self.special))
            for begin in range(max(0, held - longest), held):  # what may be the beginning of a special token
                if any(s.startswith(buffer[begin:]) for s in self.special):
                    held = begin
                    break
        pieces = self.pieces(buffer[:held])
        # the last word may go on, or, of blanks, lose its last one; a quote and two letters may become one word
        kept = 2 if len(pieces) > 1 and pieces[-2] == "'" and len(pieces[-1]) <= 2 else 1
        if len(pieces) > kept:
            done = pieces[:-kept]
            return list(chain.from_iterable(map(self._memo.__getitem__, done))), sum(map(len, done))
        if not pieces or "'" in pieces[0]:  # the rest of a run of marks would begin with a quote
            return [], 0
        return self._emitted(pieces[0].encode())

    def _emitted(self, data: bytes) -> tuple[list[int], int]:
        """Stable ids of a word that isn't over, up to the end of a character, and the characters they stand for."""
        ids: list[int] = []
        done = at = count = 0  # at: the last end of a character between tokens, after ``count`` ids
        while len(data) - done > self.window + 4:
            stable = done + self.window - self.lookahead - 4
            for token in self.merge(data[done : done + self.window]):
                size = len(self.bytes_of[token])
                if done + size > stable:
                    break
                done += size
                ids.append(token)
                if data[done] & 0xC0 != 0x80:
                    at, count = done, len(ids)
        return ids[:count], len(data[:at].decode())

    def encode_stream(self, chunks: Iterable[str], buffer_chars: int | None = None) -> Iterator[list[int]]:
        """Ids of a text that comes in chunks, list by list; a buffer and a chunk are held, and no more.

        (A run of marks with quotes in it is the exception: it is held until it ends.)
        """
        limit, buffer = BUFFER_CHARS if buffer_chars is None else buffer_chars, ""
        for chunk in chunks:
            buffer += chunk
            while len(buffer) > limit:
                ids, size = self._settled(buffer)
                if not size:
                    break
                yield ids
                buffer = buffer[size:]
        yield self.encode(buffer)

    def decode_stream(self, ids: Iterable[int], chunk: int = 1 << 16) -> Iterator[str]:
        """Text of ids in pieces: a state machine keeps at most three bytes of an unfinished character, and what can't
        become one is U+FFFD. Ids that the vocabulary hasn't are skipped."""
        decoder, ids, known = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids), self.bytes_of
        while part := list(islice(ids, chunk)):
            yield decoder.decode(b"".join([known.get(i, b"") for i in part]))
        yield decoder.decode(b"", True)


class _Memo(dict):
    """Word to ids, made on first use; bounded."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = self.bpe.word(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Bpe:
    """One per worker process and file."""
    return Bpe(path)


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an ``ids`` array for its text column. No shuffle; other columns pass through as they are."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    schema = StructType([f for f in df.schema if f.name != ids]).add(ids, ArrayType(IntegerType()))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in slices(batches):
            encoded = pa.array([bpe.encode(x) for x in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([encoded if n == ids else batch.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give empty text."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([f for f in df.schema if f.name != text]).add(text, StringType())
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in slices(batches):
            decoded = pa.array(["".join(bpe.decode_stream(x or [])) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([decoded if n == text else batch.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, in chunks, and keeps neither ids nor text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in slices(batches):
            counts, encoded, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                count, there, back = 0, hashlib.sha256(), hashlib.sha256()

                def told(text: str = text or "") -> Iterator[list[int]]:
                    nonlocal count
                    for ids in bpe.encode_stream(text[i : i + CHUNK_CHARS] for i in range(0, len(text), CHUNK_CHARS)):
                        count += len(ids)
                        there.update(little_endian(ids))
                        yield ids

                for part in bpe.decode_stream(chain.from_iterable(told())):
                    back.update(part.encode())
                counts.append(count)
                encoded.append(there.hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def little_endian(ids: list[int]) -> bytes:
    """Unsigned 32-bit, little-endian."""
    packed = array("I", ids)
    if packed.itemsize != 4:
        raise TypeError("needs a four-byte unsigned int")
    import sys

    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()
