"""BPE against the library; packing against its own rules."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nomenroll.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [None, "", " ", "\n\n x  y\t", "it's we'll 12ab", "naïve Ünïcode Ñandú…", "漢字 かな 1½ ², \x1c \x85 \u2003a", "😀😀 \U0001f468\u200d\U0001f469", "<|endoftext|>a<|endoftext|>", "a" * 5000, " ab" * 3000 + "é"]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_ids_and_text_are_the_librarys():
    tokenizer, rng = bpe.tokenizer(PATH), random.Random(7)
    texts = TEXTS + ["".join(rng.choice("ab th'es é1\n漢") for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in texts:
        ids = tokenizer.encode(text)
        assert ids == expected(text) == packing.tokenizer(PATH).encode(text)
        assert "".join(tokenizer.decode_stream(ids, chunk=3)) == LIBRARY.decode(ids, skip_special_tokens=False) == (text or "")
    broken = [rng.randrange(50257) for _ in range(400)]
    assert "".join(tokenizer.decode_stream(broken, chunk=7)) == LIBRARY.decode(broken, skip_special_tokens=False)


def test_stream_holds_a_constant_window(monkeypatch):
    tokenizer, rng = bpe.Bpe(PATH), random.Random(1)
    data = bytes(rng.choice(b"thanediosring") for _ in range(20000))
    whole = tokenizer.merge(data)
    monkeypatch.setattr(tokenizer, "window", tokenizer.lookahead + 150)
    longest = 0
    merge = tokenizer.merge

    def seen(part):
        nonlocal longest
        longest = max(longest, len(part))
        return merge(part)

    monkeypatch.setattr(tokenizer, "merge", seen)
    assert list(tokenizer.stream(data[i : i + 64] for i in range(0, len(data), 64))) == whole
    assert longest <= tokenizer.window


@pytest.mark.parametrize("buffer", [1, 7, 40])
def test_text_in_chunks(monkeypatch, buffer):
    tokenizer, rng = bpe.Bpe(PATH), random.Random(buffer)
    monkeypatch.setattr(tokenizer, "window", tokenizer.lookahead + 40)
    runs = ["a" * 400, " " * 300, "\n" * 300, "é" * 200, "漢字" * 150, "'" * 90 + "s", "it's", "'re ", "'ve", "'l", "l", " 'm", "12" * 150, "!?" * 200, "\u3000" * 120, "<|endoftext|>", "<|endof", "<", "😀" * 100, " \n", "x", "\t ", ". "]
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(runs) for _ in range(rng.randrange(14))) for _ in range(250)]
    for text in texts:
        step = rng.choice([1, 3, 17, 1000])
        parts = list(tokenizer.encode_stream((text[i : i + step] for i in range(0, len(text), step)), buffer))
        assert [x for part in parts for x in part] == expected(text), text


def test_long_text_in_constant_memory(monkeypatch):
    tokenizer, rng = bpe.tokenizer(PATH), random.Random(9)
    words = ["the ", "naïve ", "漢字", "it's ", "\n\n", "12ab, ", "zorro", "x" * 9000, " " * 9000]
    pieces = [rng.choice(words[:-2]) if rng.random() < 0.9995 else rng.choice(words[-2:]) for _ in range(1_500_000)] + ["漢" * 300_000, "z" * 1_000_000]
    held, settled = [], tokenizer._settled

    def seen(buffer):
        held.append(len(buffer))
        return settled(buffer)

    monkeypatch.setattr(tokenizer, "_settled", seen)
    text = "".join(pieces)
    assert len(text) > 10_000_000
    ids = [x for part in tokenizer.encode_stream(text[i : i + 50_000] for i in range(0, len(text), 50_000)) for x in part]
    assert ids == expected(text) and max(held) <= bpe.BUFFER_CHARS + 50_000
    assert "".join(tokenizer.decode_stream(iter(ids))) == text


def test_lookahead_of_small_lists():
    assert bpe.lookahead([(b"a", b"b")]) == 1
    # whether a joins b depends on whether c takes b, which depends on whether d takes c
    assert bpe.lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 3
    assert bpe.lookahead([]) == 0


def test_encode_and_decode_tables(spark, docs):
    back = bpe.decode_ids(bpe.encode_texts(docs, PATH), PATH)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    rows = back.collect()
    assert len(rows) == docs.count() and all(r.ids == expected(r.text) and r.decoded == (r.text or "") for r in rows)
    assert bpe.round_trip_digests(docs.limit(0), PATH).count() == 0
    assert bpe.round_trip_digests(docs, PATH).count() == docs.count()


def test_pieces(docs):
    rows = packing.token_pieces(docs, PATH, capacity=16).collect()
    texts = {i: t for i, t in enumerate(TEXTS)} | {None: "no id"}
    for doc_id, text in texts.items():
        ids = expected(text) + [0]
        mine = sorted({tuple(r) for r in rows if r.doc_id == doc_id}, key=lambda r: r[1])
        assert [r[2] for r in mine] == [sum(x[3] for x in mine[:k]) for k in range(len(mine))]
        assert sum(r[3] for r in mine) == len(ids) and all(r[3] == 16 for r in mine[1:])
        for _, _, start, length, crc in mine:
            assert crc == zlib.crc32(bpe.little_endian(ids[start : start + length]))


@pytest.mark.parametrize("shape", ["uniform", "hot", "small", "full", "one"])
def test_plan_places_every_rank_once(shape):
    rng = random.Random(shape)
    draw = {"uniform": lambda: rng.randint(1, 256), "hot": lambda: rng.choice([100, rng.randint(1, 256)]), "small": lambda: rng.randint(1, 9), "full": lambda: 256, "one": lambda: 77}[shape]
    histogram = {}
    for _ in range(4000):
        n = draw()
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing.Plan(histogram, capacity=256, groups=64)
    places, ranks = {}, {}
    for length, a, b, first, k, offset in plan.runs:
        for x in range(a, b):
            places.setdefault(first + (x - a) // k, []).append((offset + (x - a) % k * length, length))
            ranks.setdefault(length, []).append(x)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    assert sorted(places) == list(range(plan.sequences))
    for items in places.values():
        items.sort()
        assert items[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(items, items[1:])) and sum(n for _, n in items) <= 256
    total = sum(n * c for n, c in histogram.items())
    alone = sum(c for n, c in histogram.items() if n > 128)
    assert plan.sequences <= max(-(-total // 256), alone + (sum(c for n, c in histogram.items() if n == 128) + 1) // 2) * 1.03 + 2 or shape in ("hot", "one")


def test_pack(spark):
    rows = [(i % 50, 1 + i * 7 % 60, "s") for i in range(3000)] + [(None, 5, None)] * 3
    pieces = spark.createDataFrame(rows, "doc_id long, length long, offset string")
    found = packing.pack(pieces, capacity=64, bucket_rows=100).toPandas()
    assert len(found) == len(rows) and list(found.columns) == ["doc_id", "length", "sequence_id", "offset"]
    found = found.sort_values(["sequence_id", "offset"])
    groups = found.groupby("sequence_id").length
    assert (groups.sum() <= 64).all() and (found.offset == groups.cumsum() - found.length).all()
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 64) * 1.05
    assert packing.pack(pieces.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 65)], "doc_id long, length long"), capacity=64)
