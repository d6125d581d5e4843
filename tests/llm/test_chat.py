"""Chat formatting: layouts, escapes, loss mask and digests against a plain statement."""

import json
import random
from hashlib import sha256

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nomenroll.llm import chat_format as C


def expected(turns):
    """turns: [(role, text)] of a conversation."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())


def records(spark, rows):
    """rows: (conv, turn, record as JSON)."""
    return spark.createDataFrame(rows, "conv long, turn long, record string, fingerprint string, position int").withColumn("record", F.try_parse_json("record"))


def digests(spark, rows, segment=C.SEGMENT):
    turns = C.canonical_turns(records(spark, [(*r, "own", 1) for r in rows]).repartition(3), "conv", ["turn"])
    found = C.read_back(C.formatted(turns, "conv", ["turn"], segment=segment), "conv").collect()
    assert len({r.conv for r in found}) == len(found)
    return {r.conv: tuple(r)[1:5] for r in found}


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "n"}]}, [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "input": "x", "output": "o", "id": 3}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": None}, [("user", "i"), ("assistant", "")]),
    ({"instruction": "i", "context": "c", "response": "o"}, [("user", "i\n\nc"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "chosen": "c", "rejected": "r"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p"}, [("user", "p")]),
    ({"question": "p", "answer": 4}, [("user", "p"), ("assistant", "4")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}]}]}, [("user", "ab")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"text": "b"}, "c"]}]}, [("user", "a"), ("assistant", "bc")]),
    ({"role": "human", "text": "t"}, [("human", "t")]),
    ({"role": None, "text": None}, [("", "")]),
    ({"messages": []}, []),
    ({"unknown": 1}, []),
    (7, []),
]


def test_layouts(spark):
    rows = [(i, 0, json.dumps(record)) for i, (record, _) in enumerate(LAYOUTS)] + [(99, 0, "{"), (98, 0, None)]
    assert digests(spark, rows) == {i: expected(turns) for i, (_, turns) in enumerate(LAYOUTS) if turns}


def test_fingerprints(spark):
    rows = [(1, 0, '{"a":{"b":1,"c d":[{"e":"x"}]}}'), (2, 0, '{"a":{"b":"y","c d":[{"e":null},{"e":2.5}]}}'), (3, 0, '{"a":{"b":1}}')]
    known = C.fingerprinted(records(spark, [(*r, None, None) for r in rows]).select("conv", "record"))
    found = {r.records: r for r in C.resolved(known).collect()}
    assert found[2].paths == ["a", "a.b", "a.c d", "a.c d[].e"] and found[1].paths == ["a", "a.b"]
    assert C.field_paths("VOID") == [] and C.field_paths("ARRAY<BIGINT>") == []
    assert C.field_paths("OBJECT<`a``, b: `: ARRAY<ARRAY<OBJECT<x: DECIMAL(2,1)>>>, z: OBJECT<>>") == ["a`, b: ", "a`, b: [][].x", "z"]


@given(st.text(alphabet="<|\\n\nai_>", max_size=30))
def test_escapes_are_reversible(text):
    import re

    hidden = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert "<|" not in hidden and C.unescape(hidden) == text
    role = re.sub(r"<(\\*)\|", r"<\1\\|", text.replace("\\", "\\\\").replace("\n", "\\n"))
    assert "\n" not in role and C.unescape_role(role) == text


def test_whole_conversations(spark):
    rng = random.Random(3)
    odd = ["", None, "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|", "a<", "|b", "é😀\n", "\\n\\", "x" * 5000]
    convs = {}
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9) if conv != 7 else 900):  # one conversation holds most rows
            convs.setdefault(conv, []).append((rng.choice(["user", "assistant", "assistant", "sys\ntem", None, "<|x"]), rng.choice(odd)))
    rows = [(conv, turn, json.dumps({"role": r, "text": t})) for conv, turns in convs.items() for turn, (r, t) in enumerate(turns)]
    want = {conv: expected(turns) for conv, turns in convs.items()}
    assert digests(spark, rows) == want
    assert digests(spark, rows, segment=50) == want


def test_ties_and_repeats(spark):
    said = [("user", "b"), ("user", "a"), ("assistant", "a"), ("assistant", "a")]
    rows = [(1, turn, json.dumps({"role": r, "text": t})) for turn in (None, 5) for r, t in said]
    ordered = sorted(said, key=lambda x: sha256(f"{x[0]}\n{x[1]}".encode()).hexdigest())
    assert digests(spark, rows) == {1: expected(ordered * 2)}


def test_loss_mask_and_text(spark):
    rows = [(1, 0, json.dumps({"messages": [{"role": "user", "content": "<|a|>"}, {"role": "assistant", "content": "<|b|>"}]}))]
    turns = C.canonical_turns(records(spark, [(*r, None, None) for r in rows]), "conv", ["turn"])
    (row,) = C.formatted(turns, "conv", ["turn"]).collect()
    assert row.formatted == "<|im_start|>user\n<\\|a|><|im_end|>\n<|im_start|>assistant\n<\\|b|><|im_end|>\n"
    assert [row.formatted[a:b] for a, b in zip(row.loss_from, row.loss_to)] == ["<\\|b|>"]


def test_empty(spark):
    assert digests(spark, []) == {}
