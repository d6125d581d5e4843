"""Chat formatting: records of many layouts into canonical turns, one template, and a loss mask over it.

Schema fingerprinting: a record is a variant value. Its schema, without the types of scalars, lists its nested field
paths; the hash of that is the record's fingerprint. Records have few distinct fingerprints, combined on the map side;
each is resolved once against declarative layouts (the one with the most of its paths present, at least one turn whole),
and records meet their layout by fingerprint. Turns are then variant expressions, without Python.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside texts and roles, ``<``, any number of
backslashes, ``|`` gets one more backslash, so no text holds a control string, and reading back takes it away; in
roles, backslashes and line breaks are escaped too. The loss mask covers the escaped text of each assistant turn.

A conversation is never gathered: turns are sorted by range over (conversation, order), and each task writes segments
of about ``SEGMENT`` characters of the conversations that it meets; a conversation is its segments in order. Digests are
read back from segments: where a segment is a whole conversation, at once; otherwise its segments stream through one
task in order, which a sequential digest needs, with one segment in memory at a time.

Defined cases: null texts and roles are empty; rows of a null conversation are one conversation; null orders come first,
and turns with equal orders go by a digest of role and text; equal rows are turns of their own. A record that
isn't valid or has no known layout makes no turn (``resolved`` shows it); so does an empty table, and an empty list of
messages. Fields that a layout doesn't name are left alone, so extra columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenroll.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"
#: Code points of a segment, unless a single turn is longer.
SEGMENT = 1 << 18
#: Distinct fingerprints up to which their layouts are broadcast; joined by shuffle beyond.
BROADCAST_LAYOUTS = 10_000
#: Names of roles in layouts that have their own.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Each:
    """A turn for each element of the list at ``path``; ``text`` may be a list of parts whose ``part`` is joined."""

    path: str
    role: str
    text: str
    part: str = "text"
    aliases: Mapping[str, str] = field(default_factory=dict)

    @property
    def needs(self) -> list[str]:
        return [f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"]


@dataclass(frozen=True)
class One:
    """One turn of a given role from the fields at ``paths``; parts that are there are joined by a blank line."""

    role: str
    paths: Sequence[str]
    optional: bool = False

    @property
    def needs(self) -> list[str]:
        return [] if self.optional else [self.paths[0]]


@dataclass(frozen=True)
class Row:
    """The record is a turn itself."""

    role: str
    text: str

    @property
    def needs(self) -> list[str]:
        return [self.role, self.text]


@dataclass(frozen=True)
class Layout:
    name: str
    turns: Sequence[Each | One | Row]

    @property
    def needs(self) -> list[str]:
        return [p for t in self.turns for p in t.needs]


_SYSTEM = One("system", ["system"], optional=True)
LAYOUTS = (
    Layout("turn_text", [Row("role", "text")]),
    Layout("turn_content", [Row("role", "content")]),
    Layout("messages", [_SYSTEM, Each("messages", "role", "content")]),
    Layout("messages_text", [_SYSTEM, Each("messages", "role", "text")]),
    Layout("conversations", [_SYSTEM, Each("conversations", "from", "value", aliases=ALIASES)]),
    Layout("instruction", [_SYSTEM, One("user", ["instruction", "input"]), One("assistant", ["output"])]),
    Layout("instruction_response", [_SYSTEM, One("user", ["instruction", "context"]), One("assistant", ["response"])]),
    Layout("prompt_completion", [_SYSTEM, One("user", ["prompt"]), One("assistant", ["completion"])]),
    Layout("prompt_response", [_SYSTEM, One("user", ["prompt"]), One("assistant", ["response"])]),
    Layout("prompt_chosen", [_SYSTEM, One("user", ["prompt"]), One("assistant", ["chosen"])]),
    Layout("question_answer", [_SYSTEM, One("user", ["question"]), One("assistant", ["answer"])]),
    Layout("prompt", [_SYSTEM, One("user", ["prompt"])]),
)

_TOKEN = re.compile(r"(OBJECT|ARRAY)<|>|, |`((?:[^`]|``)*)`: |([^\s`<>:,]+): |([A-Z][A-Z_0-9]*(?:\([0-9, ]*\))?)")


def field_paths(shape: str) -> list[str]:
    """Nested paths of a variant's schema: ``messages[].role`` for a field of the objects of a list."""
    found, open_, path = set(), [], ""
    for m in _TOKEN.finditer(shape):
        kind, quoted, plain = m.group(1), m.group(2), m.group(3)
        if quoted is not None or plain is not None:
            name = plain if plain is not None else quoted.replace("``", "`")
            path = f"{open_[-1]}.{name}" if open_ and open_[-1] else name
            found.add(path)
        elif kind:
            path = f"{path}[]" if kind == "ARRAY" else path
            open_.append(path)
        elif m.group(0) == ">":
            open_.pop()
    return sorted(found)


def choose(paths: Sequence[str], layouts: Sequence[Layout]) -> str | None:
    """The layout whose needs are all met and most in number; the earlier one of equals."""
    fits = [x for x in layouts if set(x.needs) <= set(paths)]
    return max(fits, key=lambda x: len(x.needs)).name if fits else None


def fingerprinted(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``fingerprint`` and ``shape``: the record's nested fields without the types of scalars."""
    shape = F.regexp_replace(F.schema_of_variant(record), r"(?<=: |<)(?!OBJECT<|ARRAY<)[A-Z][A-Z_0-9 ]*(\([0-9, ]*\))?(?=,|>)", "VOID")
    return records.withColumn("shape", F.coalesce(shape, F.lit(""))).withColumn("fingerprint", F.sha2("shape", 256))


def resolved(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """fingerprint, shape, paths, layout (null if none fits), records: a row per fingerprint of ``fingerprinted`` rows."""
    counted = records.groupBy("fingerprint", "shape").agg(F.count("*").alias("records"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [field_paths(x) for x in batch.column("shape").to_pylist()]
            found = [choose(p, layouts) for p in paths]
            columns = [batch.column("fingerprint"), batch.column("shape"), pa.array(paths, pa.list_(pa.string())), pa.array(found, pa.string()), batch.column("records")]
            yield pa.RecordBatch.from_arrays(columns, ["fingerprint", "shape", "paths", "layout", "records"])

    return counted.mapInArrow(run, "fingerprint string, shape string, paths array<string>, layout string, records long")


def _path(path: str) -> str:
    return "$" + "".join(f"['{x}']" for x in path.split("."))


def _value(record: Column, path: str) -> Column:
    return F.try_variant_get(record, _path(path), "string")


def _parts(record: Column, path: str, part: str) -> Column:
    """Text at ``path``; of a list, its strings and its objects' ``part``, put together."""
    listed = F.try_variant_get(record, _path(path), "array<variant>")
    piece = lambda x: F.coalesce(F.try_variant_get(x, _path(part), "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit(""))
    return F.coalesce(F.array_join(F.transform(listed, piece), ""), _value(record, path))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns_of(record: Column, rule: Each | One | Row) -> Column:
    if isinstance(rule, Row):
        return F.array(_turn(_value(record, rule.role), _parts(record, rule.text, "text")))
    if isinstance(rule, Each):
        listed = F.coalesce(F.try_variant_get(record, _path(rule.path), "array<variant>"), F.expr("cast(array() as array<variant>)"))

        def turn(x: Column) -> Column:
            role = _value(x, rule.role)
            for name, canonical in rule.aliases.items():
                role = F.when(_value(x, rule.role) == name, F.lit(canonical)).otherwise(role)
            return _turn(role, _parts(x, rule.text, rule.part))

        return F.transform(listed, turn)
    parts = [_value(record, p) for p in rule.paths]
    joined = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n")
    one = F.array(_turn(F.lit(rule.role), joined))
    nothing = F.expr("cast(array() as array<struct<role: string, text: string>>)")
    return F.when(parts[0].isNotNull(), one).otherwise(nothing) if rule.optional else one


def canonical_turns(records: DataFrame, conv: str, order: Sequence[str], record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """conv, order, position, role, text: a row per turn of ``records``, whose ``record`` is a variant."""
    known = fingerprinted(records.select(conv, *order, F.col(record).alias("record")))
    found = written(resolved(known.select("fingerprint", "shape"), layouts).select("fingerprint", "layout").filter("layout IS NOT NULL"), "chat-layouts")
    joined = known.drop("shape").join(F.broadcast(found) if found.count() <= BROADCAST_LAYOUTS else found, "fingerprint")
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for layout in layouts:
        each = [_turns_of(F.col("record"), t) for t in layout.turns]
        turns = F.when(F.col("layout") == layout.name, F.concat(*each) if len(each) > 1 else each[0]).otherwise(turns)
    return joined.select(conv, *order, F.posexplode(turns).alias("position", "t")).select(conv, *order, "position", "t.role", "t.text")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


def formatted(turns: DataFrame, conv: str, order: Sequence[str], trained_role: str = "assistant", segment: int = SEGMENT) -> DataFrame:
    """conv, segment, whole, formatted, loss_from, loss_to: the template over ``turns``, and spans of code points under the loss.

    Segments ascend; ``whole`` marks one that is a conversation by itself for certain.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    rows = turns.select(
        F.col(conv).alias("conv"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate([*order, "position"])],
        F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256).alias("tie"),
        F.monotonically_increasing_id().alias("row"),  # splits equal rows over ranges
        F.concat(head, text, F.lit(END), F.lit("\n")).alias("piece"),
        F.length(head).alias("begin"),
        F.when(F.col("role") == trained_role, F.length(text)).alias("masked"),
    )
    keys = [F.col(c).asc_nulls_first() for c in ("conv", *[f"o{i}" for i in range(len(order) + 1)], "tie", "row")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "piece", "begin", "masked")
    names = ["conv", "segment", "whole", "formatted", "loss_from", "loss_to"]
    kind = placed.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key, known = TaskContext.get().partitionId() << 33, None, None  # known: all before the open segment is in this task
        pieces: list[str] = []
        spans: list[tuple[int, int]] = []
        rows: list[tuple] = []
        size = 0

        def end(whole: bool) -> None:
            nonlocal number, size
            rows.append((key, number, whole, "".join(pieces), [a for a, _ in spans], [b for _, b in spans]))
            number, size = number + 1, 0
            pieces.clear()
            spans.clear()

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names)
            rows.clear()
            return batch

        for batch in batches:
            for conv_id, piece, begin, masked in zip(*(batch.column(c).to_pylist() for c in ("conv", "piece", "begin", "masked"))):
                if known is None:
                    key, known = conv_id, False
                elif conv_id != key:
                    end(known)
                    key, known = conv_id, True
                elif size + len(piece) > segment:
                    end(False)
                    known = False
                if masked is not None:
                    spans.append((size + begin, size + begin + masked))
                pieces.append(piece)
                size += len(piece)
            yield flush(batch.schema.field("conv").type)
        if pieces:
            end(False)  # the next task may go on with it
            yield flush(batch.schema.field("conv").type)

    made = placed.mapInArrow(run, f"conv {kind}, segment long, whole boolean, formatted string, loss_from array<int>, loss_to array<int>")
    return made.withColumnRenamed("conv", conv)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted segment."""
    found = []
    for piece in text.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        found.append((unescape_role(role), unescape(rest[: -len(END) - 1])))
    return found


def read_back(segments: DataFrame, conv: str) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what formatted text and loss mask say."""
    kind = segments.schema[conv].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, rows, conv_type = None, False, [], None
        turns = loss = None
        counts = [0, 0, 0]

        def close() -> None:
            rows.append((key, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        def flush() -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for i in range(batch.num_rows):  # a segment at a time
                conv_id, whole, text, begins, ends = (batch.column(c)[i].as_py() for c in ("conv", "whole", "formatted", "loss_from", "loss_to"))
                if not open_ or conv_id != key or whole:
                    if open_:
                        close()
                    key, open_, counts = conv_id, True, [0, 0, 0]
                    turns, loss = sha256(), sha256()
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                for a, b in zip(begins, ends):
                    said = unescape(text[a:b])
                    loss.update(said.encode())
                    counts[1] += len(said)
                counts[2] += len(text)
            yield flush()
        if open_:
            close()
            yield flush()

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    named = segments.withColumnRenamed(conv, "conv")
    single = named.filter("whole").mapInArrow(run, schema)
    parts = named.filter("NOT whole").repartition("conv").sortWithinPartitions("conv", "segment")
    return single.unionByName(parts.mapInArrow(run, schema)).withColumnRenamed("conv", conv)


def format_digests(records: DataFrame, conv: str, order: Sequence[str], record: str = "record") -> DataFrame:
    """Digests of every conversation, read back from its formatted segments."""
    segments = written(formatted(canonical_turns(records, conv, order, record), conv, order), "chat-segments")
    return read_back(segments, conv)
