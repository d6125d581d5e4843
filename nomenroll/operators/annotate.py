"""Annotators: text in, spans out. The gazetteer annotator has a module of its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nomenroll.functions.spans import SPANS_TYPE, no_spans, pattern_spans

# A model maps one text to (text, type, start_char, end_char) tuples in reading order.
Model = Callable[[str], list[tuple[str, str, int, int]]]
BatchModel = Callable[[list[str]], list[list[tuple[str, str, int, int]]]]


def pattern_annotator(patterns: Mapping[str, str]) -> Callable[[Column], Column]:
    """Annotate with ``{type: regular expression}``; spans are ordered by position.

    Matches of different types may overlap; each type is matched on its own.
    """

    def keyed(text: Column, kind: str, rank: int) -> Column:
        # sort_array compares these fields in order; array_sort would evaluate a comparator for each two of them
        return F.transform(
            pattern_spans(text, patterns[kind], kind),
            lambda s: F.struct(
                s["start_char"].alias("start"), (-s["end_char"]).alias("back"), F.lit(rank).alias("rank"), s.alias("span")
            ),
        )

    def annotate(text: Column) -> Column:
        if len(patterns) == 1:
            ((kind, pattern),) = patterns.items()
            return F.coalesce(pattern_spans(text, pattern, kind), no_spans())
        per_type = [keyed(text, kind, rank) for rank, kind in enumerate(patterns)]
        in_order = F.sort_array(F.concat(*per_type))
        return F.coalesce(F.transform(in_order, lambda k: k["span"]), no_spans())

    return annotate


_MODELS: dict[str, object] = {}  # in a worker process: each annotator's model, built on first use


def _model(key: str, factory: Callable[[], object]):
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def model_annotator(
    factory: Callable[[], Model | BatchModel], batch_size: int = 250, batched: bool = False
) -> Callable[[Column], Column]:
    """Annotate with any model; ``factory`` builds it once per worker process.

    The model gets one text, or, with ``batched``, a list of at most ``batch_size`` texts, and gives
    spans or a list of them. Only the text column goes to Python, in Arrow batches. The other columns
    stay in the JVM, and column pruning and filters work as usual around it. Empty text never reaches
    the model.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    names, key = SPANS_TYPE.elementType.names, uuid.uuid4().hex

    @F.pandas_udf(SPANS_TYPE)
    def annotate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from nomenroll.operators.annotate import _model

        model = _model(key, factory)
        for texts in batches:
            found: list[list] = [[]] * len(texts)
            filled = [i for i, text in enumerate(texts) if text]
            for begin in range(0, len(filled), batch_size):
                some = filled[begin : begin + batch_size]
                given = [texts.iloc[i] for i in some]
                spans = model(given) if batched else [model(text) for text in given]
                if len(spans) != len(given):
                    raise ValueError(f"the model gave {len(spans)} results for {len(given)} texts")
                for i, one in zip(some, spans):
                    found[i] = [dict(zip(names, s)) for s in one]
            yield pd.Series(found, dtype=object)

    return annotate
