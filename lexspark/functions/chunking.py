"""Chunkers. Fixed windows and separator packing are JVM expressions; the
recursive splitter is an Arrow-batched helper."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.text import strip


def _not_blank(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def chunk_fixed(text: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Overlapping windows; the last may be pure overlap. Short texts stay whole."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    windows = F.transform(starts, lambda i: strip(F.substr(text, i + 1, F.lit(size))))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(_not_blank(windows))


def _pack(text: Column, sep: str, size: int, overlap: int) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, piece: Column) -> Column:
        joined = F.when(state["open"] == "", piece).otherwise(F.concat(state["open"], F.lit(sep), piece))
        fits = F.length(joined) <= size
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], strip(state["open"])))
        too_long = F.length(piece) > size
        return F.struct(
            F.when(fits, state["done"])
            .when(too_long, F.concat(closed, chunk_fixed(piece, size, overlap)))
            .otherwise(closed)
            .alias("done"),
            F.when(fits, joined).when(too_long, F.lit("")).otherwise(piece).alias("open"),
        )

    finish = lambda state: _not_blank(F.array_append(state["done"], strip(state["open"])))
    return F.aggregate(F.split(text, sep.replace(".", r"\.")), start, step, finish)


def chunk_packed(text: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Greedy packing on the coarsest separator the text holds."""
    out = chunk_fixed(text, size, overlap)
    for sep in reversed(fv.CHUNK_SEPARATORS):
        out = F.when(F.contains(text, F.lit(sep)), _pack(text, sep, size, overlap)).otherwise(out)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(out)


def _recursive_split(text: str, seps: tuple[str, ...], size: int, overlap: int) -> list[str]:
    sep = next((s for s in seps if s in text), "")
    finer = seps[seps.index(sep) + 1:] if sep else ()
    if sep:
        # the separator stays at the head of the piece that follows it
        head, *rest = text.split(sep)
        pieces = [p for p in [head, *(sep + r for r in rest)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    window: list[str] = []
    width = 0
    for piece in pieces:
        if len(piece) > size and sep:
            if window:
                out.append("".join(window))
            window, width = [], 0
            out.extend(_recursive_split(piece, finer, size, overlap))
            continue
        if width + len(piece) > size and window:
            out.append("".join(window))
            while window and (width > overlap or width + len(piece) > size):
                width -= len(window.pop(0))
        window.append(piece)
        width += len(piece)
    if window:
        out.append("".join(window))
    return [c for c in (o.strip() for o in out) if c]


def chunk_recursive(text: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Recursive separators with overlap between neighbouring chunks."""

    @F.pandas_udf("array<string>")
    def split_batch(batch: pd.Series) -> pd.Series:
        return batch.map(
            lambda t: [] if t is None else [t] if len(t) <= size else _recursive_split(t, fv.CHUNK_SEPARATORS, size, overlap)
        )

    return split_batch(text)
