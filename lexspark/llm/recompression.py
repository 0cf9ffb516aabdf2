"""Substring dedup on words by recompression: rounds that name runs and pairs alike in all documents."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from lexspark.llm.repeats import Layout, mix, sha256, without_repeats

WINDOW = 13
# words that name an anchor; the rounds below look at most half as far to each side
CONTEXT = 6
PAIR_ROUNDS = 2


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def units(text: str | None):
    own = words(text)
    symbols = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), np.uint64, len(own))
    return symbols, lambda start, end: b" ".join(own[start:end])


def in_run(symbols: np.ndarray) -> np.ndarray:
    """Mask of the symbols that equal a neighbour."""
    same = symbols[1:] == symbols[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def name_pairs(names: np.ndarray, fixed: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, kept): one round. A symbol of the left class followed by one of the right class become one new symbol.

    A symbol's class and a pair's name are drawn from the names alone, so every
    task names equal pairs alike without asking the others. Symbols of runs are
    `fixed`. kept is the mask of the symbols that still start one.
    """
    right = (mix(names, 10 + salt) >> np.uint64(40) & np.uint64(1)).astype(bool)
    joins = ~right[:-1] & right[1:] & ~fixed[:-1] & ~fixed[1:]
    named = names.copy()
    at = np.flatnonzero(joins)
    named[at] = mix(mix(names[at], 20 + salt) + names[at + 1], 30 + salt)
    kept = np.concatenate([[True], ~joins])
    return named[kept], kept


def boundaries(symbols: np.ndarray) -> np.ndarray:
    """Positions at which a symbol of the last round starts, and all positions inside runs.

    A run's words keep their places: a run is one symbol that no pair round
    touches, and its inner positions stay usable. So symbols of other words hold at most
    2 ** PAIR_ROUNDS words, and a position's state depends on three words to
    each side. Both bounds are what CONTEXT and WINDOW rest on.
    """
    fixed, names, starts = in_run(symbols), symbols, np.arange(len(symbols))
    for salt in range(PAIR_ROUNDS):
        names, kept = name_pairs(names, fixed, salt)
        starts, fixed = starts[kept], fixed[kept]
    return starts


def eligible(symbols: np.ndarray) -> np.ndarray:
    """Mask of context starts whose middle is a boundary."""
    mask = np.zeros(len(symbols) + CONTEXT, bool)
    starts = boundaries(symbols)
    mask[starts[starts >= CONTEXT // 2] - CONTEXT // 2] = True
    return mask


LAYOUT = Layout(WINDOW, CONTEXT, units, eligible)


def remove_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) and, with keep_text, kept; one row per row of docs.

    Words inside a window of 13 that also starts in a document with a smaller
    key are removed; windows are judged on the input. Null and empty texts have
    no words, texts of fewer than 13 no window. Rows with a null key neither
    lose words nor take them from others; rows that share a key do not take
    from each other. Other columns are ignored.
    """

    def result(body, symbols, gone):
        kept = b" ".join(w for w, g in zip(words(body), gone.tolist()) if not g)
        row = len(gone), int(gone.sum()), sha256(kept)
        return (*row, kept.decode()) if keep_text else row

    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return without_repeats(docs, LAYOUT, key, text, schema, result).withColumnRenamed("doc", key)
