"""Substring dedup on bytes: Burrows-Wheeler transforms of stretches, merged by interleave refinement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lexspark.llm.repeats import Layout, mix, sha256, without_repeats

WINDOW = 50
# bytes that name an anchor: long enough that few texts share one by chance
CONTEXT = 20
# bytes of the parts that rank a context
PARTS = 4
_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64), 7)


def units(text: str | None):
    data = (text or "").encode()
    return _SYMBOLS[np.frombuffer(data, np.uint8)], lambda start, end: data[start:end]


class Transform:
    """Burrows-Wheeler transforms of byte strings, one shard each, as one row of places: a place is a rotation of its own string,
    before is the place one byte earlier, and last is the transform's symbol, the byte before the rotation."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.before = np.arange(-1, len(self.text) - 1, dtype=np.int32)
        self.before[self.starts] = self.ends - 1
        self.last = self.text[self.before]

    def merge(self, depth: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(order, heads): the interleave of all shards that is right for the first `depth` bytes, and where its intervals of rotations
        with `depth` bytes in common begin. With `places` the walk starts from these places alone, and ends at the ones `depth` bytes before.

        A round walks the interleave and deals every place's predecessor out by
        the transform's symbol, keeping the order within a symbol. What was right
        for k bytes then is right for k + 1; an interval splits where the symbol
        or the interval walked changes, and there the common prefix has k bytes.
        Two symbols are dealt by at once, so a round adds two bytes. No suffix is ever compared with another.
        """
        order = np.arange(len(self.text), dtype=np.int32) if places is None else places
        heads = np.zeros(len(order), bool)
        heads[:1] = True
        two = self.last[self.before].astype(np.uint16) << 8 | self.last
        steps = [(self.last, self.before)] * (depth % 2) + [(two, self.before[self.before])] * (depth // 2)
        for dealt_by, back in steps:
            symbols = dealt_by[order]
            deal = np.argsort(symbols, kind="stable")
            interval = np.cumsum(heads, dtype=np.int32)[deal]
            symbols = symbols[deal]
            order = back[order[deal]]
            heads[1:] = (symbols[1:] != symbols[:-1]) | (interval[1:] != interval[:-1])
        return order, heads


def repeated_windows(stretches: list[bytes], docs: np.ndarray, window: int) -> np.ndarray:
    """Per stretch the bit mask of the starts of windows that a stretch of a smaller doc holds too."""
    shards = Transform(stretches)
    # a walk from the end of every window; rotations that wrap within their first bytes are left out
    lengths = shards.ends - shards.starts
    counts = np.maximum(lengths - window + 1, 0)
    if not counts.sum():
        return np.zeros(len(stretches), np.int64)
    string = np.repeat(np.arange(len(stretches)), counts)
    ends = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts) + window
    places = shards.starts[string] + np.where(ends < lengths[string], ends, 0)
    order, heads = shards.merge(window, places.astype(np.int32))
    string = np.searchsorted(shards.ends, order, "right")
    owner = docs[string]
    late = np.minimum.reduceat(owner, np.flatnonzero(heads))[np.cumsum(heads) - 1] < owner
    masks = np.zeros(len(stretches), np.int64)
    np.bitwise_or.at(masks, string[late], np.int64(1) << (order[late] - shards.starts[string[late]]))
    return masks


LAYOUT = Layout(WINDOW, CONTEXT, units, merge=repeated_windows, parts=PARTS)


def remove_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) and, with keep_bytes, kept binary; one row per row of docs.

    Whole repeats are found by anchors (see repeats.repeated_passages); where
    texts part within reach of an anchor, the stretches around it are merged as
    Burrows-Wheeler transforms, whose repeated intervals tell the windows.

    Bytes inside a string of 50 that also starts in a document with a smaller
    key are removed; strings are judged on the input and never cross documents.
    Null and empty texts have no bytes, shorter texts no string. Rows with a
    null key neither lose bytes nor take them from others; rows that share a
    key do not take from each other. Other columns are ignored.
    """

    def result(body, symbols, gone):
        data = np.frombuffer((body or "").encode(), np.uint8)
        kept = data[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        row = len(data), int(gone.sum()), spans, sha256(kept)
        return (*row, kept) if keep_bytes else row

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return without_repeats(docs, LAYOUT, key, text, schema, result).withColumnRenamed("doc", key)
