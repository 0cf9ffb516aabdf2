"""Passages that an earlier document holds too: the Spark part shared by substring and suffix dedup.

A Layout names, for every window of a text, one anchor inside it that depends
on the window's own content alone. Equal windows of any two documents thus have
equally named anchors, so anchors, far fewer than windows, are what is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexspark.llm.common import arrow_kinds, record_batch
from lexspark.operators.sizing import BROADCAST_ROWS
from lexspark.session import cut_lineage

# units of a text handled at once; longer texts go through in overlapping blocks
BLOCK = 1 << 18
_POSITION_BITS = 18
# open regions of a name that are merged in one task, at most
GROUP = 4096
_BASES = (0x9E3779B97F4A7C17 | 3, 0xC2B2AE3D27D4EB4F | 3)
_NAME_BITS = np.uint64((1 << 48) - 1)
# texts handled at once, so that a text's number and a name share 64 bits
_TEXTS = 1 << 16


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int, n: int):
        self.up = np.cumprod(np.full(n, base, np.uint64))
        self.down = np.cumprod(np.full(n, pow(base, -1, 2**64), np.uint64))


_POWERS: list[Powers] = []


def powers() -> list[Powers]:
    if not _POWERS:
        _POWERS.extend(Powers(b, 2 * BLOCK) for b in _BASES)
    return _POWERS


class Sums:
    """Hashes of any stretches of a row of symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray, which: int):
        self.p = powers()[which]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * self.p.up[: len(symbols)])])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.p.down[start])

    def each(self, size: int) -> np.ndarray:
        """Of every stretch of `size` symbols."""
        return mix((self.sums[size:] - self.sums[:-size]) * self.p.down[: len(self.sums) - size])


class Anchors(NamedTuple):
    text: np.ndarray  # number of the text in the list
    name: np.ndarray  # of the anchor's own symbols
    region: np.ndarray | None  # of all symbols of the windows that it stands for
    low: np.ndarray  # first and last start of those windows in the text
    high: np.ndarray


@dataclass(frozen=True)
class Layout:
    """How texts are cut into units and where anchors may lie.

    window: units of a window; context: units that name an anchor.
    units: text -> (symbols uint64, a function that gives the bytes of units start..end).
    eligible: symbols -> mask of the context starts that may be anchors; every
    window - context + 1 consecutive starts hold one, and whether a start is
    one depends on its context alone. None: all starts.
    parts: units of the parts of a context that rank it, if all starts are eligible. Contexts whose smallest
    part lies in the middle come first, those with it at an end next; such contexts lie further apart
    than others, so a sixth fewer anchors serve all windows. None: contexts rank by their hash alone.
    merge: (stretches, docs, window) -> per stretch a bit mask of the windows that a smaller
    doc's stretch holds too; it gets all stretches that share an anchor's name
    together. window - context is below 63 then. None: windows are compared by their hashes.
    """

    window: int
    context: int
    units: Callable
    eligible: Callable | None = None
    merge: Callable | None = None
    parts: int | None = None

    def anchors(self, texts: list[np.ndarray], regions: bool = True) -> Iterator[Anchors]:
        """Anchors of all windows of the texts. Short texts share a block, long ones are cut into overlapping blocks."""
        pieces: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for i, symbols in enumerate(texts):
            for offset in range(0, max(0, len(symbols) - self.window + 1), BLOCK - self.window + 1):
                part = symbols[offset : offset + BLOCK]
                if size + len(part) > BLOCK:
                    yield self._block(pieces, regions)
                    pieces, size = [], 0
                pieces.append((i, offset, part))
                size += len(part)
        if pieces:
            yield self._block(pieces, regions)

    def _order(self, sums: Sums, n: int) -> np.ndarray:
        """Class of each of the first n contexts: 0 if its smallest part is the middle one, 1 if it is an end, else 2."""
        values = ((sums.sums[self.parts :] - sums.sums[: -self.parts]) * sums.p.down[: len(sums.sums) - self.parts] >> np.uint64(32)).astype(np.uint32)
        last = self.context - self.parts
        least = sliding_min(values, last + 1)[:n]
        order = np.full(n, 2, np.uint64)
        order[(values[:n] == least) | (values[last : last + n] == least)] = 1
        order[values[last // 2 : last // 2 + n] == least] = 0
        return order

    def _block(self, pieces: list[tuple[int, int, np.ndarray]], regions: bool) -> Anchors:
        symbols = np.concatenate([p[2] for p in pieces])
        lengths = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(lengths)
        sums = Sums(symbols, 0)
        names = sums.each(self.context)
        # the smallest high bits win, a name is the low bits
        ranks = names >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS) | np.arange(len(names), dtype=np.uint64)
        if self.parts:
            place = np.uint64((1 << _POSITION_BITS) - 1)
            ranks = (ranks >> np.uint64(2) & ~place) | (ranks & place) | self._order(sums, len(names)) << np.uint64(62)
        if self.eligible:
            ranks[~self.eligible(symbols)[: len(names)]] = np.uint64(2**64 - 1)
        owner = (sliding_min(ranks, self.window - self.context + 1) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        for end in ends[:-1].tolist():  # windows that would cross into the next text
            owner[end - self.window + 1 : end] = -1
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        low = np.flatnonzero(first)
        high = np.concatenate([low[1:], [len(owner)]]) - 1
        inside = owner[low] >= 0
        low, high = low[inside], high[inside]
        at = owner[low]
        region = None
        if regions:
            region = mix(Sums(symbols, 1).stretch(low, high + self.window) + (at - low).astype(np.uint64), 3) & _NAME_BITS
        piece = np.searchsorted(ends, low, "right")
        shift = np.array([p[1] for p in pieces])[piece] - (ends - lengths)[piece]
        return Anchors(np.array([p[0] for p in pieces])[piece], names[at] & _NAME_BITS, region, low + shift, high + shift)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if width < size else x


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _portions(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[tuple[list, list[np.ndarray], list[Callable]]]:
    """(rows, symbols, readers) of about BLOCK units and at most _TEXTS texts at a time; a row is the tuple of its columns, doc and text first."""
    rows, symbols, readers, size = [], [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *(c[i] for c in batch.columns[2:])
            own, data = layout.units(row[1])
            rows.append(row)
            symbols.append(own)
            readers.append(data)
            size += len(own)
            if size >= BLOCK or len(rows) == _TEXTS:
                yield rows, symbols, readers
                rows, symbols, readers, size = [], [], [], 0
    if rows:
        yield rows, symbols, readers


def anchor_names(docs: DataFrame, layout: Layout) -> DataFrame:
    """(name, doc): names of the anchors of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, symbols, _ in _portions(batches, layout):
            keys = np.array([r[0] for r in rows], np.int64)
            for a in layout.anchors(symbols, regions=False):
                yield _batch(["name", "doc"], [a.name.view(np.int64), keys[a.text]])

    return docs.mapInArrow(run, "name long, doc long")


def anchor_rows(docs: DataFrame, layout: Layout) -> DataFrame:
    """(name, region, doc): anchors of every document (columns doc, text), one row for equal neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, symbols, _ in _portions(batches, layout):
            keys = np.array([r[0] for r in rows], np.int64)
            for a in layout.anchors(symbols):
                new = np.concatenate([[True], (a.region[1:] != a.region[:-1]) | (a.text[1:] != a.text[:-1])])
                yield _batch(["name", "region", "doc"], [a.name[new].view(np.int64), a.region[new].view(np.int64), keys[a.text[new]]])

    return docs.mapInArrow(run, "name long, region long, doc long")


def window_rows(docs: DataFrame, layout: Layout) -> DataFrame:
    """(a, b, doc): 128-bit names of the distinct windows for which the wanted anchors (column wanted, their regions) of a document stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, symbols, readers in _portions(batches, layout):
            wanted = Marks([_values(r[2]) for r in rows])
            out: set[tuple[int, int, int]] = set()
            for a in layout.anchors(symbols):
                hit = wanted.find(a) >= 0
                for i, low, high in zip(a.text[hit].tolist(), a.low[hit].tolist(), a.high[hit].tolist()):
                    out.update((*window_name(readers[i](s, s + layout.window)), rows[i][0]) for s in range(low, high + 1))
            if out:
                yield _batch(["a", "b", "doc"], list(np.array(list(out), np.int64).T.copy()))

    return docs.mapInArrow(run, "a long, b long, doc long")


def stretch_rows(docs: DataFrame, layout: Layout) -> DataFrame:
    """(name, region, doc, data): the units under the windows of every wanted anchor of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, symbols, readers in _portions(batches, layout):
            wanted = Marks([_values(r[2]) for r in rows])
            out: dict[tuple[int, int], tuple] = {}
            for a in layout.anchors(symbols):
                hit = wanted.find(a) >= 0
                for i, region, name, low, high in zip(*(c[hit].tolist() for c in (a.text, a.region, a.name, a.low, a.high))):
                    out[rows[i][0], region] = name, region, rows[i][0], readers[i](low, high + layout.window)
            if out:
                yield _batch(["name", "region", "doc", "data"], list(zip(*out.values())))

    return docs.mapInArrow(run, "name long, region long, doc long, data binary")


def merged_rows(stretches: DataFrame, layout: Layout) -> DataFrame:
    """(region, doc, mask): windows of a stretch that a smaller doc's stretch holds too. Stretches of a name lie together, GROUP at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged() -> pa.RecordBatch:
            masks = layout.merge([r[3] for r in held], np.array([r[2] for r in held], np.int64), layout.window)
            some = np.flatnonzero(masks)
            return _batch(["region", "doc", "mask"], [np.array([held[i][c] for i in some], np.int64) for c in (1, 2)] + [masks[some]])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield merged()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield merged()

    placed = stretches.repartition("name").sortWithinPartitions("name").select("name", "region", "doc", "data")
    return placed.mapInArrow(run, "region long, doc long, mask long")


def window_name(data: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(data)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _values(cell: pa.Scalar, field: str | None = None) -> np.ndarray:
    """Numbers of a list, or of one field of a list of structs; none for null."""
    if not cell.is_valid:
        return np.zeros(0, np.int64)
    return (cell.values.field(field) if field else cell.values).to_numpy()


class Marks:
    """Regions that are marked in each of some texts."""

    def __init__(self, regions: list[np.ndarray]):
        keys = np.concatenate([r.view(np.uint64) | np.uint64(i << 48) for i, r in enumerate(regions)])
        self.place = np.argsort(keys)
        self.keys = keys[self.place]

    def find(self, a: Anchors) -> np.ndarray:
        """Place of every anchor's region among all marks of all texts, -1 where its text does not have it."""
        if not len(self.keys):
            return np.full(len(a.text), -1)
        own = a.text.astype(np.uint64) << np.uint64(48) | a.region
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return np.where(self.keys[at] == own, self.place[at], -1)


def split_by_keys(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(docs joined with their marks, docs without marks or None if the first part holds them too).

    While the marked keys are few enough to broadcast, only marked texts are
    shuffled; beyond that size all texts are.
    """
    keys = marks.select("doc")
    if keys.count() > BROADCAST_ROWS:
        return docs.join(marks, "doc", "left"), None
    return docs.join(F.broadcast(keys), "doc", "left_semi").join(marks, "doc"), docs.join(F.broadcast(keys), "doc", "left_anti")


def repeated_passages(docs: DataFrame, layout: Layout) -> DataFrame:
    """(doc, settled array<region>, windows array<struct<a, b>>, looked_up array<region>, partial array<struct<region, mask>>): what an earlier document holds too, per document
    (columns doc, text; doc not null) with any.

    Rounds, each over what the last left open:
    1. anchors by name: names of one document only are dropped;
    2. anchors by region: a region that starts in an earlier document settles
       all windows of the anchor, and such windows are nobody's first
       occurrence, so they need not be looked at again;
    3. only where a name has several open regions, their windows: by merging
       the stretches of a name (layout.merge), or, for names with more than
       GROUP open regions and layouts without a merge, by content.
    Minima are combined before every shuffle; a name that many documents share
    is one row per task there, and joins against unique rows after that.
    """
    shared = anchor_names(docs, layout).groupBy("name").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("name")
    rows = cut_lineage(anchor_rows(docs, layout).join(shared, "name"))
    del shared  # the written rows are all that is needed; without references Spark may drop the shuffle files
    classes = cut_lineage(rows.groupBy("name", "region").agg(F.min("doc").alias("first")))
    settled = rows.join(classes, ["name", "region"]).where("first < doc").groupBy("doc").agg(F.collect_set("region").alias("settled"))
    several = classes.groupBy("name").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("name", "n")
    opened = classes.join(several, "name").withColumn("alone", F.col("n") > (GROUP if layout.merge else 0))
    wanted = cut_lineage(opened.groupBy("alone", F.col("first").alias("doc")).agg(F.collect_set("region").alias("wanted")))
    texts = lambda alone: split_by_keys(docs, wanted.where(F.col("alone") == alone).drop("alone"))[0].where("wanted is not null").select("doc", "text", "wanted")
    open_windows = cut_lineage(window_rows(texts(True), layout))
    firsts = open_windows.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("a", "b", "first")
    windows = open_windows.join(firsts, ["a", "b"]).where("first < doc").groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("windows"))
    # equal windows have equally named anchors, so only regions whose windows were compared can hold a repeated one
    compared = wanted.where("alone").select("doc", F.col("wanted").alias("looked_up"))
    marks = settled.join(windows.join(compared, "doc"), "doc", "full")
    if layout.merge:
        masks = merged_rows(stretch_rows(texts(False), layout), layout)
        marks = marks.join(masks.groupBy("doc").agg(F.collect_set(F.struct("region", "mask")).alias("partial")), "doc", "full")
    else:
        marks = marks.withColumn("partial", F.lit(None).cast("array<struct<region:long,mask:long>>"))
    return cut_lineage(marks)


def covered(rows: list, symbols: list[np.ndarray], readers: list[Callable], layout: Layout) -> list[np.ndarray]:
    """Per text the mask of the units inside any window that the marks of its row (doc, text, settled, windows, looked_up, partial) name."""
    lengths = np.array([len(s) + 1 for s in symbols])
    begins = np.cumsum(lengths) - lengths
    steps = np.zeros(lengths.sum(), np.int64)
    if len(rows[0]) > 2:
        settled, partial = Marks([_values(r[2]) for r in rows]), Marks([_values(r[5], "region") for r in rows])
        masks = np.concatenate([_values(r[5], "mask") for r in rows])
        windows = [set(zip(_values(r[3], "a").tolist(), _values(r[3], "b").tolist())) for r in rows]
        looked_up = Marks([_values(r[4]) for r in rows])
        for a in layout.anchors(symbols):
            low, high = begins[a.text] + a.low, begins[a.text] + a.high
            whole = settled.find(a) >= 0
            np.add.at(steps, low[whole], 1)
            np.add.at(steps, high[whole] + layout.window, -1)
            at = partial.find(a)
            some = ~whole & (at >= 0)
            starts = [b + s for b, n, mask in zip(low[some].tolist(), (high - low)[some].tolist(), masks[at[some]].tolist()) for s in range(n + 1) if mask >> s & 1]
            some = ~whole & (looked_up.find(a) >= 0)
            for i, b, first, last in zip(a.text[some].tolist(), begins[a.text[some]].tolist(), a.low[some].tolist(), a.high[some].tolist()):
                starts += [b + s for s in range(first, last + 1) if window_name(readers[i](s, s + layout.window)) in windows[i]]
            np.add.at(steps, np.array(starts, np.int64), 1)
            np.add.at(steps, np.array(starts, np.int64) + layout.window, -1)
    gone = np.cumsum(steps) > 0  # the steps of a text add up to zero
    return [gone[b : b + n - 1] for b, n in zip(begins.tolist(), lengths.tolist())]


def without_repeats(docs: DataFrame, layout: Layout, key: str, text: str, schema: str, result: Callable) -> DataFrame:
    """result(text, symbols, mask of removed units) per row of docs, keyed by `key`."""
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    marks = repeated_passages(texts.where("doc is not null"), layout)
    names, kinds = [p.split()[0] for p in schema.split(",")], arrow_kinds(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, symbols, readers in _portions(batches, layout):
            masks = covered(rows, symbols, readers, layout)
            out = [(r[0], *result(r[1], s, m)) for r, s, m in zip(rows, symbols, masks)]
            yield record_batch(names, kinds, list(zip(*out)))

    marked, rest = split_by_keys(texts, marks)
    done = marked.select("doc", "text", "settled", "windows", "looked_up", "partial").mapInArrow(run, schema)
    return done if rest is None else done.unionByName(rest.select("doc", "text").mapInArrow(run, schema))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
