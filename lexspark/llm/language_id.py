"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexspark.llm.common import unused
from lexspark.session import cut_lineage

DIMENSIONS = 1024
GRAM = 3
# n-gram vectors that a Python worker remembers (64 MB); emptied when full, which changes no result
REMEMBERED = 1 << 14
UNKNOWN = "und"
# profiles that the driver and a task hold at once; more labels are compared in blocks
MAX_LANGUAGES = 1024
# an unrelated text passes noise_score() with this probability
FALSE_PASS = 1e-5
# texts of fewer distinct n-grams can score below the noise in their own language, so their letters decide
FEW_GRAMS = 128
# a letter belongs to a language if it makes at least this share of its letters; foreign quotations stay below
LETTER_SHARE = 1e-4
_UNIT = 1_000_000  # unit vectors are bundled as integers of this scale, so sums do not depend on their order
_BOUNDARY = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def _letter_vector(code: int) -> np.ndarray:
    """The random bipolar vector of a letter, drawn from its code point alone."""
    return np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1


def grams_of(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct letter n-grams of a text and their counts; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letters = _letters()[codes]
    if not letters.any():
        return None
    codes = np.where(letters, codes, _BOUNDARY).astype(np.uint64)
    codes = np.concatenate([[np.uint64(_BOUNDARY)] * (GRAM - 1), codes, [np.uint64(_BOUNDARY)] * (GRAM - 1)])
    n = len(codes) - GRAM + 1
    grams = np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams = (grams << np.uint64(21)) | codes[i : i + n]
    blank = sum(_BOUNDARY << (21 * i) for i in range(GRAM))
    return np.unique(grams[grams != np.uint64(blank)], return_counts=True)


class Encoder:
    """Bundles permuted and bound letter vectors into text vectors."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((REMEMBERED, DIMENSIONS), np.float32)

    def _vectors_of(self, grams: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(grams) > REMEMBERED:
            self.rows.clear()
        out = []
        for gram in grams.tolist():
            at = self.rows.get(gram)
            if at is None:
                at = self.rows[gram] = len(self.rows)
                bound = _letter_vector(gram & 0x1FFFFF)
                for i in range(1, GRAM):  # a letter i places before the last is permuted i times
                    bound = bound * np.roll(_letter_vector(gram >> (21 * i) & 0x1FFFFF), i)
                self.vectors[at] = bound
            out.append(at)
        return self.vectors[out]

    def encode(self, text: str | None) -> np.ndarray | None:
        """The bundle of all letter n-grams of the whole text, words padded by a boundary; None without a letter."""
        found = grams_of(text)
        if found is None:
            return None
        kinds, counts = found
        total = np.zeros(DIMENSIONS, np.float64)
        for start in range(0, len(kinds), REMEMBERED // 4):  # bounded memory for any number of n-grams
            part = slice(start, start + REMEMBERED // 4)
            total += counts[part].astype(np.float32) @ self._vectors_of(kinds[part])
        return total


@lru_cache(maxsize=1)
def encoder() -> Encoder:
    return Encoder()


def fold(key: Column, folds: int = 3) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


class Profiles:
    """Prototypes by language: one dict, or a table (lang, at, x) of bundles that is read block by block."""

    def __init__(self, few: dict[str, np.ndarray] | None, table: DataFrame | None = None) -> None:
        self.few, self.table = few, table
        self.languages = len(few) if table is None else table.select("lang").distinct().count()
        self.parts = 1 if table is None else -(-2 * self.languages // MAX_LANGUAGES)  # twice as many: hashing is uneven

    def __bool__(self) -> bool:
        return self.languages > 0

    def blocks(self) -> Iterator[dict[str, np.ndarray]]:
        if self.table is None:
            yield self.few
        else:
            for part in range(self.parts):
                yield _units(self.table.where(F.pmod(F.xxhash64("lang"), F.lit(self.parts)) == part).collect())


def _units(rows: list) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["at"]] = r["x"]
    return {name: v / (np.linalg.norm(v) or 1.0) for name, v in sorted(out.items())}


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """The unit prototype vector of every language, from every row with a label and a letter.

    Every task bundles the unit vectors of its rows per language; the integer
    bundles are summed by (language, dimension). Rows with a null language or
    no letter teach nothing. About MAX_LANGUAGES * DIMENSIONS sums reach the
    driver at once, however many labels there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, language in zip(batch.column(0), batch.column(1)):
                if (v := encoder().encode(t.as_py())) is not None:
                    unit = np.rint(v / (np.linalg.norm(v) or 1.0) * _UNIT).astype(np.int64)
                    name = language.as_py()
                    sums[name] = sums.get(name, 0) + unit
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])

    parts = labelled.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(run, "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = sums.limit(MAX_LANGUAGES * DIMENSIONS + 1).collect()
    return Profiles(_units(rows)) if len(rows) <= MAX_LANGUAGES * DIMENSIONS else Profiles(None, cut_lineage(sums))


def predict(docs: DataFrame, profiles: Profiles | dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score), one row per row of docs: the language whose prototype has the largest cosine with the whole text.

    A null text, a text without a letter and an empty set of profiles give
    UNKNOWN with score 0. Equal cosines go to the first name; a negative cosine
    scores 0. Only the text decides; repeated rows get equal results, other
    columns are ignored. Blocks of profiles beyond the first cost a pass each.
    """
    known = profiles if isinstance(profiles, Profiles) else Profiles(profiles)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = _judged(rows, known, "text", "lang_pred", "score")
    return rows.select(F.col("key").alias(key), "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def _judged(docs: DataFrame, profiles: Profiles, text: str, name: str, score: str, keep: Callable[[str | None, str, float], bool] | None = None) -> DataFrame:
    """docs with the best language and its cosine in the new columns name and score, block of profiles by block; keep filters in the last pass."""
    out = docs.withColumns({name: F.lit(UNKNOWN), score: F.lit(float("-inf"))})
    for i, block in enumerate(profiles.blocks()):
        out = out.mapInArrow(_pass(judge(block), text, name, score, keep if i == profiles.parts - 1 else None), out.schema)
        if i < profiles.parts - 1:
            out = cut_lineage(out)
    return out


def _pass(best: Callable, text: str, name: str, score: str, keep: Callable | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, by, value = (batch.schema.get_field_index(c) for c in (text, name, score))
            texts, names, scores = batch.column(at).to_pylist(), batch.column(by).to_pylist(), batch.column(value).to_pylist()
            for i, t in enumerate(texts):
                found, x = best(t)
                if found != UNKNOWN and (scores[i] < x or scores[i] == x and found < names[i]):
                    names[i], scores[i] = found, x
            batch = batch.set_column(by, batch.schema.field(by), pa.array(names, pa.string())).set_column(value, batch.schema.field(value), pa.array(scores, pa.float64()))
            yield batch if keep is None else batch.filter(pa.array([keep(*x) for x in zip(texts, names, scores)], pa.bool_()))

    return run


def judge(profiles: dict[str, np.ndarray]) -> Callable[[str | None], tuple[str, float]]:
    """text -> (language, cosine)."""
    names, matrix = list(profiles), np.array(list(profiles.values())).reshape(-1, DIMENSIONS)

    def best(text: str | None) -> tuple[str, float]:
        v = encoder().encode(text) if names else None
        if v is None:
            return UNKNOWN, 0.0
        cosines = np.einsum("ij,j->i", matrix, v / (np.linalg.norm(v) or 1.0))  # row by row: equal profiles tie in whatever block they stand
        at = int(np.argmax(cosines))
        return names[at], float(cosines[at])

    return best


def noise_score(languages: int) -> float:
    """The cosine that the best of so many prototypes exceeds by chance with probability FALSE_PASS.

    Bundles without a common n-gram have a cosine of mean 0 and deviation 1 / sqrt(DIMENSIONS).
    """
    return NormalDist().inv_cdf(1 - FALSE_PASS / max(1, languages)) / math.sqrt(DIMENSIONS)


def _letter_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    return np.unique(codes[_letters()[codes]], return_counts=True)


def alphabet(labelled: DataFrame, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Sorted code points of the letters that make LETTER_SHARE of some language's letters: at most one row a code point reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t, language in zip(batch.column(0), batch.column(1)):
                name = language.as_py()
                for code, n in zip(*(x.tolist() for x in _letter_counts(t.as_py()))):
                    seen[name, code] += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen]), pa.array([x for _, x in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["lang", "code", "n"])

    parts = labelled.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(run, "lang string, code int, n long")
    counts = parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    common = counts.join(totals, "lang").where(F.col("n") >= LETTER_SHARE * F.col("total")).select("code").distinct()
    return np.array(sorted(r["code"] for r in common.collect()), np.uint32)


def recognised(docs: DataFrame, profiles: Profiles | dict[str, np.ndarray], letters: np.ndarray, text: str = "text") -> DataFrame:
    """Rows of docs, all columns kept, whose whole text is in a learned language. Rows stay in their tasks.

    A text is in one if its score reaches noise_score(). Texts of fewer than
    FEW_GRAMS distinct n-grams that score less stay if more than half of their
    letters are in `letters` (see alphabet).
    """
    known = profiles if isinstance(profiles, Profiles) else Profiles(profiles)
    least = noise_score(known.languages)

    def keep(t: str | None, name: str, score: float) -> bool:
        if name == UNKNOWN or score >= least:
            return name != UNKNOWN
        if len(grams_of(t)[0]) >= FEW_GRAMS:
            return False
        codes, n = _letter_counts(t)
        return bool(2 * n[np.isin(codes, letters)].sum() > n.sum())

    return _judged(docs, known, text, unused(docs, "best_language"), unused(docs, "best_cosine"), keep).select(*docs.columns)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): learns from rows outside the held-out fold, predicts every row.

    held_out is crc32(key as text) mod 3 = 1; a null key is hashed as the empty text.
    """
    held_out = F.coalesce(fold(F.coalesce(F.col(key).cast("string"), F.lit(""))) == 1, F.lit(False))
    profiles = learn(docs.where(~held_out), text, lang)
    return predict(docs, profiles, key, text).select(key, held_out.alias("held_out"), "lang_pred", "score")
