import random

import numpy as np
import pytest

from lexspark.llm import recompression, repeats, suffix_dedup
from tests.llm import brute


def planted(seed):
    """Texts that share stretches of all lengths around the windows' own."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20 + ["a"] * 10
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60))) for _ in range(30)]
    rows = []
    for k in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.2:
            parts.append("run " * rng.randint(1, 40))
        rows.append((k * 3 + 1, rng.choice([" ", "\n", ""]).join(parts)))
    return rows


@pytest.mark.parametrize("which", ["sample", "odd", "planted"])
def test_words(which, sample, odd_rows, frame):
    rows = {"sample": sample[0], "odd": odd_rows, "planted": planted(1)}[which]
    got = recompression.remove_repeated_words(frame(rows)).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got) == sorted(brute.repeated_words(rows))


@pytest.mark.parametrize("which", ["sample", "odd", "planted"])
def test_bytes(which, sample, odd_rows, frame):
    rows = {"sample": sample[0], "odd": odd_rows, "planted": planted(2)}[which]
    got = suffix_dedup.remove_repeated_bytes(frame(rows)).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == sorted(brute.repeated_bytes(rows))


def test_blocks_and_broadcast_bound_change_nothing(frame, monkeypatch, spark):
    rows = planted(3)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    got = recompression.remove_repeated_words(frame(rows)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == sorted((k, n) for k, _, n, _ in brute.repeated_words(rows))


def test_null_and_repeated_keys(frame):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (2, text), (2, text), (3, text), (None, None)]
    for run in (recompression.remove_repeated_words, suffix_dedup.remove_repeated_bytes):
        got = sorted((str(r["doc_id"]), r["n_removed"]) for r in run(frame(rows)).collect())
        full = 30 if run is recompression.remove_repeated_words else len(text)
        assert got == [("2", 0), ("2", 0), ("3", full), ("None", 0), ("None", 0)]
        assert run(frame([])).count() == 0


def test_anchors_depend_on_their_window_alone():
    """Every window, cut out of its text, has the anchor that it has inside it; small blocks change nothing."""
    rng = np.random.default_rng(4)
    symbols = repeats.mix(rng.integers(0, 6, 600).astype(np.uint64))
    symbols[100:130] = symbols[100]
    for layout in (recompression.LAYOUT, suffix_dedup.LAYOUT):
        for a in layout.anchors([symbols]):
            for name, low, high in zip(a.name, a.low, a.high):
                for s in range(low, high + 1):
                    (own,) = layout.anchors([symbols[s : s + layout.window]])
                    assert own.name[0] == name
    names = [x for a in recompression.LAYOUT.anchors([symbols]) for x in a.name]
    repeats.BLOCK, old = 100, repeats.BLOCK
    try:
        assert {*names} == {x for a in recompression.LAYOUT.anchors([symbols]) for x in a.name}
    finally:
        repeats.BLOCK = old
    many = [symbols[:40], symbols[:5], symbols[40:300], symbols[:0], symbols[290:]]
    (together,) = recompression.LAYOUT.anchors(many)
    apart = [(i, *x) for i, m in enumerate(many) for a in recompression.LAYOUT.anchors([m]) for x in zip(a.name, a.region, a.low, a.high)]
    assert list(zip(*together)) == apart


def test_merged_transforms():
    rng = random.Random(6)
    stretches = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 30))) for _ in range(60)] + [b"a" * 20, b"a" * 12]
    docs = np.array([rng.randint(0, 20) for _ in stretches], np.int64)
    order, heads = suffix_dedup.Transform(stretches).merge(8)
    places = [(s + s)[i : i + 8] for s in stretches for i in range(len(s))]
    assert [places[i] for i in order] == sorted(places)
    assert heads.sum() == len({*places})
    first = {}
    for s, d in sorted(zip(stretches, docs.tolist()), key=lambda x: x[1]):
        for i in range(len(s) - 7):
            first.setdefault(s[i : i + 8], d)
    want = [sum(1 << i for i in range(len(s) - 7) if first[s[i : i + 8]] < d) for s, d in zip(stretches, docs.tolist())]
    assert suffix_dedup.repeated_windows(stretches, docs, 8).tolist() == want


def test_names_with_too_many_regions(frame, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 2)
    rows = planted(5)
    got = suffix_dedup.remove_repeated_bytes(frame(rows)).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in got) == sorted((k, n, m) for k, _, n, m, _ in brute.repeated_bytes(rows))
