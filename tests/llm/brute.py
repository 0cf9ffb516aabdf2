"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def secrets(text: str | None) -> tuple[int, int, int, str]:
    spans = base_spans(text)
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), sha(joined.encode()))


def test_words(text: str | None) -> list[str]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(docs: list[tuple], items: list[tuple], size: int = 13) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = test_words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w = test_words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= names
        names = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def near_items(docs: list[tuple], items: list[tuple], size: int, slack: int) -> list[tuple]:
    """(key, number, sha of the names) of items with a window whose words all lie around its rarest word, none of them exactly."""
    texts = [test_words(text) for _, text in docs]
    seen = Counter(w for words in texts for w in words)
    windows = [(item, w[i : i + size]) for item, text in items for w in [test_words(text)] if w for i in range(max(1, len(w) - size + 1))]
    out = []
    for (key, _), words in zip(docs, texts):
        near, exact = set(), set()
        for item, window in windows:
            _, rarest, at = min((seen[w], w, i) for i, w in enumerate(window))
            for pos in (i for i, w in enumerate(words) if w == rarest):
                start = pos - at
                if start >= 0 and words[start : start + len(window)] == window:
                    exact.add(item)
                elif not Counter(window) - Counter(words[max(0, start - slack) : start + len(window) + slack]):
                    near.add(item)
        names = sorted(str(x) for x in near - exact if x is not None)
        out.append((key, len(names), sha(",".join(names).encode())))
    return out


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def fingerprint(text: str | None) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes: list, linked) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def repeated_words(docs: list[tuple], size: int = 13) -> list[tuple]:
    """(key, n_words, n_removed, kept_sha256) for docs with distinct keys."""
    split = {k: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for k, t in docs}
    first: dict[tuple, int] = {}
    for k in sorted(split):
        for i in range(len(split[k]) - size + 1):
            first.setdefault(tuple(split[k][i : i + size]), k)
    out = []
    for k, w in split.items():
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < k for j in range(i, i + size)}
        out.append((k, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())))
    return out


def repeated_bytes(docs: list[tuple], size: int = 50) -> list[tuple]:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for docs with distinct keys."""
    data = {k: (t or "").encode() for k, t in docs}
    first: dict[bytes, int] = {}
    for k in sorted(data):
        for i in range(len(data[k]) - size + 1):
            first.setdefault(data[k][i : i + size], k)
    out = []
    for k, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if first[d[i : i + size]] < k:
                gone[i : i + size] = b"\1" * size
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((k, len(d), sum(gone), spans, sha(bytes(x for x, g in zip(d, gone) if not g))))
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
