"""Byte-level BPE with a public vocabulary file: encoding by a merge queue, decoding by concatenation."""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from lexspark.llm.common import map_rows

# fixed values: the public pre-token pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# remembered pre-tokens of a Python worker, in two generations: words met since the last change move to the young one,
# and the old one goes when the young one is full. This changes no result.
REMEMBERED = 150_000
REMEMBERED_CHARS = 64


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """One vocabulary file. Encodes and decodes like the library that the file is made for."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: bytes([b]) for b, c in enumerate(letters)}
        self.first = [vocab.get(c) for c in letters]
        self.bytes_of = {i: b"".join(byte_of.get(c, c.encode()) for c in token) for token, i in vocab.items()}
        self.rank_of: dict[int, int] = {}  # left id * 2**32 + right id
        self.rules: list[tuple[int, int, int]] = []  # by rank: left, right, merged
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rules.append((vocab[left], vocab[right], vocab[left + right]))
            self.rank_of.setdefault(vocab[left] << 32 | vocab[right], rank)
        self.added = {}
        for token in spec.get("added_tokens", []):
            if any(token[flag] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"added token {token['content']!r} has flags that are not supported")
            self.added[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        longest = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else lambda text: [text]
        self.words = regex.compile(PATTERN).findall
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.packed_added = {token: self._pack([i]) for token, i in self.added.items()}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token.

        A queue holds rank and place of adjacent pairs over a doubly linked
        list; an entry is stale when its rank's symbols are no longer there.
        Time n log n for n bytes.
        """
        ids = [i for b in word.encode() if (i := self.first[b]) is not None]
        n, rank_of, rules = len(ids), self.rank_of, self.rules
        if n < 2:
            return ids
        queue = [rank << 32 | at for at in range(n - 1) if (rank := rank_of.get(ids[at] << 32 | ids[at + 1])) is not None]
        if n == 2:
            return [rules[queue[0] >> 32][2]] if queue else ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            at = entry & 0xFFFFFFFF
            left, right, merged = rules[entry >> 32]
            nxt = after[at]
            if ids[at] != left or nxt >= n or ids[nxt] != right:
                continue  # stale
            ids[at], ids[nxt] = merged, -1
            after[at] = behind = after[nxt]
            if behind < n:
                before[behind] = at
                if (rank := rank_of.get(merged << 32 | ids[behind])) is not None:
                    heapq.heappush(queue, rank << 32 | at)
            if (prev := before[at]) >= 0 and (rank := rank_of.get(ids[prev] << 32 | merged)) is not None:
                heapq.heappush(queue, rank << 32 | prev)
        return [i for i in ids if i >= 0]

    def _pack(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the bytes of their vocabulary strings put together."""
        return np.array(ids, "<u4").tobytes(), b"".join(map(self.bytes_of.__getitem__, ids))

    def _remembered(self, word: str) -> tuple[bytes, bytes]:
        """The packed word, from the old generation or from the merge queue; remembered in the young one."""
        packed = self.old.get(word) or self._pack(self.merge(word))
        if len(word) <= REMEMBERED_CHARS:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = packed
        return packed

    def pack(self, text: str) -> tuple[bytes, bytes]:
        """A text's ids as little-endian 32-bit integers, and the decoded bytes."""
        ids, data = [], []
        for part in self.split(text):
            if part in self.packed_added:
                packed = self.packed_added[part]
                ids.append(packed[0])
                data.append(packed[1])
                continue
            for word in self.words(part):
                packed = self.young.get(word) or self._remembered(word)
                ids.append(packed[0])
                data.append(packed[1])
        return b"".join(ids), b"".join(data)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the token ids of every whole text. Null and empty texts have none."""
    return map_rows(docs.select(key, text), f"{key} long, ids array<int>", lambda k, t: (k, codec(vocabulary).encode(t or "")))


def decode_documents(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, text): the texts of id lists; the inverse of encode_documents for non-null texts. Null ids give an empty text."""
    return map_rows(encoded.select(key, "ids"), f"{key} long, text string", lambda k, ids: (k, codec(vocabulary).decode(ids or [])))


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) and, with keep_ids, ids array<int>; one row per row of docs.

    Encodes and decodes in one pass, so ids are never shuffled or stored. Null
    and empty texts have no tokens and the hashes of no bytes. Repeated rows
    give repeated results; other columns are ignored.
    """

    def run(k, t):
        ids, data = codec(vocabulary).pack(t or "")
        decoded = data.decode("utf-8", "replace").encode()
        hashes = hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
        return (k, len(ids) // 4, *hashes, np.frombuffer(ids, "<i4")) if keep_ids else (k, len(ids) // 4, *hashes)

    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(key, text), schema + ", ids array<int>" * keep_ids, run)
