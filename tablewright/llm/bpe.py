"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by the pattern.  Tier 1: a minimal perfect hash
over the vocabulary (hash and displace: one displacement per bucket, one slot
per token, the bytes in the slot decide) resolves a pre-token that is itself a
token.  Tier 2, for the rest: the bytes form a linked list, a heap holds the
mergeable neighbours by (rank, position), the lowest rank merges first and the
leftmost on ties, stale entries are skipped; O(n log n) for any length.

Pre-tokens already seen by a Python worker are kept in a bounded table.

Defined cases: a null text is the empty text: no ids, empty bytes; ranks
that miss a single byte raise; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise
from operator import itemgetter

import xxhash
from pyspark.sql import DataFrame

from .common import map_texts

#: Pre-tokens kept per Python worker.
MEMO = 1_000_000
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary",
           "decoded_sha256": "string"}


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a rank file (base64 token, rank); ranks 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


def _each(table, keys) -> tuple:
    """``table[k]`` of every key (missing ones are made), in one call: a map of lookups costs half as much again."""
    return itemgetter(*keys)(table) if len(keys) > 1 else tuple(table[k] for k in keys)


class PerfectHash:
    """Minimal perfect hash from tokens to ids: ``len(tokens)`` slots."""

    def __init__(self, tokens: list[bytes], per_bucket: int = 2):
        self.n = n = len(tokens)
        self.m = m = max(1, n // per_bucket)
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        for i, t in enumerate(tokens):
            h = xxhash.xxh3_64_intdigest(t)
            buckets[h % m].append((h >> 20, i))
        self.shift = [0] * m
        self.ids = [-1] * n
        free = n - 1
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) == 1:  # any free slot will do: its distance is the displacement
                while self.ids[free] >= 0:
                    free -= 1
                h, i = buckets[b][0]
                self.shift[b] = -((free - h) % n) - 1
                self.ids[free] = i
                continue
            d = 0
            while buckets[b]:
                slots = [self._slot(h, d) for h, _ in buckets[b]]
                if len(set(slots)) == len(slots) and all(self.ids[s] < 0 for s in slots):
                    self.shift[b] = d
                    for s, (_, i) in zip(slots, buckets[b]):
                        self.ids[s] = i
                    break
                d += 1
        self.tokens = [tokens[i] for i in self.ids]

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return (h - d - 1) % self.n
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 >> 24) % self.n

    def find(self, token: bytes) -> int:
        """The id of ``token``, or -1."""
        h = xxhash.xxh3_64_intdigest(token)
        s = self._slot(h >> 20, self.shift[h % self.m])
        return self.ids[s] if self.tokens[s] == token else -1


class Encoder(dict):
    """Ids of pre-tokens, computed when first asked for."""

    def __init__(self, tokens: list[bytes], pattern: str, perfect: PerfectHash | None = None):
        import regex

        self.vocabulary = tokens
        self.numbers = [b"%d" % i for i in range(len(tokens))]
        self.split = regex.compile(pattern).findall
        self.perfect = find = perfect or PerfectHash(tokens)
        self.of_byte = [find.find(bytes([b])) for b in range(256)]
        if min(self.of_byte) < 0:
            raise ValueError("a byte has no rank")
        self.pairs = {}
        for i, t in enumerate(tokens):  # every way to join two tokens into a third
            for cut in range(1, len(t)):
                a, b = find.find(t[:cut]), find.find(t[cut:])
                if a >= 0 and b >= 0:
                    self.pairs[a << 32 | b] = i

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        i = self.perfect.find(raw)
        self[piece] = ids = (i,) if i >= 0 else tuple(self.merge(raw))
        return ids

    def merge(self, raw: bytes) -> list[int]:
        ids = list(map(self.of_byte.__getitem__, raw))
        n, pair = len(ids), self.pairs.get
        rank = [pair(a << 32 | b, -1) for a, b in pairwise(ids)]
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return ids
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            x = heappop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], rank[j] = r, -1, -1
            if k < n:
                before[k] = i
                rank[i] = s = pair(r << 32 | ids[k], -1)
                if s >= 0:
                    heappush(heap, s << 32 | i)
            else:
                rank[i] = -1
            p = before[i]
            if p >= 0:
                rank[p] = s = pair(ids[p] << 32 | r, -1)
                if s >= 0:
                    heappush(heap, s << 32 | p)
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        if len(self) > MEMO:
            self.clear()
        return list(chain.from_iterable(_each(self, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(_each(self.vocabulary, ids))


_encoders: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", carry: list[str] | None = None,
                  outputs=("n_tokens", "ids")) -> DataFrame:
    """``row`` (the carried columns) and the :data:`OUTPUTS` asked for:
    ``decoded`` is what the ids decode to.  The driver reads the rank file and
    builds the hash; both (the size of the file) are broadcast."""
    tokens = load_ranks(ranks)
    name = hashlib.sha256(b"\n".join(tokens) + pattern.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))

    def make():
        if name not in _encoders:
            _encoders[name] = Encoder(shared.value[0], pattern, shared.value[1])
        return lambda texts: _columns(_encoders[name], texts, outputs)

    fields = ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)
    return map_texts(docs, text, fields, make, carry)


def _columns(encoder: Encoder, texts: list, outputs) -> dict:
    got: dict[str, list] = {c: [] for c in outputs}
    for t in texts:
        ids = encoder.encode(t or "")
        raw = encoder.decode(ids) if {"decoded", "decoded_sha256"} & got.keys() else b""
        for c, values in got.items():
            if c == "n_tokens":
                values.append(len(ids))
            elif c == "ids":
                values.append(ids)
            elif c == "ids_sha256":
                values.append(hashlib.sha256(b" ".join(_each(encoder.numbers, ids))).hexdigest())
            elif c == "decoded":
                values.append(raw)
            else:
                values.append(hashlib.sha256(raw).hexdigest())
    return got
