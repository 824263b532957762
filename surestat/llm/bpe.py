"""Operator 8, byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token. Tier two: for a miss, a
heap of adjacent pairs over a linked list of the bytes merges the pair of least rank, leftmost first, until none is left.
What either tier found is remembered, within a bound in bytes, as natural text repeats its words.

The whole text is encoded. Cutting at single blanks is exact for the pattern unless white space meets white space; such a
text is matched as a whole. Defined results: null and empty texts give no ids; surrogates can't occur in UTF-8 columns; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, only_memory, table

#: Bytes that each of an encoder's three memories may hold before it is emptied, and the longest entry that is remembered.
REMEMBERED, LONGEST = 100_000_000, 2_000
# The characters with Unicode's White_Space property, which the tokenizer's engine takes for \s.
WHITE = "\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which count from 0 without gaps."""
    with open(path) as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(str.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [token for _, token in pairs]


class PerfectHash:
    """Hash and displace: n keys to n slots. A bucket of several keys has a displacement that sends its keys to free
    slots; a bucket of one key names its slot. `displaced` (a number for each two keys) is all that has to be shipped."""

    MASK, STEP, MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

    def __init__(self, n: int, displaced: np.ndarray) -> None:
        self.n, self.displaced, self.buckets = n, displaced.tolist(), len(displaced)

    @classmethod
    def built(cls, keys: list[bytes]) -> PerfectHash:
        n, buckets = len(keys), max(1, len(keys) // 2)
        members = [[] for _ in range(buckets)]
        for k in keys:
            d = xxhash.xxh3_64_intdigest(k)
            members[d % buckets].append(d)
        taken, displaced, single = bytearray(n), np.zeros(buckets, np.int64), []
        for b in sorted(range(buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) < 2:
                single += [b] * len(own)
                continue
            d = 0
            while True:
                d += 1
                slots = {cls._sent(x, d, n) for x in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
            displaced[b] = d
            for s in slots:
                taken[s] = 1
        for b, slot in zip(single, (s for s in range(n) if not taken[s]), strict=True):
            displaced[b] = -slot - 1
        return cls(n, displaced)

    @classmethod
    def _sent(cls, x: int, d: int, n: int) -> int:
        return ((x ^ d * cls.STEP & cls.MASK) * cls.MIX & cls.MASK) % n

    def slot(self, key: bytes) -> int:
        """The key's slot; for a key that isn't in the set, any."""
        x = xxhash.xxh3_64_intdigest(key)
        d = self.displaced[x % self.buckets]
        return -d - 1 if d < 0 else ((x ^ d * self.STEP & self.MASK) * self.MIX & self.MASK) % self.n


_FORTH, _BACK = list(range(1, 65)), list(range(-1, 64))


class Encoder:
    """Words to ids. Each of three memories holds at most `bound` bytes."""

    def __init__(self, tokens: list[bytes], displaced: np.ndarray, pattern: str, bound: int = REMEMBERED) -> None:
        self.tokens, self.hash = tokens, PerfectHash(len(tokens), displaced)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.placed: list[int] = [0] * len(tokens)
        for i, t in enumerate(tokens):
            self.placed[self.hash.slot(t)] = i
        white = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.split = regex.compile(white).findall
        self.white = regex.compile(f"[{WHITE}]").match
        self.decimal = [str(i) for i in range(len(tokens))]
        self.first, self.later, self.single = _Memo(self.lone, bound), _Memo(self.after_blank, bound), _Memo(self.pre_token, bound)

    def pre_token(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        at = self.placed[self.hash.slot(raw)]
        return (at,) if self.tokens[at] == raw else tuple(self.merged(raw))

    def merged(self, raw: bytes) -> list[int]:
        """Tier two. pair[i] is the rank of the token that the piece from i and the one after it would make."""
        n, rank = len(raw), self.rank.get
        after, before = [*_FORTH[:n]], [*_BACK[: n + 1]]
        if n >= len(_FORTH):
            after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [rank(raw[i : i + 2], -1) for i in range(n)]
        pair[-1] = -1
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            x = pop(heap)
            i = x & 0xFFFFFFFF
            if pair[i] != x >> 32:
                continue  # one of its pieces has been merged since
            j = after[i]
            end = after[i] = after[j]
            before[end] = i
            pair[j] = -1
            pair[i] = r = rank(raw[i : after[end]], -1) if end < n else -1
            if r >= 0:
                push(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                pair[h] = r = rank(raw[h:end], -1)
                if r >= 0:
                    push(heap, r << 32 | h)
        ids, i = [], 0
        while i < n:
            ids.append(self.rank[raw[i : after[i]]])
            i = after[i]
        return ids

    def lone(self, piece: str) -> tuple[int, ...] | None:
        """Ids of what lies before the first blank; None if white space at an end might belong with what is outside."""
        if self.white(piece[-1]) or self.white(piece[0]):
            return None
        return tuple(chain.from_iterable(map(self.single.__getitem__, self.split(piece))))

    def after_blank(self, piece: str) -> tuple[int, ...] | None:
        """As lone(), of what follows a blank. A word with a full stop or comma or nothing after it needs no pattern."""
        if piece.isalpha():
            return self.pre_token(f" {piece}")
        last = piece[-1]
        if last in ",." and piece[:-1].isalpha():
            return self.single[f" {piece[:-1]}"] + self.single[last]
        if self.white(last) or self.white(piece[0]):
            return None
        return tuple(chain.from_iterable(map(self.single.__getitem__, self.split(f" {piece}"))))

    def encode(self, text: str) -> list[int]:
        if text and "  " not in text and text[0] != " " and text[-1] != " ":
            pieces = text.split(" ")
            head = self.first[pieces[0]]
            tail = list(map(self.later.__getitem__, pieces[1:]))
            if head is not None and None not in tail:
                return list(chain(head, chain.from_iterable(tail)))
        return list(chain.from_iterable(map(self.single.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    """Remembers make(key). An entry costs its characters and ids and some 200 bytes of objects; one of over LONGEST bytes is
    made anew each time."""

    def __init__(self, make, bound: int) -> None:
        self.make, self.bound, self.held = make, bound, 0

    def __missing__(self, key):
        value = self.make(key)
        cost = 200 + 4 * len(key) + 8 * len(value or ())
        if cost <= LONGEST:
            if self.held + cost > self.bound:
                self.clear()
                self.held = 0
            self.held += cost
            self[key] = value
        return value


_ready: dict[tuple, Encoder] = {}


def encoder(path: str, displaced: np.ndarray, pattern: str) -> Encoder:
    """This process's encoder: workers live on from task to task, and so does what they remember."""
    only_memory("bpe", _ready.clear)
    key = (path, pattern)
    if key not in _ready:
        _ready[key] = Encoder(read_ranks(path), displaced, pattern)
    return _ready[key]


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """(key, ids array<int> if asked for, n_tokens, ids_sha256, decoded_sha256): decoded from the ids, not from the text.

    The displacements, a fixed 200 KB for 50,000 tokens, are built once on the driver."""
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    displaced = PerfectHash.built(read_ranks(path)).displaced
    displaced = np.array(displaced, np.int64)

    def make():
        coder = encoder(path, displaced, pattern)
        decimal = coder.decimal.__getitem__

        def handle(b):
            every, count, sha, back = [], [], [], []
            for text in b.column(1).to_pylist():
                x = coder.encode(text or "")
                if ids:
                    every.append(x)
                count.append(len(x))
                sha.append(hashlib.sha256(" ".join(map(decimal, x)).encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode(x)).hexdigest())
            columns = [b.column(0), *([pa.array(every, pa.list_(pa.int32()))] if ids else []), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["key", *(["ids"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

        return handle

    schema = f"key {kind}, {'ids array<int>, ' if ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string"
    return by_batch(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), make, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False)
