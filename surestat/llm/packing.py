"""Operator 3, best-fit packing with Martello-Toth dominance reduction.

Pieces of at most `capacity` tokens go into as few sequences as possible. Only the counts of each length matter for the
plan, at most `capacity` numbers whatever the corpus: they come to the driver, which plans runs, "pieces r to s of length L go to
sequences t to t+s-r at offset o". Tasks then look up each piece by its length and its rank among pieces of that length.

Reduction: for the longest piece j left, the set {j, i} with the longest i that still fits dominates every other set with j
if it fills the sequence, if no two pieces fit beside j, or if two but not three fit and no such pair is longer than i. Such sets are fixed for
good in bulk, the instance shrinks, and what isn't dominated is packed best-fit by falling length.

Defined results: null and empty texts are one token (the closing id 0); a longer document is cut into pieces of capacity,
the last shorter; repeated rows and ties are packed each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, only_memory, table, written

CAPACITY = 2048
#: Bytes of words and ids that a worker remembers from batch to batch.
REMEMBERED = 100_000_000
#: Groups in which the ranks of one length are counted.
RANK_GROUPS = 64

_ready: dict[str, WordIds] = {}


class WordIds(dict):
    """Little-endian ids of the pieces between blanks and line feeds. The tokenizer drops white space before it cuts, and
    neither its normaliser nor its pattern looks across it, so pieces are encoded apart, each distinct one once. Of a word
    with a full stop or comma after it, the word and the mark are looked up, as the pattern cuts there too; ASCII case
    doesn't matter to the normaliser. Words of letters only end in a token marked as a word's last, so many are
    encoded in one call."""

    TOGETHER = 512

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.held = 0  # bytes
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode_apart(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[word] = np.array(got.ids, "<u4").tobytes()

    def encode_together(self, words: list[str]) -> None:
        for at in range(0, len(words), self.TOGETHER):
            part = words[at : at + self.TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(part):
                self.encode_apart(part)
                continue
            raw, begin = ids.tobytes(), 0
            for word, end in zip(part, ends, strict=True):
                self[word] = raw[4 * begin : 4 * end]
                begin = end

    def learn(self, words: set[str]) -> None:
        new = words - self.keys()
        plain, other, made = set(), [], []
        for w in new:
            stem, mark = (w[:-1], w[-1]) if w.endswith((".", ",")) else (w, "")
            low = stem.lower()
            if not low.isalpha() or not stem.isalpha():  # a letter may become a letter and a mark
                other.append(w)
                continue
            if low.isascii() and stem.isascii():
                stem = low
            if stem not in self:
                plain.add(stem)
            if stem != w:
                made.append((w, stem, mark))
        self.encode_apart([*other, *(m for m in (".", ",") if m not in self)])
        self.encode_together(list(plain))
        for w, stem, mark in made:
            self[w] = self[stem] + self[mark] if mark else self[stem]
        self.held += 150 * len(new) + 5 * sum(map(len, new))  # about an id for each four letters

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*cut))
        for words in cut:
            yield b"".join(map(self.__getitem__, words))


def word_ids(path: str) -> WordIds:
    only_memory("packing", _ready.clear)
    if path not in _ready:
        _ready[path] = WordIds(path)
    return _ready[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's ids and the closing 0, cut at capacity."""
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def make():
        coder = word_ids(path)

        def handle(b):
            texts = [t or "" for t in b.column(1).to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(coder.encode_batch(texts)):
                ids += b"\0\0\0\0"
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["key", "piece", "start", "length", "ids_crc32"])

        return handle

    return by_batch(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


class Counts:
    """How many pieces there are of each length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.of = {k: v for k, v in counts.items() if v}
        self.lengths = sorted(self.of)

    def take(self, length: int, n: int) -> None:
        self.of[length] -= n
        if not self.of[length]:
            del self.of[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def longest(self, room: int, but: int | None = None) -> int:
        """The longest length up to room that is there, one piece of length `but` being spoken for; 0 if none."""
        at = bisect_right(self.lengths, room) - 1
        while at >= 0 and self.lengths[at] == but and self.of[but] < 2:
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def shortest(self, n: int, but: int) -> int | None:
        """Sum of the n shortest pieces beside one of length `but`; None if there aren't n."""
        total = 0
        for length in self.lengths:
            have = self.of[length] - (length == but)
            used = min(n, have)
            total, n = total + used * length, n - used
            if not n:
                return total
        return None

    def longest_pair(self, room: int, but: int) -> int:
        """The greatest sum of two pieces up to room, beside one of length `but`."""
        best = 0
        have = lambda x: self.of.get(x, 0) - (x == but)
        for a in self.lengths:
            if 2 * a > room:
                break
            if have(a) < 1:
                continue
            at = bisect_right(self.lengths, room - a) - 1
            while at >= 0 and self.lengths[at] >= a:
                b = self.lengths[at]
                if have(b) >= (2 if b == a else 1):
                    best = max(best, a + b)
                    break
                at -= 1
        return best


def dominating(left: Counts, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes sets that provably dominate their alternatives out of `left`, and returns them as (lengths, how many)."""
    fixed = []
    for j in sorted(left.lengths, reverse=True):
        while left.of.get(j):
            room = capacity - j
            i = left.longest(room, j)
            if not i:
                fixed.append(((j,), left.of[j]))
                left.take(j, left.of[j])
                break
            if i < room:
                two = left.shortest(2, j)
                if two is not None and two <= room:
                    three = left.shortest(3, j)
                    if three is not None and three <= room or left.longest_pair(room, j) > i:
                        break  # not dominated: stays for best fit
            if i == j:
                n = left.of[j] // 2
                left.take(j, 2 * n)
            else:
                # in bulk: as pieces go, i stays the longest that fits and the sums of others only grow scarcer
                n = min(left.of[j], left.of[i])
                left.take(j, n)
                left.take(i, n)
            fixed.append(((j, i), n))
    return fixed


def best_fit(left: Counts, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length, for all pieces of a length at once. Sequences of like content are one group."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # by room left
    rooms: list[int] = []

    def put(room: int, held: tuple[int, ...], n: int) -> None:
        if room not in open_ or not open_[room]:
            at = bisect_left(rooms, room)
            if at == len(rooms) or rooms[at] != room:
                rooms.insert(at, room)
        open_[room][held] += n

    for length in sorted(left.lengths, reverse=True):
        n = left.of[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                held, have = open_[room].popitem()
                if not open_[room]:
                    del rooms[at]
            else:
                room, held, have = capacity, (), n
            each = room // length  # best fit fills one sequence before it opens the next room
            full = min(have, n // each)
            if full:
                put(room - each * length, held + (length,) * each, full)
                n, have = n - full * each, have - full
            if have and n:
                put(room - n * length, held + (length,) * n, 1)
                n, have = 0, have - 1
            if have and held:
                put(room, held, have)
    return [(held, n) for groups in open_.values() for held, n in groups.items() if n]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, how many, first sequence, offset), sorted, of a packing of these counts.

    There are at most a few for each length and room, whatever the counts are."""
    left = Counts(counts)
    sets = dominating(left, capacity)
    sets += best_fit(left, capacity)
    rank: dict[int, int] = defaultdict(int)
    runs, sequence = [], 0
    for held, n in sets:
        offset = 0
        for length in held:
            runs.append((length, rank[length], n, sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    if dict(rank) != {k: v for k, v in counts.items() if v}:
        raise AssertionError("the plan doesn't hold every piece once")
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def ranked(parts: DataFrame, key: str, length: str = "length") -> DataFrame:
    """Adds rank, from 0 without gaps among the pieces of each length. Ranks are counted in RANK_GROUPS groups of each
    length, which go on from one another by their counts (at most RANK_GROUPS x capacity rows)."""
    parts = parts.withColumn("_group", F.pmod(F.xxhash64(key, "piece"), F.lit(RANK_GROUPS)).cast("int"))
    sizes = parts.groupBy(length, "_group").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(length).orderBy("_group")) - F.col("_n")
    starts = sizes.select(length, "_group", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(length, "_group").orderBy(key, "piece")) - 1
    return parts.withColumn("_inside", inside).join(F.broadcast(starts), [length, "_group"]).withColumn("rank", F.col("_before") + F.col("_inside")).drop("_group", "_inside", "_before")


def pack(parts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """parts (key, piece, start, length, ids_crc32), a stored table, with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs = plan(counts, capacity)
    kind = dict(parts.dtypes)[key]
    names = [key, "piece", "start", "length", "ids_crc32"]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        first = runs[:, 0] << 44 | runs[:, 1]

        def handle(b):
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            run = runs[np.searchsorted(first, length << 44 | rank, "right") - 1] if len(runs) else np.zeros((0, 5), np.int64)
            return pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*names, "sequence_id", "offset"])

        return handle

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return by_batch(ranked(parts, key).select(*names, F.col("rank").cast("long")), make, schema)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    return pack(written(pieces(docs, path, capacity, key), "pieces"), capacity, key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
