"""Operator 2, near duplicates by SuperMinHash signatures, banding, verification and union-find.

A document is the set of its distinct word shingles, as 64-bit hashes. SuperMinHash gives each element one rank for every
position of the signature, by a random permutation of the positions, so that the ranks j + r of an element are correlated and
the estimate has less variance; step j can only set ranks from j up, so a document stops as soon as all its positions are
below. Bands of the signature are keys of buckets. Equal sets are one class from the start. Candidates are then verified on
full sets:
 1. every member of a bucket against the bucket's smallest and its largest document: two links a member, however large it is;
 2. verified links are grouped (union-find within each partition, then stars over all partitions);
 3. in buckets that still hold several groups, shingles are counted over all their members. Shingles that no other
    member has can't be shared, so a set with too many of them has no link and is done with, however large its buckets are;
 4. the others are compared with the member of their bucket that has the least share of such shingles;
 5. members of one bucket that are still in different groups, all outside its main group against all of the other groups, small
    buckets pair by pair, large ones in blocks of bytes that put out links only. Pairs within a group can add nothing to
    it. So no link between groups that banding proposes is lost, and no bucket is expanded into all its pairs.

32 bands of 5 ranks propose a pair of similarity 0.8 but for 3 in a million, and one of 0.9 but for one in 10^12.

Defined results: null or wordless texts have 0 shingles, component_id = doc_id, kept true, and link with nothing; a row with a null doc_id
belongs to the group of its text, whose component_id is null if no row of it has an id, and is kept if it is that group's least
row, by the text's hash; each of several rows with one doc_id takes the component of its own text; ties go to the smallest
doc_id; an empty table gives an empty result; further columns are ignored by components() and left as they are by one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, only_memory, table, written

POSITIONS, BANDS = 160, 32
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Bytes of words and hashes that a worker remembers.
REMEMBERED = 64_000_000
#: Buckets of so few members are compared pair by pair, others in blocks of about BLOCK_BYTES.
FEW, BLOCK_BYTES = 8, 4_000_000
#: Parts that repeated rows are dealt into.
SALTS = 64
#: Elements whose permutations are held at once.
ELEMENTS = 32_768

_LOWER = bytes(range(256)).lower()
_U = np.uint64
_GOLD, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 256:
            if self.held > REMEMBERED:
                self.clear()
                self.held = 0
            self.held += 170 + len(word)
            self[word] = h
        return h


_hashes = _WordHashes()


def _forget() -> None:
    _hashes.clear()
    _hashes.held = 0


def _begin() -> None:
    only_memory("dedup", _forget)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles. A-Z are lower-cased; words end at blanks and at 9 to 13."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for j in range(min(k, len(w))):
        h = mixed(h * _GOLD + w[j : j + n])
    return np.unique(h)


def super_minhash(sets: list[np.ndarray], m: int = POSITIONS) -> np.ndarray:
    """Signatures (documents x m) of nonempty sets: at each position the least j << 32 | r over the set's elements."""
    h = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    todo: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, s in enumerate(sets):
        for at in range(0, len(s), ELEMENTS):
            part = s[at : at + ELEMENTS]
            if held + len(part) > ELEMENTS:
                _lower(h, todo, m)
                todo, held = [], 0
            todo.append((i, part))
            held += len(part)
    _lower(h, todo, m)
    return h


def _lower(h: np.ndarray, todo: list[tuple[int, np.ndarray]], m: int) -> None:
    if not todo:
        return
    x = np.concatenate([s for _, s in todo])
    doc = np.repeat(np.array([i for i, _ in todo]), [len(s) for _, s in todo])
    order = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(x), m)).copy().ravel()
    base = np.arange(len(x)) * m
    flat, low = h.reshape(-1), _U(0xFFFFFFFF)
    for j in range(m):
        random = mixed(x + _U((j + 1) * int(_GOLD) % (1 << 64)))
        at = base + (j + ((random & low) * _U(m - j) >> _U(32)).astype(np.int64))
        place = order[at]
        order[at] = order[base + j]  # the other half of the swap is never read again
        np.minimum.at(flat, doc * m + place, _U(j) << _U(32) | random >> _U(32))
        open_ = h[doc[0] : doc[-1] + 1].max(axis=1) >= _U(j + 1) << _U(32)
        if not open_.any():
            break
        stays = open_[doc - doc[0]]
        if not stays.all():
            x, base, doc = x[stays], base[stays], doc[stays]


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(documents x bands) 64-bit keys; the band's number is part of its key."""
    s = signatures.reshape(len(signatures), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, s.shape[:2])
    for r in range(s.shape[2]):
        keys = mixed(keys * _A + s[:, :, r])
    return keys.view(np.int64)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc, mark, text) to (doc, mark, n, digest, bands): the set's size, its 128-bit digest, and its band keys (null for an empty set)."""

    def make():
        _begin()

        def handle(b):
            sets = [shingles(t, k) for t in b.column(2).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(super_minhash([sets[i] for i in full])) if full else np.empty((0, BANDS), np.int64)
            offsets = np.zeros(len(sets) + 1, np.int32)
            offsets[1:] = np.cumsum([BANDS if len(s) else 0 for s in sets])
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            return pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([len(s) for s in sets], pa.int64()), digest, bands], ["doc", "mark", "n", "digest", "bands"])

        return handle

    return by_batch(docs.select("doc", "mark", "text"), make, "doc long, mark long, n long, digest binary, bands array<long>")


def set_rows(texts: DataFrame, k: int) -> DataFrame:
    """texts (node, text) to (node, elements): the sorted set as bytes."""

    def make():
        _begin()
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, k).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "elements"])

    return by_batch(texts, make, "node long, elements binary")


def lone_shingles(sets: DataFrame) -> DataFrame:
    """sets (node, elements) to (node, lone): how many of a set's shingles no other of these sets has; sets without any are left out."""

    def make():
        def handle(b):
            held = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            node = b.column(0).take(pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held])))
            return pa.RecordBatch.from_arrays([node, pa.array(np.concatenate(held) if held else np.empty(0, np.int64))], ["node", "shingle"])

        return handle

    rows = by_batch(sets.select("node", "elements"), make, "node long, shingle long")
    lone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("sets")).where("sets = 1")
    return lone.groupBy("node").agg(F.count("*").alias("lone"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sets are unique by node; a node in many pairs is on
    the side that adaptive execution splits."""
    near = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("right")), "b")
    near = near.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("left")), "a").select("a", "b", "left", "right")

    def make():
        def handle(batch):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            return pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return handle

    return by_batch(near, make, "a long, b long")


def of_buckets(rows: DataFrame) -> DataFrame:
    """A row for each bucket, dealt out again: only where both sides of a join come from a shuffle can adaptive execution split a
    bucket's members over tasks."""
    return rows.repartition("bucket")


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """verified(), stored, so that the next step's workers don't stand beside these."""
    return written(verified(pairs, sets, percent), "verified")


def within_reach(n: Column, o: Column, other_n: Column, percent: int) -> Column:
    """Whether a set of n shingles, o of which others have too, can be similar enough to a set of other_n: with c in common the similarity
    is c / (n + other_n - c), and c is at most o."""
    return (100 + percent) * o >= percent * (n + other_n)


def compared_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the groups of one bucket's members (bucket, node, n, o, c): the members outside the bucket's most frequent
    group, but for those that can't reach the bucket's smallest set, against all members of other groups.

    Each side is cut into blocks of about BLOCK_BYTES, by its own size: a member is shipped once for each block of the other
    side, so rows grow with the askers' bytes times the bucket's over BLOCK_BYTES, and a task holds two blocks. Only one link
    of a member to each other group in a block is put out."""
    cost = (8 * F.col("n") + 64).alias("cost")
    main = members.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("main"))
    whole = members.groupBy("bucket").agg(F.min("n").alias("least"), F.ceil(F.sum(cost) / BLOCK_BYTES).cast("int").alias("targets"))
    sides = written(members.join(of_buckets(whole.join(main, "bucket")), "bucket"), "sides")
    asking = sides.where("c <> main").where(within_reach(F.col("n"), F.col("o"), F.col("least"), percent))
    asked = of_buckets(asking.groupBy("bucket").agg(F.ceil(F.sum(cost) / BLOCK_BYTES).cast("int").alias("askers")))
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asking = asking.join(asked, "bucket").withColumn("qb", block("askers")).withColumn("tb", every("targets"))
    # a bucket in which nothing asks isn't shipped
    targets = sides.join(asked, "bucket").withColumn("tb", block("targets")).withColumn("qb", every("askers"))
    keys = ["bucket", "qb", "tb"]
    both = asking.select(*keys, "node", "c", F.lit(True).alias("asks")).union(targets.select(*keys, "node", "c", F.lit(False)))

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        mine, theirs = rows[rows["asks"]], rows[~rows["asks"]]
        if len(mine) and len(theirs):
            held = [np.frombuffer(x, np.uint64) for x in theirs["elements"]]
            size = np.array([len(x) for x in held])
            owner = np.repeat(np.arange(len(held)), size)
            flat = np.concatenate(held)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            nodes, groups = theirs["node"].to_numpy(), theirs["c"].to_numpy()
            for node, c, raw in zip(mine["node"].tolist(), mine["c"].tolist(), mine["elements"], strict=True):
                x = np.frombuffer(raw, np.uint64)
                begin, end = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = end - begin
                if 100 * np.count_nonzero(n) < percent * len(x):
                    continue
                at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(held))
                near = np.flatnonzero((100 * shared >= percent * (len(x) + size - shared)) & (groups != c))
                _, first = np.unique(groups[near], return_index=True)
                found += [(min(node, y), max(node, y)) for y in nodes[near[first]].tolist()]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return both.join(sets, "node").groupBy(keys).applyInPandas(links, "a long, b long").distinct()


def _joined_here(edges: DataFrame) -> DataFrame:
    """Union-find over the links of each partition: every document that has one, with the smallest it is joined to there.
    It holds the documents of one partition's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while up.setdefault(top, top) != top:
                top = up[top]
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        ends = [(x, r) for x in list(up) if (r := root(x)) != x]
        for at in range(0, len(ends), 10_000):
            part = ends[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["child", "parent"])

    return edges.mapInArrow(run, "child long, parent long")


def grouped(edges: DataFrame) -> DataFrame:
    """(doc, component) of every document with a link (a, b): the smallest document it can reach.

    Union-find first makes each partition's links a forest of stars. Then, until all is stars, large-star steps link the greater
    neighbours of a document to its least one, and small-star steps the lesser ones; both only need a minimum for
    each document, which is aggregated before the shuffle."""
    links = written(_joined_here(edges), "links")
    while True:
        # a star forest: each child has one parent, and no parent is a child
        parents = links.groupBy("child").agg(F.min("parent").alias("least"), F.max("parent").alias("most"))
        chained = links.select(F.col("parent").alias("child")).join(parents, "child", "left_semi")
        if parents.where("least <> most").isEmpty() and chained.isEmpty():
            return links.select(F.col("child").alias("doc"), F.col("parent").alias("component")).distinct()
        both = links.union(links.select("parent", "child")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("child"), F.col("m").alias("parent")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("child").agg(F.min("parent").alias("m"))
        down = large.join(least, "child").select(F.col("parent").alias("child"), F.col("m").alias("parent")).where("child > parent")
        links = written(down.union(least).distinct(), "small-star")


def linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc, mark, text), a row each: (doc, mark, n, digest), and for each distinct set (digest, no, least_doc, least_mark), the
    least row of the group that the set belongs to; `no` tells that the row has no doc. Rows with a doc come first.

    A set is a node, with a number of its own, so texts that share a doc stay apart. Its text is found again by
    the (doc, mark) of its least row; mark is a hash of the text."""
    rows = written(signed(docs, k), "signatures")
    first = F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "mark", "n", "bands"))
    one = rows.where("n > 0").groupBy("digest").agg(first.alias("x"))
    classes = written(one.select(F.monotonically_increasing_id().alias("node"), "digest", "x.*"), "classes")

    # buckets with two classes or more
    banded = classes.select("node", "n", F.explode("bands").alias("bucket"))
    ends = banded.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high")).where("low.node < high.node")
    shared = written(banded.join(of_buckets(ends), "bucket"), "buckets")
    involved = classes.join(shared.select("node").distinct(), "node", "left_semi")
    place = [F.coalesce("doc", F.lit(0)).alias("at"), "mark"]
    texts = docs.select(*place, "text").join(involved.select("node", *place), ["at", "mark"]).select("node", "text").dropDuplicates(["node"])
    sets = written(set_rows(texts, k), "sets")

    def pairs(rows: DataFrame, tried: DataFrame | None, label: str) -> DataFrame:
        """rows (a, an, b, bn) as distinct pairs a < b of sizes that allow a link, without those tried before."""
        alike = F.expr(f"100 * least(an, bn) >= {percent} * greatest(an, bn)")
        rows = rows.where(F.col("a") != F.col("b")).where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return written(rows.join(tried, ["a", "b"], "left_anti") if tried is not None else rows, label)

    def ends_of(x: str, y: str) -> list[Column]:
        return [F.col(f"{x}.node").alias("a"), F.col(f"{x}.n").alias("an"), F.col(f"{y}.node").alias("b"), F.col(f"{y}.n").alias("bn")]

    own = shared.select("bucket", F.struct("node", "n").alias("own"), "low", "high")
    tried = pairs(own.select(*ends_of("low", "own")).union(own.select(*ends_of("own", "high"))), None, "pairs")
    found = written(grouped(links_of(tried, sets, percent)), "groups")

    def placed(members: DataFrame) -> DataFrame:
        """Members with their groups c, of buckets that hold several groups."""
        members = members.join(found.select(F.col("doc").alias("node"), "component"), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        several = members.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("members")).where("c0 < c1")
        return members.join(of_buckets(several.select("bucket", "members")), "bucket")

    def joined(more: DataFrame) -> DataFrame:
        return written(grouped(more.union(found.select(F.col("component").alias("a"), F.col("doc").alias("b")))), "groups")

    # o: how many shingles another set of an open bucket has too; a set without enough of them has no link
    open_ = written(placed(shared.select("bucket", "node", "n")).drop("c", "members"), "open-buckets")
    lone = lone_shingles(sets.join(open_.select("node").distinct(), "node", "left_semi"))
    able = open_.join(lone, "node", "left").withColumn("o", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
    able = written(able.where(within_reach(F.col("n"), F.col("o"), F.ceil(F.col("n") * percent / 100), percent)), "able")

    # the member with the least share of shingles of its own is the likeliest to be linked with the others
    left = written(placed(able), "left")
    hub = F.min_by(F.struct("node", "n", "c"), F.struct((F.col("n") - F.col("o")) / F.col("n"), F.xxhash64("node", "bucket"))).alias("hub")
    asked = left.join(of_buckets(left.groupBy("bucket").agg(hub)), "bucket").where("c <> hub.c").select("hub", F.struct("node", "n").alias("own")).select(*ends_of("hub", "own"))
    asked = pairs(asked, tried, "hub-pairs")
    found, tried = joined(links_of(asked, sets, percent)), tried.union(asked)

    left = written(placed(able), "left")
    few = left.where(F.col("members") <= FEW)
    x, y = (few.select("bucket", F.struct("node", "n", "o", "c").alias(s)) for s in ("x", "y"))
    reach = within_reach(F.col("x.n"), F.least("x.o", "y.o"), F.col("y.n"), percent)
    asked = pairs(x.join(y, "bucket").where("x.node < y.node AND x.c <> y.c").where(reach).select(*ends_of("x", "y")), tried, "few-pairs")
    in_blocks = written(compared_in_blocks(left.where(F.col("members") > FEW), sets, percent), "verified")
    found = joined(links_of(asked, sets, percent).union(in_blocks))

    own = classes.select("digest", "node", F.struct("no", "doc", "mark").alias("row"))
    in_groups = own.join(found.select(F.col("doc").alias("node"), "component"), "node", "left").select("digest", "row", F.coalesce("component", "node").alias("component"))
    least = in_groups.groupBy("component").agg(F.min("row").alias("least"))
    of_set = in_groups.join(least, "component").select("digest", F.col("least.no").alias("no"), F.col("least.doc").alias("least_doc"), F.col("least.mark").alias("least_mark"))
    return rows.drop("bands"), of_set


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def components(docs: DataFrame, k: int = 5, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of docs."""
    rows, of_set = linked(_marked(docs, key, text), k, percent)
    out = rows.join(of_set, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("least_doc")).otherwise(F.col("doc"))
    nameless = F.when(F.col("n") > 0, F.col("no") & (F.col("mark") == F.col("least_mark"))).otherwise(True)
    kept = F.when(F.col("doc").isNotNull(), F.col("doc") == component).otherwise(nameless)
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: of the smallest key, null last, then of the smallest hash of the text. Rows are judged each by
    its own text: one that shares its key with a copy stays if its text has no other row. Of repeated rows (equal key
    and text) one stays, whichever. Rows without words are all left."""
    rows, of_set = linked(_marked(docs, key, text), k, percent)
    judged = rows.where("n > 0").join(of_set, "digest").select("doc", "mark", F.col("doc").eqNullSafe(F.col("least_doc")) & (F.col("mark") == F.col("least_mark")).alias("stays"))
    judged = judged.toDF("doc", "mark", "stays").groupBy(F.col("doc").isNull().alias("__no"), F.coalesce("doc", F.lit(0)).alias("__at"), F.col("mark").alias("__mark")).agg(F.first("stays").alias("stays"), F.count("*").alias("n"))
    judged = written(judged.where("NOT stays OR n > 1"), "judged")
    names = ["__no", "__at", "__mark"]
    own = docs.select(F.struct(*docs.columns).alias("__row"), F.col(key).cast("long").alias("__key"), F.xxhash64(text).alias("__mark"))
    own = own.select("__row", F.col("__key").isNull().alias("__no"), F.coalesce("__key", F.lit(0)).alias("__at"), "__mark")
    single = own.join(judged.select(*names), names, "left_anti").select("__row.*")
    again = judged.where("stays")
    if again.isEmpty():
        return single
    # a row that makes up much of the table meets its equals in SALTS parts first
    salted = own.join(again.select(*names), names, "left_semi").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    once = salted.groupBy(*names, "__salt").agg(F.first("__row").alias("__row")).groupBy(*names).agg(F.first("__row").alias("__row"))
    return single.unionByName(once.select("__row.*"))


#: All pairs that share a shingle, and all that they reach: for small tables with an id a row.
ORACLE = """
    WITH RECURSIVE
    words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
    shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    near AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
    least AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
    SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
    FROM sets LEFT JOIN least USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), k=2)
