"""The knowledge graph: nodes, weighted edges, transition weights, PageRank and random walks with restart."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HIERARCHY_RELATION, RELATION_WEIGHTS, TARGET_TYPES
from ..functions import numeric as N

#: A graph whose transitions take more bytes than this in a worker walks by joins (walk), not from memory (walk_in_memory).
EDGE_BYTES, MEMORY_BYTES = 12, 256_000_000
#: The like for PageRank, whose steps by joins have rows for nodes alone.
RANK_BYTES = 4_000_000
#: Notes that walk together, the least that are worth a task, and bytes that a step gathers at once.
NOTES, LEAST_NOTES, STEP_BYTES = 32, 8, 1 << 19
#: Steps of a block at which its changes are tried for a few directions, what of them counts as none (less than
#: doubles' own rounding of a walk), and steps of the directions alone.
FIRST_TRY, TRY_EVERY, ROUNDING, CLEAN = 16, 6, 1e-16, 6
#: Bytes of a block's column array; transitions in a packet that is dealt to tasks, its columns, and bytes of packets that are sorted at once.
BLOCK_BYTES, PACKET, PART_BYTES = 64_000_000, 100_000, 100_000_000
#: Longest vectors whose means are columns of one aggregation.
COLUMNS = 128
PACKED = {"src": np.int64, "dst": np.int64, "q": np.float64}

_built: dict = {}


def valid_edges(edges: DataFrame) -> DataFrame:
    """Both ends there and a relation of the list."""
    return edges.dropna(subset=["x_index", "y_index"]).where(F.lower("display_relation").isin(list(RELATION_WEIGHTS)))


def nodes(edges: DataFrame, order: str = "ord") -> DataFrame:
    """(index, id, type, name): each node as it occurs first, all x sides before all y sides; names in lower case."""

    def side(s: str, rank: int) -> DataFrame:
        return edges.select(F.lit(rank).alias("side"), F.col(order).alias("ord"), F.col(f"{s}_index").cast("long").alias("index"), F.col(f"{s}_id").alias("id"), F.col(f"{s}_type").alias("type"), F.lower(F.coalesce(F.col(f"{s}_name"), F.lit(""))).alias("name"))

    both = side("x", 0).unionByName(side("y", 1))
    # a minimum of structs combines before the shuffle, unlike a window
    first = both.groupBy("index").agg(F.min(F.struct("side", "ord", "id", "type", "name")).alias("x"))
    return first.select("index", "x.id", "x.type", "x.name")


def relation_weight(relation: str = "display_relation"):
    weights = F.create_map(*(F.lit(x) for pair in RELATION_WEIGHTS.items() for x in pair))
    return F.coalesce(F.try_element_at(weights, F.lower(relation)), F.lit(1.0))


def weighted_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """(a, b, w), a <= b: one undirected edge a pair, the weight of the last row in order."""
    ends = edges.select(F.col("x_index").cast("long").alias("x"), F.col("y_index").cast("long").alias("y"), F.col(order).alias("ord"), relation_weight().alias("w"))
    return ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max_by("w", F.struct("ord", "w")).alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions; a self-loop once."""
    return edges.selectExpr("a src", "b dst", "w").union(edges.where("a <> b").selectExpr("b src", "a dst", "w"))


def degrees(edges: DataFrame) -> DataFrame:
    """(index, weighted, degree): a self-loop counts twice in the plain degree."""
    return symmetric(edges).groupBy(F.col("src").alias("index")).agg(F.sum("w").alias("weighted"), F.sum(F.when(F.col("src") == F.col("dst"), 2).otherwise(1)).alias("degree"))


def transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, q): weights over the source's total; a source without weight moves nowhere."""
    both = symmetric(edges)
    total = both.groupBy("src").agg(F.sum("w").alias("t"))
    return both.join(total, "src").select("src", "dst", F.coalesce(F.try_divide("w", "t"), F.lit(0.0)).alias("q"))


def hierarchy(edges: DataFrame) -> DataFrame:
    """(src, dst) from child to parent, for rows of exactly the hierarchy's relation with both types known."""
    rows = edges.where((F.col("display_relation") == HIERARCHY_RELATION) & F.col("x_type").isNotNull() & F.col("y_type").isNotNull())
    return rows.select(F.col("y_index").cast("long").alias("src"), F.col("x_index").cast("long").alias("dst")).distinct()


def hierarchy_nodes(tree: DataFrame, node_table: DataFrame) -> DataFrame:
    """(index): ends of the tree's edges, and disease nodes without any."""
    return tree.selectExpr("src index").union(tree.selectExpr("dst index")).union(targets(node_table).select("index")).distinct()


def targets(node_table: DataFrame) -> DataFrame:
    return node_table.where(F.col("type").isin(TARGET_TYPES))


def pagerank(tree: DataFrame, members: DataFrame, steps: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6, n_edges: int | None = None) -> DataFrame:
    """(index, rank). Power iteration; mass of nodes without an edge out spreads evenly; stops early when the L1 change is below
    nodes x tolerance (None: never). It is a walk that starts again at any member alike: from memory for a tree of at most RANK_BYTES, as
    that comes to the driver and one task walks it, else by joins."""
    n = members.count()
    if not n:
        return members.withColumn("rank", F.lit(0.0))
    if EDGE_BYTES * ((tree.count() if n_edges is None else n_edges) + 2 * n) > RANK_BYTES:
        return pagerank_by_joins(tree, members, n, steps, damping, tolerance)
    q = tree.join(tree.groupBy("src").agg((1 / F.count("*")).alias("q")), "src")
    start = members.select(F.lit(0).alias("note"), "index", F.lit(1.0 / n).alias("prob"))
    ranks = walk_blocks(start, shared_moves(q), reached, WALKED.format("int"), steps, 1 - damping, None if tolerance is None else n * tolerance)
    return ranks.select("index", F.col("p").alias("rank"))


def pagerank_by_joins(tree: DataFrame, members: DataFrame, n: int, steps: int, damping: float, tolerance: float | None) -> DataFrame:
    """As pagerank(). Each step's ranks are checkpointed, so plans don't grow; the change and the loose mass come to the
    driver, and no side of a join."""
    out = tree.groupBy("src").agg(F.count("*").alias("out"))
    moves = tree.join(out.hint("merge"), "src").select("src", "dst", (1 / F.col("out")).alias("q")).persist()
    rank = members.join(out.select(F.col("src").alias("index"), F.lit(False).alias("dangling")).hint("merge"), "index", "left")
    rank = rank.select("index", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("was")).checkpoint()
    loose = F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0))
    mass = rank.agg(loose).first()[0]
    for _ in range(steps):
        come = moves.join(rank.hint("merge"), F.col("src") == F.col("index")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("q")).alias("come"))
        base = (1 - damping) / n + damping * mass / n
        new = rank.join(come.hint("merge"), F.col("index") == F.col("dst"), "left").select("index", "dangling", (F.lit(base) + damping * F.coalesce("come", F.lit(0.0))).alias("rank"), F.col("rank").alias("was"))
        rank = new.checkpoint()
        mass, change = rank.agg(loose, F.sum(F.abs(F.col("rank") - F.col("was")))).first()
        if tolerance is not None and change < n * tolerance:
            break
    moves.unpersist()
    return rank.select("index", "rank")


def specificity(ranks: DataFrame) -> DataFrame:
    return ranks.select("index", (-F.log("rank")).alias("specificity"))


def anchors(starts: DataFrame, node_table: DataFrame, embeddings: DataFrame, special: DataFrame) -> DataFrame:
    """(note, index, C, S, W, prob) for start nodes (note, index) that are in the graph: coherence with the centroid of the note's
    vectors, specificity, their product, and its share of the note's total (even shares if that is 0)."""
    known = starts.distinct().join(node_table.select("index", "id"), "index")
    known = known.withColumn("id", F.coalesce("id", F.col("index").cast("string")))
    known = known.join(embeddings.select(F.col("node_id").alias("id"), "vec"), "id", "left").join(special, "index", "left")
    held = known.where("vec IS NOT NULL")
    size = embeddings.agg(F.max(F.size("vec"))).first()[0] or 0
    if 0 < size <= COLUMNS:  # means by place combine before the shuffle, a row a start
        means = F.array(*(F.avg(F.get("vec", F.lit(i)).cast("double")) for i in range(size)))
        centroid = held.groupBy("note").agg(means.alias("means"), F.max(F.size("vec")).alias("size")).select("note", F.slice("means", F.lit(1), F.col("size")).alias("centroid"))
    else:
        parts = held.select("note", F.posexplode("vec").alias("at", "x"))
        centroid = parts.groupBy("note", "at").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("note").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))
    scored = known.join(centroid, "note", "left").select("note", "index", N.coherence(F.col("vec"), F.col("centroid")).alias("C"), F.coalesce("specificity", F.lit(1.0)).alias("S"))
    scored = scored.withColumn("W", N.anchor_weight(F.col("C"), F.col("S")))
    whole = Window.partitionBy("note")
    total = F.sum("W").over(whole)
    return scored.withColumn("prob", F.when(total > 0, F.col("W") / total).otherwise(1 / F.count("*").over(whole)))


def walk(q: DataFrame, start: DataFrame, steps: int = 50, restart: float = 0.2, tolerance: float | None = 1e-6) -> DataFrame:
    """(note, index, p) after at most `steps` steps from start (note, index, prob), all notes at once; a note stops when its
    L1 change is below tolerance (None: never). Mass at nodes without transitions goes back to the start.

    Notes and transitions meet by a join: the transitions, packed by target, are dealt to every task of notes, which walks its notes block by
    block. Neither the driver nor a broadcast holds the graph, a worker keeps what passes MEMORY_BYTES in files of its own that
    end with the task, and no rows are stored between steps."""
    return walk_blocks(start, q, reached, WALKED.format(dict(start.dtypes)["note"]), steps, restart, tolerance)


class Moves:
    """Transitions by target: targets of equal in-degree form one dense array, so a step of a block of notes is a few matrix products."""

    def __init__(self, ids: np.ndarray, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """parts: (src, dst, w) by places in ids, each with all that leads to its targets."""
        self.ids, self.groups, self.bytes = ids, [], 0
        self.moving = np.zeros(len(ids), bool)
        for part in parts:
            self.add(*part)

    def add(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> None:
        if not len(dst):
            return
        self.moving[src] = True
        degree = np.bincount(dst)[dst]
        order = np.lexsort((src, dst, degree))
        src, w, dst, degree = self.kept(src[order].astype(np.int32)), self.kept(w[order]), dst[order], degree[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, degree[1:] != degree[:-1]]), len(dst)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            d = degree[i]
            self.groups.append((dst[i:j:d].copy(), src[i:j].reshape(-1, d), w[i:j].reshape(-1, 1, d)))

    def kept(self, x: np.ndarray) -> np.ndarray:
        """x, or past MEMORY_BYTES its like in a file that has no name, so nothing stays behind."""
        self.bytes += x.nbytes
        if self.bytes <= MEMORY_BYTES:
            return x
        with tempfile.TemporaryFile() as f:
            x.tofile(f)
            f.flush()
            return np.memmap(f, x.dtype, "r", shape=x.shape)

    def step(self, x: np.ndarray, out: np.ndarray, share: float = 1.0) -> None:
        """Puts into out the share of what comes to each node (nodes x notes)."""
        n = x.shape[1]
        for targets, sources, weights in self.groups:
            d = sources.shape[1]
            rows = max(1, STEP_BYTES // (8 * d * n))
            buffer = np.empty((min(rows, len(targets)) * d, n))
            for i in range(0, len(targets), rows):
                at = sources[i : i + rows]
                came = np.take(x, at.ravel(), axis=0, out=buffer[: at.size], mode="clip")
                out[targets[i : i + rows]] = share * (weights[i : i + rows] @ came.reshape(len(at), d, n))[:, 0]

    def walked(self, every: np.ndarray, p0: np.ndarray, steps: int, restart: float, tolerance: float | None) -> np.ndarray:
        """Columns of p0 after their walks; every: the graph's nodes, then start nodes that aren't in it."""
        n = len(self.ids)
        stuck = np.r_[np.flatnonzero(~self.moving), np.arange(n, len(every))]
        # only start nodes get anything back, at most some of each note's
        began = np.flatnonzero(p0.any(1))
        start, live, x = p0[began], np.arange(p0.shape[1]), p0.copy()
        out, new = p0.copy(), np.empty_like(p0)
        for k in range(1, steps + 1):
            new.fill(0)
            self.step(x[:n], new[:n], 1 - restart)
            new[began] += start * ((1 - restart) * x[stuck].sum(0) + restart) if len(stuck) else start * restart
            x, new = new, x
            if tolerance is not None:
                rows = max(1, STEP_BYTES // (8 * x.shape[1]))
                done = sum(np.abs(x[i : i + rows] - new[i : i + rows]).sum(0) for i in range(0, len(x), rows)) < tolerance
                if done.any():
                    out[:, live[done]] = x[:, done]
                    live, x, start = live[~done], x[:, ~done].copy(), start[:, ~done].copy()
                    if not len(live):
                        break
                    new = np.empty_like(x)
                    continue
            if k >= FIRST_TRY and (k - FIRST_TRY) % TRY_EVERY == 0 and steps - k > TRY_EVERY and not x[stuck].any() and (few := self.few_directions(np.subtract(x, new, out=new), 1 - restart)):
                self.walked_on(x, live, out, *few, steps - k, tolerance)
                return out
        out[:, live] = x
        return out

    def few_directions(self, change: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(basis, turn, c) where a step's changes are basis @ c and those of the step after basis @ turn @ c, both but for ROUNDING, so that all
        later steps stay among a few directions; None if that isn't so."""
        q, r = np.linalg.qr(change)
        u, s, _ = np.linalg.svd(r)
        few, n = int((s > ROUNDING).sum()), len(self.ids)
        if not 0 < few <= max(1, change.shape[1] // 2):
            return None
        basis = q @ u[:, :few]
        for _ in range(CLEAN + 1):  # weak directions shed what dies out soon
            after = np.zeros_like(basis)
            self.step(np.ascontiguousarray(basis[:n]), after[:n], share)
            last, basis = basis, np.linalg.qr(after)[0]
        basis = np.ascontiguousarray(last)
        turn, c = basis.T @ after, basis.T @ change
        good = max(np.linalg.norm(change - basis @ c), np.linalg.norm((after - basis @ turn) @ c)) <= 5 * ROUNDING
        return (basis, turn, c) if good else None

    def walked_on(self, x: np.ndarray, live: np.ndarray, out: np.ndarray, basis: np.ndarray, turn: np.ndarray, c: np.ndarray, steps: int, tolerance: float | None) -> None:
        """Puts the columns of x into out as they are after the steps that are left, with the same stopping rule."""
        total = np.zeros_like(c)
        for _ in range(steps):
            c = turn @ c
            total += c
            if tolerance is None:
                continue
            rows = max(1, STEP_BYTES // (8 * x.shape[1]))
            done = sum(np.abs(basis[i : i + rows] @ c).sum(0) for i in range(0, len(x), rows)) < tolerance
            if done.any():
                out[:, live[done]] = x[:, done] + basis @ total[:, done]
                live, x, c, total = live[~done], x[:, ~done], c[:, ~done], total[:, ~done]
                if not len(live):
                    return
        out[:, live] = x + basis @ total


def fits_in_memory(n_edges: int) -> bool:
    return EDGE_BYTES * n_edges <= MEMORY_BYTES


def shared_moves(q: DataFrame) -> Callable[[], Moves]:
    """The transitions for every worker: arrays that are broadcast, of which each worker builds its Moves once."""
    rows = q.select("src", "dst", "q").toArrow()
    src, dst, w = (rows.column(i).to_numpy() for i in range(3))
    ids = np.unique(np.concatenate([src, dst])).astype(np.int64)
    arrays = ids, np.searchsorted(ids, src).astype(np.int32), np.searchsorted(ids, dst).astype(np.int32), w.astype(np.float64)
    shared, token = q.sparkSession.sparkContext.broadcast(arrays), uuid.uuid4().hex

    return partial(built_moves, token, shared)


def built_moves(token: str, shared) -> Moves:
    """This process's Moves of what is broadcast; those of an earlier graph go."""
    if token not in _built:
        _built.clear()
        ids, *part = shared.value
        _built[token] = Moves(ids, part)
    return _built[token]


def dealt_moves(q: DataFrame, tasks: int) -> DataFrame:
    """(_task, src, dst, q) for each of the tasks: q's columns as bytes, all rows of a target in one packet."""
    packets = max(1, -(-q.count() // PACKET))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := [x for x in batches if len(x)]:
            rows = pd.concat(parts)
            yield pd.DataFrame({c: [rows[c].to_numpy(t).tobytes()] for c, t in PACKED.items()})

    packed = q.select("src", "dst", "q").repartition(packets, "dst").mapInPandas(pack, "src binary, dst binary, q binary")
    return packed.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))


def unpacked(packets: list[list[bytes]]) -> Moves:
    """Moves of the packets (src, dst, q), joined to parts of about PART_BYTES; the packets go as they are used."""
    ids = np.empty(0, np.int64)
    for src, dst, _ in packets:
        ids = np.unique(np.concatenate([ids, np.frombuffer(src, np.int64), np.frombuffer(dst, np.int64)]))
    made, held, size = Moves(ids), [], 0
    while packets:
        held.append([np.frombuffer(x, t) for x, t in zip(packets.pop(), PACKED.values(), strict=True)])
        size += sum(x.nbytes for x in held[-1])
        if size > PART_BYTES or not packets:
            src, dst, w = (np.concatenate(x) for x in zip(*held, strict=True))
            made.add(np.searchsorted(ids, src), np.searchsorted(ids, dst), w)
            held, size = [], 0
    return made


def walk_blocks(starts: DataFrame, moves: Callable[[], Moves] | DataFrame, finish: Callable, schema: str, steps: int, restart: float, tolerance: float | None) -> DataFrame:
    """Walks for blocks of about NOTES notes, fewer where the columns of a block would pass BLOCK_BYTES, which a task reads in order of notes.
    starts (note, index, prob, and more) may have rows without prob, which start nothing. moves: transitions that are
    broadcast, or (src, dst, q), which are dealt to all tasks. finish(rows, notes, every, p) makes the block's result from its rows,
    notes, nodes (in rising order but for start nodes outside the graph, which come last) and probabilities (nodes x notes)."""

    shared = moves if callable(moves) else None

    def block(matrix: Moves, rows: pd.DataFrame) -> pd.DataFrame:
        notes = np.unique(rows["note"].to_numpy())
        began = rows[rows["prob"].notna()]
        index = began["index"].to_numpy(np.int64)
        every = np.concatenate([matrix.ids, np.setdiff1d(index, matrix.ids)])
        p0 = np.zeros((len(every), len(notes)))
        np.add.at(p0, (places(every, index), np.searchsorted(notes, began["note"].to_numpy())), began["prob"].to_numpy(np.float64))
        return finish(rows, notes, every, matrix.walked(every, p0, steps, restart, tolerance))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, matrix, packets = pd.DataFrame(), None, []
        for batch in batches:
            if "_task" in batch:  # packets come first
                packets += batch.loc[batch["dst"].notna(), list(PACKED)].values.tolist()
                batch = batch[batch["dst"].isna()].drop(columns=["_task", *PACKED]).rename(columns={"_index": "index"})
            if not len(batch):
                continue
            matrix = matrix or (shared() if shared else unpacked(packets))
            most = max(1, min(NOTES, BLOCK_BYTES // (8 * max(1, len(matrix.ids)))))
            held = pd.concat([held, batch]) if len(held) else batch
            while len(notes := held["note"].unique()) > 2 * most:
                whole = held["note"].isin(notes[:most])
                yield block(matrix, held[whole])
                held = held[~whole]
        if len(held):
            notes = held["note"].unique()
            for part in np.array_split(notes, max(1, round(len(notes) / most))):
                yield block(matrix, held[held["note"].isin(part)])

    # dealt by a number of its own: rows are few, and the work isn't in proportion to their bytes
    notes, slots = starts.select("note").distinct().count(), starts.sparkSession.sparkContext.defaultParallelism
    if callable(moves):
        tasks = max(1, min(-(-notes // LEAST_NOTES), 4 * slots))
        return starts.repartition(tasks, "note").sortWithinPartitions("note").mapInPandas(run, schema)
    tasks = max(1, min(-(-notes // LEAST_NOTES), 2 * slots))
    rows = starts.withColumn("_task", F.pmod(F.xxhash64("note"), F.lit(tasks)).cast("int")).withColumnRenamed("index", "_index")
    both = rows.unionByName(dealt_moves(moves, tasks), allowMissingColumns=True)
    return both.repartitionById(tasks, "_task").sortWithinPartitions(F.col("dst").isNull(), "note").mapInPandas(run, schema)


def places(every: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Where each index is in every, -1 where it isn't."""
    order = np.argsort(every, kind="stable")
    at = np.minimum(np.searchsorted(every, index, sorter=order), len(every) - 1) if len(every) else np.zeros(len(index), np.int64)
    return np.where(every[order[at]] == index, order[at], -1) if len(every) else at - 1


WALKED = "note {}, index long, p double"


def reached(rows: pd.DataFrame, notes: np.ndarray, every: np.ndarray, p: np.ndarray) -> pd.DataFrame:
    """Every node that a note reaches."""
    column, node = np.nonzero(p.T)
    return pd.DataFrame({"note": notes[column], "index": every[node], "p": p[node, column]})


def walk_in_memory(q: DataFrame, start: DataFrame, steps: int = 50, restart: float = 0.2, tolerance: float | None = 1e-6, n_edges: int | None = None) -> DataFrame:
    """As walk(), blocks of notes at a time over a broadcast matrix. A graph whose arrays pass MEMORY_BYTES goes by a join,
    with the same rule. Puts out every node that a note reaches; expansion.scored() keeps what a run needs."""
    if not fits_in_memory(q.count() if n_edges is None else n_edges):
        return walk(q, start, steps, restart, tolerance)

    return walk_blocks(start, shared_moves(q), reached, WALKED.format(dict(start.dtypes)["note"]), steps, restart, tolerance)


def share_below(scores: DataFrame, group: str, score: str) -> DataFrame:
    """Adds the share of the group's rows that are strictly lower."""
    lower = F.rank().over(Window.partitionBy(group).orderBy(score)) - 1
    return scores.withColumn("share_below", lower / F.count("*").over(Window.partitionBy(group)))


