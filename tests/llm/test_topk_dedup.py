import random
from collections import Counter

import numpy as np

from surestat.llm import dedup, topk


def brute_topk(rows, k=20):
    out = []
    for i, q in rows:
        if i is not None and i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if j is not None and j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return Counter(out)


def test_threshold_search_equals_brute_force(spark):
    pick = random.Random(5)
    # few values make many ties; one vector is very common
    rows = [(i, [pick.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)] if i % 3 else [0.5] * 6) for i in range(700)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = topk.quantised(docs)
    got = topk.search(q.where("id % 20 = 0"), q, block=128, query_block=16).collect()
    assert Counter(map(tuple, got)) == brute_topk([(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows])


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-3.0, 0.1]), (None, [1.0, 1.0]), (6, []), (7, [1.0]), (20, [0.0, 0.0])]
    q = topk.quantised(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, id int"))
    got = Counter(map(tuple, topk.search(q.where("id % 20 = 0"), q).collect()))
    assert got == brute_topk([(0, [64, 128]), (5, [-192, 6]), (7, [64]), (20, [0, 0])])
    none = q.where("id < 0")
    assert topk.search(none, none).count() == 0


def test_large_components_are_exact(spark):
    """Sums of up to 2^52 in floats, up to 2^62 in 64 bits, and beyond; scores out of range are the nearest long, and ties."""
    for top in (2**20, 2**28, 2**40):
        rows = [(i, [float(top + i), -float(2 * top - 3 * i), 5.0]) for i in range(0, 60, 5)]
        q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), factor=1)
        got = Counter(map(tuple, topk.search(q.where("id % 20 = 0"), q, k=3).collect()))
        exact = {i: [int(x) for x in v] for i, v in rows}
        want = []
        for i in exact:
            if i % 20 == 0:
                best = sorted((-min(sum(a * b for a, b in zip(exact[i], v, strict=True)), 2**63 - 1), j) for j, v in exact.items() if j != i)[:3]
                want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
        assert got == Counter(want)
        assert (max(s for *_, s in got) == 2**63 - 1) == (top == 2**40)


def brute_walk(ids, rows, query_id, q, k):
    return [(-s, i) for s, i in sorted((-int(v @ q), int(i)) for i, v in zip(ids, rows, strict=True) if i != query_id)[:k]]


def test_walks_stop_early_on_skewed_vectors():
    """Few rows have a great component in the query's dimensions; others can't reach the k-th score, and aren't met."""
    pick = np.random.default_rng(3)
    n, dims, k = 4000, 16, 20
    rows = np.floor(64 * pick.pareto(2.5, (n, dims)) * pick.choice([-1, 1], (n, dims)) / 8).astype(np.float64)
    block = topk.Block(np.arange(n), rows)
    stops, accesses = 0, []
    for i in range(60):
        q = np.where(np.arange(dims) % 5 == i % 5, rows[i], 0.0)
        walk = block.threshold_search(i, q, k)
        assert walk.best == brute_walk(np.arange(n), rows, i, q, k)
        assert walk.random_accesses <= min(n - 1, walk.sorted_accesses) and walk.stopped == (walk.random_accesses < n - 1)
        stops += walk.stopped
        accesses.append(walk.random_accesses / n)
    assert stops >= 55 and np.median(accesses) < 0.5


def test_walks_over_ties_zeros_and_negative_scores():
    pick = np.random.default_rng(4)
    for n in (1, 2, 25, 300):
        rows = pick.integers(-2, 3, (n, 5)).astype(np.float64)
        rows[: n // 2] = rows[0]
        block = topk.Block(np.arange(n) * 3, rows)
        for q in (np.zeros(5), np.array([1.0, 0, 0, 0, 0]), -np.ones(5), rows[n // 2], np.array([-2.0, 1, 0, 0, 2])):
            for k in (1, 3, 20):
                assert block.threshold_search(0, q, k).best == brute_walk(np.arange(n) * 3, rows, 0, q, k)
        worst = topk.Block(np.arange(n), -np.abs(rows) - 1)  # all scores are negative
        assert worst.threshold_search(-1, np.ones(5), 4).best == brute_walk(np.arange(n), -np.abs(rows) - 1, -1, np.ones(5), 4)


def brute_components(rows, k):
    """component of each row by comparing all pairs of sets."""
    sets = []
    for i, t in rows:
        w = bytes((t or "").encode()).lower().split()
        sets.append((i, frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y in range(x):
            j, b = sets[y]
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
                up[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return Counter((i, len(s), low.get(root(x)) if i is not None else None) for x, (i, s) in enumerate(sets))


def near_copies(seed):
    pick = random.Random(seed)
    word = lambda: f"w{pick.randint(0, 400)}"
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(pick.randint(3, 120))]
        for _ in range(pick.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(pick.randint(0, max(1, len(copy) // 12))):
                copy[pick.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
            base = copy if pick.random() < 0.5 else base  # chains, not only stars
    pick.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = near_copies(1) + [(900, "one"), (901, "one"), (902, "one two"), (903, "ONE  Two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        got = dedup.components(docs, k=k).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_messy_rows(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = dedup.components(messy, k=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)
    assert all(r.kept for r in got if r.doc_id is None)
    assert dedup.components(empty, k=2).count() == 0


def test_signatures_estimate_similarity_and_stop_early():
    pick = np.random.default_rng(6)
    a = np.unique(pick.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:2400], pick.integers(0, 2**63, 600).astype(np.uint64)]))
    x, y, alone = dedup.super_minhash([a, b, a[:3]])
    assert abs((x == y).mean() - 2400 / 3600) < 0.15
    assert x.max() < 2 << 32 and (dedup.super_minhash([a])[0] == x).all() and len(alone) == dedup.POSITIONS
    # a set larger than what is held at once
    big = np.unique(pick.integers(0, 2**63, 3 * dedup.ELEMENTS).astype(np.uint64))
    parts = np.minimum(dedup.super_minhash([big[: len(big) // 2]]), dedup.super_minhash([big[len(big) // 2 :]]))
    assert (dedup.super_minhash([big]) == parts).all()


def test_long_chains_are_one_group(spark):
    order = list(range(300))
    random.Random(7).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299)] + [(1000, 1001)], "a long, b long").repartition(7)
    assert {(r.doc, r.component) for r in dedup.grouped(edges).collect()} == {(i, 0) for i in range(1, 300)} | {(1001, 1000)}


def test_large_buckets_in_blocks_join_what_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_BYTES", 1_500)  # three sets or so
    pick = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(40):  # a chain of edits: far ends differ, neighbours are alike
        base = list(base)
        base[pick.randrange(60)] = f"x{n}"
        rows.append((n, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = dedup.set_rows(docs.toDF("node", "text"), 2)
    members = docs.selectExpr("1L bucket", "doc_id node", "59L n", "59L o", "doc_id c")
    got = {tuple(r) for r in dedup.compared_in_blocks(members, sets, 80).collect()}
    w = {i: set(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
    want = {(i, j) for i in w for j in w if i < j and 100 * len(w[i] & w[j]) >= 80 * len(w[i] | w[j])}
    assert got == want
    monkeypatch.setattr(dedup, "FEW", 1)
    found = dedup.components(docs, k=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 2)
