"""Hand-worked cases and properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surestat import models
from surestat.config import Parity, Settings
from surestat.functions import numeric as N
from surestat.functions import text as T
from surestat.operators import evaluate, expansion, fusion, graph, linking, sampling, tokens
from surestat.plans import runs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


# ---- text

def test_plain_sections_stop_at_anything_like_a_heading(spark):
    cut = lambda t, s=False: one(spark, T.without_plain_sections(F.col("t"), s), t=t)
    assert cut("CC: pain\nPAST MEDICAL HISTORY: dm2\nhtn\nmore text\nplan: home\nEND") == "CC: pain\n\nhtn\nmore text\nplan: home\nEND"
    assert cut("A: x\nPAST MEDICAL HISTORY: dm2\nhtn\n") == "A: x\n\n"
    assert cut("HOSPITAL COURSE: long. 1\n") != cut("HOSPITAL COURSE: long. 1\n", True)


def test_hospital_sections_stop_at_known_headings(spark):
    cut = lambda t: one(spark, T.without_hospital_sections(F.col("t")), t=t)
    assert cut("HPI: x\nPMH: dm2\nother: y\nAllergies: none\n") == "HPI: x\n\nAllergies: none\n"
    assert cut("Social History: none 1\nfoo: bar") == "\n"


def test_slicing_at_the_exam(spark):
    t = "HPI: x\n Physical Exam: ok\nPertinent Results: y"
    assert one(spark, T.sliced_at_exam(F.col("t")), t=t) == "HPI: x"
    assert one(spark, T.sliced_at_exam(F.col("t")), t="a\nPE without colon") == "a\nPE without colon"
    results = "HPI: x\nPertinent Results: y"
    sliced = Settings(mode="sliced", parity=Parity(step1_slice=True))
    assert one(spark, T.prepared_note(F.col("t"), sliced, True), t=results) == results
    assert one(spark, T.prepared_note(F.col("t"), sliced), t=results) == "HPI: x"


@pytest.mark.parametrize(
    ("reply", "found"),
    [('```json\n["A (x)", 1]\n```', ["A", "1"]), ('text ["B"] tail', ["B"]), ('{"a": 1}', []), ("garbage", []), ("", []), ('["A", null]', ["A", None]), ("3", [])],
)
def test_json_entities(spark, reply, found):
    assert one(spark, T.json_entities(F.col("t")), t=reply) == found


def test_list_names(spark):
    t = "- Foo (bar)\n* Baz [x\n12) Qux\n-X\nplain\n1. 'Due' \n• Sepsis due to UTI"
    assert [r["name"] for r in one(spark, T.list_names(F.col("t")), t=t)] == ["Foo", "Baz", "Qux", "Due", "Sepsis due to UTI"]
    assert one(spark, T.without_explanation(F.col("t")), t="Sepsis due to UTI") == "Sepsis"
    assert one(spark, T.without_bullet(F.col("t")), t="- tuberculosis") == "tuberculosis"
    assert one(spark, T.without_bullet(F.col("t"), True), t="- tuberculosis") == "uberculosis"


def test_last_tokens_and_answers(spark):
    assert one(spark, T.last_tokens(F.col("t"), 2), t=["a", "b", "c"]) == ["b", "c"]
    assert one(spark, T.last_tokens(F.col("t"), 5), t=["a"]) == ["a"]
    assert one(spark, T.matched_answer(F.lit("'gout'"), F.col("t"), F.lit("x")), t=["Gout", "Flu"]) == "Gout"
    assert one(spark, T.matched_answer(F.lit("none"), F.col("t"), F.lit("x")), t=["Gout"]) == "x"


def test_token_lists():
    assert tokens.listed(["-", " ", "Flu", " due", " to", " x", "\n", "- ", "flu", "\n", "2", ".", " Gout", " (", "a", ")", "\n", "word", "\n", "- ", "ab"]) == [("Flu", 2, 5), ("Gout", 12, 14)]
    assert tokens.listed(["- ", "Note", ": x", "\n", "- ", "Gout"]) == []
    assert tokens.listed(["- ", "\n", "Gout"]) == [("Gout", 2, 2)]  # the search for a letter goes on in the next line
    assert tokens.listed(["- ", "tuberculosis"], True) == [("uberculosis", 1, 1)]
    assert tokens.listed([]) == []


# ---- sampling

def samples(spark, rows):
    return spark.createDataFrame([(1, s, i, d) for i, (s, d) in enumerate(rows)], "index long, sample_id int, ord long, disease string")


def test_frequency_of_clusters(spark):
    rows = samples(spark, [(0, "Flu"), (0, "flu"), (1, "FLU"), (1, "Gout")])
    for f in (sampling.casefold_clusters, sampling.leader_clusters):
        assert {(r.disease, r.uq) for r in f(rows, num_samples=2).collect()} == {("Flu", 1.0), ("Gout", 0.5)}
    floor = spark.createDataFrame([(1, "a", 0.05), (1, "b", 0.06)], "index long, disease string, uq double")
    assert [r.disease for r in sampling.above_floor(floor).collect()] == ["b"]


def test_leader_clustering_depends_on_order(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "index long, a string, b string")
    sizes = lambda names: sorted(round(r.uq * 3) for r in sampling.leader_clusters(samples(spark, list(enumerate(names))), pairs, 3).collect())
    assert sizes("ABC") == [1, 2] and sizes("BAC") == [3]


@given(st.lists(st.sampled_from("abcABC"), max_size=12))
def test_leaders_partition_their_input(names):
    leaders = sampling.leader_of(names, lambda a, b: {a.lower(), b.lower()} == {"a", "b"})
    assert all(leaders[x] == x for x in set(leaders)) and all(x <= i for i, x in enumerate(leaders))


def test_entailment_is_either_direction(spark):
    rows = spark.createDataFrame([(0.9, 0.1), (0.9, 0.9), (0.5, 0.5)], "forward double, backward double")
    assert sampling.entailed_pairs(rows).count() == 2 and sampling.entailed_pairs(rows, "both").count() == 1


# ---- scores

def test_token_scores(spark):
    r = tokens.confidence(spark.createDataFrame([(1, 0.5, 1.0), (1, 0.125, 3.0)], "i int, prob double, entropy double"), "i").first()
    assert [round(x, 5) for x in r[1:]] == [0.25, 0.0625, -2.0, -0.69315, -2.07944]
    r = tokens.claim_probability(spark.createDataFrame([(1, 0.5, True), (1, 0.3, False), (1, 0.2, True)], "i int, prob double, entailed boolean"), "i").first()
    assert math.isclose(r.uq_ccp, 0.7)


@pytest.mark.parametrize(("values", "scaled"), [([0.2, 0.6, 1.0], [0, 0.5, 1]), ([0.4], [1]), ([0.0, 0.2, 0.6], [0, 0, 1]), ([0.0, None], [0, 0])])
def test_min_max(spark, values, scaled):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "index int, i int, s double")
    assert [round(r.kg_only, 9) for r in fusion.min_max_local(rows, "index", "s").orderBy("i").collect()] == scaled


def test_fusion(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 1.0), (1, "b", 0.5, 0.0), (1, "c", 0.005, 0.5)], "index int, disease string, uq_pure double, kg_only double").withColumns({"is_expanded": F.lit(False), "tf_logits_expanded": F.lit(0.0)})
    got = {r.disease: r.uq_rrf for r in fusion.reciprocal_rank(rows).collect()}
    assert all(math.isclose(got[k], v) for k, v in {"a": 2 / 11, "b": 1 / 12, "c": 1 / 13}.items())
    fused = {r.disease: (r.kg_only, r.uq_kg) for r in fusion.linear(rows).collect()}
    assert fused["c"] == (0.0, 0.75 * 0.005)
    assert math.isclose(one(spark, N.fused(F.lit(1.0), F.lit(0.4), 0.25)), 0.55)


def test_rounds_of_leaders_equal_the_sequential_fold(spark):
    """Entailment that isn't transitive, so that order matters."""
    pick = random.Random(2)
    names = [f"name {c}" for c in "abcdefghij"]
    alike = {frozenset(x) for x in (("name a", "name c"), ("name c", "name e"), ("name b", "name e"), ("name f", "name a"), ("name g", "name j"), ("name d", "name c"))}
    rows = [(n, s, o, pick.choice([str.upper, str.title, str])(pick.choice(names))) for n in range(6) for s in range(5) for o in range(3)]
    samples = spark.createDataFrame(rows, "index long, sample_id int, ord long, disease string")
    low = lambda c: F.lower(F.trim(c))
    known = spark.createDataFrame([tuple(sorted(x)) for x in alike], "a string, b string")
    asked = []

    def judge(pairs):
        asked.append(pairs.count())
        ends = pairs.withColumn("a", F.least(low("leader"), low("name"))).withColumn("b", F.greatest(low("leader"), low("name")))
        return ends.join(known, ["a", "b"], "left_semi")

    want = sampling.leader_clusters(samples, sampling.name_pairs(samples).join(known, ["a", "b"], "left_semi").select("index", "a", "b"), 5)
    got = sampling.clusters_by_rounds(samples, judge, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(asked) < sampling.name_pairs(samples).count()
    empty = samples.where("false")
    assert sampling.clusters_by_rounds(empty, lambda p: p, 5).count() == 0


# ---- graph

def test_last_weight_of_an_edge_wins(spark):
    rows = [(1.0, "P1", "disease", "A", 2.0, "P2", "drug", "B", "Phenotype Present", 1), (2.0, "P2", "drug", "B", 1.0, "P1", "disease", "A", "target", 2), (None, "", "", "", 2.0, "", "", "", "target", 3), (1.0, "P1", "disease", "late", 3.0, "P3", "disease", None, "other", 4)]
    edges = spark.createDataFrame(rows, "x_index double, x_id string, x_type string, x_name string, y_index double, y_id string, y_type string, y_name string, display_relation string, ord long")
    good = graph.valid_edges(edges)
    assert [tuple(r) for r in graph.weighted_edges(good).collect()] == [(1, 2, 1.0)]
    assert {(r["index"], r.name) for r in graph.nodes(good).collect()} == {(1, "a"), (2, "b")}
    loop = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "a long, b long, w double")
    assert {(r["index"], r.weighted, r.degree) for r in graph.degrees(loop).collect()} == {(1, 3.0, 3), (2, 1.0, 1)}


def test_walks(spark):
    q = graph.transitions(spark.createDataFrame([(1, 2, 1.0)], "a long, b long, w double"))
    start = spark.createDataFrame([(7, 1, 1.0), (8, 9, 1.0)], "note long, index long, prob double")
    for steps, expected in ((1, {1: 0.2, 2: 0.8}), (2, {1: 0.84, 2: 0.16}), (50, {1: 5 / 9, 2: 4 / 9})):
        for f in (lambda: graph.walk_in_memory(q, start, steps), lambda: graph.walk(q, start, min(steps, 8))):
            got = f().collect()
            assert math.isclose(sum(r.p for r in got if r.note == 7), 1.0)
            if steps < 9:
                assert all(math.isclose(r.p, expected[r["index"]]) for r in got if r.note == 7)
            assert [(r["index"], round(r.p, 9)) for r in got if r.note == 8 and r.p > 0] == [(9, 1.0)]
    at_cap = {r["index"]: r.p for r in graph.walk_in_memory(q, start, 50).collect() if r.note == 7}
    assert 1e-6 < abs(at_cap[1] - 5 / 9) < 1e-4  # the cap binds before the tolerance
    assert math.isclose(one(spark, N.hub_penalised(N.bias_corrected(F.lit(0.84), F.lit(1.0), 0.2), F.lit(1))), 0.64 / math.log10(11))


def test_pagerank_sums_to_one(spark):
    tree = spark.createDataFrame([(2, 1), (3, 1), (4, 2)], "src long, dst long")
    members = spark.createDataFrame([(i,) for i in range(1, 6)], "index long")
    ranks = {r["index"]: r["rank"] for r in graph.pagerank(tree, members, 12, tolerance=None).collect()}
    assert math.isclose(sum(ranks.values()), 1.0) and max(ranks, key=ranks.get) == 1


def test_pagerank_stops_where_the_change_is_small(spark):
    tree = spark.createDataFrame([(i, i // 3) for i in range(3, 60)], "src long, dst long")
    members = spark.createDataFrame([(i,) for i in range(1, 62)], "index long")
    get = lambda *a, **b: {r["index"]: r["rank"] for r in graph.pagerank(tree, members, *a, **b).collect()}
    src, dst, n = np.array([i - 1 for i in range(3, 60)]), np.array([i // 3 - 1 for i in range(3, 60)]), 61
    loose = np.setdiff1d(np.arange(n), src)
    x, k = np.full(n, 1 / n), 0
    for k in range(1, 101):
        new = 0.15 / n + 0.85 * (np.bincount(dst, x[src], n) + x[loose].sum() / n)
        change, x = np.abs(new - x).sum(), new
        if change < n * 1e-6:
            break
    assert 3 < k < 100
    for got in (get(100), get(100, n_edges=10**12)):
        assert len(got) == n and all(math.isclose(got[i + 1], x[i], rel_tol=1e-12) for i in range(n))


def test_pagerank_of_a_larger_tree_stays_off_the_driver(spark, monkeypatch):
    tree = spark.createDataFrame([(2, 1), (3, 1), (4, 2)], "src long, dst long")
    members = spark.createDataFrame([(i,) for i in range(1, 6)], "index long")
    want = {r["index"]: r["rank"] for r in graph.pagerank(tree, members, 12).collect()}
    monkeypatch.setattr(graph, "shared_moves", lambda q: pytest.fail("the tree comes to the driver"))
    got = {r["index"]: r["rank"] for r in graph.pagerank(tree, members, 12, n_edges=1_000_000).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want)


def test_best_columns_equal_a_full_sort_without_one(monkeypatch):
    pick = np.random.default_rng(5)
    y = pick.normal(size=(1000, 8))
    y[700:900] = y[:200]  # ties
    y[33] = np.nan
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    x = np.concatenate([y[:60], y[650:720]])
    monkeypatch.setattr(linking, "ROWS", 50)
    sim = np.array([[(a * b).sum() for b in y] for a in x])
    want = np.argsort(-sim, axis=1, kind="stable")[:, :5]
    sort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *b, **c: pytest.fail("sorts all") if np.size(a) > 9999 else sort(a, *b, **c))
    row, at, good = (np.concatenate(t) for t in zip(*(linking.best_columns(x, y, 5, i) for i in range(0, len(x), 50)), strict=True))
    assert (row.reshape(-1, 5) == np.arange(len(x))[:, None]).all() and (at.reshape(-1, 5) == want).all()
    assert np.array_equal(good.reshape(-1, 5), np.take_along_axis(sim, want, 1), equal_nan=True)


def test_centroids_need_no_row_for_each_component(spark, monkeypatch):
    starts = spark.createDataFrame([(n, i) for n in range(4) for i in range(n, n + 4)] + [(9, 3)], "note long, index long")
    nodes = spark.createDataFrame([(i, f"P{i}") for i in range(8)], "index long, id string")
    vectors = spark.createDataFrame([(f"P{i}", [float(i), 1.0 - i, None if i == 2 else 0.5][: 2 if i == 3 else 3]) for i in range(1, 7)], "node_id string, vec array<float>")
    special = spark.createDataFrame([(i, 1.0 + i) for i in range(5)], "index long, specificity double")
    get = lambda: {(r.note, r["index"]): tuple(round(x, 12) for x in (r.C, r.S, r.W, r.prob)) for r in graph.anchors(starts, nodes, vectors, special).collect()}
    monkeypatch.setattr(graph, "COLUMNS", 0)
    rows = get()
    monkeypatch.undo()
    monkeypatch.setattr(F, "posexplode", lambda *a: pytest.fail("a row for each component"))
    assert get() == rows and len(rows) == 17 and len({x[0] for x in rows.values()}) > 3


def random_graph(spark, seed, nodes=40):
    pick = np.random.default_rng(seed)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in pick.integers(0, nodes, (90, 2))}
    edges = spark.createDataFrame([(a * 10, b * 10, float(pick.choice([1, 3, 5]))) for a, b in sorted(pairs)], "a long, b long, w double").persist()
    starts = []
    for note in range(9):
        own = pick.choice(nodes + 5, pick.integers(1, 6), replace=False)
        starts += [(note, int(i) * 10, 1 / len(own)) for i in own]  # some aren't in the graph
    return edges, spark.createDataFrame(starts, "note long, index long, prob double").persist()


@pytest.mark.parametrize("tolerance", [None, 0.05, 0.1])
def test_both_forms_of_the_walk_agree_and_stop_note_by_note(spark, monkeypatch, tolerance):
    edges, starts = random_graph(spark, 1)
    q = graph.transitions(edges)
    monkeypatch.setattr(graph, "NOTES", 4)
    monkeypatch.setattr(graph, "STEP_BYTES", 256)
    memory = {(r.note, r["index"]): r.p for r in graph.walk_in_memory(q, starts, 9, 0.2, tolerance).collect()}
    joins = {(r.note, r["index"]): r.p for r in graph.walk_in_memory(q, starts, 9, 0.2, tolerance, n_edges=10**12).collect()}
    assert memory.keys() == joins.keys() and all(math.isclose(memory[x], joins[x], rel_tol=1e-9) for x in memory)
    dense = np.zeros((45, 45))
    for r in q.collect():
        dense[r.src // 10, r.dst // 10] = r.q
    taken = set()
    for note in range(9):
        p0 = np.zeros(45)
        for r in starts.where(F.col("note") == note).collect():
            p0[r["index"] // 10] += r.prob
        x = p0
        for k in range(1, 10):
            new = 0.8 * (x @ dense + x[dense.sum(1) == 0].sum() * p0) + 0.2 * p0
            change, x = np.abs(new - x).sum(), new
            if tolerance is not None and change < tolerance:
                break
        taken.add(k)
        assert all(math.isclose(memory.get((note, i * 10), 0.0), x[i], rel_tol=1e-9, abs_tol=1e-15) for i in range(45))
    assert len(taken) > 1 or tolerance is None


def test_the_walk_by_joins_stores_no_rows_between_steps(spark, monkeypatch):
    edges, starts = random_graph(spark, 1)
    q = graph.transitions(edges)
    memory = {(r.note, r["index"]): r.p for r in graph.walk_in_memory(q, starts, 30, 0.2, None).collect()}
    monkeypatch.setattr(type(q), "checkpoint", lambda *a: pytest.fail("a step's rows are notes x nodes"))
    monkeypatch.setattr(graph, "PACKET", 20)
    joins = {(r.note, r["index"]): r.p for r in graph.walk(q, starts, 30, 0.2, None).collect()}
    assert memory.keys() == joins.keys() and all(math.isclose(memory[x], joins[x], rel_tol=1e-12) for x in memory)


@pytest.mark.parametrize("tolerance", [None, 1e-4, 1e-6])
def test_late_steps_of_a_block_take_a_few_directions(monkeypatch, tolerance):
    pick = np.random.default_rng(3)
    dense = np.kron(np.ones((2, 2)) - np.eye(2), pick.random((150, 150)) < 0.5) * 1.0  # two sides, as parts and suppliers
    dense = np.triu(dense) + np.triu(dense).T
    dense /= dense.sum(1, keepdims=True)
    src, dst = np.nonzero(dense)
    p0 = np.where(pick.random((300, 20)) < 0.1, pick.random((300, 20)), 0)
    p0 /= p0.sum(0)
    moves, full, step = graph.Moves(np.arange(300), (src, dst, dense[src, dst])), [], graph.Moves.step
    monkeypatch.setattr(graph.Moves, "step", lambda self, x, *a: (full.append(x.shape[1]), step(self, x, *a)))
    got = moves.walked(np.arange(300), p0, 50, 0.2, tolerance)
    for j in range(20):
        x = p0[:, j]
        for _ in range(50):
            new = 0.8 * (x @ dense) + 0.2 * p0[:, j]
            change, x = np.abs(new - x).sum(), new
            if tolerance is not None and change < tolerance:
                break
        assert np.abs(got[:, j] - x).max() < 1e-15
    assert sum(n > 10 for n in full) < 30


def test_transitions_past_the_memory_go_to_files(monkeypatch):
    pick = np.random.default_rng(4)
    src, dst, w = pick.integers(0, 50, 400), pick.integers(0, 50, 400), pick.random(400)
    x, want, out = pick.random((50, 3)), np.zeros((50, 3)), np.zeros((50, 3))
    np.add.at(want, dst, w[:, None] * x[src])
    packets = [[src[part].tobytes(), dst[part].tobytes(), w[part].tobytes()] for part in (dst < 20, dst >= 20)]
    monkeypatch.setattr(graph, "MEMORY_BYTES", 1000)
    monkeypatch.setattr(graph, "PART_BYTES", 10)
    moves = graph.unpacked(packets)
    moves.step(x[moves.ids], half := np.zeros((len(moves.ids), 3)))
    out[moves.ids] = half
    assert any(isinstance(g[1].base, np.memmap) or isinstance(g[1], np.memmap) for g in moves.groups) and np.allclose(out, want, rtol=1e-12)


def test_scores_of_blocks_equal_those_by_joins(spark, monkeypatch):
    edges, starts = random_graph(spark, 2)
    monkeypatch.setattr(graph, "NOTES", 4)
    q, degrees = graph.transitions(edges), graph.degrees(edges)
    targets = spark.range(0, 400, 20).select(F.col("id").alias("index"))
    made = starts.where("index % 3 = 0").select("note", "index").union(spark.createDataFrame([(0, None), (0, 10), (99, 20)], "note long, index long"))
    settings = Settings(walk_steps=7, top_k_kg=3)
    get = lambda n: {(r.note, r["index"]): (r["rank"], round(r.raw, 12), round(r.score, 12)) for r in expansion.scored(q, starts, degrees, targets, made, settings, n).collect()}
    memory, joins = get(None), get(10**12)
    assert memory == joins and any(r[0] is None for r in memory.values()) and {r[0] for r in memory.values()} == {None, 1, 2, 3}


def test_expansion_cuts_before_it_filters(spark):
    """Of targets 1 to 5, 1 is generated; 2, 3 and 4 are the cut to three, of which the threshold and names leave one."""
    scores = spark.createDataFrame([(1, 1, 0.0, 0.65, None), (1, 2, 0.0, 0.8, 1), (1, 3, 0.0, 0.7, 2), (1, 4, 0.0, 0.66, 3)], "note long, index long, raw double, score double, rank int")
    nodes = spark.createDataFrame([(1, "flu"), (2, "gout (x)"), (3, "Gout"), (4, "ok"), (5, "low")], "index long, name string")
    made = spark.createDataFrame([(1, 1, "influenza"), (1, None, "ok")], "note long, index long, disease string")
    limits = expansion.thresholds(scores.where("rank IS NULL"))
    assert [r.threshold for r in limits.collect()] == [0.65]
    got = expansion.candidates(scores, made, limits, nodes).collect()
    assert [(r["index"], r.disease) for r in got] == [(2, "gout")]


# ---- evaluation

def metric_rows(spark, gains, scores):
    rows = [(1, "m", f"i{k}", float(g), float(s), True, True) for k, (g, s) in enumerate(zip(gains, scores, strict=True))]
    return spark.createDataFrame(rows, "index long, method string, item string, gain double, score double, predicted boolean, in_reference boolean")


def test_ndcg_and_tau(spark):
    rows = metric_rows(spark, (0.9, 0.5, 0), (0.1, 0.8, 0.8))
    assert round(evaluate.ndcg(rows).first().ndcg_5, 5) == 0.70568
    assert math.isclose(evaluate.kendall_tau_b(rows).first().kendall_tau_b, -2 / math.sqrt(6))
    assert evaluate.kendall_tau_b(metric_rows(spark, (1, 2), (3, 3))).first().kendall_tau_b == 0
    assert evaluate.ndcg(metric_rows(spark, (0, 0), (1, 2))).first().ndcg_5 == 0
    assert evaluate.judged(metric_rows(spark, (1,), (1,))).count() == 0


def test_positions_and_overlap(spark):
    schema = "index long, method string, item string, gain double, score double, predicted boolean, in_reference boolean"
    rows = evaluate.ranked(spark.createDataFrame([(1, "m", "a", 1.0, 0.9, True, True), (1, "m", "b", 0.5, 0.0, False, True), (1, "m", "c", 0.2, 0.0, False, True), (1, "m", "x", 0.0, 0.5, True, False)], schema))
    r = evaluate.positional(rows).first()
    assert (r.mrr, r.precision_5) == (1.0, 0.5) and math.isclose(r.recall_5, 1 / 3)
    swapped = evaluate.ranked(spark.createDataFrame([(1, "m", "a", 0.9, 0.1, True, True), (1, "m", "b", 0.1, 0.9, True, True)], schema))
    assert math.isclose(evaluate.rank_biased_overlap(swapped).first().rbo, 0.09)
    none = evaluate.ranked(spark.createDataFrame([(1, "m", "a", 0.9, 0.1, False, True)], schema))
    assert evaluate.rank_biased_overlap(none).first().rbo == 0 and evaluate.positional(none).first().mrr == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.booleans(), st.booleans()), min_size=2, max_size=8))
def test_metrics_stay_in_their_range(spark, rows):
    schema = "index long, method string, item string, gain double, score double, predicted boolean, in_reference boolean"
    data = spark.createDataFrame([(1, "m", f"i{k}", g * r / 3, s / 3, p, r) for k, (g, s, p, r) in enumerate(rows)], schema)
    order = evaluate.ranked(data)
    for frame in (evaluate.ndcg(data), evaluate.positional(order), evaluate.rank_biased_overlap(order)):
        assert all(-1e-12 <= x <= 1 + 1e-12 for r in frame.collect() for x in r[2:])
    back = data.withColumn("score", -F.col("score"))
    assert math.isclose(evaluate.kendall_tau_b(data).first()[2], -evaluate.kendall_tau_b(back).first()[2], abs_tol=1e-12)


def test_summary_of_one_note_has_no_deviation(spark):
    got = evaluate.summary(evaluate.note_metrics(spark.createDataFrame([(1, "m", "a", 0.5), (1, "m", "b", 0.4)], "index long, method string, item string, score double"), spark.createDataFrame([(1, "a", 0.5)], "index long, item string, gain double"))).first()
    assert got.n == 1 and got.kendall_tau_b_sd is None


# ---- the three runs, with the stub

def test_runs_end_to_end(spark, tmp_path):
    notes = spark.createDataFrame([(i, f"HPI: note {i}\nPMH: x\nAllergies: none" if i < 4 else None) for i in range(1, 5)], "index long, text string")
    setting = Settings(num_samples=5)
    names = models.Stub.names
    random.seed(1)
    edges = spark.createDataFrame(
        [(float(i), f"P{i}", "disease", names[i], float(j), f"P{j}", "disease", names[j], "parent-child" if j == i + 1 else "associated with", i * 10 + j) for i in range(6) for j in range(i + 1, 6)],
        "x_index double, x_id string, x_type string, x_name string, y_index double, y_id string, y_type string, y_name string, display_relation string, ord long",
    )
    vectors = spark.createDataFrame([(f"P{i}", [random.random(), random.random()]) for i in range(6)], "node_id string, vec array<float>")
    entities = runs.extract_entities(notes, setting)
    reference = runs.reference_scores(notes, setting).checkpoint()
    assert {r["index"] for r in reference.collect()} == {1, 2, 3, 4} and reference.where("index = 4 AND disease IS NULL").count() == 1
    found = runs.combined_scores(notes, entities, edges, vectors, setting)
    runs.stored(found, str(tmp_path), setting)
    scored = spark.read.parquet(f"{tmp_path}/{setting.output('predictions')}")
    mapping = {r["index"]: r for r in spark.read.parquet(f"{tmp_path}/{setting.output('mapping_stats')}").collect()}
    assert mapping.keys() == {1, 2, 3, 4} and f"index {mapping[4].num_starting_nodes}" == "index 0" and mapping[4].qwen_similarities == "None"
    assert all(r.num_starting_nodes == 1 and " -> mapped -> " in r.qwen_similarities and "(Bi:1.00)" in r.qwen_similarities for i, r in mapping.items() if i < 4)
    walks = spark.read.parquet(f"{tmp_path}/{setting.output('walk_stats')}").collect()
    assert {r.note_index for r in walks} == {1, 2, 3} and all(math.isclose(r.prob, 1.0) for r in walks)
    assert len(scored.columns) == 14 and scored.where("index = 4").count() == 1 and scored.where("NOT is_expanded").count() >= 4
    metrics, log, overlap = runs.evaluated(scored, reference, setting, models.Stub)
    assert metrics.where("method = 'uq_pure'").count() >= 1 and overlap.count() >= 1 and log.where("status = 'Exact'").count() == 0
