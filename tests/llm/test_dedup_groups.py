"""Large groups of near copies, shingles of a set's own, and rows that share ids."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surestat.llm import dedup


def components_by_matrix(texts, k):
    """Smallest index that each text reaches, all pairs of sets being compared."""
    sets = [dedup.shingles(t, k) for t in texts]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), flat.max() + 1), np.float32)
    has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), flat] = 1
    size = has.sum(1)
    both = has @ has.T
    near = 100 * both >= 80 * (size[:, None] + size[None] - both)
    low = np.arange(len(sets))
    while True:
        new = np.array([low[row].min() for row in near])
        if (new == low).all():
            return low.tolist(), near
        low = new


def crowd(n, seed):
    """Near copies of one text, many of them just below similarity 0.8 to it and to each other, some further on in chains."""
    pick = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(n):
        copy = list(base) if i % 7 else texts[pick.randrange(len(texts))].split() if texts else list(base)
        for at in pick.sample(range(100), pick.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 12])):
            copy[at] = f"x{pick.randint(0, 40)}" if i % 3 else f"y{i}"  # own words, and words that others have too
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_a_crowd_of_near_copies_loses_no_link(spark, k):
    texts = crowd(2000, k)
    want, near = components_by_matrix(texts, k)
    base = dedup.shingles(" ".join(f"w{i}" for i in range(100)), k)
    below = sum(0.7 < len(np.intersect1d(s, base)) / len(np.union1d(s, base)) < 0.8 for s in (dedup.shingles(t, k) for t in texts))
    assert below > 100 and 1 < len(set(want)) and (near.sum(1) == 1).any()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in dedup.components(docs, k=k).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_shingles_that_no_other_set_has_are_counted(spark):
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [2, 3, 4, 5], [9], [2])]
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, elements binary")
    assert {(r.node, r.lone) for r in dedup.lone_shingles(rows).collect()} == {(0, 1), (1, 2), (2, 1)}


def test_sets_without_a_link_are_done_with_and_others_are_not(spark):
    n = 50
    for own in range(n):
        for other_n in (n, 40):
            row = spark.range(1).select(dedup.within_reach(F.lit(n), F.lit(n - own), F.lit(other_n), 80).alias("x"))
            best = min(n - own, other_n)  # all that could be shared
            possible = 100 * best >= 80 * (n + other_n - best)
            if own in (0, 4, 5, 6, 9, 10, 11, 49) and possible:
                assert row.first().x


A = "one two three four five six seven eight nine ten"
B = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_one_row_of_each_group_stays(spark):
    rows = [(1, A, "x"), (5, A, "y"), (5, B, "x"), (7, "lone text of its own here", "x"), (7, "lone text of its own here", "x"), (None, A, "z"), (None, "without an id but with words", "x"), (None, "without an id but with words", "x"), (8, "", "x"), (8, "", "x"), (9, None, "x"), (10, f"{B} lambda", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = dedup.one_of_each(docs, k=2)
    assert got.columns == docs.columns
    want = [(1, A), (5, B), (7, "lone text of its own here"), (None, "without an id but with words"), (8, ""), (8, ""), (9, None)]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_rows_that_share_an_id_have_their_own_texts_groups(spark):
    rows = [(1, A), (5, A), (5, B), (6, B), (None, A), (None, "no id at all")]
    got = dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(1, 1, True), (5, 1, False), (5, 5, True), (6, 5, False), (None, 1, False), (None, None, True)])


def test_one_of_each_of_messy_rows(messy, empty):
    got = dedup.one_of_each(messy, k=5)
    assert got.columns == messy.columns
    expected = {(r.doc_id, r.text) for r in messy.collect()} - {(2, messy.where("doc_id = 2").first().text)}
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(expected)
    assert dedup.one_of_each(empty).count() == 0
