"""Memories are bounded by bytes, and no language is left out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surestat.llm import bpe, common, langid


def test_a_memory_stays_within_its_bytes():
    memo = bpe._Memo(lambda w: (len(w),), 5_000)
    for i in range(300):
        assert memo[f"w{i}" * (i % 40)] == (len(f"w{i}" * (i % 40)),)
        assert memo.held <= 5_000 and len(memo) <= 25
    memo["x" * 10_000]
    assert "x" * 10_000 not in memo


def test_every_language_is_learned(spark):
    pick = random.Random(0)
    rows = []
    for y in range(80):
        own = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(6)]
        rows += [(100 * y + i, " ".join(pick.choices(own, k=30)), f"l{y:02}") for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == [f"l{y:02}" for y in range(80)] and len(model.weights) * 80 <= langid.WEIGHTS
    held = langid.predicted(docs, model, ["doc_id", "lang"]).where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, f"{'ab cd ef ' if i % 2 else 'gh ij kl '}" * 4_000, "xy"[i % 2]) for i in range(12)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["x", "y"]
    assert langid.Labeller(model).predict(["ab cd", "gh kl"])[0][0] == "y"


def test_smaller_tables_fold_the_same_features():
    flat, _ = langid.word_features(["word", "übung"])
    assert (langid.folded(flat, langid.FEATURES) == flat).all() and langid.folded(flat, 1 << 12).max() < 1 << 12
    assert np.unique(langid.folded(flat, 1 << 12)).size > 5


def test_a_cluster_has_to_name_its_folder():
    class Context:
        master = "yarn"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(type("Session", (), {"sparkContext": Context()})())
