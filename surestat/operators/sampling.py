"""Repeated samples to clusters and reference scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency(samples: DataFrame, num_samples: int = 100, note: str = "index", name: str = "disease") -> DataFrame:
    """(note, name, uq): share of the samples that name it."""
    return samples.groupBy(note, name).agg((F.count_distinct("sample_id") / F.lit(num_samples)).alias("uq"))


def above_floor(scores: DataFrame, floor: float = 0.05) -> DataFrame:
    """Strictly above; notes with nothing left are gone."""
    return scores.where(F.col("uq") > floor)


def casefold_clusters(samples: DataFrame, num_samples: int = 100, note: str = "index") -> DataFrame:
    """Leader clustering where names match but for case: then order only decides which spelling leads, so no rows need
    gathering. (note, disease, spellings, uq)"""
    return (
        samples.groupBy(note, F.lower(F.trim("disease")).alias("_name"))
        .agg(F.min(F.struct("sample_id", "ord", "disease")).alias("x"), F.sort_array(F.collect_set("disease")).alias("spellings"), (F.count_distinct("sample_id") / F.lit(num_samples)).alias("uq"))
        .select(note, F.col("x.disease").alias("disease"), "spellings", "uq")
    )


def leader_of(names: list[str], alike: Callable[[str, str], bool]) -> list[int]:
    """For each name in order, the position of its cluster's first name: the earliest cluster that it equals or is alike to."""
    leaders: list[int] = []
    out = []
    for at, name in enumerate(names):
        own = name.strip().lower()
        found = next((x for x in leaders if names[x].strip().lower() == own or alike(names[x], name)), None)
        if found is None:
            leaders.append(at)
            found = at
        out.append(found)
    return out


def leader_clusters(samples: DataFrame, entailed: DataFrame | None = None, num_samples: int = 100, note: str = "index") -> DataFrame:
    """Greedy leader clustering of a note's samples in (sample, line) order; entailed has unordered pairs (note, a, b), lower
    case, a < b, that count as alike. (note, disease, uq). Inherently sequential within a note; a task holds one note's distinct names.

    A repeat of a name falls to the same cluster as its first occurrence, as clusters only get added after it; so each
    distinct name is placed once."""
    first = samples.groupBy(note, F.lower(F.trim("disease")).alias("name")).agg(F.min(F.struct("sample_id", "ord", "disease")).alias("at"), F.collect_set("sample_id").alias("in_samples"))
    first = first.select(note, "name", "at.sample_id", "at.ord", F.col("at.disease").alias("disease"), "in_samples")
    kind = dict(samples.dtypes)[note]
    schema = f"{note} {kind}, disease string, uq double"

    def place(names: pd.DataFrame, pairs: pd.DataFrame | None) -> pd.DataFrame:
        names = names.sort_values(["sample_id", "ord", "name"], kind="stable")
        linked = set(zip(pairs["a"], pairs["b"], strict=True)) if pairs is not None else set()
        alike = lambda x, y: (min(x.strip().lower(), y.strip().lower()), max(x.strip().lower(), y.strip().lower())) in linked
        spelt, held = names["disease"].tolist(), names["in_samples"].tolist()
        members: dict[int, set] = {}
        for at, leader in enumerate(leader_of(spelt, alike)):
            members.setdefault(leader, set()).update(held[at])
        out = pd.DataFrame({"disease": [spelt[x] for x in members], "uq": [len(s) / num_samples for s in members.values()]})
        out.insert(0, note, names[note].iloc[0] if len(names) else None)
        return out

    if entailed is None:
        return first.groupBy(note).applyInPandas(lambda x: place(x, None), schema)
    entailed = entailed.select(*(F.col(c).alias(c) for c in (note, "a", "b")))  # may come from the same rows
    return first.groupBy(note).cogroup(entailed.groupBy(note)).applyInPandas(lambda x, y: place(x, y) if len(x) else pd.DataFrame(columns=[note, "disease", "uq"]), schema)


def clusters_by_rounds(samples: DataFrame, judge: Callable[[DataFrame], DataFrame], num_samples: int = 100, note: str = "index") -> DataFrame:
    """As leader_clusters(), but asking only about pairs of a leader and a name, for all notes at once. (note, disease, uq)

    In a round each note's first name that is in no cluster leads the next one, and judge gets (note, leader, name) for the names
    left and returns those that are alike; they are the leader's, as no earlier leader took them. There are as many rounds as the note of
    most clusters has, and pairs in proportion to names times clusters, not to names squared. Each round's rows are stored."""
    first = samples.groupBy(note, F.lower(F.trim("disease")).alias("_name")).agg(F.min(F.struct("sample_id", "ord", "disease")).alias("at"), F.collect_set("sample_id").alias("held"))
    left, found = first.checkpoint(), None
    while True:
        leaders = left.groupBy(note).agg(F.min(F.struct("at.sample_id", "at.ord", "_name", "at.disease")).alias("lead"))
        asked = left.join(leaders, note).select(note, "_name", "held", F.col("lead._name").alias("_lead"), F.col("lead.disease").alias("leader"), F.col("at.disease").alias("name"))
        alike = judge(asked.where("_name <> _lead").select(note, "leader", "name")).select(note, "name", F.lit(True).alias("_alike"))
        taken = asked.join(alike, [note, "name"], "left").where("_name = _lead OR _alike").select(note, "_name", "leader", "held").checkpoint()
        found = taken if found is None else found.unionByName(taken)
        left = left.join(taken.select(note, "_name"), [note, "_name"], "left_anti").checkpoint()
        if left.isEmpty():
            break
    return found.select(note, "leader", F.explode("held").alias("sample")).groupBy(note, "leader").agg((F.count_distinct("sample") / F.lit(num_samples)).alias("uq")).withColumnRenamed("leader", "disease")


def name_pairs(names: DataFrame, note: str = "index", name: str = "disease") -> DataFrame:
    """Distinct unordered pairs (note, a, b) of a note's names, lower case: what an entailment model has to judge once."""
    distinct = names.select(note, F.lower(F.trim(name)).alias("a")).distinct()
    return distinct.join(distinct.withColumnRenamed("a", "b"), note).where("a < b")


def entailed_pairs(judged: DataFrame, mode: str = "either", least: float = 0.5) -> DataFrame:
    """judged has forward and backward probabilities; either direction above `least` is enough unless both are asked for."""
    ahead, back = F.col("forward") > least, F.col("backward") > least
    return judged.where(ahead | back if mode == "either" else ahead & back)
