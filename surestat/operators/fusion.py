"""Linear and reciprocal-rank fusion of model and graph scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def local_bounds(scores: DataFrame, note: str, score: str) -> DataFrame:
    """(note, low, high) of the positive scores; 0 if there are none."""
    positive = F.when(F.col(score) > 0, F.col(score))
    return scores.groupBy(note).agg(F.coalesce(F.min(positive), F.lit(0.0)).alias("low"), F.coalesce(F.max(positive), F.lit(0.0)).alias("high"))


def min_max_local(scores: DataFrame, note: str, score: str, out: str = "kg_only") -> DataFrame:
    """Adds the score scaled between the note's positive bounds."""
    note_rows = Window.partitionBy(note)
    positive = F.when(F.col(score) > 0, F.col(score))
    low, high = (F.coalesce(f(positive).over(note_rows), F.lit(0.0)) for f in (F.min, F.max))
    return scores.withColumn(out, N.min_max(F.col(score), low, high))


def linear(scores: DataFrame, alpha: float = 0.25, veto: float | None = 0.01, kg: str = "kg_only", pure: str = "uq_pure") -> DataFrame:
    """Adds uq_kg; a row the model itself finds improbable loses its graph share (veto None: never, as for expanded rows)."""
    if veto is not None:
        scores = scores.withColumn(kg, F.when(F.col(pure) < veto, 0.0).otherwise(F.col(kg)))
    return scores.withColumn("uq_kg", N.fused(F.col(kg), F.col(pure), alpha))


def reciprocal_rank(scores: DataFrame, note: str = "index", k: int = 10, veto: float = 0.01) -> DataFrame:
    """Adds uq_rrf: 1/(k + rank) by effective score, the teacher-forced one of expanded rows, and by graph score unless vetoed."""
    effective = F.when(F.col("is_expanded"), F.col("tf_logits_expanded")).otherwise(F.col("uq_pure"))
    scores = scores.withColumn("_effective", effective)
    by = lambda c: F.rank().over(Window.partitionBy(note).orderBy(F.desc(c)))
    kg = F.when((F.col("_effective") < veto) | (F.col("kg_only") == 0), 0.0).otherwise(1 / (k + by("kg_only")))
    return scores.withColumn("uq_rrf", 1 / (k + by("_effective")) + kg).drop("_effective")
