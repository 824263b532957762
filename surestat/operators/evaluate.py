"""Alignment to the reference distribution and ranking metrics, for all notes and methods in one long table
(index, method, item, score, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LOG_SCALE, METHODS, METRICS, WITH_EXPANSION
from ..functions import text as T


def long_form(predictions: DataFrame, methods: list[str] = METHODS) -> DataFrame:
    """(index, disease, method, score, is_expanded); expanded rows only for the methods that allow them."""
    long = predictions.select("index", "disease", "is_expanded", *(F.col(m).cast("double") for m in methods)).unpivot(["index", "disease", "is_expanded"], methods, "method", "score")
    return long.where(~F.coalesce("is_expanded", F.lit(False)) | F.col("method").isin(WITH_EXPANSION))


def without_expansion(predictions: DataFrame) -> DataFrame:
    return predictions.where(~F.coalesce("is_expanded", F.lit(False))) if "is_expanded" in predictions.columns else predictions


def upto_index(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.where(F.col("index") <= limit)


def distinct_items(rows: DataFrame) -> DataFrame:
    return rows.where("disease IS NOT NULL").select("index", "disease").distinct()


def aligned(names: DataFrame, reference: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(index, original, aligned, status) of each distinct name of a note: the reference's spelling where they are equal but for case
    (Exact), the entry that a model's answer (index, original, answer) names (Aligned), otherwise itself (Unmatched)."""
    own = distinct_items(names).withColumnRenamed("disease", "original")
    spelt = distinct_items(reference).groupBy("index", F.lower(F.trim("disease")).alias("_key")).agg(F.max("disease").alias("exact"))
    own = own.withColumn("_key", F.lower(F.trim("original"))).join(spelt, ["index", "_key"], "left").drop("_key")
    if answers is None:
        own = own.withColumn("said", F.col("original"))
    else:
        lists = distinct_items(reference).groupBy("index").agg(F.sort_array(F.collect_list("disease")).alias("entries"))
        own = own.join(answers, ["index", "original"], "left").join(lists, "index", "left")
        own = own.withColumn("said", T.matched_answer(F.col("answer"), F.coalesce("entries", F.array().cast("array<string>")), F.col("original")))
    final = F.coalesce("exact", "said")
    status = F.when(F.col("exact").isNotNull(), "Exact").when(F.lower(final) != F.lower("original"), "Aligned").otherwise("Unmatched")
    return own.select("index", "original", final.alias("aligned"), status.alias("status"))


def alignment_log(names: DataFrame) -> DataFrame:
    """What is logged: exact matches aren't."""
    return names.where("status <> 'Exact'")


def by_aligned_name(rows: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """Greatest score and common expansion flag of each aligned name; names without one are dropped."""
    found = rows.join(names.select("index", F.col("original").alias("disease"), "aligned"), ["index", "disease"], "left").where("aligned IS NOT NULL")
    return found.groupBy("index", *keys, F.col("aligned").alias("item")).agg(F.max("score").alias("score"), F.bool_and("is_expanded").alias("is_expanded"))


def universe(predicted: DataFrame, reference: DataFrame, fill: float | None = None) -> DataFrame:
    """(index, method, item, gain, score, predicted, in_reference): a full join of reference (index, item, gain) and predicted (index,
    method, item, score), so items of either side count; missing gains are 0, missing scores the method's default.

    Each method is judged on the notes that have a reference, also where it has no rows."""
    methods = predicted.select("method").distinct()
    notes = reference.select("index").distinct()
    wanted = reference.join(F.broadcast(methods))  # at most METHODS, a fixed list
    low = F.when(F.col("method").isin(LOG_SCALE), -100.0).otherwise(0.0) if fill is None else F.lit(fill)
    both = wanted.withColumn("in_reference", F.lit(True)).join(predicted.join(notes, "index", "left_semi").withColumn("predicted", F.lit(True)), ["index", "method", "item"], "full")
    return both.select("index", "method", "item", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("score", low).alias("score"), F.coalesce("predicted", F.lit(False)).alias("predicted"), F.coalesce("in_reference", F.lit(False)).alias("in_reference"))


_KEY = ["index", "method"]


def judged(rows: DataFrame, least: int = 2) -> DataFrame:
    """Notes of at least two items, for each method."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*_KEY))).where(F.col("_n") >= least).drop("_n")


def ranked(rows: DataFrame) -> DataFrame:
    """Adds pos, the place by score, and ref_pos, that by gain, ties by name; items that aren't predicted, or not in the reference, have none."""
    by = lambda flag, value: F.when(F.col(flag), F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc(flag), F.desc(value), "item")))
    return rows.withColumn("pos", by("predicted", "score")).withColumn("ref_pos", by("in_reference", "gain"))


def ndcg(rows: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(index, method, ndcg_5, ndcg_10, ndcg_std): linear gains, tied scores share their mean gain, the ideal doesn't; 0 if
    the ideal is. ndcg_std cuts at the reference's size."""
    at = Window.partitionBy(*_KEY)
    rows = rows.withColumns(
        {
            "_pos": F.row_number().over(at.orderBy(F.desc("score"), "item")),
            "_ideal": F.row_number().over(at.orderBy(F.desc("gain"), "item")),
            "_mean": F.avg("gain").over(Window.partitionBy(*_KEY, "score")),
            "_size": F.sum(F.col("in_reference").cast("int")).over(at),
        }
    )

    def cut(k):
        dcg = F.sum(F.when(F.col("_pos") <= k, F.col("_mean") / F.log2(F.col("_pos") + 1)))
        ideal = F.sum(F.when(F.col("_ideal") <= k, F.col("gain") / F.log2(F.col("_ideal") + 1)))
        return F.coalesce(F.when(ideal > 0, dcg / ideal), F.lit(0.0))

    return rows.groupBy(*_KEY).agg(*(cut(F.lit(k)).alias(f"ndcg_{k}") for k in cuts), cut(F.col("_size")).alias("ndcg_std"))


def kendall_tau_b(rows: DataFrame) -> DataFrame:
    """(index, method, kendall_tau_b): 0 if either side is constant. Pairs of one note's items, tens of them."""
    a = rows.select(*_KEY, "item", "gain", "score")
    pairs = a.join(a.toDF(*_KEY, "item2", "gain2", "score2"), _KEY).where("item < item2")
    g, s = F.signum(F.col("gain") - F.col("gain2")), F.signum(F.col("score") - F.col("score2"))
    tau = F.try_divide(F.sum(g * s), F.sqrt(F.sum(F.abs(g)) * F.sum(F.abs(s))))
    return pairs.groupBy(*_KEY).agg(F.coalesce(tau, F.lit(0.0)).alias("kendall_tau_b"))


def positional(rows: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(index, method, mrr, precision and recall at each cut) of ranked(): precision over what was retrieved, recall over the reference."""
    hit = F.col("in_reference") & F.col("pos").isNotNull()
    out = [F.coalesce(F.try_divide(F.lit(1.0), F.min(F.when(hit, F.col("pos")))), F.lit(0.0)).alias("mrr")]
    for k in cuts:
        hits = F.count(F.when(hit & (F.col("pos") <= k), 1))
        out.append(F.coalesce(F.try_divide(hits, F.count(F.when(F.col("pos") <= k, 1))), F.lit(0.0)).alias(f"precision_{k}"))
        out.append(F.coalesce(F.try_divide(hits, F.count(F.when(F.col("in_reference"), 1))), F.lit(0.0)).alias(f"recall_{k}"))
    return rows.groupBy(*_KEY).agg(*out)


def rank_biased_overlap(rows: DataFrame, p: float = 0.9) -> DataFrame:
    """(index, method, rbo) of ranked(): (1-p) sum of p^(d-1) x overlap at d / d up to the longer list; 0 if either is empty.

    An item of both lists counts from its greater place on: its share is the sum over the depths from there."""
    size = rows.groupBy(*_KEY).agg(F.count("pos").alias("n"), F.count("ref_pos").alias("m"))
    depths = size.select(*_KEY, F.greatest("n", "m").alias("deep"), F.least("n", "m").alias("short"))
    common = rows.where("pos IS NOT NULL AND ref_pos IS NOT NULL").select(*_KEY, F.greatest("pos", "ref_pos").alias("depth")).join(depths, _KEY)
    share = F.aggregate(F.sequence("depth", F.col("deep").cast("int")), F.lit(0.0), lambda acc, d: acc + F.pow(F.lit(p), d - 1) / d)
    found = common.groupBy(*_KEY).agg(F.sum((1 - p) * share).alias("rbo"))
    return depths.join(found, _KEY, "left").select(*_KEY, F.coalesce("rbo", F.lit(0.0)).alias("rbo"))


def note_metrics(predicted: DataFrame, reference: DataFrame, rbo_p: float = 0.9) -> DataFrame:
    """All metrics of each note and method, from one stored table of ranked items."""
    rows = ranked(judged(universe(predicted, reference))).checkpoint()
    out = ndcg(rows).join(positional(rows), _KEY).join(rank_biased_overlap(rows, rbo_p), _KEY).join(kendall_tau_b(rows), _KEY, "left")
    return out.select(*_KEY, *(F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS))


def summary(metrics: DataFrame, *keys: str) -> DataFrame:
    """For each method: notes, means, and the sample deviation of tau (null for one note)."""
    return metrics.groupBy(*keys, "method").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in METRICS), F.stddev_samp("kendall_tau_b").alias("kendall_tau_b_sd"))


def overlap_ratio(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """(index, overlap_ratio): share of a note's distinct items, expanded ones too, that the reference has; 0 for a note with
    none. Notes are the reference's."""
    items = generated.select("index", "item").distinct().join(reference.select("index", "item", F.lit(1).alias("hit")).distinct(), ["index", "item"], "left")
    shares = items.groupBy("index").agg((F.count("hit") / F.count("*")).alias("overlap_ratio"))
    return reference.select("index").distinct().join(shares, "index", "left").select("index", F.coalesce("overlap_ratio", F.lit(0.0)).alias("overlap_ratio"))


def mean_overlap(overlaps: DataFrame) -> DataFrame:
    return overlaps.agg(F.coalesce(F.avg("overlap_ratio"), F.lit(0.0)).alias("mean_overlap"))


def full_against_sliced(full: DataFrame, sliced: DataFrame) -> DataFrame:
    """(n_common, mean_difference, n_sliced_only, mean_sliced_only) over aligned items (index, item, score) of both modes."""
    both = full.select("index", "item", F.col("score").alias("f")).join(sliced.select("index", "item", F.col("score").alias("s")), ["index", "item"], "full")
    common, only = F.col("f").isNotNull() & F.col("s").isNotNull(), F.col("f").isNull()
    return both.agg(
        F.count_if(common).alias("n_common"),
        F.avg(F.when(common, F.col("s") - F.col("f"))).alias("mean_difference"),
        F.count_if(only).alias("n_sliced_only"),
        F.avg(F.when(only, F.col("s"))).alias("mean_sliced_only"),
    )


def indices(*frames: DataFrame) -> DataFrame:
    """Distinct indices of all frames, sorted."""
    every = frames[0].select("index")
    for frame in frames[1:]:
        every = every.union(frame.select("index"))
    return every.distinct().orderBy("index")
