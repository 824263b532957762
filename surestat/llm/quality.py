"""Operator 1, quality classifier by hierarchical empirical Bayes.

A document's own evidence is a logistic regression on a dozen measures of its whole text, fitted to labelled documents. A site has
two levels, host and path. Every document adds its label, or with weight SOFT its own probability, to the sums of its path and
host (grouped aggregation with partial sums, so a host with a third of all rows is no burden). Paths shrink toward their host
and hosts toward the whole by Beta priors whose strength is found by moments, so sparse sites lean on the prior. Keys are
dealt into FOLDS folds, and sums are kept by fold: the posteriors that a document meets are those of the other folds, so neither its
own label or probability nor that of a repeated row counts for it. The result combines the path's posterior and the
document's likelihood ratio.

Fitting takes at most TRAIN_DOCS labelled documents, those of smallest hash; sums cover every document.

Defined results: null and empty texts have quality 0 and are rejected; null hosts and paths are a site of their own; a doc_id with several
labels counts as their mean; without labels of both kinds a document's own probability is 0.5 and it is accepted; ties of the threshold are accepted; repeated rows each give
their own row; an empty table gives an empty result; further columns, also of clashing names, stay or are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, only_memory, table, written

TRAIN_DOCS = 20_000
SOFT, THRESHOLD, STRONGEST = 0.5, 0.5, 1e6
FOLDS = 32
MEASURES = ["words", "distinct", "most", "again", "lines", "marks", "symbols", "upper", "digits", "length", "spread", "other"]

_CLASS = np.zeros(256, np.uint8)  # 1 blank, 2 lower, 3 upper, 4 digit, 5 mark, 6 symbol, 7 beyond ASCII
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 7
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[c for c in range(33, 127) if not _CLASS[c]]] = 6


def measures(text: str | None) -> list[float]:
    """Of a whole text: length, repetition of words, neighbours and lines, and shares of character classes."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(MEASURES)
    n, size = len(words), len(raw)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / size
    counts = Counter(words)
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.float64, n)
    letters = share[2] + share[3] + 1e-9
    return [
        math.log(n),
        math.log(len(counts)) / math.log(n + 1),
        counts.most_common(1)[0][1] / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        share[5],
        share[6],
        share[3] / letters,
        share[4],
        min(float(lengths.mean()), 40.0),
        min(float(lengths.std()), 40.0),
        share[7],
    ]


class Classifier:
    """Logistic regression on standardised measures and their squares."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, rate: float) -> None:
        self.mean, self.scale, self.weights, self.rate = mean, scale, weights, rate

    @staticmethod
    def spread(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z * z / 4], 1)

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier | None:
        if len(y) == 0 or y.min() >= 0.5 or y.max() < 0.5:
            return None
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = cls.spread(x, mean, scale)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w, float(y.mean()))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.spread(x, self.mean, self.scale) @ self.weights, -12, 12)))


def measured(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """docs' columns, then __x, the measures of `text`."""
    taken = docs.select(*(F.col(c) for c in columns), F.col(text).alias("__text"))
    kinds = dict(taken.dtypes)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        only_memory("quality", dict)  # nothing of its own
        kind = pa.list_(pa.float64())
        return lambda b: pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([measures(t) for t in b.column(len(columns)).to_pylist()], kind)], [*columns, "__x"])

    return by_batch(taken, make, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "__x array<double>"]))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(n_sites: float, n: float, mean: float, between: float) -> float:
    """The Beta prior's pseudo-count by moments: between is the sites' n-weighted variance about their priors."""
    within = mean * (1 - mean)
    excess = between - within * n_sites / n if n else 0.0
    return min(STRONGEST, max(1.0, (within - between) / excess)) if excess > 0 else STRONGEST


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """evidence (host, path, fold, w, e) to (host, path, fold, n, s, host_mean, path_prior): sums of the path and the host's shrunken mean,
    both without the fold's own share, and the strength with which the path is drawn to it. A site has at most FOLDS rows;
    two rows of totals go to the driver."""
    folds = written(evidence.groupBy("host", "path", "fold").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("e")).alias("s")), "paths")
    paths = folds.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.count("*").alias("sites"), F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("q")).first()
    n, mean = total["n"] or 0.0, (total["s"] or 0.0) / total["n"] if total["n"] else 0.5
    pull = strength(total["sites"], n, mean, (total["q"] or 0.0) / n - mean * mean if n else 0.0)
    shrunk = (F.col("hs") + pull * mean) / (F.col("hn") + pull)
    off = paths.join(hosts.select("host", shrunk.alias("host_mean")), "host").agg(F.count("*").alias("sites"), F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("host_mean")) ** 2).alias("v")).first()
    others = lambda c, *site: F.greatest(F.sum(c).over(Window.partitionBy(*site)) - F.col(c), F.lit(0.0)).alias(c)
    by_host = folds.groupBy("host", "fold").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")).select("host", "fold", others("hn", "host"), others("hs", "host"))
    by_path = folds.select("host", "path", "fold", others("n", "host", "path"), others("s", "host", "path"))
    out = by_path.join(by_host.select("host", "fold", shrunk.alias("host_mean")), ["host", "fold"])
    return out.withColumn("path_prior", F.lit(strength(off["sites"], n, mean, (off["v"] or 0.0) / n if n else 0.0)))


def scored(rows: DataFrame, labels: DataFrame, key: str, host: str, path: str) -> DataFrame:
    """Adds p_document, host_posterior, path_posterior and quality to rows, a stored table with __x.

    Only the key, site and measures are read for the sums; rows are joined to the site table by site, so their text
    doesn't move where the site table is small enough for Spark to broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("__label")).withColumnRenamed("doc_id", "__key")
    slim = rows.select(F.col(key).alias("__key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "__x")
    slim = written(slim.join(known, "__key", "left"), "evidence")
    # only hashes are sorted for the draw; a repeated row is drawn once
    labelled = slim.where("__label IS NOT NULL AND __x[1] + __x[2] > 0").select("__x", "__label", F.xxhash64("__key", "__x").alias("h"))
    drawn = labelled.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    sample = sorted(labelled.where(F.col("h") <= drawn).groupBy("h").agg(F.first("__x"), F.first("__label")).collect()) if drawn is not None else []
    model = Classifier.fitted(np.array([r[1] for r in sample]), np.array([r[2] >= 0.5 for r in sample], float)) if sample else None

    def probability(x: Column) -> Column:
        if model is None:
            return F.when(F.try_element_at(x, F.lit(1)) >= 0, F.lit(0.5))
        score = F.lit(float(model.weights[0]))
        for i in range(len(MEASURES)):
            z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (x[i] - float(model.mean[i])) / float(model.scale[i])))
            score = score + z * float(model.weights[1 + i]) + z * z * float(model.weights[1 + len(MEASURES) + i] / 4)
        score = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), score))
        return 1 / (1 + F.exp(-score))

    rate = model.rate if model else 0.5
    worded = F.col("__x")[1] + F.col("__x")[2] > 0
    weight = F.when(F.col("__label").isNotNull(), 1.0).otherwise(SOFT)
    fold = lambda k: F.pmod(F.xxhash64(k), F.lit(FOLDS)).cast("int")
    evidence = slim.where(worded).select("host", "path", fold("__key").alias("fold"), weight.alias("w"), F.coalesce("__label", probability(F.col("__x"))).alias("e"))
    sites = site_posteriors(evidence).select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("fold").alias("__fold"), F.col("n").alias("__n"), F.col("s").alias("__s"), F.col("host_mean").alias("__mean"), F.col("path_prior").alias("__pull"))

    out = rows.withColumn("__host", F.coalesce(F.col(host).cast("string"), F.lit(""))).withColumn("__path", F.coalesce(F.col(path).cast("string"), F.lit("")))
    out = out.withColumn("__fold", fold(key)).join(sites, ["__host", "__path", "__fold"], "left").withColumn("p_document", probability(F.col("__x")))
    mean, pull = F.coalesce("__mean", F.lit(rate)), F.coalesce("__pull", F.lit(STRONGEST))
    posterior = (F.coalesce("__s", F.lit(0.0)) + pull * mean) / (F.coalesce("__n", F.lit(0.0)) + pull)
    out = out.withColumn("host_posterior", mean).withColumn("path_posterior", F.least(posterior, F.lit(1.0)))
    value = 1 / (1 + F.exp(-(logit(F.col("p_document")) - logit(F.lit(rate)) + logit(F.col("path_posterior")))))
    return out.withColumn("quality", F.when(worded, value).otherwise(0.0)).drop("__host", "__path", "__fold", "__n", "__s", "__mean", "__pull")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, and paths are a source's languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = written(measured(docs, ["doc_id", "source", "lang"]), "measures")
    out = scored(rows, table(spark, sf_dir, "labels"), "doc_id", "source", "lang")
    return out.select("doc_id", "p_document", "host_posterior", "path_posterior", "quality", (F.col("quality") >= THRESHOLD).alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """docs without those it rejects, row by row; texts are stored with their measures once and not shuffled by key."""
    rows = written(measured(docs, docs.columns, text), "measures")
    # own columns can't meet those of docs: the row travels as one struct
    kept = rows.select(F.struct(*docs.columns).alias("__row"), F.col(key).alias("__id"), F.col(host).alias("__h"), F.col(path).alias("__p"), "__x")
    return scored(kept, labels, "__id", "__h", "__p").where(F.col("quality") >= THRESHOLD).select("__row.*")
