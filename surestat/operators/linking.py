"""Linking of names to graph nodes by vector similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..config import NO_DETAIL
from ..functions import numeric as N
from ..functions import text as T

#: Names whose vectors a task compares, graph nodes that they are compared with, the least names that are worth a task, and names at once.
BLOCK, PART, LEAST, ROWS = 16_384, 16_384, 1024, 256


def best_columns(x: np.ndarray, y: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, product) of the k greatest products with y of each of ROWS rows of x from first on; ties to the smaller column, NaN last.

    Columns are looked at in groups: at least k products reach the k-th greatest maximum of a group, so only those that do are sorted.
    They are computed anew one by one, so that equal vectors tie wherever they stand."""
    x = x[first : first + ROWS]
    sim = x @ y.T
    if odd := bool(np.isnan(sim).any()):
        sim[np.isnan(sim)] = -np.inf
    groups = len(y) // 64
    if groups >= k:
        tops = np.concatenate([sim[:, : 64 * groups].reshape(len(x), 64, groups).max(1), sim[:, 64 * groups :]], axis=1)
        least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
    else:
        least = np.full(len(x), -np.inf)
    row, at = np.nonzero(sim >= least[:, None] - 1e-12)
    good = np.concatenate([(x[row[i : i + 65_536]] * y[at[i : i + 65_536]]).sum(1) for i in range(0, max(1, len(row)), 65_536)])
    order = np.lexsort((at, np.where(np.isnan(good), np.inf, -good) if odd else -good, row))
    row, at, good = row[order], at[order], good[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k] + first, at[place < k], good[place < k]


def nearest(entities: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(entity, index, sim, rank): each entity's k nodes of greatest cosine, ties to the smaller node index.

    Entities (entity, vec) go in blocks of about BLOCK, smaller ones where there are few, nodes (index, vec) in parts of about PART; a task compares
    one of each by matrix product and keeps the k best of each entity, so k rows an entity and part are shuffled, never all pairs."""
    n, slots = entities.count(), entities.sparkSession.sparkContext.defaultParallelism
    blocks, parts = max(1, -(-n // BLOCK), min(slots, -(-n // LEAST))), max(1, -(-nodes.count() // PART))
    ent = entities.withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int"))
    dealt = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("index"), F.lit(parts)).cast("int"))
    spread = ent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = dict(entities.dtypes)["entity"]

    def best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"entity": [], "index": [], "sim": []})
        b = b.sort_values("index")
        x, y = (np.stack(t["vec"].to_numpy()).astype(np.float64) for t in (a, b))
        x, y = (t / np.linalg.norm(t, axis=1, keepdims=True) for t in (x, y))
        row, at, sim = (np.concatenate(t) for t in zip(*(best_columns(x, y, k, i) for i in range(0, len(x), ROWS)), strict=True))
        return pd.DataFrame({"entity": a["entity"].to_numpy()[row], "index": b["index"].to_numpy()[at], "sim": sim})

    keys = ["block", "part"]
    found = spread.groupBy(keys).cogroup(dealt.groupBy(keys)).applyInPandas(best, f"entity {kind}, index long, sim double")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("sim"), "index"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def linked(candidates: DataFrame, entailed: DataFrame | None = None, threshold: float = 0.70) -> DataFrame:
    """(entity, index, sim): of nearest()'s rows the first in rank at the threshold or above that is entailed. entailed has (entity, index);
    None counts all as entailed."""
    good = candidates.where(F.col("sim") >= threshold)
    if entailed is not None:
        good = good.join(entailed.select("entity", "index"), ["entity", "index"], "left_semi")
    return good.groupBy("entity").agg(F.min_by("index", "rank").alias("index"), F.min_by("sim", "rank").alias("sim"))


def mapping_rates(mapped: DataFrame, total: DataFrame, note: str = "index") -> DataFrame:
    """(note, rate): distinct nodes over entities, so entities that share a node count once."""
    hit = mapped.groupBy(note).agg(F.count_distinct("node").alias("hit"))
    return total.join(hit, note, "left").select(note, F.coalesce(F.try_divide(F.coalesce("hit", F.lit(0)), F.col("total")), F.lit(0.0)).alias("rate"))


def mapping_details(names: DataFrame, links: DataFrame) -> DataFrame:
    """(note, ord, name, index, detail): names (note, ord, name) with the node of links (name, index, node, sim), or without."""
    found = names.join(links, "name", "left")
    return found.select("note", "ord", "name", "index", T.similarity_detail(F.col("name"), F.col("node"), F.col("sim")).alias("detail"))


def mapping_stats(notes: DataFrame, context: DataFrame, generated: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """A row of schemas.MAPPING_STATS for each note (index): shares of mapped names and what is said of them, in the names' order.

    Both inputs are mapping_details(). The context's share counts distinct nodes, so entities that share a node count
    once; of generated names those count, and are told of, whose node is in valid (index), all if that is None."""
    said = lambda keep: T.joined_details(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "name", "detail")))), lambda x: x["detail"]))
    own = context.groupBy("note").agg(F.count("*").alias("n"), F.count_distinct("index").alias("nodes"), said(F.lit(True)).alias("qwen_similarities"))
    made = generated if valid is None else generated.join(valid.select("index", F.lit(True).alias("good")), "index", "left")
    good = F.col("index").isNotNull() if valid is None else F.col("good")
    made = made.groupBy("note").agg(F.count("*").alias("total"), F.count(F.when(good, 1)).alias("mapped"), said(good).alias("kg_similarities"))
    rate = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    out = notes.select(F.col("index").alias("note")).distinct().join(own, "note", "left").join(made, "note", "left")
    none = F.lit(NO_DETAIL)
    return out.select(
        F.col("note").alias("index"),
        rate("nodes", "n").alias("qwen_mapping_rate"),
        F.coalesce("qwen_similarities", none).alias("qwen_similarities"),
        F.coalesce("nodes", F.lit(0)).cast("long").alias("num_starting_nodes"),
        rate("mapped", "total").alias("kg_mapping_rate"),
        F.coalesce("kg_similarities", none).alias("kg_similarities"),
    )


def normalised_vectors(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return rows.withColumn(vec, N.normalised(F.col(vec)))


def embedded(names: DataFrame, provider, name: str = "name") -> DataFrame:
    """Adds vec, the provider's embedding of the lower-cased name, L2-normalised; blocks of 512 names."""
    columns = names.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512].copy()
                v = np.asarray(provider.embed([str(x or "").lower() for x in part[name]]), np.float32)
                part["vec"] = list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
                yield part[[*columns, "vec"]]

    return names.mapInPandas(run, StructType([*names.schema.fields, StructField("vec", ArrayType(FloatType()))]))
