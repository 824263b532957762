"""The three runs end to end: reference sampling, combined scoring, evaluation. Every step is a plan over all notes; models
come from an injected provider."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import models
from ..config import Settings
from ..functions import text as T
from ..operators import evaluate, expansion, fusion, graph, linking, sampling, tokens
from ..sources import sinks


def prepared(notes: DataFrame, settings: Settings, factory: Callable, extraction: bool = False) -> DataFrame:
    """(index, text): notes without the sections that a run leaves out, of which the last tokens that fit are kept."""
    rows = notes if settings.parity.missing_text_is_nan else notes.where("text IS NOT NULL")
    rows = rows.select("index", T.prepared_note(F.col("text"), settings, extraction).alias("text"))
    return models.shortened(rows, settings.extraction_tokens if extraction else settings.note_tokens, factory)


def extract_entities(notes: DataFrame, settings: Settings, factory: Callable = models.Stub) -> DataFrame:
    """(index, entities)."""
    prompts = prepared(notes, settings, factory, True).select("index", T.extraction_prompt(F.col("text")).alias("prompt"))
    return models.extracted(prompts, factory).select("index", T.json_entities(F.col("reply")).alias("entities"))


def reference_scores(notes: DataFrame, settings: Settings, factory: Callable = models.Stub) -> DataFrame:
    """(index, disease, uq), and a row of nulls for a note without any."""
    prompts = prepared(notes, settings, factory).select("index", T.diagnosis_prompt(F.col("text")).alias("prompt"))
    texts = models.sampled(prompts, settings.num_samples, batch=settings.batch_size, factory=factory)
    names = T.parsed_lists(texts, "text", "index", "sample_id").withColumn("ord", F.col("ord").cast("long")).checkpoint()
    alike = lambda pairs: sampling.entailed_pairs(models.entailment(pairs, "leader", "name", factory), settings.entailment_mode)
    scores = sampling.clusters_by_rounds(names, alike, settings.num_samples)
    return expansion.with_placeholders(notes, scores, {})


class Combined(NamedTuple):
    """predictions: all fourteen columns for every note, a row of zeros for a note without any; mapping: a row of statistics for each note;
    walks: a row for each start node."""

    predictions: DataFrame
    mapping: DataFrame
    walks: DataFrame


def combined_scores(notes: DataFrame, entities: DataFrame, edges: DataFrame, embeddings: DataFrame, settings: Settings, factory: Callable = models.Stub) -> Combined:
    good = graph.valid_edges(edges)
    nodes = graph.nodes(good).checkpoint()
    plain = graph.weighted_edges(good).checkpoint()
    tree = graph.hierarchy(good)
    special = graph.specificity(graph.pagerank(tree, graph.hierarchy_nodes(tree, nodes), settings.rank_steps, settings.damping))
    q = graph.transitions(plain)
    vectors = linking.embedded(nodes.select("index", "name"), models.provider(factory)).select("index", "vec").checkpoint()

    def link(names: DataFrame) -> DataFrame:
        """(name, index, node, sim) of distinct names (entity): the graph node that each is linked to, with its name."""
        near = linking.nearest(linking.embedded(names.select(F.col("entity"), F.col("entity").alias("name")), models.provider(factory)).select("entity", "vec"), vectors, settings.link_k)
        near = near.join(nodes.select("index", "name"), "index").checkpoint()
        judged = models.entailment(near, "entity", "name", factory)
        found = linking.linked(near, sampling.entailed_pairs(judged, settings.entailment_mode), settings.link_threshold)
        return found.join(nodes.select("index", F.col("name").alias("node")), "index").select(F.col("entity").alias("name"), "index", "node", "sim")

    said = entities.select(F.col("index").alias("note"), F.posexplode("entities").alias("ord", "name"))
    context = linking.mapping_details(said, link(said.select(F.col("name").alias("entity")).distinct())).checkpoint()
    anchors = graph.anchors(context.where("index IS NOT NULL").select("note", "index"), nodes, embeddings, special).checkpoint()

    prompts = prepared(notes, settings, factory).select("index", T.diagnosis_prompt(F.col("text")).alias("prompt"))
    lists = tokens.token_lists(models.generated(prompts, factory=factory), settings.parity.strip_leading_t).select(F.col("index").alias("note"), "ord", F.col("disease").alias("name")).checkpoint()
    linked = linking.mapping_details(lists, link(lists.select(F.col("name").alias("entity")).distinct())).checkpoint()
    valid = nodes.where(expansion.right_type(F.col("type"))).select("index")
    mapping = linking.mapping_stats(notes, context, linked, valid)
    generated = linked.join(valid.withColumn("good", F.lit(True)), "index", "left").select("note", "ord", F.col("name").alias("disease"), F.when(F.col("good"), F.col("index")).alias("index")).checkpoint()

    every = expansion.scored(q, anchors, graph.degrees(plain), graph.targets(nodes), generated, settings).checkpoint()
    scores = every.where("rank IS NULL").drop("rank")

    force = lambda rows, prefix: tokens.confidence(models.forced(rows.groupBy("index").agg(F.collect_list("disease").alias("diseases")).join(prompts, "index"), prefix, factory), "index", "disease")
    own = force(generated.select(F.col("note").alias("index"), "disease"), "\n-")
    asked = generated.select(F.col("note").alias("index"), "disease").join(prompts, "index").withColumn("prefix", F.lit("\n-"))
    claims = models.alternatives(asked, settings.top_k_ccp, factory=factory)
    judged = models.entailment(claims, "disease", "alternative", factory)
    claims = judged.withColumn("entailed", (F.lower("disease") == F.lower("alternative")) | (F.col("forward") > 0.5) | (F.col("backward") > 0.5))
    ccp = tokens.claim_probability(claims, "index", "disease")
    mapped = generated.join(scores, ["note", "index"], "left")
    bounds = fusion.local_bounds(mapped, "note", "raw")
    rows = mapped.select("note", "disease", F.when(F.col("index").isNotNull(), F.coalesce("raw", F.lit(0.0))).alias("raw"))
    rows = rows.join(own.join(ccp, ["index", "disease"], "left").withColumnRenamed("index", "note"), ["note", "disease"]).fillna(0.0, ["uq_ccp"])

    limits = expansion.thresholds(mapped)
    more = expansion.candidates(every, generated, limits, nodes)
    again = force(more.select(F.col("note").alias("index"), "disease"), "\n- ").select(F.col("index").alias("note"), "disease", F.col("uq_pure").alias("tf_logits_expanded"), F.col("uq_min_logprob").alias("tf_min_logprob_expanded"))
    expanded = more.join(every.where("rank IS NOT NULL").select("note", "index", "raw"), ["note", "index"]).select("note", "disease", "raw").join(again, ["note", "disease"])
    out = expansion.predictions(rows, expanded, bounds, settings)
    out = expansion.with_placeholders(notes, out, {c: 0.0 for c in out.columns if c not in ("index", "disease", "is_expanded")} | {"is_expanded": False})
    return Combined(out, mapping, sinks.walk_stats(anchors, nodes))


def stored(found: Combined, root: str, settings: Settings) -> None:
    """Appends a run's three outputs to their tables; walk statistics only where there are rows, as appending does."""
    for kind, rows in zip(("predictions", "mapping_stats", "walk_stats"), found, strict=True):
        sinks.append_table(rows, root, settings, kind)


def evaluated(predictions: DataFrame, reference: DataFrame, settings: Settings, factory: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(note metrics, alignment log, overlap ratios). A model is asked only for names that don't match exactly."""
    reference = sampling.above_floor(evaluate.upto_index(reference, settings.limit_index).where("disease IS NOT NULL"), settings.reference_floor)
    rows = evaluate.upto_index(evaluate.without_expansion(predictions) if settings.ignore_expansion else predictions, settings.limit_index)
    names = evaluate.aligned(rows, reference)
    if factory is not None:
        lists = reference.groupBy("index").agg(F.sort_array(F.collect_set("disease")).alias("entries"))
        ask = names.where("status <> 'Exact'").join(lists, "index").select("index", "original", T.alignment_prompt(F.col("original"), F.col("entries")).alias("prompt"))
        names = evaluate.aligned(rows, reference, models.answers(ask, factory))
    gains = reference.groupBy("index", F.col("disease").alias("item")).agg(F.max("uq").alias("gain"))
    long = evaluate.by_aligned_name(evaluate.long_form(rows), names, "method")
    items = evaluate.by_aligned_name(rows.select("index", "disease", "is_expanded", F.col("uq_ccp").alias("score")), names)
    return evaluate.note_metrics(long, gains, settings.rbo_p), evaluate.alignment_log(names), evaluate.overlap_ratio(items, gains)
