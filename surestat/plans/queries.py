"""Queries of the confidence engine, by name, and the SQL that gives the same rows. Doubles are rounded on both sides."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HOSPITAL_FAMILIES, HOSPITAL_STOPS, PLAIN_HEADINGS, Settings
from ..functions import numeric as N
from ..functions import text as T
from ..operators import evaluate, expansion, fusion, graph, linking, sampling, tokens
from ..sources import sinks, tables
from .views import in_spark, in_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SETTINGS = Settings()
#: Rows of a CSV file, which one task reads.
FILE_ROWS = 100_000


def query(sql: str | None = None, recursive: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = in_sql(sql, recursive)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---- sampling

@query("SELECT index, disease, round(count(DISTINCT sample_id) / 100.0e0, 6) AS uq FROM {samples} GROUP BY 1, 2 HAVING count(DISTINCT sample_id) > 5")
def sampling_frequency(spark, d):
    return rounded(sampling.above_floor(sampling.frequency(in_spark(spark, d, "samples"))))


_CASE = "CASE WHEN sample_id % 2 = 0 THEN upper(disease) ELSE disease END"


def _mixed_case(spark, d):
    return in_spark(spark, d, "samples").withColumn("disease", F.expr(_CASE))


@query(
    f"""SELECT index, min(struct_pack(s := sample_id, o := ord, d := x)).d AS disease, count(DISTINCT x) AS n_spellings, round(count(DISTINCT sample_id) / 100.0e0, 6) AS uq
        FROM (SELECT *, {_CASE} AS x FROM {{samples}}) GROUP BY index, lower(trim(disease))"""
)
def cluster_casefold(spark, d):
    return rounded(sampling.casefold_clusters(_mixed_case(spark, d))).select("index", "disease", F.size("spellings").cast("long").alias("n_spellings"), "uq")


@query(ORACLES["cluster_casefold"].replace("count(DISTINCT x) AS n_spellings, ", ""))
def cluster_leader(spark, d):
    """The sequential fold; without entailments it must equal grouping by case-folded names."""
    return rounded(sampling.leader_clusters(_mixed_case(spark, d)))


@query(
    """SELECT DISTINCT a.index, a.n AS a, b.n AS b FROM (SELECT DISTINCT index, lower(trim(disease)) AS n FROM {samples}) a
       JOIN (SELECT DISTINCT index, lower(trim(disease)) AS n FROM {samples}) b ON a.index = b.index AND a.n < b.n"""
)
def entailment_pairs(spark, d):
    return sampling.name_pairs(in_spark(spark, d, "samples"))


# ---- token scores

@query(
    """SELECT index, item, round(exp(avg(ln(prob + 1e-9))), 6) AS uq_pure, round(product(prob), 6) AS uq_seq_prob, round(-avg(entropy), 6) AS uq_neg_ent,
              round(max(ln(prob + 1e-9)), 6) AS uq_max_logprob, round(min(ln(prob + 1e-9)), 6) AS uq_min_logprob FROM {trace} GROUP BY 1, 2"""
)
def token_confidence(spark, d):
    return rounded(tokens.confidence(in_spark(spark, d, "trace"), "index", "item"))


@query("SELECT index, item, round(coalesce(sum(prob) FILTER (entailed) / nullif(sum(prob), 0), 0), 6) AS uq_ccp FROM {trace} GROUP BY 1, 2")
def ccp_ratio(spark, d):
    return rounded(tokens.claim_probability(in_spark(spark, d, "trace"), "index", "item"))


# ---- fusion

_BOUNDS = "SELECT *, coalesce(min(kg_only) FILTER (kg_only > 0) OVER w, 0) AS lo, coalesce(max(kg_only) FILTER (kg_only > 0) OVER w, 0) AS hi FROM {scored} WINDOW w AS (PARTITION BY index)"
_MINMAX = "CASE WHEN hi > lo THEN least(1, greatest(0, (kg_only - lo) / (hi - lo))) WHEN hi > 0 THEN 1e0 ELSE 0e0 END"


@query(f"SELECT index, disease, round({_MINMAX}, 6) AS scaled FROM ({_BOUNDS})")
def minmax_local(spark, d):
    return rounded(fusion.min_max_local(in_spark(spark, d, "scored"), "index", "kg_only", "scaled").select("index", "disease", "scaled"))


@query("SELECT index, disease, round(CASE WHEN uq_pure < 0.01e0 THEN 0 ELSE kg_only END, 6) AS kg_only, round(0.25e0 * CASE WHEN uq_pure < 0.01e0 THEN 0 ELSE kg_only END + 0.75e0 * uq_pure, 6) AS uq_kg FROM {scored}")
def linear_fusion(spark, d):
    return rounded(fusion.linear(in_spark(spark, d, "scored")).select("index", "disease", "kg_only", "uq_kg"))


@query(
    """SELECT index, disease, round(1.0e0 / (10 + rank() OVER (PARTITION BY index ORDER BY e DESC))
              + CASE WHEN e < 0.01e0 OR kg_only = 0 THEN 0 ELSE 1.0e0 / (10 + rank() OVER (PARTITION BY index ORDER BY kg_only DESC)) END, 6) AS uq_rrf
       FROM (SELECT *, CASE WHEN is_expanded THEN uq_pure / 100 ELSE uq_pure END AS e FROM {scored})"""
)
def rrf_fusion(spark, d):
    rows = in_spark(spark, d, "scored").withColumn("tf_logits_expanded", F.col("uq_pure") / 100)
    return rounded(fusion.reciprocal_rank(rows).select("index", "disease", "uq_rrf"))


# ---- evaluation

_ALIGNED = "SELECT index, CASE WHEN r.key IS NULL THEN disease ELSE r.exact END AS item, max(uq_pure) AS score, bool_and(is_expanded) AS is_expanded, count(r.key) AS n FROM (SELECT *, lower(trim(disease)) AS key FROM {scored}) LEFT JOIN (SELECT index, lower(trim(item)) AS key, max(upper(item)) AS exact FROM {gains} GROUP BY 1, 2) r USING (index, key) GROUP BY 1, 2"


def _gains(spark, d):
    return sampling.above_floor(sampling.frequency(in_spark(spark, d, "samples"))).select("index", F.col("disease").alias("item"), F.col("uq").alias("gain"))


def _spelt(spark, d):
    return _gains(spark, d).select("index", F.upper("item").alias("disease"))


@query(f"SELECT index, item, round(score, 6) AS score, is_expanded FROM ({_ALIGNED})")
def align_max_and(spark, d):
    rows = in_spark(spark, d, "scored").withColumn("score", F.col("uq_pure"))
    return rounded(evaluate.by_aligned_name(rows, evaluate.aligned(rows, _spelt(spark, d))))


@query("SELECT index, disease AS original, coalesce(r.exact, disease) AS aligned, CASE WHEN r.exact IS NULL THEN 'Unmatched' ELSE 'Exact' END AS status FROM (SELECT DISTINCT index, disease, lower(trim(disease)) AS key FROM {scored}) LEFT JOIN (SELECT index, lower(trim(item)) AS key, max(upper(item)) AS exact FROM {gains} GROUP BY 1, 2) r USING (index, key)")
def alignment(spark, d):
    return evaluate.aligned(in_spark(spark, d, "scored"), _spelt(spark, d))


def _long(spark, d):
    return evaluate.long_form(in_spark(spark, d, "scored"), ["uq_pure", "kg_only"]).select("index", "method", F.col("disease").alias("item"), "score")


def _universe(spark, d):
    return evaluate.universe(_long(spark, d), _gains(spark, d))


@query("SELECT index, method, item, round(score, 6) AS score FROM {long}")
def long_method_scores(spark, d):
    return rounded(_long(spark, d))


@query("SELECT index, disease, round(uq_pure, 6) AS uq_pure FROM {scored} WHERE NOT is_expanded")
def ignore_expansion(spark, d):
    return rounded(evaluate.without_expansion(in_spark(spark, d, "scored")).select("index", "disease", "uq_pure"))


@query("SELECT index, disease FROM {scored} WHERE index <= 50")
def index_limit(spark, d):
    """The index limit is the original's own option."""
    return evaluate.upto_index(in_spark(spark, d, "scored"), 50).select("index", "disease")


@query("SELECT index, method, item, round(gain, 6) AS gain, round(score, 6) AS score, predicted, in_reference FROM {universe}")
def metric_universe(spark, d):
    return rounded(_universe(spark, d))


@query("SELECT index, method, round(ndcg_5, 6) AS ndcg_5, round(ndcg_10, 6) AS ndcg_10, round(ndcg_std, 6) AS ndcg_std FROM {ndcg}")
def ndcg_at_k(spark, d):
    return rounded(evaluate.ndcg(evaluate.judged(_universe(spark, d))))


@query("SELECT index, method, round(kendall_tau_b, 6) AS kendall_tau_b FROM {tau}")
def kendall_tau_b(spark, d):
    return rounded(evaluate.kendall_tau_b(evaluate.judged(_universe(spark, d))))


@query("SELECT index, method, round(mrr, 6) AS mrr FROM {hits}")
def mrr(spark, d):
    return rounded(evaluate.positional(evaluate.ranked(evaluate.judged(_universe(spark, d)))).select("index", "method", "mrr"))


@query("SELECT index, method, round(rbo, 6) AS rbo FROM {rbo}")
def rbo(spark, d):
    return rounded(evaluate.rank_biased_overlap(evaluate.ranked(evaluate.judged(_universe(spark, d)))))


@query("SELECT index, method, round(precision_5, 6) AS precision_5, round(precision_10, 6) AS precision_10, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10 FROM {hits}")
def precision_recall_at_k(spark, d):
    return rounded(evaluate.positional(evaluate.ranked(evaluate.judged(_universe(spark, d)))).drop("mrr"))


_METRICS = ["ndcg_5", "ndcg_10", "ndcg_std", "rbo", "mrr", "recall_5", "recall_10", "precision_5", "precision_10", "kendall_tau_b"]


@query("SELECT method, count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _METRICS) + ", round(stddev_samp(kendall_tau_b), 6) AS kendall_tau_b_sd FROM {metrics} GROUP BY 1")
def method_summary(spark, d):
    return rounded(evaluate.summary(evaluate.note_metrics(_long(spark, d), _gains(spark, d))))


_OVERLAP = "SELECT index, coalesce(o, 0) AS overlap_ratio FROM (SELECT DISTINCT index FROM {gains}) LEFT JOIN (SELECT s.index, count(g.item) / CAST(count(*) AS DOUBLE) AS o FROM {scored} s LEFT JOIN {gains} g ON s.index = g.index AND s.disease = g.item GROUP BY 1) USING (index)"


@query(f"SELECT index, round(overlap_ratio, 6) AS overlap_ratio FROM ({_OVERLAP})")
def overlap_ratio(spark, d):
    return rounded(evaluate.overlap_ratio(in_spark(spark, d, "scored").withColumnRenamed("disease", "item"), _gains(spark, d)))


@query(f"SELECT round(coalesce(avg(overlap_ratio), 0), 6) AS mean_overlap FROM ({_OVERLAP})")
def mean_overlap(spark, d):
    return rounded(evaluate.mean_overlap(evaluate.overlap_ratio(in_spark(spark, d, "scored").withColumnRenamed("disease", "item"), _gains(spark, d))))


@query(
    """SELECT count(*) FILTER (f IS NOT NULL AND s IS NOT NULL) AS n_common, round(avg(s - f), 6) AS mean_difference, count(*) FILTER (f IS NULL) AS n_sliced_only, round(avg(s) FILTER (f IS NULL), 6) AS mean_sliced_only
       FROM (SELECT index, item, gain AS f FROM {gains}) FULL JOIN (SELECT index, disease AS item, uq_pure AS s FROM {scored}) USING (index, item)"""
)
def full_against_sliced(spark, d):
    full = _gains(spark, d).withColumnRenamed("gain", "score")
    return rounded(evaluate.full_against_sliced(full, in_spark(spark, d, "scored").select("index", F.col("disease").alias("item"), F.col("uq_pure").alias("score"))))


@query("SELECT index FROM {gains} UNION SELECT doc_id FROM labels")
def note_indices(spark, d):
    return evaluate.indices(_gains(spark, d), in_spark(spark, d, "labels").select(F.col("doc_id").alias("index")))


# ---- text

_LINE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(trim(line), '^([-*•]\\s*|[0-9]+[.)]\\s*)(.+)$', 2), '\\(.*?\\)|\\[.*?\\]', '', 'g'), '\\(.*$|\\[.*$', ''), '', ''), ' \"''')"


@query(f"SELECT index, ord, disease FROM (SELECT index, CAST(ord - 1 AS INT) AS ord, {_LINE} AS disease FROM (SELECT index, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM {{lists}})) WHERE length(disease) > 1")
def bullet_parse(spark, d):
    return T.parsed_lists(in_spark(spark, d, "lists"), "text", "index")


@query("SELECT p_partkey AS index, trim(regexp_extract(regexp_replace('12. ' || p_brand || ' secondary to ' || p_type || ' (x)', '^[-*•0-9.\\s]+', ''), '^(.*?)\\s+(?:due to|secondary to)', 1), ' \"''') AS name, trim(regexp_replace(p_name || ' (' || p_brand || ')', '\\s*\\(.*?\\)', '', 'g')) AS node_name FROM {part}")
def clean_names(spark, d):
    part = in_spark(spark, d, "part")
    raw = F.concat(F.lit("12. "), "p_brand", F.lit(" secondary to "), "p_type", F.lit(" (x)"))
    name = T.unquoted(T.without_explanation(T.without_brackets(T.without_bullet(raw))))
    return part.select(F.col("p_partkey").alias("index"), name.alias("name"), T.without_round_brackets(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("node_name"))


@query("SELECT index, min(ord) AS ord, arg_min(disease, (ord, disease)) AS disease FROM {samples} GROUP BY index, lower(disease)")
def first_names(spark, d):
    return T.first_of_each_name(in_spark(spark, d, "samples"), "index", "disease", "ord")


@query("SELECT event_id AS index, CASE WHEN event_id % 3 = 0 THEN [CAST(event_id AS VARCHAR), 'b'] WHEN event_id % 3 = 1 THEN ['q'] ELSE [] END AS entities FROM events")
def json_entities(spark, d):
    rows = in_spark(spark, d, "events").select(F.col("event_id").alias("index"), "props")
    listed = F.concat(F.lit('```json\n["'), F.col("index").cast("string"), F.lit(' (x)", "b [y]"]\n```'))
    reply = F.when(F.col("index") % 3 == 0, listed).when(F.col("index") % 3 == 1, F.lit('Sure: ["q"] as asked')).otherwise(F.col("props"))
    return rows.select("index", T.json_entities(reply).alias("entities"))


def _cut(text: str, headings: list[str], stop: str) -> str:
    """Sections from each heading up to a stop, which SQL's patterns can't look ahead to: it is matched and put back. That is the same
    where no section follows one of its own heading."""
    for heading in headings:
        text = f"regexp_replace({text}, '(?ims)^\\s*{heading}.*?(^\\s*{stop}:|\\z)', chr(10) || '\\1', 'g')"
    return text


def _words(headings: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in headings) + ")"


@query(f"SELECT index, {_cut('text', [re.escape(h) for h in PLAIN_HEADINGS], '[A-Z\\s/-]+')} AS text FROM {{notes}}")
def section_removal(spark, d):
    """Hand-worked cases, also of sections in a row, are in the tests."""
    return in_spark(spark, d, "notes").select("index", T.without_plain_sections(F.col("text")).alias("text"))


@query(f"SELECT index, {_cut('text', [_words(f) + '\\s*:' for f in HOSPITAL_FAMILIES], _words(HOSPITAL_STOPS) + '\\s*')} AS text FROM {{notes}}")
def hospital_section_removal(spark, d):
    return in_spark(spark, d, "notes").select("index", T.without_hospital_sections(F.col("text")).alias("text"))


@query("SELECT index, regexp_replace(text, '\\n\\s*(Physical Exam|Physical Examination|PE|Admission PE|Pertinent Results)\\s*:.*$', '', 'is') AS text FROM {notes}")
def slice_at_exam(spark, d):
    return in_spark(spark, d, "notes").select("index", T.sliced_at_exam(F.col("text")).alias("text"))


@query()
def token_list_parse(spark, d):
    """Sequential over tokens; tested by hand-worked cases."""
    rows = in_spark(spark, d, "lists")
    return tokens.token_lists(rows.select("index", F.split("text", r"(?<= )|(?=\n)|(?<=\n)").alias("tokens")))


# ---- graph

def _valid(spark, d):
    return graph.valid_edges(in_spark(spark, d, "kg"))


@query("SELECT * FROM {nodes}")
def kg_nodes(spark, d):
    return graph.nodes(_valid(spark, d))


@query("SELECT * FROM {weighted}")
def kg_edges_weighted(spark, d):
    return graph.weighted_edges(_valid(spark, d))


@query("SELECT * FROM {degree}")
def kg_degree(spark, d):
    return graph.degrees(graph.weighted_edges(_valid(spark, d)))


@query("SELECT index, type FROM {nodes} WHERE type IN ('disease', 'effect/phenotype')")
def expansion_targets(spark, d):
    return graph.targets(graph.nodes(_valid(spark, d))).select("index", "type")


@query("SELECT src, dst FROM {tree}")
def kg_hierarchy(spark, d):
    return graph.hierarchy(_valid(spark, d))


@query("SELECT src, dst, round(q, 9) AS q FROM {q}")
def transition_matrix(spark, d):
    return rounded(graph.transitions(graph.weighted_edges(_valid(spark, d))), 9)


_RANK = f"""ranks(k, index, rank) AS (
        SELECT 0, index, 1.0e0 / (SELECT count(*) FROM {{members}}) FROM {{members}}
        UNION ALL
        SELECT min(k) + 1, index, 0.15e0 / (SELECT count(*) FROM {{members}}) + 0.85e0 * sum(x) FROM (
            SELECT r.k, m.dst AS index, r.rank * m.q AS x FROM ranks r JOIN {{moves}} m ON r.index = m.src WHERE r.k < {SETTINGS.rank_steps}
            UNION ALL
            SELECT r.k, t.index, l.loose / (SELECT count(*) FROM {{members}}) FROM ranks r JOIN {{members}} t ON r.index = t.index
                CROSS JOIN (SELECT sum(rank) AS loose FROM ranks WHERE index NOT IN (SELECT src FROM {{moves}})) l WHERE r.k < {SETTINGS.rank_steps})
        GROUP BY index),
    changes AS (SELECT k, sum(abs(d)) AS change FROM (SELECT k, rank - lag(rank) OVER (PARTITION BY index ORDER BY k) AS d FROM ranks) GROUP BY k),
    last AS (SELECT coalesce(min(k), {SETTINGS.rank_steps}) AS k FROM changes WHERE change < 1e-6 * (SELECT count(*) FROM {{members}}))"""


@query("SELECT index, round(-ln(rank), 6) AS specificity FROM ranks WHERE k = (SELECT k FROM last)", _RANK)
def pagerank_specificity(spark, d):
    edges = _valid(spark, d)
    tree = graph.hierarchy(edges).checkpoint()
    ranks = graph.pagerank(tree, graph.hierarchy_nodes(tree, graph.nodes(edges)).checkpoint(), SETTINGS.rank_steps, SETTINGS.damping)
    return rounded(graph.specificity(ranks))


_P0 = "SELECT note, index, 1.0e0 / count(*) OVER (PARTITION BY note) AS prob FROM {starts} WHERE index IN (SELECT index FROM {nodes})"


def _walk(steps: int) -> str:
    return f"""start AS ({_P0}), walk(k, note, index, p) AS (
        SELECT 0, note, index, prob FROM start
        UNION ALL
        SELECT min(k) + 1, note, index, sum(p) FROM (
            SELECT w.k, w.note, q.dst AS index, 0.8e0 * w.p * q.q AS p FROM walk w JOIN {{q}} q ON w.index = q.src WHERE w.k < {steps}
            UNION ALL
            SELECT m.k, s.note, s.index, 0.2e0 * s.prob FROM start s JOIN (SELECT note, min(k) AS k FROM walk GROUP BY note) m ON s.note = m.note WHERE m.k < {steps})
        GROUP BY note, index)"""


# a note's walk ends with its first step that changes less than the tolerance
_STOPPED = f"""{_walk(SETTINGS.walk_steps)},
    changes AS (
        SELECT note, k, sum(abs(p - coalesce(was, 0))) AS change
        FROM (SELECT *, lag(p) OVER (PARTITION BY note, index ORDER BY k) AS was FROM walk) WHERE k > 0 GROUP BY 1, 2),
    last AS (SELECT note, coalesce(min(k) FILTER (change < 1e-6), {SETTINGS.walk_steps}) AS k FROM changes GROUP BY 1),
    walked AS (SELECT w.note, w.index, w.p FROM walk w JOIN last USING (note, k))"""


def _even_starts(spark, d):
    known = in_spark(spark, d, "starts").join(graph.nodes(_valid(spark, d)).select("index"), "index", "left_semi")
    n = known.groupBy("note").agg((F.lit(1.0) / F.count("*")).alias("prob"))
    return known.join(n, "note")


@query("SELECT note, index, round(p, 9) AS p FROM walked", _STOPPED)
def rwr_fixed_k(spark, d):
    """At most 50 steps, fewer where a note's change falls below the tolerance."""
    q = graph.transitions(graph.weighted_edges(_valid(spark, d))).checkpoint()
    return rounded(graph.walk_in_memory(q, _even_starts(spark, d), SETTINGS.walk_steps, SETTINGS.restart_rate, SETTINGS.walk_tolerance), 9)


@query("SELECT note, index, round(p, 9) AS p FROM walked", _STOPPED)
def rwr_by_joins(spark, d):
    """The form for graphs beyond memory, with the same steps and stopping rule."""
    q = graph.transitions(graph.weighted_edges(_valid(spark, d))).checkpoint()
    return rounded(graph.walk(q, _even_starts(spark, d), SETTINGS.walk_steps, SETTINGS.restart_rate, SETTINGS.walk_tolerance), 9)


_ANCHORS = """known AS (SELECT s.note, s.index, e.embedding FROM {starts} s JOIN {nodes} n USING (index) LEFT JOIN (SELECT 'P' || CAST(vec_id AS VARCHAR) AS id, embedding FROM {embeddings}) e USING (id)),
    parts AS (SELECT note, index, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM known WHERE embedding IS NOT NULL),
    centre AS (SELECT note, i, avg(CAST(x AS DOUBLE)) AS c FROM parts GROUP BY 1, 2),
    cosines AS (SELECT note, index, sum(x * CAST(c AS DOUBLE)) / nullif(sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(sum(c * c)), 0) AS cos FROM parts JOIN centre USING (note, i) GROUP BY 1, 2),
    weighed AS (SELECT note, index, coalesce((cos + 1) / 2, 1) AS "C", coalesce(ln(d.degree + 1), 1.0e0) AS "S" FROM known k LEFT JOIN cosines USING (note, index) LEFT JOIN {degree} d USING (index))"""


def _anchors(spark, d):
    """Specificity stands in as ln(degree + 1)."""
    edges = _valid(spark, d)
    special = graph.degrees(graph.weighted_edges(edges)).select("index", F.log(F.col("degree") + 1).alias("specificity"))
    vectors = in_spark(spark, d, "embeddings").select(F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("node_id"), F.col("embedding").alias("vec"))
    return graph.anchors(in_spark(spark, d, "starts"), graph.nodes(edges), vectors, special)


@query('SELECT note, index, round("C", 6) AS "C", round("S", 6) AS "S", round("C" * "S", 6) AS "W", round("C" * "S" / sum("C" * "S") OVER (PARTITION BY note), 6) AS prob FROM weighed', _ANCHORS)
def anchor_personalization(spark, d):
    return rounded(_anchors(spark, d))


@query("SELECT index, disease, round((rank() OVER (PARTITION BY index ORDER BY uq_pure) - 1) / CAST(count(*) OVER (PARTITION BY index) AS DOUBLE), 6) AS share_below FROM {scored}")
def percentile_rank(spark, d):
    return rounded(graph.share_below(in_spark(spark, d, "scored"), "index", "uq_pure").select("index", "disease", "share_below"))


# ---- linking and expansion

_COSINES = """SELECT a.vec_id AS entity, b.vec_id AS index, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) /
    (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS sim
    FROM embeddings a CROSS JOIN embeddings b"""


def _near(spark, d):
    rows = in_spark(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return linking.nearest(rows.withColumnRenamed("vec_id", "entity"), rows.withColumnRenamed("vec_id", "index"))


@query(f"SELECT entity, index, round(sim, 5) AS sim, CAST(row_number() OVER (PARTITION BY entity ORDER BY sim DESC, index) AS INT) AS rank FROM ({_COSINES}) QUALIFY rank <= 5")
def entity_link_topk(spark, d):
    return rounded(_near(spark, d), 5)


@query(f"SELECT entity, arg_max(index, sim) AS index, round(max(sim), 5) AS sim FROM (SELECT * FROM ({_COSINES}) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY sim DESC, index) <= 5) WHERE sim >= 0.3 AND index % 3 <> 0 GROUP BY 1")
def entity_link(spark, d):
    """First match at threshold 0.3 whose node isn't divisible by 3, which stands in for entailment."""
    near = _near(spark, d).checkpoint()  # read twice
    return rounded(linking.linked(near, near.where("index % 3 <> 0"), 0.3), 5)


@query("SELECT index, round(count(DISTINCT node) / 10.0e0, 6) AS rate FROM (SELECT l_suppkey AS index, l_partkey % 10 AS node FROM lineitem) GROUP BY 1")
def mapping_rate(spark, d):
    rows = in_spark(spark, d, "lineitem").select(F.col("l_suppkey").alias("index"), (F.col("l_partkey") % 10).alias("node"))
    return rounded(linking.mapping_rates(rows, rows.select("index").distinct().withColumn("total", F.lit(10))))


_EXPANDED = f"""{_STOPPED}, scores AS (
        SELECT w.note, w.index, greatest(0, w.p - 0.2e0 * coalesce(s.prob, 0)) / log10(d.degree + 10) AS score, s.index IS NOT NULL AS generated
        FROM walked w LEFT JOIN start s USING (note, index) JOIN {{degree}} d USING (index)),
    limits AS (SELECT note, coalesce(avg(score) FILTER (score > 0 AND generated), 0) AS threshold FROM scores GROUP BY 1),
    top AS (SELECT s.*, n.name, row_number() OVER (PARTITION BY note ORDER BY score DESC, index) AS rank FROM scores s JOIN {{nodes}} n USING (index)
            WHERE n.type IN ('disease', 'effect/phenotype') AND NOT generated QUALIFY rank <= 5),
    names AS (SELECT note, lower(n.name) AS name FROM start s JOIN {{nodes}} n USING (index))"""


def _expansion(spark, d):
    """(scores, generated, nodes): the start nodes stand in for what was generated."""
    edges = _valid(spark, d)
    plain, nodes, starts = graph.weighted_edges(edges).checkpoint(), graph.nodes(edges).checkpoint(), _even_starts(spark, d).checkpoint()
    made = starts.join(nodes, "index").select("note", "index", F.col("name").alias("disease"))
    return expansion.scored(graph.transitions(plain).checkpoint(), starts, graph.degrees(plain), graph.targets(nodes), made, SETTINGS), made, nodes


@query("SELECT note, index, CAST(rank AS INT) AS rank, round(score, 9) AS score FROM top", _EXPANDED)
def expansion_top(spark, d):
    """The five target nodes of greatest score that aren't generated, before threshold and names."""
    return rounded(_expansion(spark, d)[0].where("rank IS NOT NULL").select("note", "index", "rank", "score"), 9)


@query("SELECT note, index, name AS disease, round(score, 9) AS score FROM top JOIN limits USING (note) WHERE score > threshold AND NOT EXISTS (SELECT 1 FROM names x WHERE x.note = top.note AND x.name = top.name) QUALIFY row_number() OVER (PARTITION BY note, name ORDER BY rank) = 1", _EXPANDED)
def expansion_candidates(spark, d):
    scores, made, nodes = _expansion(spark, d)
    scores = scores.checkpoint()
    return rounded(expansion.candidates(scores, made, expansion.thresholds(scores.where("rank IS NULL")), nodes), 9)


@query("SELECT index, disease, round(uq_pure, 6) AS tf_logits_expanded FROM {scored} WHERE uq_pure >= 0.5")
def forced_threshold(spark, d):
    rows = in_spark(spark, d, "scored").withColumnRenamed("uq_pure", "tf_logits_expanded")
    return rounded(expansion.forced(rows, "pure_logits", 0.5).select("index", "disease", "tf_logits_expanded"))


@query("SELECT index, disease, (lower(disease) LIKE '%disease%' OR lower(disease) LIKE '%effect%' OR lower(disease) LIKE '%phenotype%') AS valid FROM (SELECT index, type AS disease FROM {nodes})")
def mapped_type(spark, d):
    return graph.nodes(_valid(spark, d)).select("index", F.col("type").alias("disease"), expansion.right_type(F.col("type")).alias("valid"))


# ---- resumption

@query("SELECT doc_id AS index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return tables.remaining(in_spark(spark, d, "documents").select(F.col("doc_id").alias("index")), in_spark(spark, d, "labels").select(F.col("doc_id").alias("index")))


@query("SELECT doc_id AS index, CAST(NULL AS VARCHAR) AS disease, 0.0e0 AS uq FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'q' || CAST(quality AS VARCHAR), CAST(toxic AS DOUBLE) FROM labels")
def placeholder_rows(spark, d):
    found = in_spark(spark, d, "labels").select(F.col("doc_id").alias("index"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("disease"), F.col("toxic").cast("double").alias("uq"))
    return expansion.with_placeholders(in_spark(spark, d, "documents").select(F.col("doc_id").alias("index")), found, {"uq": 0.0})


@query("SELECT o_orderkey AS index FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) BETWEEN 101 AND 1100")
def row_range(spark, d):
    """The reference's own feature: rows 100 up to 1100 by place."""
    return tables.in_range(in_spark(spark, d, "orders").select(F.col("o_orderkey").alias("index")), 100, 1100)


@query("SELECT index, coalesce(entities, []) AS entities FROM (SELECT doc_id AS index FROM documents) LEFT JOIN (SELECT doc_id AS index, ['q' || CAST(quality AS VARCHAR)] AS entities FROM labels) USING (index)")
def note_entities(spark, d):
    found = in_spark(spark, d, "labels").select(F.col("doc_id").alias("index"), F.array(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("entities"))
    return tables.with_entities(in_spark(spark, d, "documents").select(F.col("doc_id").alias("index")), found)


# ---- what models answer, with stand-ins for the answers

@query(
    """SELECT index, arg_min(disease, (sample_id, ord, disease)) AS disease, round(count(DISTINCT sample_id) / 100.0e0, 6) AS uq
       FROM {samples} GROUP BY index, split_part(lower(trim(disease)), ' ', 1)"""
)
def entailed_clusters(spark, d):
    """Names of one first word entail one another, in one direction of the two that are asked for."""
    names = in_spark(spark, d, "samples")
    first = lambda c: F.split(c, " ")[0]
    judged = sampling.name_pairs(names).withColumns({"forward": F.when(first("a") == first("b"), 0.9).otherwise(0.1), "backward": F.lit(0.1)})
    return rounded(sampling.leader_clusters(names, sampling.entailed_pairs(judged).select("index", "a", "b")))


@query(ORACLES["entailed_clusters"])
def clusters_by_rounds(spark, d):
    """The same, asking in each round about pairs of a leader and a name."""
    first = lambda c: F.split(F.lower(F.trim(c)), " ")[0]
    return rounded(sampling.clusters_by_rounds(in_spark(spark, d, "samples"), lambda pairs: pairs.where(first("leader") == first("name"))))


_ENTRIES = "SELECT index, max(upper(item)) AS entry FROM {gains} GROUP BY 1"


@query(
    f"""SELECT index, disease AS original, coalesce(r.exact, entry, disease) AS aligned,
               CASE WHEN r.exact IS NOT NULL THEN 'Exact' WHEN lower(coalesce(entry, disease)) <> lower(disease) THEN 'Aligned' ELSE 'Unmatched' END AS status
        FROM (SELECT DISTINCT index, disease, lower(trim(disease)) AS key FROM {{scored}})
        LEFT JOIN (SELECT index, lower(trim(item)) AS key, max(upper(item)) AS exact FROM {{gains}} GROUP BY 1, 2) r USING (index, key) LEFT JOIN ({_ENTRIES}) USING (index)"""
)
def aligned_by_answer(spark, d):
    """The answer stands in as the note's last entry, quoted and in lower case."""
    rows, spelt = in_spark(spark, d, "scored"), _spelt(spark, d)
    said = spelt.groupBy("index").agg(F.concat(F.lit("'"), F.lower(F.max("disease")), F.lit("'")).alias("answer"))
    answers = evaluate.distinct_items(rows).withColumnRenamed("disease", "original").join(said, "index")
    return evaluate.aligned(rows, spelt, answers)


@query("SELECT index, array_to_string(CASE WHEN len(tokens) > 50 THEN tokens[-50:] ELSE tokens END, ' ') AS text FROM (SELECT index, string_split(text, ' ') AS tokens FROM {notes} WHERE text IS NOT NULL)")
def last_tokens(spark, d):
    """The cut to a model's last tokens is the feature; blanks stand in for a tokenizer."""
    rows = in_spark(spark, d, "notes").where("text IS NOT NULL")
    return rows.select("index", F.array_join(T.last_tokens(F.split("text", " "), 50), " ").alias("text"))


@query(
    """SELECT vec_id AS index, round(-list_sum(list_transform(e, lambda x: x / s * ln(x / s + 1e-9))), 6) AS entropy
       FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS e, list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))) AS s FROM embeddings)"""
)
def logit_entropy(spark, d):
    """Vectors stand in for a token's logits."""
    rows = in_spark(spark, d, "embeddings").select(F.col("vec_id").alias("index"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    return rounded(rows.select("index", N.entropy(N.softmax(F.col("logits"))).alias("entropy")))


@query("SELECT vec_id AS index, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS first, 64 AS size FROM embeddings")
def normalised_vectors(spark, d):
    rows = linking.normalised_vectors(in_spark(spark, d, "embeddings").select(F.col("vec_id").alias("index"), F.col("embedding").alias("vec")))
    return rounded(rows.select("index", F.col("vec")[0].alias("first"), F.size("vec").alias("size")))


_LINKS = "SELECT DISTINCT disease AS name, length(disease) % 7 AS node_index, upper(disease) AS node, 0.70037e0 + length(disease) / 100e0 AS sim FROM {scored} WHERE length(disease) % 3 <> 0"
_DETAILS = f"""SELECT s.index, disease, is_expanded, node_index, CASE WHEN l.name IS NULL THEN disease || ' -> UNMAPPED' ELSE disease || '  -> mapped ->  ' || node || ' (Bi:' || printf('%.2f', sim) || ')' END AS detail
    FROM {{scored}} s LEFT JOIN ({_LINKS}) l ON disease = name"""


@query(
    f"""SELECT index, round(count(DISTINCT node_index) / CAST(count(*) AS DOUBLE), 6) AS qwen_mapping_rate, string_agg(detail, ' | ' ORDER BY disease) AS qwen_similarities, count(DISTINCT node_index) AS num_starting_nodes,
               round(coalesce(count(*) FILTER (is_expanded AND node_index % 2 = 0) / nullif(CAST(count(*) FILTER (is_expanded) AS DOUBLE), 0), 0), 6) AS kg_mapping_rate,
               coalesce(string_agg(detail, ' | ' ORDER BY disease) FILTER (is_expanded AND node_index % 2 = 0), 'None') AS kg_similarities
        FROM ({_DETAILS}) GROUP BY 1"""
)
def mapping_stats(spark, d):
    """Links by the length of names; expanded names stand in for generated ones, nodes of even number for those of a fitting type."""
    rows = in_spark(spark, d, "scored").select(F.col("index").alias("note"), F.col("disease").alias("ord"), F.col("disease").alias("name"), "is_expanded")
    size = F.length("name")
    links = rows.select("name").distinct().where(size % 3 != 0).select("name", (size % 7).cast("long").alias("index"), F.upper("name").alias("node"), (F.lit(0.70037) + size / 100).alias("sim"))
    details = lambda x: linking.mapping_details(x.select("note", "ord", "name"), links)
    valid = spark.range(0, 8, 2).select(F.col("id").alias("index"))
    return rounded(linking.mapping_stats(rows.select(F.col("note").alias("index")), details(rows), details(rows.where("is_expanded")), valid))


@query('SELECT note AS note_index, name AS node_name, round("C", 6) AS "C", round("S", 6) AS "S", round("C" * "S", 6) AS "W", round("C" * "S" / sum("C" * "S") OVER (PARTITION BY note), 6) AS prob FROM weighed JOIN {nodes} USING (index)', _ANCHORS)
def walk_stats(spark, d):
    nodes = graph.nodes(_valid(spark, d))
    return rounded(sinks.walk_stats(_anchors(spark, d), nodes))


# ---- sources and sinks: what is written comes back

@query("SELECT index, text FROM {notes} QUALIFY row_number() OVER (ORDER BY index) > 100")
def notes_scan(spark, d):
    """Notes as quoted CSV with line feeds, appended in two halves and read from the 100th on by place, as a run that goes on does."""
    rows, path = in_spark(spark, d, "notes").withColumnRenamed("text", "discharge_summary"), sinks.scratch(spark, "notes")
    for half in (0, 1):
        sinks.append_csv(rows.where(F.col("index") % 2 == half), path)
    return tables.notes(spark, path, Settings(start_index=100))


@query("SELECT doc_id AS index, CASE WHEN toxic = 1 THEN ['again', lang] ELSE [lang] END AS entities FROM documents JOIN labels USING (doc_id)")
def entities_scan(spark, d):
    """Entities as JSON lines; of the lines of one index the last holds, in file order."""
    path = sinks.scratch(spark, "entities")
    rows = in_spark(spark, d, "documents").join(in_spark(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("index"), "lang", "toxic")
    first = rows.select("index", F.lit(0).alias("turn"), F.array("lang").alias("entities"))
    again = rows.where("toxic = 1").select("index", F.lit(1).alias("turn"), F.array(F.lit("again"), "lang").alias("entities"))
    sinks.append_json(first.union(again).coalesce(1).sortWithinPartitions("turn").drop("turn"), path)
    return tables.entities(spark, path)


@query("SELECT DISTINCT doc_id AS index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def done_scan(spark, d):
    """What remains after an output in CSV and one in JSON lines, of which only the index is read."""
    labels, csv, json = in_spark(spark, d, "labels").withColumnRenamed("doc_id", "index"), sinks.scratch(spark, "done"), sinks.scratch(spark, "done")
    sinks.append_csv(labels.where("quality = 1"), csv)
    sinks.append_json(labels.where("quality = 0"), json)
    rows = in_spark(spark, d, "documents").select(F.col("doc_id").alias("index")).distinct()
    return tables.remaining(tables.remaining(rows, tables.done(spark, csv)), tables.done(spark, json, "json"))


@query("SELECT * FROM {weighted}")
def kg_scan(spark, d):
    """The graph as CSV in files of about FILE_ROWS rows, two at least, written in order of ord; the last row of a pair in (file, line) order
    sets its weight."""
    path = sinks.scratch(spark, "kg")
    columns = ["x_index", "x_id", "x_type", "x_name", "y_index", "y_id", "y_type", "y_name", "display_relation"]
    weight = graph.relation_weight()
    files = max(2, -(-in_spark(spark, d, "lineitem").count() // FILE_ROWS))
    rows = in_spark(spark, d, "kg").repartitionByRange(files, "ord", weight).sortWithinPartitions("ord", weight)
    sinks.append_csv(rows.select(*columns), path)
    return graph.weighted_edges(graph.valid_edges(tables.kg_edges(spark, path)))


@query("SELECT index, disease, round(uq_pure, 6) AS uq_pure FROM {scored}")
def score_scan(spark, d):
    """A method's file, with headers in capitals and the score under one of its names."""
    path = sinks.scratch(spark, "scores")
    sinks.append_csv(in_spark(spark, d, "scored").select(F.col("index").alias("INDEX"), F.col("disease").alias("Disease"), F.col("uq_pure").alias("CCP_SCORE")), path)
    return rounded(tables.scores(spark, path, "pure"))


@query("SELECT index, disease, round(uq_pure, 6) AS score_full FROM {scored} WHERE NOT is_expanded")
def predictions_scan(spark, d):
    """Predictions as CSV; expanded rows go as they are read, and one method is taken."""
    path = sinks.scratch(spark, "predictions")
    sinks.append_csv(in_spark(spark, d, "scored"), path)
    return rounded(tables.method_scores(tables.predictions(spark, path, Settings(ignore_expansion=True)), "uq_pure", "full"))


@query("SELECT index, method, item, round(score, 6) AS score FROM {long}")
def method_table(spark, d):
    """One table with a folder for each method."""
    path = sinks.scratch(spark, "methods")
    sinks.by_method(_long(spark, d), path)
    return rounded(spark.read.parquet(path).select("index", "method", "item", "score"))


@query("SELECT l_suppkey AS index, 'mimic' AS dataset, 'llama' AS model, 'full' AS mode, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'mimic', 'llama', 'sliced', count(*) FROM lineitem GROUP BY 1")
def output_table(spark, d):
    """Outputs of two runs in one table, in folders by data set, model and mode; an earlier one was reset."""
    path, rows = sinks.scratch(spark, "outputs"), in_spark(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("index")).agg(F.count("*").alias("n"))
    for mode in ("full", "sliced"):
        setting = Settings(mode=mode)
        sinks.append_table(rows, path, setting, "counts")
        sinks.reset(rows, f"{path}/{setting.output('counts')}")
        sinks.append_table(rows, path, setting, "counts")
    return spark.read.parquet(f"{path}/counts").select("index", "dataset", "model", "mode", "n")


@query("SELECT method, count(*) AS n, round(avg(mrr), 6) AS mrr FROM {metrics} GROUP BY 1")
def summary_scan(spark, d):
    """The summary's one CSV file."""
    path = sinks.scratch(spark, "summary")
    sinks.summary_csv(evaluate.summary(evaluate.note_metrics(_long(spark, d), _gains(spark, d))), path)
    return rounded(tables.csv(spark, path, "method string, n long, mrr double"))
