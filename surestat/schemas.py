"""Declared schemas of every relation; nothing is inferred."""

from __future__ import annotations

from .config import METRICS

NOTES = "index long, text string"
ENTITIES = "index long, entities array<string>"
KG_EDGES = "x_index double, x_id string, x_type string, x_name string, y_index double, y_id string, y_type string, y_name string, display_relation string"
KG_NODES = "index long, id string, type string, name string"
KGE_MAP = "primekg_node_id string, matrix_index long"
KGE = "node_id string, vec array<float>"
KG_TEXT = "index long, name string, vec array<float>"
SAMPLES = "index long, sample_id int, ord long, disease string"
REFERENCE = "index long, disease string, uq double"
TOKEN_TRACE = "index long, disease string, pos int, prob double, entropy double"
CCP = "index long, disease string, rank int, prob double, entailed boolean"
PREDICTIONS = (
    "index long, disease string, uq_pure double, uq_seq_prob double, uq_neg_ent double, uq_max_logprob double, "
    "uq_min_logprob double, uq_ccp double, uq_kg double, kg_only double, is_expanded boolean, tf_logits_expanded double, "
    "tf_min_logprob_expanded double, uq_rrf double"
)
MAPPING_STATS = "index long, qwen_mapping_rate double, qwen_similarities string, num_starting_nodes long, kg_mapping_rate double, kg_similarities string"
WALK_STATS = "note_index long, node_name string, C double, S double, W double, prob double"
NOTE_METRICS = "index long, " + ", ".join(f"{m} double" for m in METRICS)
ALIGNMENT_LOG = "index long, original string, aligned string, status string"
OVERLAP = "index long, overlap_ratio double"
