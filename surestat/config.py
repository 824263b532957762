"""Parameters and switches, and the fixed values that results depend on."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# ---- Fixed values -------------------------------------------------------------------------------------------------
# Relations that enter the graph, lower case, and their weights.
RELATION_WEIGHTS = {
    "phenotype present": 5.0,
    "indication": 3.0,
    "off-label use": 3.0,
    "parent-child": 1.0,
    "associated with": 1.0,
    "side effect": 1.0,
    "target": 1.0,
    "enzyme": 1.0,
    "transporter": 1.0,
    "carrier": 1.0,
}
HIERARCHY_RELATION = "parent-child"
TARGET_TYPES = ["disease", "effect/phenotype"]
MAPPED_TYPE_WORDS = ["disease", "effect", "phenotype"]

# Headings of sections that are removed from plainly structured notes; the last only from sliced ones.
PLAIN_HEADINGS = ["PAST MEDICAL HISTORY:", "SOCIAL AND FAMILY HISTORY:", "PHYSICAL EXAMINATION:", "DISCHARGE DIAGNOSIS:"]
PLAIN_HEADINGS_SLICED = ["HOSPITAL COURSE:"]

# Heading families of sections that are removed from hospital notes.
HOSPITAL_FAMILIES = [
    ["Past Medical History", "PMH", "Past Psychiatric History", "Medical History"],
    ["Social History", "Social Hx"],
    ["Family History", "Family Hx"],
    ["SOCIAL/FAMILY HX", "Social/Family History"],
    ["Discharge Diagnosis", "Discharge Diagnoses", "Primary Diagnosis", "Primary Diagnoses", "Final Diagnosis", "Final Diagnoses", "Secondary Diagnoses"],
    ["Discharge Medications", "Discharge Meds", "Medications on Discharge", "Medications at Discharge"],
    ["Inactive Issues", "Chronic Issues"],
    ["Medications on Admission", "Admission Medications", "Admission Meds", "Medications at Admission", "Pre-admission Medications", "Preadmission Medications"],
]
# Headings of hospital notes at which a removed section ends.
HOSPITAL_STOPS = [
    "Admission Date", "Discharge Date", "Date of Birth", "Sex", "Service",
    "Allergies", "Attending", "Chief Complaint", "Major Surgical or Invasive Procedure",
    "History of Present Illness", "HPI", "Past Medical History", "PMH",
    "Social History", "Family History", "Physical Exam", "PE", "Admission Physical Exam",
    "Physical Examination", "Pertinent Results", "Labs on Admission", "Labs on Discharge",
    "Imaging", "Brief Hospital Course", "Hospital Course", "Medications on Admission",
    "Admission Medications", "Discharge Medications", "Discharge Disposition",
    "Discharge Diagnosis", "Discharge Diagnoses", "Primary Diagnosis", "Final Diagnosis",
    "Discharge Condition", "Discharge Instructions", "Followup Instructions",
    "Review of Systems", "ROS", "Inactive Issues", "Admission Diagnosis",
    "Discharge Status", "Condition on Discharge", "Discharge",
    "Active Issues", "Transitional Issues", "Code Status", "Disposition",
]
# Headings at which a sliced hospital note is cut; the last is left out by the parity switch for extraction.
EXAM_HEADINGS = ["Physical Exam", "Physical Examination", "PE", "Admission PE", "Pertinent Results"]

# Phrases that begin an explanation after a name.
ENTAILMENT_SENTENCE = "The patient is diagnosed with {}."
MAPPED_DETAIL, UNMAPPED_DETAIL, DETAIL_SEPARATOR, NO_DETAIL = "%s  -> mapped ->  %s (Bi:%s)", "%s -> UNMAPPED", " | ", "None"
EXPLANATIONS = ["cannot be", "due to", "secondary to", "despite", "likely", "possible", "probable", "concerning for", "rule out", "suspected"]
# -------------------------------------------------------------------------------------------------------------------

METHODS = ["uq_pure", "uq_seq_prob", "uq_neg_ent", "uq_max_logprob", "uq_min_logprob", "uq_ccp", "uq_kg", "kg_only", "uq_rrf"]
WITH_EXPANSION = ["uq_kg", "kg_only", "uq_rrf"]
LOG_SCALE = ["uq_neg_ent", "uq_max_logprob", "uq_min_logprob"]
METRICS = ["ndcg_5", "ndcg_10", "ndcg_std", "rbo", "mrr", "recall_5", "recall_10", "precision_5", "precision_10", "kendall_tau_b"]

TEXT_COLUMNS = {"mimic": "discharge_summary", "pmc": "structured_output", "mtsamples": "structured_output"}


@dataclass(frozen=True)
class Parity:
    """True restores the quirk, False the plain rule."""

    strip_leading_t: bool = False  # the bullet strip also takes a name's first t
    step1_slice: bool = False  # extraction doesn't cut at Pertinent Results
    missing_text_is_nan: bool = False  # a missing note is the text "nan"


@dataclass(frozen=True)
class Settings:
    dataset: str = "mimic"
    model: str = "llama"
    mode: str = "full"
    start_index: int = 0
    end_index: int | None = None
    num_samples: int = 100
    batch_size: int = 10
    reference_floor: float = 0.05
    top_k_ccp: int = 5
    top_k_kg: int = 5
    alpha: float = 0.25
    restart_rate: float = 0.2
    walk_steps: int = 50
    walk_tolerance: float = 1e-6
    damping: float = 0.85
    rank_steps: int = 100
    tf_threshold_type: str = "min_logprob"
    tf_threshold_val: float = -12.6
    link_threshold: float = 0.70
    link_k: int = 5
    veto: float = 0.01
    rrf_k: int = 10
    rbo_p: float = 0.9
    limit_index: int | None = None
    ignore_expansion: bool = False
    entailment_mode: str = "either"  # or "both"
    note_tokens: int = 7300
    extraction_tokens: int = 7000
    parity: Parity = field(default_factory=Parity)

    @property
    def text_column(self) -> str:
        return TEXT_COLUMNS[self.dataset]

    @property
    def sliced(self) -> bool:
        return self.mode == "sliced"

    def output(self, kind: str) -> str:
        """Name of an output of this run, as partition folders rather than a file for each combination."""
        tail = "/ignore_expansion=true" if self.ignore_expansion else ""
        return f"{kind}/dataset={self.dataset}/model={self.model}/mode={self.mode}{tail}"


def paths_from_environment() -> dict[str, str | None]:
    """Places of the graph and the embeddings, and the model hub's token, from the environment."""
    return {name: os.environ.get(name) for name in ("KG_PATH", "KGE_EMB_PATH", "KGE_MAP_PATH", "HF_TOKEN")}
