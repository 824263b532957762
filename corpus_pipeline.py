"""Documents to packed training sequences in five stages; each works on all that the one before it kept.

run() stores every stage's result in the shared folder before the next begins, so a lost executor costs one stage's tasks.

Defined results of every stage: rows are judged one by one, whatever their ids, so null and repeated ids do no harm; further columns, also of names that
an operator uses itself, pass as they are up to the last stage; an empty table gives an empty one. What a stage does with null, empty
and very long texts, repeated rows and ties is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surestat.llm import dedup, langid, packing, pii, quality
from surestat.llm.common import table, written

#: A text is rejected if it has no letter or if no language has this share of its words.
LEAST_SHARE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language; a missing lang becomes the predicted one.

    Null, empty and letterless texts are rejected; every word of a long text counts; repeated rows fare alike; of languages
    with equal shares the first in order is predicted."""
    out = langid.predicted(docs, langid.train(docs), docs.columns, names=("__predicted", "__share"))
    kept = out.where((F.col("__predicted") != langid.UNDETERMINED) & (F.col("__share") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "__predicted")).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality.

    Null, empty and wordless texts are rejected; a null source or lang is a site of its own; measures are of the whole
    text; a quality of exactly the threshold is accepted; repeated rows fare alike; without labels all others are accepted."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8), that of the smallest doc_id.

    Rows are judged by their own texts: one of repeated rows stays; a text of its own stays though its id is also that of a copy;
    null ids come last; texts without words all stay."""
    return dedup.one_of_each(docs, k=5)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts and sets n_chars to their new length.

    Null and empty texts stay as they are, with n_chars null and 0; whole texts are searched; overlapping spans become one, of
    the kind that begins first, the longer of those; repeated rows fare alike."""
    out = pii.cleaned(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one token; longer ones than 2,048 are cut into pieces; rows of one id are packed each for itself; pieces of
    equal length are interchangeable, and which goes where isn't defined."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("near_duplicates", dedup_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the trained models, so the pipeline is tested against its operators stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
