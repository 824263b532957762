"""The queries op1 to op10 and their SQL; operators that SQL can't express are tested against brute force instead."""

from . import bpe, dedup, langid, licenses, media, packing, pii, quality, sharding, topk

QUERIES = {
    "op1_quality": quality.query,
    "op2_near_duplicates": dedup.query,
    "op3_best_fit_packing": packing.query,
    "op4_media_columns": media.query,
    "op5_threshold_topk": topk.query,
    "op6_language_id": langid.query,
    "op7_sharding": sharding.query,
    "op8_byte_bpe": bpe.query,
    "op9_personal_data": pii.query,
    "op10_license_scan": licenses.query,
}
ORACLES = {
    "op2_near_duplicates": dedup.ORACLE,
    "op5_threshold_topk": topk.ORACLE,
    "op10_license_scan": licenses.oracle(),
}
