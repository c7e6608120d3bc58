"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, langid, lm, mixing, neardup, pieces, quality, secrets, spotsigs, toxicity

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": langid.op7_language_id,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_spotsigs": spotsigs.op9_spotsigs,
    "op10_mixing": mixing.op10_mixing,
    # What SQL can express of the results above, to be held against it.
    "lm_base_scores": lm.lm_base_scores,
    "secret_base_counts": secrets.secret_base_counts,
    "spotsigs_likeness": spotsigs.spotsigs_likeness,
    # The fingerprints compared with each other in length partitions, with pruning.
    "spotsigs_classes": spotsigs.spotsigs_classes,
}

ORACLES = {
    "lm_base_scores": lm.LM_BASE_SQL,
    "secret_base_counts": secrets.SECRET_BASE_SQL,
    "spotsigs_likeness": spotsigs.SPOTSIGS_SQL,
    "spotsigs_classes": spotsigs.CLASSES_SQL,
    "op2_near_duplicates": neardup.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
}
