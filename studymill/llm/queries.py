"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, importance, language, media, mixing, near_dedup, periodic, quality, sharding, substring_dedup, token_counts, topk, toxicity
from .common import documents


def op1(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir))


def op2(spark, sf_dir):
    return bpe.encode_digests(documents(spark, sf_dir), memo=bpe.ROOMY)


QUERIES = {
    "op1_token_counts": op1,
    "op2_bpe": op2,
    "op3_toxicity": toxicity.op3,
    "op4_substring_dedup": substring_dedup.op4,
    "op5_source_mix": mixing.op5,
    "op6_quality_classifier": quality.op6,
    "op7_media_png": media.op7,
    "op8_near_dedup": near_dedup.op8,
    "op9_ring_sharding": sharding.op9,
    "op10_topk_search": topk.op10,
    "op11_periodic_runs": periodic.op11,
    "op12_language_id": language.op12,
    "op13_importance_resampling": importance.op13,
}
ORACLE = {"op5_source_mix": mixing.ORACLE, "op10_topk_search": topk.ORACLE, "op13_importance_resampling": importance.ORACLE}
