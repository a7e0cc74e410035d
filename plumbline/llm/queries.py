"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from plumbline.llm.bpe import op9_byte_bpe
from plumbline.llm.extraction import op4_html_extraction
from plumbline.llm.hard_negatives import negatives_sql, op12_hard_negatives
from plumbline.llm.jaccard import jaccard_sql, op5_jaccard_join
from plumbline.llm.langid import op8_language_id
from plumbline.llm.lm_scoring import op10_lm_scoring
from plumbline.llm.near_vectors import near_sql, op7_near_vectors
from plumbline.llm.packing import op6_packing
from plumbline.llm.pivots import op11_pivot_search, pivot_sql
from plumbline.llm.quality import op2_quality_rules, quality_sql
from plumbline.llm.resampling import op13_importance_resampling
from plumbline.llm.sharding import op1_sharding, shard_sql
from plumbline.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_html_extraction": op4_html_extraction,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_near_vectors": op7_near_vectors,
    "op8_language_id": op8_language_id,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_pivot_search": op11_pivot_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {
    "op1_sharding": shard_sql(),
    "op2_quality_rules": quality_sql(),
    "op5_jaccard_join": jaccard_sql(),
    "op7_near_vectors": near_sql(),
    "op11_pivot_search": pivot_sql(),
    "op12_hard_negatives": negatives_sql(),
}
