"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op6_hash_prefix_forest
from .bpe import op9_bpe_roundtrip
from .langid import op5_language_id
from .linededup import OP2_BY_LANGUAGE_SQL, OP2_PAGES_SQL, OP2_SQL, op2_line_dedup, op2_line_dedup_by_language, op2_line_dedup_pages
from .mixing import OP10_SQL, op10_mix_sources
from .neardup import op8_minmax_neardup
from .quality import op1_fertility_rules
from .tokencount import op3_token_counts
from .toxicity import op7_toxicity
from .urlfilter import op4_url_filter

QUERIES = {
    "op1_fertility_rules": op1_fertility_rules,
    "op2_line_dedup": op2_line_dedup,
    "op2_line_dedup_by_language": op2_line_dedup_by_language,
    "op2_line_dedup_pages": op2_line_dedup_pages,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_hash_prefix_forest": op6_hash_prefix_forest,
    "op7_toxicity": op7_toxicity,
    "op8_minmax_neardup": op8_minmax_neardup,
    "op9_bpe_roundtrip": op9_bpe_roundtrip,
    "op10_mix_sources": op10_mix_sources,
}

ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op2_line_dedup_by_language": OP2_BY_LANGUAGE_SQL,
    "op2_line_dedup_pages": OP2_PAGES_SQL,
    "op10_mix_sources": OP10_SQL,
}
