"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from ctxforge.llm.bpe import op7_bpe_forced_boundaries
from ctxforge.llm.chat_format import op6_chat_format
from ctxforge.llm.dual_tree_lloyd import OP11_SQL, op11_dual_tree_lloyd
from ctxforge.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from ctxforge.llm.language_id import op8_language_id
from ctxforge.llm.line_dedup import OP4_SQL, op4_line_dedup
from ctxforge.llm.lm_score import op5_lm_context_mixing
from ctxforge.llm.packing import op9_best_fit_packing
from ctxforge.llm.permutation_index import op1_permutation_index
from ctxforge.llm.secrets import op2_secret_scan
from ctxforge.llm.simhash import op3_simhash_near_dedup
from ctxforge.llm.suffix_dedup import OP12_SQL, op12_suffix_dedup
from ctxforge.llm.token_alignment import op13_token_alignment

QUERIES = (
    op1_permutation_index,
    op2_secret_scan,
    op3_simhash_near_dedup,
    op4_line_dedup,
    op5_lm_context_mixing,
    op6_chat_format,
    op7_bpe_forced_boundaries,
    op8_language_id,
    op9_best_fit_packing,
    op10_exact_dedup,
    op11_dual_tree_lloyd,
    op12_suffix_dedup,
    op13_token_alignment,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op10_exact_dedup": OP10_SQL, "op11_dual_tree_lloyd": OP11_SQL, "op12_suffix_dedup": OP12_SQL}
