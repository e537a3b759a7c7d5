"""Operators of a training-data pipeline. Importing the subpackage registers their queries."""

from freightloom.llm import audit, collocations
from freightloom.llm.audit import op11_filter_audit
from freightloom.llm.bpe import op2_bpe
from freightloom.llm.byte_bpe import op12_byte_bpe
from freightloom.llm.collocations import op13_collocations
from freightloom.llm.jaccard import op5_jaccard_join
from freightloom.llm.language import op4_language_id
from freightloom.llm.lm import op3_lm_scoring
from freightloom.llm.mixing import op1_mixing
from freightloom.llm.registry import ORACLE, QUERIES, add
from freightloom.llm.repeats import op9_suffix_dedup
from freightloom.llm.rules import op10_quality_rules
from freightloom.llm.simhash import op7_simhash
from freightloom.llm.token_files import op6_token_files
from freightloom.llm.viterbi import op8_token_counts

for _query in (
    op1_mixing, op2_bpe, op3_lm_scoring, op4_language_id, op5_jaccard_join, op6_token_files, op7_simhash, op8_token_counts, op9_suffix_dedup, op10_quality_rules, op12_byte_bpe,
):
    add(_query.__name__, _query)
add("op11_filter_audit", op11_filter_audit, audit.SQL)
add("op13_collocations", op13_collocations, collocations.SQL)

__all__ = ["ORACLE", "QUERIES"]
