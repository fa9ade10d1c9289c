"""Queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from timberline.llm.chat_format import op2_chat_format
from timberline.llm.conversation_repair import op12_conversation_repair
from timberline.llm.decontamination import op8_decontamination
from timberline.llm.language_id import op4_language_id
from timberline.llm.line_dedup import op1_line_dedup
from timberline.llm.ngram_join import op10_ngram_join
from timberline.llm.oracles import ORACLES
from timberline.llm.pii import op5_pii
from timberline.llm.piece_sampling import op3_piece_sampling
from timberline.llm.quality_classifier import op7_quality_classifier
from timberline.llm.quality_rules import op9_quality_rules
from timberline.llm.toxicity import op6_toxicity
from timberline.llm.url_filters import op11_url_filters
from timberline.llm.vector_codes import op13_vector_codes

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_piece_sampling": op3_piece_sampling,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_join": op10_ngram_join,
    "op11_url_filters": op11_url_filters,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}
