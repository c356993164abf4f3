"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from tidewright.llm import exact_dedup, substring_dedup
from tidewright.llm.context_mixing import op10_lm_score
from tidewright.llm.exact_dedup import op6_exact_dedup
from tidewright.llm.iso_media import op8_media_columns
from tidewright.llm.language_id import op5_language_id
from tidewright.llm.mixing import op7_mixing
from tidewright.llm.near_dedup import op1_near_dedup
from tidewright.llm.piece_codec import op4_pieces
from tidewright.llm.substring_dedup import op9_substring_dedup
from tidewright.llm.token_store import op2_token_store
from tidewright.llm.url_filter import op3_url_filter

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_token_store, op3_url_filter, op4_pieces, op5_language_id, op6_exact_dedup, op7_mixing, op8_media_columns, op9_substring_dedup, op10_lm_score)}
ORACLE_SQL = {"op6_exact_dedup": exact_dedup.SQL, "op9_substring_dedup": substring_dedup.SQL}
