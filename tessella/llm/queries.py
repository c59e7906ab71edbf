"""The opN_<name> queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from tessella.llm import base_sql
from tessella.llm.fingerprint import op9_fingerprints
from tessella.llm.html_text import op6_html_text
from tessella.llm.langid import op2_language_id
from tessella.llm.line_dedup import OP7_SQL, op7_line_dedup
from tessella.llm.mixing import op10_mixing
from tessella.llm.neardup import OP1_SQL, op1_near_duplicates
from tessella.llm.pii import op3_pii
from tessella.llm.secrets import op5_secrets
from tessella.llm.sentencepiece_codec import op8_sentencepiece
from tessella.llm.topk import OP4_SQL, op4_exact_topk

QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_language_id,
        op3_pii,
        op4_exact_topk,
        op5_secrets,
        op6_html_text,
        op7_line_dedup,
        op8_sentencepiece,
        op9_fingerprints,
        op10_mixing,
    )
} | base_sql.QUERIES
ORACLES = {"op1_near_duplicates": OP1_SQL, "op4_exact_topk": OP4_SQL, "op7_line_dedup": OP7_SQL} | base_sql.ORACLES
