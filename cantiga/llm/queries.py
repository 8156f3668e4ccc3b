"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat_formatting
from .exact import OP5_SQL, op5_exact_dedup
from .hmm import op2_hmm_scoring
from .importance import op7_quality_classifier
from .jaccard import op1_ngram_jaccard
from .licences import op4_licence_scan
from .mixing import op6_mixing
from .packing import op8_packing
from .quality_rules import op10_quality_rules
from .substrings import op3_substring_dedup

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_hmm_scoring, op3_substring_dedup, op4_licence_scan, op5_exact_dedup, op6_mixing, op7_quality_classifier, op8_packing, op9_chat_formatting, op10_quality_rules)}

SQL: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op9_chat_formatting": OP9_SQL}
