"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from .chat_formatting import OP12_SQL, op12_chat_formatting
from .decontamination import op1_benchmark_decontamination
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .language_id import op7_language_id
from .pii import OP10_SQL, op10_pii
from .ranked_search import OP13_SQL, op13_ranked_search
from .secrets import OP5_SQL, op5_secret_scans
from .sentencepieces import op6_sentencepiece
from .simhash import op3_simhash_near_dedup
from .spelling_variants import OP11_SQL, op11_spelling_variants
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .toxicity import op9_toxicity
from .url_filters import OP4_SQL, op4_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_substring_dedup,
        op3_simhash_near_dedup,
        op4_url_filters,
        op5_secret_scans,
        op6_sentencepiece,
        op7_language_id,
        op8_exact_dedup,
        op9_toxicity,
        op10_pii,
        op11_spelling_variants,
        op12_chat_formatting,
        op13_ranked_search,
    )
}

ORACLE_SQL = {
    "op2_substring_dedup": OP2_SQL,
    "op4_url_filters": OP4_SQL,
    "op5_secret_scans": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_pii": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_chat_formatting": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
