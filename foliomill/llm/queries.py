"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op4_decontamination
from .divergence import OP11_SQL, op11_divergence
from .filter_audit import OP13_SQL, op13_filter_audit
from .line_dedup import op3_line_dedup
from .near_dup import op9_ngram_jaccard
from .packing import op8_packing
from .pii import op10_pii
from .rules import op6_quality_rules
from .scoring import op1_lm_scoring
from .sharding import op2_sharding
from .substring_dedup import OP12_SQL, op12_substring_dedup
from .token_counts import OP7_SQL, op7_token_counts
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_pii": op10_pii,
    "op11_divergence": op11_divergence,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op7_token_counts": OP7_SQL, "op11_divergence": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
