"""The queries of this subpackage and, where SQL can say the same, DuckDB SQL for their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import op7_bpe_codec
from .chat_format import op10_chat_format
from .conversation_trie import op13_conversation_trie
from .decontamination import op2_decontamination
from .filter_audit import op12_filter_audit
from .jaccard_join import op3_jaccard_join
from .quality_rules import op9_quality_rules
from .quality_classifier import op4_quality_classifier
from .source_mix import op11_source_mix
from .sql import ORACLE_SQL
from .substring_dedup import op6_substring_dedup
from .token_counts import op8_token_counts
from .token_output import op1_token_output
from .url_filter import op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_decontamination": op2_decontamination,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
    "op11_source_mix": op11_source_mix,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_trie": op13_conversation_trie,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
