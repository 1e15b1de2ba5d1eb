"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from medwright.llm.decontamination import op4_decontamination
from medwright.llm.divergence import OP13_SQL, op13_source_divergence
from medwright.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from medwright.llm.filter_audit import OP12_SQL, op12_filter_audit
from medwright.llm.hmm import op8_lm_score
from medwright.llm.langid import op7_language
from medwright.llm.line_dedup import OP11_SQL, op11_line_dedup
from medwright.llm.near_dedup import op1_near_dedup
from medwright.llm.packing import op10_packing
from medwright.llm.quality import op2_quality
from medwright.llm.token_output import op6_token_output
from medwright.llm.toxicity import op5_toxicity
from medwright.llm.warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_token_output": op6_token_output,
    "op7_language": op7_language,
    "op8_lm_score": op8_lm_score,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op9_warc": OP9_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
