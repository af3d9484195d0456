"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftnet.llm.centroids import op12_centroids, op12_sql
from weftnet.llm.html_text import op2_html_text
from weftnet.llm.importance import op11_importance, op11_sql
from weftnet.llm.langid import op8_language_id
from weftnet.llm.licences import op5_licences, op5_sql
from weftnet.llm.line_dedup import op9_line_dedup
from weftnet.llm.mixing import op7_mixing
from weftnet.llm.packing import op10_packing
from weftnet.llm.quality import op1_quality
from weftnet.llm.secrets import op13_secrets
from weftnet.llm.simhash import op3_simhash
from weftnet.llm.token_counts import op6_token_counts
from weftnet.llm.topk import OP4_SQL, op4_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_html_text": op2_html_text,
        "op3_simhash": op3_simhash,
        "op4_topk": op4_topk,
        "op5_licences": op5_licences,
        "op6_token_counts": op6_token_counts,
        "op7_mixing": op7_mixing,
        "op8_language_id": op8_language_id,
        "op9_line_dedup": op9_line_dedup,
        "op10_packing": op10_packing,
        "op11_importance": op11_importance,
        "op12_centroids": op12_centroids,
        "op13_secrets": op13_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op5_licences": op5_sql(), "op11_importance": op11_sql(), "op12_centroids": op12_sql()}
