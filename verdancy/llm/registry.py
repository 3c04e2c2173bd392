"""The queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdancy.llm.chat import OP4_SQL, op4_chat_formatting
from verdancy.llm.decontamination import OP3_SQL, op3_benchmark_decontamination
from verdancy.llm.embeddings import OP8_SQL, op8_embedding_near_dedup
from verdancy.llm.html import op2_html_extraction
from verdancy.llm.minhash import OP1_SQL, op1_minhash_near_dedup
from verdancy.llm.packing import op9_best_fit_packing
from verdancy.llm.phrases import OP12_SQL, op12_phrase_collocations
from verdancy.llm.pseudo_likelihood import op7_lm_scoring
from verdancy.llm.quality import op10_quality_classifier
from verdancy.llm.rollups import op5_token_rollups
from verdancy.llm.runs import OP11_SQL, op11_periodic_runs
from verdancy.llm.secrets import OP13_SQL, op13_secret_scans
from verdancy.llm.toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_html_extraction, op3_benchmark_decontamination, op4_chat_formatting, op5_token_rollups, op6_toxicity, op7_lm_scoring, op8_embedding_near_dedup, op9_best_fit_packing, op10_quality_classifier, op11_periodic_runs, op12_phrase_collocations, op13_secret_scans)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op3_benchmark_decontamination": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op8_embedding_near_dedup": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op12_phrase_collocations": OP12_SQL, "op13_secret_scans": OP13_SQL}
