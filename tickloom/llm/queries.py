"""One query for each operator, with production parameters, over its whole table; and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.bpe_chunks import encode_documents
from tickloom.llm.exact_dedup import EXACT_COPIES_SQL, exact_copies
from tickloom.llm.kd_sharding import kd_shards
from tickloom.llm.language_id import language_id
from tickloom.llm.lm_automaton import LM_SQL, lm_scores
from tickloom.llm.media_sequences import MEDIA_TAGS, media_sequences, page_payloads
from tickloom.llm.mixing import MIXTURE_SQL, mixture
from tickloom.llm.simhash_dedup import near_copies
from tickloom.llm.substring_dedup import SUBSTRING_SQL, substring_duplicates
from tickloom.llm.toxicity import toxicity


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": lambda s, d: substring_duplicates(_t(s, d, "documents")),
    "op2_language_id": lambda s, d: language_id(_t(s, d, "documents")),
    "op3_mix_sources": lambda s, d: mixture(_t(s, d, "documents")),
    "op4_toxicity": lambda s, d: toxicity(_t(s, d, "documents"), _t(s, d, "labels")),
    "op5_exact_dedup": lambda s, d: exact_copies(_t(s, d, "documents")),
    "op6_kd_sharding": lambda s, d: kd_shards(_t(s, d, "documents")),
    "op7_lm_automaton": lambda s, d: lm_scores(_t(s, d, "documents")),
    "op8_media_sequences": lambda s, d: media_sequences(_t(s, d, "pages"), page_payloads(_t(s, d, "pages")), (*MEDIA_TAGS, "a", "style", "script")),
    "op9_simhash_dedup": lambda s, d: near_copies(_t(s, d, "documents")),
    "op10_bpe": lambda s, d: encode_documents(_t(s, d, "documents")),
}

LLM_ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_SQL,
    "op3_mix_sources": MIXTURE_SQL,
    "op7_lm_automaton": LM_SQL,
    "op5_exact_dedup": EXACT_COPIES_SQL,
}
