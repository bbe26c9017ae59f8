"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, near_dedup, packing, quality, sentence_dedup, suffix_dedup, topk_search, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.query,
    "op2_sentence_span_dedup": sentence_dedup.query,
    "op3_maxscore_topk": topk_search.query,
    "op4_quality_classifier": quality.query,
    "op5_minhash_near_dedup": near_dedup.query,
    "op6_benchmark_decontamination": decontaminate.query,
    "op7_harmonic_packing": packing.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_chat_transcripts": chat.query,
    "op10_warc_derivatives": warc.query,
}
ORACLES: dict[str, str] = {
    "op2_sentence_span_dedup": sentence_dedup.SQL,
    "op3_maxscore_topk": topk_search.SQL,
    "op5_minhash_near_dedup": near_dedup.SQL,
    "op6_benchmark_decontamination": decontaminate.SQL,
}
