"""The operators as registered queries, over the whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from retailloom.llm import (
    decontaminate,
    extraction,
    hard_negatives,
    lz_dedup,
    nearest,
    ngram_join,
    packing,
    quality,
    simhash,
    suffix_dedup,
    token_alignment,
    token_counts,
    toxicity,
)
from retailloom.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(operator: Callable[..., DataFrame], *tables: str):
        return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in tables))

    return {
        "op1_suffix_array_dedup": on(suffix_dedup.digest, "documents"),
        "op2_benchmark_decontamination": on(decontaminate.contaminated, "documents", "benchmark"),
        "op3_best_fit_packing": on(packing.pack, "documents"),
        "op4_substring_dedup": on(lz_dedup.digest, "documents"),
        "op5_html_extraction": on(extraction.main_text, "pages"),
        "op6_nearest_neighbours": on(nearest.nearest, "embeddings"),
        "op7_quality_classifier": on(quality.quality, "documents", "labels"),
        "op8_token_counts": on(token_counts.digest, "documents"),
        "op9_ngram_jaccard_join": on(ngram_join.digest, "documents"),
        "op10_toxicity": on(toxicity.toxicity, "documents", "labels"),
        "op11_hard_negatives": on(hard_negatives.digest, "embeddings"),
        "op12_simhash_near_duplicates": on(simhash.near_duplicates, "documents"),
        "op13_token_alignment": on(token_alignment.aligned, "documents"),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": lz_dedup.ORACLE,
        "op6_nearest_neighbours": nearest.ORACLE,
        "op9_ngram_jaccard_join": ngram_join.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
    }
