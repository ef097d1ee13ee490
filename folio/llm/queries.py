"""Queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import alignment, bpe, collocations, decontamination, exact_dedup, jaccard_join, language_id, language_model, line_dedup, sharding, substrings, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        language_id.op1_ppm_language,
        jaccard_join.op2_token_group_join,
        jaccard_join.op2_link_counts,
        language_model.op3_pitman_yor,
        toxicity.op4_nearest_toxicity,
        exact_dedup.op5_block_naming,
        bpe.op6_bpe_round_trip,
        sharding.op7_feistel_shards,
        token_files.op8_context_mixing_files,
        decontamination.op9_benchmark_containment,
        line_dedup.op10_line_chunks,
        collocations.op11_collocations,
        substrings.op12_substring_dedup,
        alignment.op13_token_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_token_group_join": jaccard_join.SQL,
    "op2_link_counts": jaccard_join.LINKS_SQL,
    "op5_block_naming": exact_dedup.SQL,
    "op9_benchmark_containment": decontamination.SQL,
    "op11_collocations": collocations.SQL,
    "op12_substring_dedup": substrings.SQL,
}
