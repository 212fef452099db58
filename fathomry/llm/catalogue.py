"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomry.llm import cross_tokenizers, decontaminate, jaccard_join, language_id, mix_sources, nearest, packing, passage_quality, pii, secret_scan, toxic_spans, url_filter, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": secret_scan.op1_secrets,
        "op2_quality": passage_quality.op2_quality,
        "op3_toxicity": toxic_spans.op3_toxicity,
        "op4_language": language_id.op4_language,
        "op5_urls": url_filter.op5_urls,
        "op6_pii": pii.op6_pii,
        "op7_jaccard": jaccard_join.op7_jaccard,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_mix": mix_sources.op9_mix,
        "op10_nearest": nearest.op10_nearest,
        "op11_align": cross_tokenizers.op11_align,
        "op12_pack": packing.op12_pack,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_urls": url_filter.OP5_SQL, "op7_jaccard": jaccard_join.OP7_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op9_mix": mix_sources.OP9_SQL}
