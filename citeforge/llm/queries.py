"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, capfilters, langid, licenses, mixing, pii, quality, simhash, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_language_id": langid.op2_language_id,
        "op3_license_digests": licenses.op3_license_digests,
        "op4_substring_dedup": substring.op4_substring_dedup,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_cap_filters": capfilters.op6_cap_filters,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_pii_crf": pii.op8_pii_crf,
        "op9_quality_divergence": quality.op9_quality_divergence,
        "op10_simhash": simhash.op10_simhash,
        "quality_every_language": quality.quality_every_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_digests": licenses.oracle(), "op4_substring_dedup": substring.ORACLE, "op5_mix_sources": mixing.ORACLE, "op9_quality_divergence": quality.ORACLE, "quality_every_language": quality.ORACLE_EVERY}
