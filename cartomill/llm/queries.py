"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartomill.llm import decontamination, dedup, language, mixing, nearest, quality, scoring, secrets, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": dedup.op1_near_duplicates,
    "op2_secrets": secrets.op2_secrets,
    "op3_language": language.op3_language,
    "op4_quality": quality.op4_quality,
    "op5_lm_scores": scoring.op5_lm_scores,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_kd_shards": sharding.op9_kd_shards,
    "op10_nearest": nearest.op10_nearest,
}

ORACLE_SQL: dict[str, str] = {"op7_mixing": mixing.OP7_SQL, "op10_nearest": nearest.OP10_SQL}
