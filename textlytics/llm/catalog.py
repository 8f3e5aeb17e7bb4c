"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from textlytics.llm import clustering, vector_codes
from textlytics.llm.clustering import op13_centroid_clustering
from textlytics.llm.decontamination import op9_decontamination
from textlytics.llm.html_extraction import op12_html_extraction
from textlytics.llm.license_scan import op10_license_scan
from textlytics.llm.line_dedup import op1_line_dedup
from textlytics.llm.near_dedup import op8_near_dedup
from textlytics.llm.packing import op3_packing
from textlytics.llm.quality_classifier import op5_quality_classifier
from textlytics.llm.quality_rules import op4_quality_rules
from textlytics.llm.secret_scan import op2_secret_scan
from textlytics.llm.sharding import op6_sharding
from textlytics.llm.suffix_dedup import op7_suffix_dedup
from textlytics.llm.vector_codes import op11_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_sum_of_squares_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_sharding": op6_sharding,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_html_extraction": op12_html_extraction,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": corpus_pipeline.run,
}

#: the other results have no SQL form; tests/llm holds them against brute force
ORACLE: dict[str, str] = {
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op13_centroid_clustering": clustering.oracle_sql(),
}
