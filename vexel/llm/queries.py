"""The queries of the corpus operators: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .best_fit import op6_best_fit
from .bloom_cascade import OP9_SQL, op9_bloom_cascade
from .cube_mix import op2_cube_mix
from .gif_media import op1_gif_media
from .line_spread import OP10_SQL, op10_line_spread
from .scaled_sketch import op7_scaled_sketch
from .secret_scan import op3_token_efficiency
from .simhash_forest import op4_simhash_forest
from .string_kernel import op5_string_kernel
from .subword_quality import op8_subword_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gif_media": op1_gif_media,
    "op2_cube_mix": op2_cube_mix,
    "op3_token_efficiency": op3_token_efficiency,
    "op4_simhash_forest": op4_simhash_forest,
    "op5_string_kernel": op5_string_kernel,
    "op6_best_fit": op6_best_fit,
    "op7_scaled_sketch": op7_scaled_sketch,
    "op8_subword_quality": op8_subword_quality,
    "op9_bloom_cascade": op9_bloom_cascade,
    "op10_line_spread": op10_line_spread,
}

ORACLE_SQL: dict[str, str] = {
    "op9_bloom_cascade": OP9_SQL,
    "op10_line_spread": OP10_SQL,
}
