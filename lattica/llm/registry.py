"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bitplanes import op4_bit_planes
from .langid import op3_language_id
from .lines import op1_line_dedup
from .ogg import op7_ogg_media
from .packing import op8_hierarchical_packing
from .pieces import op5_sentencepiece
from .quality import op2_perplexity_quality
from .secrets import op9_secret_scan
from .simhash import op10_simhash
from .suffixes import op6_suffix_repeats


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_perplexity_quality, op3_language_id, op4_bit_planes, op5_sentencepiece, op6_suffix_repeats, op7_ogg_media, op8_hierarchical_packing, op9_secret_scan, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {}
