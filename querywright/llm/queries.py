"""The thin queries of this subpackage.  None is expressible in SQL on whole tables at a bearable cost:
each is tested against brute force in tests/llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .edit_fingerprint import op3_edit_fingerprints
from .mixing import op7_mixing
from .ngram_join import op4_ngram_join
from .packing import op2_packing
from .quality import op9_quality
from .sharding import op1_hilbert_shards
from .suffix_dedup import op8_suffix_dedup
from .token_files import op5_token_files
from .toxicity import op10_toxicity
from .vector_search import op6_vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_hilbert_shards, op2_packing, op3_edit_fingerprints, op4_ngram_join, op5_token_files, op6_vector_search, op7_mixing, op8_suffix_dedup, op9_quality, op10_toxicity]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
