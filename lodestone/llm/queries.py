"""The queries of this package and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_sql import op7_bpe_sql
from .fingerprints import op1_fingerprints
from .packing import op8_best_fit
from .quality_classifier import op10_quality_classifier
from .sharding import op9_minimax_shards
from .simhash import op3_simhash
from .token_store import op5_token_store
from .url_filter import op2_url_filter
from .warc import OP4_SQL, op4_warc
from .weak_rules import op6_weak_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_url_filter,
        op3_simhash,
        op4_warc,
        op5_token_store,
        op6_weak_rules,
        op7_bpe_sql,
        op8_best_fit,
        op9_minimax_shards,
        op10_quality_classifier,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_warc": OP4_SQL}
