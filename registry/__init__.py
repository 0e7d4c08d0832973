"""Registered queries: each operator on the supplied tables, with its SQL twin.

``SPARK`` maps a key to ``(spark, sf_dir) -> DataFrame`` and ``ORACLE`` maps the
same key to SQL over the same tables, for every query SQL can express.
"""

from registry.core import ORACLE, SPARK
from registry import (  # noqa: F401  (importing registers)
    ingest_queries, window_queries, spike_queries, feature_queries, profile_queries,
    split_queries, model_queries, contract_queries, sketch_queries,
)

__all__ = ["ORACLE", "SPARK"]
