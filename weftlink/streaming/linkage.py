"""Exact blocking of a stream of queries against a table of targets.

This is the batch join of the blocking operator with a streaming left side. It keeps no state: each micro-batch of S1
records meets the keys of the targets, so results equal those of the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking
from ..sources.records import RECORD


def exact(queries: DataFrame, target_keys: DataFrame, strict: bool = True) -> DataFrame:
    """Evidence of equal keys for a streaming (or batch) table of S1 records; target_keys come from ``blocking.melted``."""
    keys = blocking.melted(queries.select(F.lit("S1").alias("source"), *RECORD), strict=strict)
    on = ["field", "view", "key", "country"]
    q = keys.select(F.col("entity_id").alias("s1_id"), *on)
    t = target_keys.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), F.col("tie").alias("target_content_key"), *on)
    return q.join(t, on).select("s1_id", "target_id", "target_source", F.concat_ws("_", F.lit("exact"), "field", "view").alias("channel"), "target_content_key")
