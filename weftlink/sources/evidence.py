"""Checks of evidence tables before they are fused or used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import DataError

PAIR = ("s1_id", "target_id", "target_source")
MAX_RANK = 32767


def row_violations(evidence: DataFrame, channels: tuple[str, ...] | None = None) -> DataFrame:
    """(kind, s1_id, target_id): nulls, foreign ids or sources, unknown channels, scores that aren't finite, ranks out of range, exact flags that don't fit the channel."""
    c = F.col
    kind = (
        F.when(c("s1_id").isNull() | c("target_id").isNull() | c("channel").isNull() | c("retrieval_score").isNull() | c("channel_rank").isNull(), "null")
        .when(~F.startswith("s1_id", F.lit("S1-")) | ~F.startswith("target_id", F.concat(c("target_source"), F.lit("-"))) | ~c("target_source").isin("S2", "S3"), "id")
        .when(F.isnan(c("retrieval_score")) | (F.abs(c("retrieval_score")) > 1e308), "score").when((c("channel_rank") < 1) | (c("channel_rank") > MAX_RANK), "rank").when(c("exact_match") != c("channel").startswith("exact_"), "exact flag")
    )
    if channels:
        kind = F.coalesce(kind, F.when(~c("channel").isin(*channels), "channel"))
    return evidence.select(kind.alias("kind"), "s1_id", "target_id").filter("kind is not null")


def group_violations(evidence: DataFrame, contiguous: bool = True) -> DataFrame:
    """Pairs twice in a channel, and channels whose ranks of an S1 aren't 1 to n."""
    twice = evidence.groupBy(*PAIR, "channel").count().filter("count > 1").select(F.lit("duplicate").alias("kind"), "s1_id", "target_id")
    if not contiguous:
        return twice
    ranks = evidence.groupBy("s1_id", "target_source", "channel").agg(F.min("channel_rank").alias("lo"), F.max("channel_rank").alias("hi"), F.count("*").alias("n"), F.countDistinct("channel_rank").alias("d"))
    gaps = ranks.filter((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))).select(F.lit("ranks").alias("kind"), "s1_id", F.lit(None).cast("string").alias("target_id"))
    return twice.unionByName(gaps)


def check(evidence: DataFrame, channels: tuple[str, ...] | None = None, contiguous: bool = True, queries: DataFrame | None = None) -> DataFrame:
    """The evidence, or an error that names up to five violations; with queries, each must have evidence."""
    bad = row_violations(evidence, channels).unionByName(group_violations(evidence, contiguous))
    if queries is not None:
        bad = bad.unionByName(queries.select("s1_id").join(evidence, "s1_id", "left_anti").select(F.lit("no evidence").alias("kind"), "s1_id", F.lit(None).cast("string").alias("target_id")))
    if got := bad.orderBy("kind", "s1_id", "target_id").limit(5).collect():
        raise DataError("; ".join(f"{r['kind']}: {r['s1_id']} {r['target_id'] or ''}".strip() for r in got))
    return evidence
