"""Candidate pairs by exact keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, views

FIELDS = {"name": "business_name", "address": "business_address"}


def melted(records: DataFrame, fields=("name", "address"), view_names=("unicode_preserving", "accent_folded"), strict: bool = True) -> DataFrame:
    """One row for each key of a record: entity_id, source, country, field, view, key, tie. Empty keys have none.

    Views are computed once for each record, before any join.
    """
    base = records.select("entity_id", "source", "country", hashing.tie_key(F.col("business_name"), F.col("business_address"), F.col("country")).alias("tie"), *[views.field(F.col(FIELDS[f]), strict).alias(f) for f in fields])
    keys = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("view"), views.key(F.col(f), v).alias("key")) for f in fields for v in view_names])
    return base.select("entity_id", "source", "country", "tie", F.explode(keys).alias("k")).select("entity_id", "source", "country", "tie", "k.*").filter("key <> ''")


def exact(keys: DataFrame, by_country: bool = True) -> DataFrame:
    """Evidence of equal keys: every match, score 1 and rank 1. S1 rows are queries, the others targets."""
    on = ["field", "view", "key", *(["country"] if by_country else [])]
    q = keys.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), *on)
    t = keys.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), F.col("tie").alias("target_content_key"), *on)
    return q.join(t, on).select(
        "s1_id", "target_id", "target_source", F.concat_ws("_", F.lit("exact"), "field", "view").alias("channel"), "field", F.col("view").alias("normalization_view"),
        F.lit(1.0).alias("retrieval_score"), F.lit(1).alias("channel_rank"), F.lit(True).alias("exact_match"), "target_content_key",
    )


def exact_top_k(keys: DataFrame, k: int = 80, by_country: bool = True) -> DataFrame:
    """Exact evidence ranked by content within query, source and channel, the first k.

    A query has one key of a field and view, so its first k are the first k targets of
    that key: these are ranked before the join, which then has k rows a query at most.
    """
    on = ["field", "view", "key", *(["country"] if by_country else [])]
    rank = F.row_number().over(Window.partitionBy(*on, "source").orderBy("tie", "entity_id"))
    first = keys.filter("source <> 'S1'").withColumn("channel_rank", rank).filter(F.col("channel_rank") <= k)
    found = exact(keys.filter("source = 'S1'").unionByName(first.drop("channel_rank")), by_country).drop("channel_rank")
    ranked = first.select(F.col("entity_id").alias("target_id"), "field", F.col("view").alias("normalization_view"), "channel_rank")
    return found.join(ranked, ["target_id", "field", "normalization_view"])


def save_index(keys: DataFrame, table: str, buckets: int = 64) -> None:
    """Keys as a bucketed table: later joins on (country, key) need no shuffle of it."""
    keys.write.bucketBy(buckets, "country", "key").sortBy("country", "key").mode("errorifexists").saveAsTable(table)


def capped(evidence: DataFrame, limit: int) -> DataFrame:
    """The evidence, or an error if it has more rows than allowed."""
    n = evidence.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} evidence rows")
    return evidence


def digit_overlap(records: DataFrame, by_country: bool = False, strict: bool = True) -> DataFrame:
    """Distinct pairs whose addresses share a digit run."""
    d = records.select("entity_id", "source", *(["country"] if by_country else []), F.explode(F.array_distinct(views.digits(views.lowered(F.col("business_address"), strict)))).alias("digits"))
    on = ["digits", *(["country"] if by_country else [])]
    q = d.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), *on)
    t = d.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), *on)
    return q.join(t, on).select("s1_id", "target_id", "target_source").distinct()


def prefix_negatives(records: DataFrame, truth: DataFrame, limit: int = 500, per_prefix: int = 8, strict: bool = True) -> DataFrame:
    """Pairs that look alike but aren't true: equal six-character name prefixes, eight-character address prefixes, and equal names.

    Of a prefix's queries and targets the first ``per_prefix`` by content hash count,
    and of each category the first ``limit`` pairs by hash: an order that input order doesn't change.
    """
    base = records.select("entity_id", "source", "country", hashing.tie_key(F.col("business_name"), F.col("business_address"), F.col("country")).alias("tie"), views.field(F.col("business_name"), strict).alias("n"), views.field(F.col("business_address"), strict).alias("a"))
    parts = F.array(
        F.struct(F.lit("name_prefix").alias("sample_type"), F.when(F.length("n.compact") >= 6, F.substring("n.compact", 1, 6)).alias("block")),
        F.struct(F.lit("address_prefix").alias("sample_type"), F.when(F.length("a.compact") >= 8, F.substring("a.compact", 1, 8)).alias("block")),
        F.struct(F.lit("exact_name").alias("sample_type"), F.when(F.col("n.folded") != "", F.col("n.folded")).alias("block")),
    )
    keys = base.select("entity_id", "source", "country", "tie", F.explode(parts).alias("p")).select("entity_id", "source", "country", "tie", "p.*").filter("block is not null")
    few = F.row_number().over(Window.partitionBy("sample_type", "country", "block", F.col("source") == "S1").orderBy("tie", "entity_id"))
    keys = keys.withColumn("_r", few).filter(F.col("_r") <= per_prefix)
    q = keys.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "sample_type", "country", "block")
    t = keys.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), "sample_type", "country", "block")
    pairs = q.join(t, ["sample_type", "country", "block"]).select("s1_id", "target_id", "target_source", "sample_type").join(truth.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")
    order = F.row_number().over(Window.partitionBy("sample_type").orderBy(F.sha2(F.concat_ws("|", "s1_id", "target_id"), 256), "s1_id", "target_id"))
    return pairs.withColumn("_r", order).filter(F.col("_r") <= limit).drop("_r")


def random_negatives(records: DataFrame, truth: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pairs of an S1 row and a target, paired by rank in a seeded hash order; true pairs fall out."""
    def ranked(side: DataFrame, name: str) -> DataFrame:
        chosen = side.select(F.col("entity_id").alias(name), F.xxhash64(F.lit(seed), "entity_id").alias("_h")).orderBy("_h", name).limit(n)
        return chosen.withColumn("_r", F.row_number().over(Window.orderBy("_h", name))).drop("_h")

    pairs = ranked(records.filter("source = 'S1'"), "s1_id").join(ranked(records.filter("source <> 'S1'"), "target_id"), "_r").drop("_r")
    return pairs.join(truth.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti").withColumn("sample_type", F.lit("random"))


def with_digit_agreement(pairs: DataFrame, records: DataFrame, strict: bool = True) -> DataFrame:
    """Address digits as evidence on pairs that exist: do they overlap, are they equal and non-empty?"""
    d = records.select("entity_id", views.digits(views.lowered(F.col("business_address"), strict)).alias("d"))
    q = d.select(F.col("entity_id").alias("s1_id"), F.col("d").alias("_q"))
    t = d.select(F.col("entity_id").alias("target_id"), F.col("d").alias("_t"))
    return pairs.join(q, "s1_id").join(t, "target_id").withColumns({"digit_overlap": F.arrays_overlap("_q", "_t"), "digits_equal": (F.size("_q") > 0) & (F.col("_q") == F.col("_t"))}).drop("_q", "_t")
