"""Data profiles: rates, duplicates, vocabulary shifts, truth structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import views


def rates(records: DataFrame, by: list[str], strict: bool = True) -> DataFrame:
    """Row counts and shares of each group: empty, blank, null-like, non-ASCII, digits, replacement and control characters by field; both missing. One pass."""
    share = lambda c: F.avg(c.cast("double"))
    aggs = []
    for f in ("business_name", "business_address"):
        c, short = F.col(f), f.split("_")[1]
        aggs += [
            share(c == "").alias(f"{short}_empty"), share((c != "") & views.is_missing(c)).alias(f"{short}_blank"), share(views.is_null_like(c, strict)).alias(f"{short}_null_like"), share(c.rlike(r"[^\x00-\x7f]")).alias(f"{short}_non_ascii"),
            share(c.rlike(r"\p{Nd}")).alias(f"{short}_has_digit"), share(F.contains(c, F.lit("�"))).alias(f"{short}_replacement"), share(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")).alias(f"{short}_control"), F.avg(F.length(c).cast("double")).alias(f"{short}_mean_length"),
        ]
    return records.groupBy(*by).agg(F.count("*").alias("n_rows"), share(views.is_missing(F.col("business_name")) & views.is_missing(F.col("business_address"))).alias("both_missing"), *aggs)


def duplicates(records: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """For each named key: distinct values, rows beyond one a value, groups of several rows, and their rows. Exact."""
    out = None
    for name, columns in keys.items():
        g = records.groupBy(*columns).agg(F.count("*").alias("c"))
        more = F.when(F.col("c") > 1, F.col("c")).otherwise(0)
        part = g.agg(F.lit(name).alias("key"), F.count("*").alias("n_unique"), F.sum(F.col("c") - 1).alias("excess"), F.sum((F.col("c") > 1).cast("long")).alias("n_groups"), F.sum(more).alias("rows_in_groups")).select("key", "n_unique", "excess", "n_groups", "rows_in_groups")
        out = part if out is None else out.unionByName(part)
    return out


def token_counts(records: DataFrame, column: str, by: list[str], strict: bool = True) -> DataFrame:
    t = views.tokens(views.folded(F.col(column), strict)) if strict else views.tokens(views.punctuation(F.col(column), False))
    return records.select(*by, F.explode(t).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def top_tokens(counted: DataFrame, by: list[str], n: int = 30) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "token"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= n)


def shift(counted: DataFrame, side: str, base: str, other: str, top: int = 100) -> DataFrame:
    """Share of one side's token occurrences that the other's vocabulary lacks, and how many of the top tokens are common."""
    a, b = counted.filter(F.col(side) == base), counted.filter(F.col(side) == other)
    lacking = b.join(a.select("token"), "token", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("oov"))
    total = b.agg(F.sum("n").alias("total"))
    head = lambda d: d.orderBy(F.desc("n"), "token").limit(top).select("token")
    common = head(a).join(head(b), "token").agg(F.count("*").alias("common_top"))
    return lacking.crossJoin(total).crossJoin(common).select((F.col("oov") / F.greatest(F.col("total"), F.lit(1))).alias("oov_rate"), "total", "common_top")


def rate_deltas(profile: DataFrame, dataset: str, a: str, b: str, by: list[str]) -> DataFrame:
    """Differences of every rate between two datasets, by group."""
    numbers = [f.name for f in profile.schema.fields if f.name not in (dataset, *by) and f.dataType.typeName() in ("double", "long", "integer")]
    left, right = profile.filter(F.col(dataset) == a).alias("a"), profile.filter(F.col(dataset) == b).alias("b")
    return left.join(right, by).select(*by, *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"delta_{c}") for c in numbers])


def truth_structure(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Counts of a ground truth: lists by cardinality, edges by source, owners, and what breaks it."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    size = F.size("targets")
    own = lambda s: F.size(F.filter("targets", lambda t: t.startswith(f"{s}-")))
    rows = truth.agg(
        F.count("*").alias("n_s1"), *[n(size == i).alias(f"n_{i}") for i in range(4)], n(size >= 4).alias("n_4_or_more"), n(own("S2")).alias("edges_s2"), n(own("S3")).alias("edges_s3"), n((own("S2") > 0) & (own("S3") > 0)).alias("n_both_sources"),
    )
    edges = truth.select("s1_id", F.explode("targets").alias("target_id"))
    owners = edges.groupBy("target_id").agg(F.countDistinct("s1_id").alias("o")).agg(n(F.col("o") > 1).alias("n_shared_targets"))
    unknown = edges.join(records.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti").agg(F.count("*").alias("n_unknown_targets"))
    return rows.crossJoin(owners).crossJoin(unknown)


def edges_by_country(edges: DataFrame, records: DataFrame) -> DataFrame:
    """By country and whether the S1 row lacks an address: edges, S1 rows, and targets."""
    s1 = records.select(F.col("entity_id").alias("s1_id"), "country", (F.col("business_address") == "").alias("missing_address"))
    return edges.join(s1, "s1_id", "left").groupBy("country", "missing_address").agg(F.count("*").alias("edges"), F.countDistinct("s1_id").alias("n_s1"), F.countDistinct("target_id").alias("n_targets"))
