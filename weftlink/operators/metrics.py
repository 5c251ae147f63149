"""Recall, coverage and F-scores of candidates and matches, always over all S1 rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETA = 0.5


def f_beta(tp: Column, predicted: Column, true: Column, beta: float = BETA) -> Column:
    """F of one S1; one without truth scores 1 if nothing is predicted, else 0."""
    p, r, b = tp / predicted, tp / true, beta * beta
    return F.when(true == 0, (predicted == 0).cast("double")).when(tp == 0, F.lit(0.0)).otherwise((1 + b) * p * r / (b * p + r))


def per_s1(truth: DataFrame, predicted: DataFrame, s1: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_pred, tp, f): truth and predicted are (s1_id, target_id), s1 all ids."""
    n_true = truth.groupBy("s1_id").agg(F.countDistinct("target_id").alias("n_true"))
    distinct = predicted.select("s1_id", "target_id").distinct()
    hit = distinct.join(truth.select("s1_id", "target_id").distinct().withColumn("_t", F.lit(1)), ["s1_id", "target_id"], "left")
    n_pred = hit.groupBy("s1_id").agg(F.count("*").alias("n_pred"), F.count("_t").alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return s1.select("s1_id").join(n_true, "s1_id", "left").join(n_pred, "s1_id", "left").select("s1_id", zero("n_true"), zero("n_pred"), zero("tp")).withColumn("f", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro(rows: DataFrame) -> DataFrame:
    """Macro F with counts, what happens to S1 rows without truth, and five bins of F (the last is closed)."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    nothing = F.col("n_true") == 0
    bins = [(F.col("f") >= i / 5) & ((F.col("f") < (i + 1) / 5) if i < 4 else F.lit(True)) for i in range(5)]
    return rows.agg(
        F.count("*").alias("n_s1"), F.coalesce(F.avg("f"), F.lit(0.0)).alias("macro_f"), n(F.col("tp"))("tp"), n(F.col("n_pred") - F.col("tp"))("fp"), n(F.col("n_true") - F.col("tp"))("fn"),
        n(nothing)("n_no_match"), n(nothing & (F.col("n_pred") == 0))("n_no_match_right"), *[n(b)(f"bin_{i}") for i, b in enumerate(bins)],
    )


def candidate_rows(truth: DataFrame, candidates: DataFrame, s1: DataFrame) -> DataFrame:
    """As per_s1, with f the oracle score: the F of a perfect choice among the candidates."""
    rows = per_s1(truth, candidates, s1)
    return rows.withColumn("f", f_beta(F.col("tp"), F.col("tp"), F.col("n_true")))


def _summary() -> list[Column]:
    at = lambda q: F.expr(f"percentile(n_pred, {q})")
    edges = F.greatest(F.sum("n_true"), F.lit(1))
    return [
        F.count("*").alias("entities"), F.sum("n_true").alias("truth_edges"), F.sum("tp").alias("recalled"), (F.sum("tp") / edges).alias("recall"), (1 - F.sum("tp") / edges).alias("missed_rate"),
        F.avg((F.col("tp") == F.col("n_true")).cast("double")).alias("all_truth_rate"), F.avg("n_pred").alias("mean"), at(0.5).alias("median"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"),
        F.max("n_pred").alias("max"), F.avg((F.col("n_pred") == 0).cast("double")).alias("zero_rate"), F.avg("f").alias("oracle_f"),
    ]


def candidate_metrics(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Recall, coverage and volume, overall and by each of the columns: (grouping, value, figures). One pass by grouping sets."""
    if not by:
        return rows.agg(*_summary()).select(F.lit("all").alias("grouping"), F.lit("all").alias("value"), "*")
    keys = F.array(F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("value")) for c in by])
    return rows.withColumn("_k", F.explode(keys)).select("*", "_k.*").groupBy("grouping", "value").agg(*_summary())


def volume(counts: DataFrame, value: str = "n", freq: str | None = None) -> DataFrame:
    """Mean, median, 95th percentile and maximum of counts, or of a histogram of them; zeros if empty."""
    w = F.col(freq) if freq else F.lit(1)
    f = f", {freq}" if freq else ""
    zero = lambda c, name: F.coalesce(c.cast("double"), F.lit(0.0)).alias(name)
    return counts.agg(F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("count"), zero(F.sum(F.col(value) * w) / F.sum(w), "mean"), zero(F.expr(f"percentile({value}, 0.5{f})"), "median"), zero(F.expr(f"percentile({value}, 0.95{f})"), "p95"), zero(F.max(value), "max"))


def edge_agreement(edges: DataFrame) -> DataFrame:
    """Country agreement of edges (target_source, s1_country, target_country) by source and overall (null source)."""
    same = (F.col("s1_country") == F.col("target_country")).cast("long")
    return edges.rollup("target_source").agg(F.count("*").alias("edges"), F.sum(same).alias("agreeing"), F.avg(same.cast("double")).alias("rate"))


def pareto(configs: DataFrame) -> DataFrame:
    """Configurations that none beats: recall and oracle_f up, mean and p95 down. One row per configuration, a small table."""
    a, b = configs.alias("a"), configs.alias("b")
    better = (F.col("b.recall") >= F.col("a.recall")) & (F.col("b.oracle_f") >= F.col("a.oracle_f")) & (F.col("b.mean") <= F.col("a.mean")) & (F.col("b.p95") <= F.col("a.p95"))
    strictly = (F.col("b.recall") > F.col("a.recall")) | (F.col("b.oracle_f") > F.col("a.oracle_f")) | (F.col("b.mean") < F.col("a.mean")) | (F.col("b.p95") < F.col("a.p95"))
    return a.join(b, better & strictly, "left_anti")


def compared(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """A run's per-S1 rows against a baseline's: owners found in full, in part or not at all, edges gained and lost, cost of each gain."""
    j = rows.join(baseline.select("s1_id", F.col("tp").alias("b_tp"), F.col("n_pred").alias("b_pred")), "s1_id", "left").fillna(0, ["b_tp", "b_pred"])
    has = F.col("n_true") > 0
    n = lambda c: F.sum(c.cast("long"))
    gain, lost, added = n(F.greatest(F.col("tp") - F.col("b_tp"), F.lit(0))), n(F.greatest(F.col("b_tp") - F.col("tp"), F.lit(0))), n(F.col("n_pred") - F.col("b_pred"))
    return j.agg(
        n(has & (F.col("tp") == F.col("n_true"))).alias("full"), n(has & (F.col("tp") > 0) & (F.col("tp") < F.col("n_true"))).alias("partial"), n(has & (F.col("tp") == 0)).alias("none"),
        gain.alias("gained"), lost.alias("lost"), (gain - lost).alias("net"), added.alias("added"), F.when(gain > 0, added / gain).alias("cost_per_edge"),
    )


def fold_summary(rows: DataFrame, value: str = "f") -> DataFrame:
    """Mean, least and population deviation over folds of a value's fold means."""
    return rows.groupBy("fold").agg(F.avg(value).alias("v")).agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.stddev_pop("v").alias("deviation"))
