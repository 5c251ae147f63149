"""Choosing a fusion setting: measurements by fold, gates, and reports."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fusion, metrics


@dataclass(frozen=True)
class Gates:
    """What a setting must reach: recall and oracle score at least, mean and 95th percentile of candidates at most."""

    # The default gates.
    recall: float = 0.985
    oracle_f: float = 0.99
    mean: float = 50.0
    p95: float = 100.0

    def volume(self, m: dict) -> bool:
        return m["mean"] <= self.mean and m["p95"] <= self.p95

    def all(self, m: dict) -> bool:
        return self.volume(m) and m["recall"] >= self.recall and m["oracle_f"] >= self.oracle_f


def measured(truth: DataFrame, candidates: DataFrame, s1: DataFrame) -> dict:
    """The candidate metrics of some S1 rows as a dictionary."""
    return metrics.candidate_metrics(metrics.candidate_rows(truth.join(s1, "s1_id", "left_semi"), candidates.join(s1, "s1_id", "left_semi"), s1)).first().asDict()


def chosen(results: list[dict], gates: Gates) -> dict:
    """Of the settings that pass all gates the smallest; else, of those of a safe volume, the one of the best recall. ``key`` settles ties."""
    if good := [r for r in results if gates.all(r)]:
        return min(good, key=lambda r: (r["mean"], r["p95"], -r["recall"], r["key"]))
    safe = [r for r in results if gates.volume(r)] or results
    return min(safe, key=lambda r: (-r["recall"], -r["oracle_f"], r["mean"], r["key"]))


def evaluate(pairs: DataFrame, specs: list[fusion.FusionSpec], truth: DataFrame, folds: DataFrame, dev: tuple[int, ...], gates: Gates | None = None) -> dict:
    """Measure every setting on the development folds, choose one, and report it on the others: together, by fold, mean and worst.

    ``pairs`` are aggregated pairs, read by every setting, so they are kept in memory.
    """
    gates = gates or Gates()
    pairs = pairs.persist()
    try:
        on = folds.filter(F.col("fold").isin(*dev)).select("s1_id")
        results = [{"key": s.key, **measured(truth, fusion.select_candidates(pairs, s), on)} for s in specs]
        best = chosen(results, gates)
        spec = next(s for s in specs if s.key == best["key"])
        kept = fusion.select_candidates(pairs, spec).persist()
        held = sorted(r["fold"] for r in folds.select("fold").distinct().collect() if r["fold"] not in dev)
        by_fold = {k: measured(truth, kept, folds.filter(F.col("fold") == k).select("s1_id")) for k in held}
        together = measured(truth, kept, folds.filter(~F.col("fold").isin(*dev)).select("s1_id")) if held else None
        kept.unpersist()
    finally:
        pairs.unpersist()
    scores = [m["oracle_f"] for m in by_fold.values()]
    return {"dev": results, "chosen": best, "held_out": together, "by_fold": by_fold, "mean_oracle_f": sum(scores) / len(scores) if scores else None, "worst_oracle_f": min(scores, default=None), "passes": bool(together) and gates.all(together)}


def output_bytes(sample_bytes: int, sample_rows: int, rows: int) -> int:
    """Bytes of a full output, from those of a sample; 0 for an empty one."""
    return ceil(sample_bytes / sample_rows * rows) if sample_rows else 0


def depth_table(evidence: DataFrame, truth: DataFrame, s1: DataFrame, unions: dict[str, list[str] | None], depths=(5, 10, 20, 40, 80)) -> DataFrame:
    """Candidate metrics of each union of channels at each depth: one plan, with the setting as a key."""
    spark = evidence.sparkSession
    grid = [(n, c, k) for n, cs in unions.items() for c in (cs if cs is not None else ["*"]) for k in depths]
    wanted = F.broadcast(spark.createDataFrame(grid, "channels string, channel string, depth int"))
    e = evidence.withColumn("channel", F.explode(F.array(F.col("channel"), F.lit("*"))))
    pairs = e.join(wanted, "channel").filter(F.col("channel_rank") <= F.col("depth")).select("channels", "depth", "s1_id", "target_id").distinct()
    t = truth.select("s1_id", "target_id").distinct().withColumn("_t", F.lit(1))
    got = pairs.join(t, ["s1_id", "target_id"], "left").groupBy("channels", "depth", "s1_id").agg(F.count("*").alias("n_pred"), F.count("_t").alias("tp"))
    n_true = t.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    settings = spark.createDataFrame(sorted({(n, k) for n, _, k in grid}), "channels string, depth int")
    rows = s1.select("s1_id").crossJoin(F.broadcast(settings)).join(n_true, "s1_id", "left").join(got, ["channels", "depth", "s1_id"], "left").fillna(0, ["n_true", "n_pred", "tp"])
    rows = rows.withColumn("f", metrics.f_beta(F.col("tp"), F.col("tp"), F.col("n_true")))
    edges = F.greatest(F.sum("n_true"), F.lit(1))
    return rows.groupBy("channels", "depth").agg((F.sum("tp") / edges).alias("recall"), F.avg("f").alias("oracle_f"), F.avg("n_pred").alias("mean"), F.expr("percentile(n_pred, 0.95)").alias("p95"), F.max("n_pred").alias("max"))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A small result as a Markdown table."""
    show = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c, "")) for c in columns) + " |" for r in rows]) + "\n"
