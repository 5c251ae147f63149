"""From scored pairs to matches: thresholds, top-k, and one owner for each target."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


@dataclass(frozen=True)
class Decoder:
    threshold: float | None = None
    source_thresholds: dict[str, float] = field(default_factory=dict)
    top_k: int | None = None
    ownership: bool = False
    margin: float = 0.0
    min_evidence: float | None = None

    def __post_init__(self):
        if self.top_k is not None and self.top_k < 1:
            raise ValueError("top_k must be 1 or more")
        if self.margin < 0 or (self.margin > 0 and not self.ownership):
            raise ValueError("a margin is positive and needs ownership")

    def cut(self, source: str) -> float:
        return self.source_thresholds.get(source, self.threshold or 0.0)


def pairs(scored: DataFrame, d: Decoder, by: tuple[str, ...] = (), threshold: Column | None = None, margin: Column | None = None, top_k: Column | None = None, owned: Column | None = None) -> DataFrame:
    """The pairs that stay. ``by`` are further keys, so that several settings are decoded in one plan; ``owned`` says which of them let a target have one owner only."""
    best = F.row_number().over(Window.partitionBy(*by, "s1_id", "target_id").orderBy(F.desc("score"), "target_source"))
    df = scored.withColumn("_n", best).filter("_n = 1")
    if d.min_evidence is not None:
        df = df.filter(F.col("score") >= d.min_evidence)
    if threshold is None:
        threshold = F.lit(float(d.threshold or 0.0))
        for source, t in sorted(d.source_thresholds.items()):
            threshold = F.when(F.col("target_source") == source, F.lit(float(t))).otherwise(threshold)
    df = df.filter(F.col("score") >= threshold)
    k = top_k if top_k is not None else F.lit(d.top_k) if d.top_k is not None else None
    if k is not None:
        rank = F.row_number().over(Window.partitionBy(*by, "s1_id", "target_source").orderBy(F.desc("score"), "s1_id", "target_id"))
        df = df.withColumn("_n", rank).filter(F.col("_n") <= k)
    if d.ownership:
        order = Window.partitionBy(*by, "target_id").orderBy(F.desc("score"), "s1_id")
        free = ~owned if owned is not None else F.lit(False)
        df = df.withColumns({"_n": F.row_number().over(order), "_next": F.lead("score").over(order)}).filter(free | (F.col("_n") == 1))
        m = margin if margin is not None else F.lit(float(d.margin))
        gap = F.col("score") - F.col("_next")
        # A gap counts as the margin when it is as close as numpy's isclose asks.
        df = df.filter(free | F.col("_next").isNull() | (gap >= m) | (F.abs(gap - m) <= 1e-12 + 1e-12 * F.abs(m)))
    return df.drop("_n", "_next")


def decode(scored: DataFrame, s1: DataFrame, d: Decoder) -> DataFrame:
    """(s1_id, targets sorted), one row for each S1."""
    lists = pairs(scored, d).groupBy("s1_id").agg(F.array_sort(F.collect_set("target_id")).alias("targets"))
    return s1.select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def search(scored: DataFrame, truth: DataFrame, s1: DataFrame, thresholds=(0.3, 0.5, 0.7), ks=(1, 3), owners=((True, 0.0),), source_thresholds=None) -> DataFrame:
    """Macro F of each setting, the best first; ties (to 1e-9) prefer higher thresholds (global, S2, S3), then larger margins, then smaller k.

    ``owners`` are (ownership, margin); ``source_thresholds`` are (S2, S3) pairs, by
    default the global threshold for both. Settings are a small table joined to the
    scores, and a key of every window, so the grid is one plan.
    """
    spark = scored.sparkSession
    pairs_of = lambda t: source_thresholds if source_thresholds is not None else ((t, t),)
    rows = [(float(t), float(a), float(b), k, bool(o), float(m)) for t in thresholds for a, b in pairs_of(t) for k, (o, m) in product(ks, owners)]
    grid = [(i, *r) for i, r in enumerate(rows)]
    settings = F.broadcast(spark.createDataFrame(grid, "setting int, threshold double, t2 double, t3 double, k int, owned boolean, m double"))
    # The lowest threshold searched cuts the scores before they meet the settings.
    df = scored.filter(F.col("score") >= min(min(r[1], r[2]) for r in rows)).crossJoin(settings)
    cut = F.when(F.col("target_source") == "S2", F.col("t2")).otherwise(F.col("t3"))
    kept = pairs(df, Decoder(ownership=True), by=("setting",), threshold=cut, margin=F.col("m"), top_k=F.col("k"), owned=F.col("owned"))
    marked = truth.select("s1_id", "target_id").distinct().withColumn("_t", F.lit(1))
    hit = kept.join(marked, ["s1_id", "target_id"], "left").groupBy("setting", "s1_id").agg(F.count("*").alias("n_pred"), F.count("_t").alias("tp"))
    n_true = truth.groupBy("s1_id").agg(F.countDistinct("target_id").alias("n_true"))
    per = s1.select("s1_id").crossJoin(settings).join(n_true, "s1_id", "left").join(hit, ["setting", "s1_id"], "left").fillna(0, ["n_true", "n_pred", "tp"])
    f = metrics.f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    out = per.groupBy("setting", "threshold", "t2", "t3", "k", "owned", "m").agg(F.round(F.avg(f), 9).alias("macro_f"))
    return out.orderBy(F.desc("macro_f"), F.desc("threshold"), F.desc("t2"), F.desc("t3"), F.desc("m"), "k", "owned")


def tune(scored: DataFrame, truth: DataFrame, s1: DataFrame, thresholds=(0.3, 0.5, 0.7, 0.8, 0.9), ks=(1, 3, 5), step: float = 0.05) -> Decoder:
    """Thresholds, sizes and ownership (off, on, on with a margin of 0.05) first, then seven settings of both sources' thresholds around the best."""
    best = search(scored, truth, s1, thresholds, ks, ((False, 0.0), (True, 0.0), (True, 0.05))).first()
    at = best["threshold"]
    held = lambda x: min(1.0, max(0.0, round(at + x, 9)))
    near = [(held(a), held(b)) for a, b in ((0, 0), (-step, -step), (step, step), (-step, 0), (0, -step), (step, 0), (0, step))]
    best = search(scored, truth, s1, (at,), (best["k"],), ((best["owned"], best["m"]),), near).first()
    return Decoder(threshold=at, source_thresholds={"S2": best["t2"], "S3": best["t3"]}, top_k=best["k"], ownership=best["owned"], margin=best["m"])
