"""Evidence of several channels: provenance, reciprocal-rank scores, and budgets with ties."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The retrieval channels.
CHANNELS = ("exact_name_unicode_preserving", "exact_name_accent_folded", "exact_address_unicode_preserving", "exact_address_accent_folded", "name_char_tfidf", "address_char_tfidf")
PAIR = ("s1_id", "target_id", "target_source")
K = 60


@dataclass(frozen=True)
class Gathered:
    """Evidence by pair, as ``pairs.gathered`` makes it.

    ``near`` (s1_id, target_id, target_source, seen, exact_only) are pairs of a fuzzy channel or of an id with several
    texts, with all their observations. ``far`` (s1_id, target_id, kind, key) are all others: what is seen of them
    depends on their kind alone, the exact channels they have and their source, but for the target's content.
    ``kinds`` is as near, one row for each kind, which stands as s1_id; ``counts`` makes (s1_id, kind, n), the far
    pairs of each query counted by their keys; ``first`` makes far pairs without those that are behind the k-th of their query
    and source, by kinds with more channels, then ids.
    """

    near: DataFrame
    far: DataFrame
    kinds: DataFrame
    counts: Callable[[], DataFrame]
    first: Callable[[int], DataFrame]

    def leading(self, k: int) -> Gathered:
        """Enough pairs for the first k of each query and source, by a score that further exact channels don't lessen, then id."""
        return replace(self, far=self.first(k))

    def _joined(self, rows: DataFrame, f: Callable[[DataFrame], DataFrame], own: dict[str, Column]) -> DataFrame:
        """Rows with a kind, and what f says of it; ``own`` are columns of the rows themselves."""
        of_kind = f(self.kinds)
        said = of_kind.select(F.col("s1_id").cast("int").alias("kind"), *[F.col(c).alias(f"_{c}") for c in of_kind.columns])
        own = {"s1_id": F.col("s1_id"), "exact_only": F.lit(True)} | own
        return rows.join(F.broadcast(said), "kind").select(*[own.get(c, F.col(f"_{c}")).alias(c) for c in of_kind.columns], *[c for c in ("n",) if c in rows.columns])

    def each(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """f of all pairs; f works on pairs one by one. It is asked once for each kind, not for each far pair."""
        return f(self.near).unionByName(self._joined(self.far, f, {"target_id": F.col("target_id"), "target_content_key": F.col("key")}))

    def counted(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """As each, with n: the far pairs of one query and kind are one row, without target and content."""
        none = F.lit(None).cast("string")
        return f(self.near).withColumn("n", F.lit(1).cast("long")).unionByName(self._joined(self.counts(), f, {"target_id": none, "target_content_key": none}))


def top_k(evidence: DataFrame, channels: list[str] | None, k: int) -> DataFrame:
    """Distinct pairs of some channels (all if None) at ranks up to k: the union of their top lists."""
    kept = evidence.filter(F.col("channel_rank") <= k)
    if channels is not None:
        kept = kept.filter(F.col("channel").isin(*channels))
    return kept.select(*PAIR).dropDuplicates(list(PAIR))


def deduplicated(evidence: DataFrame) -> DataFrame:
    """One row for each pair and channel: the least rank, then the best score."""
    best = F.row_number().over(Window.partitionBy(*PAIR, "channel").orderBy("channel_rank", F.desc("retrieval_score"), "target_content_key"))
    return evidence.withColumn("_b", best).filter("_b = 1").drop("_b")


def provenance(evidence: DataFrame | Gathered, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Pairs with has, score and rank of each channel, whether a name or address is equal, and the channels joined by ``|``."""
    if isinstance(evidence, Gathered):
        return evidence.each(lambda x: provenance(x, channels))
    if "seen" in evidence.columns:
        return _provenance(evidence, channels)
    aggs = []
    for c in channels:
        own = F.col("channel") == c
        aggs += [F.max(own).alias(f"has_{c}"), F.max(F.when(own, F.col("retrieval_score"))).alias(f"score_{c}"), F.min(F.when(own, F.col("channel_rank"))).alias(f"rank_{c}")]
    return evidence.groupBy(*PAIR).agg(
        *aggs, F.max(F.col("exact_match") & F.col("channel").startswith("exact_name")).alias("exact_name"), F.max(F.col("exact_match") & F.col("channel").startswith("exact_address")).alias("exact_address"),
        F.array_join(F.array_sort(F.collect_set("channel")), "|").alias("channels"),
    )


def _of(channel: str) -> Column:
    """What a channel saw of a gathered pair; null if nothing."""
    return F.get(F.filter("seen", lambda x: x["channel"] == channel), F.lit(0))


def _provenance(pairs: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    cols = []
    for c in channels:
        cols += [_of(c).isNotNull().alias(f"has_{c}"), _of(c)["score"].alias(f"score_{c}"), _of(c)["rank"].alias(f"rank_{c}")]
    exact = lambda field: F.exists("seen", lambda x: x["exact"] & x["channel"].startswith(f"exact_{field}"))
    return pairs.select(*PAIR, *cols, exact("name").alias("exact_name"), exact("address").alias("exact_address"), F.array_join(F.array_sort(F.transform("seen", lambda x: x["channel"])), "|").alias("channels"))


def _ranks(evidence: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Pairs with the least rank in each channel and the least content."""
    if "seen" in evidence.columns:
        content = F.array_min(F.transform("seen", lambda x: x["key"])).alias("target_content_key")
        return evidence.select(*PAIR, *[_of(c)["rank"].alias(c) for c in channels], content, "exact_only")
    ranks = [F.min(F.when(F.col("channel") == c, F.col("channel_rank"))).alias(c) for c in channels]
    return evidence.groupBy(*PAIR).agg(*ranks, F.min("target_content_key").alias("target_content_key"))


def _loose(df: DataFrame, exact: Column) -> DataFrame:
    """Pairs that aren't exact, read from those of fuzzy channels only where they are known, and without the mark of the others."""
    return df.filter(~F.col("exact_only") & ~exact).drop("exact_only") if "exact_only" in df.columns else df.filter(~exact)


def aggregated(evidence: DataFrame | Gathered, k: int = K, depth: int = 80, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Pairs with reciprocal-rank scores: 1 / (k + rank) of each channel, sums by family, and ranks normalised by depth.

    The sums of names and addresses hold all channels of the field, exact ones too.
    """
    if isinstance(evidence, Gathered):
        return evidence.each(lambda x: aggregated(x, k, depth, channels))
    p = _ranks(evidence, channels)
    rrf = {c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0)) for c in channels}
    total = lambda test: sum((rrf[c] for c in channels if test(c)), F.lit(0.0))
    marks = [c for c in ("target_content_key", "exact_only") if c in p.columns]
    return p.select(
        *PAIR, *[rrf[c].alias(f"rrf_{c}") for c in channels], *[F.coalesce(1 - (F.col(c) - 1) / (depth - 1), F.lit(0.0)).alias(f"normalized_rank_{c}") for c in channels],
        total(lambda c: "name" in c).alias("rrf_name"), total(lambda c: "address" in c).alias("rrf_address"),
        total(lambda c: c.startswith("exact_name")).alias("rrf_exact_name"), total(lambda c: c.startswith("exact_address")).alias("rrf_exact_address"), total(lambda c: True).alias("rrf_total"),
        sum((F.col(c).isNotNull().cast("int") for c in channels), F.lit(0)).alias("supporting_channels"),
        F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in channels if c.startswith("exact_name")], F.lit(False)).alias("exact_name"),
        F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in channels if c.startswith("exact_address")], F.lit(False)).alias("exact_address"), *marks,
    )


@dataclass(frozen=True)
class FusionSpec:
    """strategy: rrf, exact_first or source_specific; one global budget, or one for each source."""

    strategy: str = "rrf"
    budget: int | None = 40
    source_budgets: dict[str, int] | None = None
    rescue_budget: int = 0
    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self):
        if self.strategy not in ("rrf", "exact_first", "source_specific"):
            raise ValueError(f"unknown strategy: {self.strategy}")
        if (self.budget is None) == (self.source_budgets is None):
            raise ValueError("give a global budget or one for each source")

    @property
    def key(self) -> str:
        budgets = f"global={self.budget}" if self.budget is not None else ",".join(f"{s}={b}" for s, b in sorted(self.source_budgets.items()))
        return f"{self.strategy}:{budgets}" + (f":rescue={self.rescue_budget}" if self.rescue_budget else "")


def specs(budgets=(20, 40, 80), strategies=("rrf", "exact_first"), source_budgets=(), adaptive=None, weights=None) -> list[FusionSpec]:
    """The grid: for each strategy each global budget and each (S2, S3) pair of budgets, then the adaptive (base, rescue) budgets.

    ``weights`` go to the source-specific strategy, which can't be scored without them.
    """
    own = lambda s: dict(weights or {}) if s == "source_specific" else {}
    out = []
    for s in strategies:
        out += [FusionSpec(s, b, weights=own(s)) for b in budgets]
        out += [FusionSpec(s, None, {"S2": x, "S3": y}, weights=own(s)) for x, y in source_budgets]
    if adaptive is not None:
        base, rescue = adaptive
        out += [FusionSpec(s, base, rescue_budget=rescue, weights=own(s)) for s in strategies]
    return out


def fusion_score(spec: FusionSpec, sources: tuple[str, ...] = ("S2", "S3")) -> Column:
    """The sum over channels, or for each source its weights times fuzzy names, fuzzy addresses and exact channels."""
    if spec.strategy != "source_specific":
        return F.col("rrf_total")
    if lacking := [s for s in sources if set(spec.weights.get(s, ())) != {"name", "address", "exact"}]:
        raise ValueError(f"weights of name, address and exact are needed for {', '.join(lacking)}")
    out = F.lit(None).cast("double")
    for source, w in spec.weights.items():
        fuzzy = lambda f: F.col(f"rrf_{f}") - F.col(f"rrf_exact_{f}")
        own = w["name"] * fuzzy("name") + w["address"] * fuzzy("address") + w["exact"] * (F.col("rrf_exact_name") + F.col("rrf_exact_address"))
        out = F.when(F.col("target_source") == source, own).otherwise(out)
    return out


def _with_ties(rank: Column, take: Column, key: Column, group) -> Column:
    """Rank up to take, or a key equal to that of the row at take."""
    edge = F.max(F.when(rank == take, key)).over(group)
    return (rank <= take) | F.coalesce(key == edge, F.lit(False))


def select_candidates(pairs: DataFrame, spec: FusionSpec, counted: DataFrame | None = None) -> DataFrame:
    """Exact pairs always; fuzzy ones up to the budget that exact ones leave, with all ties of the last.

    A query without exact pairs, or whose pairs have one channel at most, gets the rescue budget too.
    ``counted`` are the same pairs as ``Gathered.counted`` has them; without it, exact pairs are made once more to be counted.
    """
    by = ["s1_id"] if spec.budget is not None else ["s1_id", "target_source"]
    group, query = Window.partitionBy(*by), Window.partitionBy("s1_id")
    exact = F.col("exact_name") | F.col("exact_address")
    base = F.lit(spec.budget) if spec.budget is not None else F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(spec.source_budgets.items()) for x in kv])[F.col("target_source")], F.lit(0))
    # Exact pairs are counted and stay: only the others are dealt by query.
    scored = pairs.withColumn("fusion_score", fusion_score(spec))
    sure = scored.filter(exact)
    known = (pairs.withColumn("n", F.lit(1)) if counted is None else counted).filter(exact)
    df = _loose(scored, exact).join(known.groupBy(*by).agg(F.sum("n").alias("_n_exact")), by, "left").join(known.groupBy("s1_id").agg(F.max("supporting_channels").alias("_most")), "s1_id", "left")
    weak = F.col("_most").isNull() | (F.greatest("_most", F.max("supporting_channels").over(query)) <= 1)
    left = F.greatest(base + F.when(weak, spec.rescue_budget).otherwise(0) - F.coalesce("_n_exact", F.lit(0)), F.lit(0))
    key = F.struct(F.col("fusion_score"), F.col("supporting_channels"), F.col("target_content_key"))
    rank = F.row_number().over(group.orderBy(F.desc("fusion_score"), F.desc("supporting_channels"), "target_content_key", "target_id"))
    df = df.withColumns({"_rank": rank, "_left": left, "_key": key})
    df = df.withColumn("_chosen", _with_ties(F.col("_rank"), F.col("_left"), F.col("_key"), group)).filter("_chosen")
    kept = [c for c in scored.columns if c != "exact_only"]
    return sure.select(*kept).unionByName(df.select(*kept))


@dataclass(frozen=True)
class Budget:
    """Fusion with budgets. Weights are looked up as source:channel, then channel, then 1."""

    top_k: int = 40
    expanded_k: int | None = None
    source_quotas: dict[str, int] = field(default_factory=dict)
    channel_quotas: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    rrf_k: int = K
    preserve_channel_union: bool = False

    def __post_init__(self):
        if not 0 < self.top_k <= (self.expanded_k or self.top_k) <= 32767 or self.rrf_k <= 0:
            raise ValueError("0 < top_k <= expanded_k <= 32767, and rrf_k is positive")
        if set(self.source_quotas) - {"S2", "S3"}:
            raise ValueError("quotas are of S2 and S3")
        for quotas in (self.source_quotas, self.channel_quotas):
            if any(q < 0 for q in quotas.values()) or sum(quotas.values()) > self.top_k:
                raise ValueError("quotas must be 0 or more and fit into top_k")
        if any(w <= 0 for w in self.weights.values()):
            raise ValueError("weights must be positive")


# The named profiles.
PROFILES = {
    "fast_submission": Budget(top_k=40, preserve_channel_union=True),
    "safe_k40": Budget(top_k=40),
    "emergency_k20": Budget(top_k=20),
    "stretch_adaptive": Budget(top_k=40, expanded_k=400, source_quotas={"S2": 20, "S3": 20}),
    "competitive_adaptive": Budget(top_k=80, expanded_k=512, source_quotas={"S2": 40, "S3": 40}, preserve_channel_union=True),
    "max_score": Budget(top_k=80, expanded_k=8192, source_quotas={"S2": 40, "S3": 40}, preserve_channel_union=True),
}


def observed(evidence: DataFrame | Gathered, budget: Budget) -> DataFrame:
    """One row for each pair: score, number of channels, exactness, content and channel of the primary observation, and the support list."""
    if isinstance(evidence, Gathered):
        return evidence.each(lambda x: observed(x, budget))
    w = F.lit(1.0)
    for name, value in sorted(budget.weights.items()):
        if ":" not in name:
            w = F.when(F.col("channel") == name, value).otherwise(w)
    for name, value in sorted(budget.weights.items()):
        if ":" in name:
            w = F.when(F.concat_ws(":", "target_source", "channel") == name, value).otherwise(w)
    if "seen" in evidence.columns:
        return _observed(evidence, budget)
    rows = deduplicated(evidence).withColumn("_w", w / (budget.rrf_k + F.col("channel_rank")))
    seen = F.array_sort(F.collect_list(F.struct("channel", F.col("retrieval_score").cast("double").alias("score"), F.col("channel_rank").cast("int").alias("rank"), F.col("exact_match").alias("exact"), "_w")))
    primary = F.min(F.struct((~F.col("exact_match")).alias("x"), F.col("channel_rank").alias("r"), F.col("channel").alias("c"), F.col("retrieval_score").alias("s"), F.col("target_content_key").alias("key")))
    g = rows.groupBy(*PAIR).agg(seen.alias("_seen"), primary.alias("_p"))
    # Scores are summed in the channels' order, so equal evidence gives equal scores whatever the partitions.
    return g.select(
        *PAIR, F.col("_p.c").alias("channel"), F.col("_p.s").alias("retrieval_score"), F.col("_p.r").alias("channel_rank"), (~F.col("_p.x")).alias("exact_match"), F.col("_p.key").alias("target_content_key"),
        F.aggregate("_seen", F.lit(0.0), lambda a, x: a + x["_w"]).alias("fusion_score"), F.size("_seen").alias("n_channels"), F.transform("_seen", lambda x: F.struct(x["channel"].alias("channel"), x["score"].alias("score"), x["rank"].alias("rank"), x["exact"].alias("exact"))).alias("support"),
    )


def _observed(pairs: DataFrame, budget: Budget) -> DataFrame:
    """``observed`` of gathered pairs: what each has is there, so nothing is shuffled."""

    def weighted(x: Column) -> Column:
        w = F.lit(1.0)
        for name, value in sorted(budget.weights.items()):
            if ":" not in name:
                w = F.when(x["channel"] == name, value).otherwise(w)
        for name, value in sorted(budget.weights.items()):
            if ":" in name:
                w = F.when(F.concat_ws(":", F.col("target_source"), x["channel"]) == name, value).otherwise(w)
        return w / (budget.rrf_k + x["rank"])

    primary = F.array_min(F.transform("seen", lambda x: F.struct((~x["exact"]).alias("x"), x["rank"].alias("r"), x["channel"].alias("c"), x["score"].alias("s"), x["key"].alias("key"))))
    return pairs.withColumn("_p", primary).select(
        *PAIR, F.col("_p.c").alias("channel"), F.col("_p.s").alias("retrieval_score"), F.col("_p.r").alias("channel_rank"), (~F.col("_p.x")).alias("exact_match"), F.col("_p.key").alias("target_content_key"),
        F.aggregate("seen", F.lit(0.0), lambda a, x: a + weighted(x)).alias("fusion_score"), F.size("seen").alias("n_channels"), F.transform("seen", lambda x: F.struct(x["channel"].alias("channel"), x["score"].alias("score"), x["rank"].alias("rank"), x["exact"].alias("exact"))).alias("support"), "exact_only",
    )


def fuse(evidence: DataFrame | Gathered, budget: Budget, weak: DataFrame | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """Candidates under a budget: exact pairs always, then quotas of sources, quotas of channels, and the rest of the budget; ties at each cut stay.

    ``weak`` (s1_id) are queries that get expanded_k; ``also`` are further columns of each pair that ``observed`` makes. Each stage is a window over the
    query's pairs: all share one partitioning, so quotas cost no further shuffle.
    """
    see = lambda x: observed(x, budget).withColumns(also or {})
    every = evidence.each(see) if isinstance(evidence, Gathered) else see(evidence)
    kept = [c for c in every.columns if c != "exact_only"]
    if budget.preserve_channel_union:
        return every.select(*kept)
    members = [(F.col("target_source") == source, quota) for source, quota in sorted(budget.source_quotas.items())]
    members += [(F.exists("support", _is_channel(channel)), quota) for channel, quota in sorted(budget.channel_quotas.items())]
    members.append((F.lit(True), None))
    # Exact pairs are counted and stay: only the others are dealt by query.
    sure = every.filter("exact_match")
    known = evidence.counted(see).filter("exact_match") if isinstance(evidence, Gathered) else sure.withColumn("n", F.lit(1))
    counts = known.groupBy("s1_id").agg(F.sum("n").alias("_sure"), *[F.sum(F.when(m, F.col("n")).otherwise(0)).alias(f"_sure{i}") for i, (m, _) in enumerate(members)])
    df = _loose(every, F.col("exact_match")).join(counts, "s1_id", "left").fillna(0, [c for c in counts.columns if c != "s1_id"])
    if weak is not None and budget.expanded_k:
        df = df.join(weak.select("s1_id").distinct().withColumn("_weak", F.lit(True)), "s1_id", "left").withColumn("_b", F.when(F.col("_weak"), budget.expanded_k).otherwise(budget.top_k)).drop("_weak")
    else:
        df = df.withColumn("_b", F.lit(budget.top_k))
    df = df.withColumn("_chosen", F.lit(False))
    for i, (member, quota) in enumerate(members):
        df = _stage(df, member, quota, f"_sure{i}")
    return sure.select(*kept).unionByName(df.filter("_chosen").select(*kept))


def _is_channel(channel: str):
    return lambda x: x["channel"] == channel


def _stage(df: DataFrame, member: Column, quota: int | None, sure: str) -> DataFrame:
    """One cut of pairs that aren't exact; ``sure`` counts the exact ones that are members."""
    query = Window.partitionBy("s1_id")
    count = lambda c: F.sum(c.cast("int")).over(query)
    df = df.withColumn("_m", member).withColumn("_open", F.col("_m") & ~F.col("_chosen"))
    room = F.greatest(F.col("_b") - F.col("_sure") - count(F.col("_chosen")), F.lit(0))
    take = room if quota is None else F.least(room, F.greatest(F.lit(quota) - F.col(sure) - count(F.col("_chosen") & F.col("_m")), F.lit(0)))
    key = F.struct(F.col("fusion_score"), F.col("n_channels"), F.col("target_content_key"))
    group = Window.partitionBy("s1_id", "_open")
    rank = F.row_number().over(group.orderBy(F.desc("fusion_score"), F.desc("n_channels"), "target_content_key", "target_source", "target_id"))
    df = df.withColumns({"_take": take, "_key": key}).withColumn("_rank", rank)
    taken = F.col("_open") & _with_ties(F.col("_rank"), F.col("_take"), F.col("_key"), group)
    return df.withColumn("_chosen", F.col("_chosen") | taken).drop("_m", "_open", "_take", "_key", "_rank")


def fuse_exact(evidence: DataFrame, rrf_k: int = K) -> DataFrame:
    """All exact pairs; score = channels / (k + 1)."""
    g = evidence.filter("exact_match").groupBy(*PAIR).agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.min("target_content_key").alias("target_content_key"))
    return g.withColumn("fusion_score", F.size("channels") / F.lit(float(rrf_k + 1)))


def support_json(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("support_json", F.to_json("support")).drop("support")


def query_quality(evidence: DataFrame | Gathered, queries: DataFrame) -> DataFrame:
    """(s1_id, facts, weak) of each query. ``queries`` has s1_id, name_view and address_view.

    Weak: an empty view, a name under 5 or an address under 8 characters, no exact
    pair, a least margin under 0.05 (the gap of the two best of a source and fuzzy
    channel; 1 where there is one, 0 without any), no pair of two channels, or fewer
    than two fuzzy channels.
    """
    if isinstance(evidence, Gathered):
        fuzzy = _loose(evidence.near, F.lit(False)).select(*PAIR, F.explode(F.filter("seen", lambda x: ~x["exact"])).alias("x"))
        rows = fuzzy.select(*PAIR, "x.channel", F.col("x.score").alias("retrieval_score"), F.col("x.rank").alias("channel_rank"), F.col("x.exact").alias("exact_match"), F.col("x.key").alias("target_content_key"))
        by_pair = evidence.counted(lambda x: x.select("s1_id", "seen")).select("s1_id", F.size("seen").alias("n"), F.exists("seen", lambda x: x["exact"]).alias("e"))
    else:
        rows = deduplicated(evidence)
        by_pair = rows.groupBy(*PAIR).agg(F.count("*").alias("n"), F.max("exact_match").alias("e"))
    order = Window.partitionBy("s1_id", "target_source", "channel").orderBy("channel_rank", F.desc("retrieval_score"), "target_content_key")
    margins = rows.filter(~F.col("exact_match")).withColumns({"_n": F.row_number().over(order), "_next": F.lead("retrieval_score").over(order)}).filter("_n = 1")
    fuzzy = margins.groupBy("s1_id").agg(F.min(F.coalesce(F.col("retrieval_score") - F.col("_next"), F.lit(1.0))).alias("margin"), F.countDistinct("channel").alias("fuzzy_views"))
    pairs = by_pair.groupBy("s1_id").agg(F.max("n").alias("agreement"), F.max("e").alias("has_exact"))
    q = queries.join(fuzzy, "s1_id", "left").join(pairs, "s1_id", "left").select(
        "s1_id", (F.col("name_view") == "").alias("missing_name"), (F.col("address_view") == "").alias("missing_address"), (F.length("name_view") < 5).alias("short_name"), (F.length("address_view") < 8).alias("short_address"),
        F.coalesce("has_exact", F.lit(False)).alias("has_exact"), F.coalesce("margin", F.lit(0.0)).alias("min_margin"), F.coalesce("agreement", F.lit(0)).alias("max_agreement"), F.coalesce("fuzzy_views", F.lit(0)).alias("fuzzy_views"),
    )
    weak = F.col("missing_name") | F.col("missing_address") | F.col("short_name") | F.col("short_address") | ~F.col("has_exact") | (F.col("min_margin") < 0.05) | (F.col("max_agreement") < 2) | (F.col("fuzzy_views") < 2)
    return q.withColumn("weak", weak)


def rescue_queries(quality: DataFrame) -> DataFrame:
    return quality.filter(F.col("weak") & ~F.col("missing_name")).select("s1_id")
