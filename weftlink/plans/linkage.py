"""Record-linkage queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, ratios, views
from ..operators import audit, blocking, decode, features, fusion, metrics, pairs, profile, ranker, sampling, sinks, tfidf
from ..sources import entities as source
from ..sources import records

#: Queries that SQL checks compare by lower case; the library's default is NFKC and case folding.
STRICT = False
TFIDF = tfidf.Config(top_k=10, threshold=0.2, min_df=2, max_features=50_000)


def _e(spark: SparkSession, d: str) -> DataFrame:
    return source.entities(spark, d)


def _s1(e: DataFrame) -> DataFrame:
    return e.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"))


def _truth(e: DataFrame) -> DataFrame:
    return records.truth_lists(source.truth_file(e))


def _exact(e: DataFrame) -> DataFrame:
    return blocking.exact(blocking.melted(e, strict=STRICT))


COLUMNS = ("s1_id", "target_id", "target_source", "channel", "retrieval_score", "channel_rank", "exact_match", "target_content_key")


def _fuzzy(e: DataFrame, column: str, channel: str, queries: DataFrame | None = None) -> DataFrame:
    return tfidf.joined(tfidf.bags(e, column, strict=STRICT), TFIDF, channel, query_filter=queries)


def _both_fuzzy(e: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """The best of names and addresses, of all queries or of those in a table of s1_id."""
    return _fuzzy(e, "business_name", "name_char_tfidf", queries).select(*COLUMNS).unionByName(_fuzzy(e, "business_address", "address_char_tfidf", queries).select(*COLUMNS))


def _evidence(e: DataFrame) -> DataFrame:
    """Exact channels, and the best of names and addresses."""
    return _exact(e).select(*COLUMNS).unionByName(_both_fuzzy(e))


def _gathered(e: DataFrame) -> fusion.Gathered:
    """The evidence by pair."""
    return pairs.gathered(e, _both_fuzzy(e), STRICT)


def _named(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))
    return c.unionByName(s).unionByName(p)


def source_validation(spark, d):
    return records.source_summary(_e(spark, d))


def _views(spark, d, strict):
    v = views.comparison_views(F.col("business_name"), True, strict)
    join = lambda c: F.array_join(c, "|")
    return _e(spark, d).select("entity_id", v.alias("v")).select("entity_id", "v.unicode_lower", "v.whitespace_normalized", "v.punctuation_normalized", "v.accent_folded", "v.alphanumeric_compact", join(F.col("v.word_tokens")).alias("word_tokens"), join(F.col("v.sorted_tokens")).alias("sorted_tokens"))


def norm_views(spark, d):
    return _views(spark, d, False)


def norm_views_strict(spark, d):
    return _views(spark, d, True)


def field_scripts(spark, d):
    return _e(spark, d).select("entity_id", views.script(F.col("business_name")).alias("script"))


def digit_tokens(spark, d):
    return _e(spark, d).select("entity_id", F.array_join(views.digits(views.lowered(F.col("business_address"), STRICT)), ",").alias("digits"))


SUFFIXES = (" Inc.", ", LLC", " Private Limited", " Company", " plc", "", " Ltd. ", " Corp", " pvt ltd", " Co-op")


def legal_suffix(spark, d):
    endings = F.array(*[F.lit(x) for x in SUFFIXES])
    named = _named(spark, d).withColumn("full_name", F.concat("name", F.element_at(endings, (F.col("k") % len(SUFFIXES) + 1).cast("int"))))
    return named.select("full_name", views.without_suffix(views.punctuation(F.col("full_name"), STRICT)).alias("bare_name"))


def terminal_postal(spark, d):
    endings = F.array(*[F.lit(x) for x in (" 12345", " 12345-6789", "9 123456", " 90210 ", "", " 1234")])
    at = F.expr("cast(conv(substr(content, 1, 4), 16, 10) as int) % 6 + 1")
    return _e(spark, d).withColumn("address", F.concat("business_address", F.element_at(endings, at))).select("entity_id", "address", views.terminal_postal(F.col("address")).alias("postal"))


def null_like_flags(spark, d):
    values = F.array(*[F.lit(x) for x in ("NULL", " n/a ", "nan", "--", "", "  ", "None", "nonesuch")])
    at = F.expr("cast(conv(substr(content, 1, 4), 16, 10) as int) % 16 + 1")
    v = F.when(at <= 8, F.element_at(values, F.least(at, F.lit(8)))).otherwise(F.col("business_address"))
    f = views.field(F.col("value"), STRICT)
    return _e(spark, d).select("entity_id", v.alias("value")).select("entity_id", "value", f["missing"].alias("missing"), f["null_like"].alias("null_like"), f["unicode"].alias("unicode_view"))


def content_tie_key(spark, d):
    return _e(spark, d).select("entity_id", hashing.tie_key(F.col("business_name"), F.col("business_address"), F.col("country")).alias("tie"))


def truth_edges(spark, d):
    return records.truth_edges(records.check_truth(source.truth_file(_e(spark, d))))


def truth_lists(spark, d):
    return _truth(_e(spark, d)).select("s1_id", F.array_join("targets", ",").alias("targets"))


def exact_block_top_k(spark, d):
    return blocking.exact_top_k(blocking.melted(_e(spark, d), strict=STRICT), 5).select("s1_id", "target_id", "target_source", "channel", "channel_rank")


def exact_block_all(spark, d):
    return fusion.fuse_exact(_exact(_e(spark, d))).select("s1_id", "target_id", "target_source", F.array_join("channels", "|").alias("channels"), F.round("fusion_score", 9).alias("fusion_score"))


def digit_overlap_block(spark, d):
    return blocking.digit_overlap(_e(spark, d), strict=STRICT)


def tfidf_idf(spark, d):
    g = tfidf.grams(_e(spark, d), "business_name", strict=STRICT)
    return tfidf.vocabulary(g.filter("source <> 'S1'"), TFIDF).select("source", "gram", F.round("idf", 6).alias("idf"))


def tfidf_topn_join(spark, d):
    return _fuzzy(_e(spark, d), "business_name", "name_char_tfidf").select("s1_id", "target_id", "target_source", "retrieval_score", "channel_rank")


def word_tfidf_topn(spark, d):
    words = lambda t: views.word_ngrams(views.tokens(t))
    config = tfidf.Config(top_k=20, threshold=0.35, min_df=2, max_features=40_000, inclusive=True, by_country=False)
    b = tfidf.bags(_e(spark, d), "business_name", words, STRICT, "accent_folded")
    return tfidf.joined(b, config, "name_word_tfidf").select("s1_id", "target_id", "target_source", "retrieval_score", "channel_rank")


def _quality(e, evidence):
    q = e.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), views.field(F.col("business_name"), STRICT)["unicode"].alias("name_view"), views.field(F.col("business_address"), STRICT)["unicode"].alias("address_view"))
    return fusion.query_quality(evidence, q)


def query_quality(spark, d):
    e = _e(spark, d)
    return _quality(e, _gathered(e)).withColumn("min_margin", F.round("min_margin", 6))


def rescue_missing_address(spark, d):
    e = _e(spark, d)
    weak = fusion.rescue_queries(_quality(e, _gathered(e)))
    return tfidf.rescue(e, weak, tfidf.Config(top_k=20, threshold=0.2), STRICT).select("s1_id", "target_id", "target_source", "channel", "retrieval_score", "channel_rank")


def prefix_block_negatives(spark, d):
    e = _e(spark, d)
    return blocking.prefix_negatives(e, source.edges(e), strict=STRICT)


def random_negatives(spark, d):
    e = _e(spark, d)
    return blocking.random_negatives(e, source.edges(e), 200)


def semi_anti_membership(spark, d):
    e = _e(spark, d)
    edges, found = source.edges(e), _exact(e).select("s1_id", "target_id").distinct()
    hit = edges.join(found, ["s1_id", "target_id"], "left_semi").select("s1_id", "target_id", F.lit("recovered").alias("kind"))
    return hit.unionByName(edges.join(found, ["s1_id", "target_id"], "left_anti").select("s1_id", "target_id", F.lit("missed").alias("kind")))


def union_topk(spark, d):
    return fusion.top_k(_evidence(_e(spark, d)), ["name_char_tfidf", "address_char_tfidf"], 3)


def provenance(spark, d):
    return _gathered(_e(spark, d)).each(lambda x: fusion.provenance(x).select("s1_id", "target_id", "target_source", "exact_name", "exact_address", "channels", "score_name_char_tfidf", F.coalesce("rank_name_char_tfidf", F.lit(0)).alias("rank_name_char_tfidf"), "score_address_char_tfidf", F.coalesce("rank_address_char_tfidf", F.lit(0)).alias("rank_address_char_tfidf"), "has_exact_name_accent_folded"))


def rrf_pivot(spark, d):
    r = lambda c: F.round(c, 9).alias(c)
    return _gathered(_e(spark, d)).each(lambda x: fusion.aggregated(x, depth=10).select("s1_id", "target_id", "target_source", r("rrf_name"), r("rrf_address"), r("rrf_exact_name"), r("rrf_exact_address"), r("rrf_total"), r("normalized_rank_name_char_tfidf"), F.col("supporting_channels").cast("long").alias("supporting_channels")))


def select_budget_ties(spark, d):
    g = _gathered(_e(spark, d))
    scored = lambda x: fusion.aggregated(x).withColumn("rrf_total", F.round("rrf_total", 9))
    return fusion.select_candidates(g.each(scored), fusion.FusionSpec("rrf", 3), g.counted(scored)).select("s1_id", "target_id", "target_source")


def fuse_no_quota(spark, d):
    e = _e(spark, d)
    return fusion.fuse(_gathered(e), fusion.Budget(top_k=4)).select("s1_id", "target_id", "target_source", "channel", "channel_rank", "exact_match", F.round("fusion_score", 9).alias("fusion_score"), F.col("n_channels").cast("long").alias("n_channels"))


def fuse_quota(spark, d):
    e = _e(spark, d)
    budget = fusion.Budget(top_k=6, source_quotas={"S2": 2, "S3": 2}, channel_quotas={"address_char_tfidf": 1})
    return fusion.fuse(_gathered(e), budget, also={"support_json": F.to_json("support")}).drop("support")


def _edge_countries(e):
    one = e.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("s1_country"))
    other = e.select(F.col("entity_id").alias("target_id"), F.col("country").alias("target_country"))
    return source.edges(e).join(one, "s1_id").join(other, "target_id")


def country_rollup(spark, d):
    return metrics.edge_agreement(_edge_countries(_e(spark, d)))


def _candidates_by_query(e: DataFrame, near: DataFrame, sizes: dict[str, Column]) -> DataFrame:
    """(s1_id, n_true, n_exact, n_found, n_* and t_* by size): candidates and true ones of each query.

    Exact pairs are counted by their keys and never made; ``near`` are the fuzzy pairs, those that a size holds for are counted where no exact channel has them.
    """
    true, exact = audit.TrueEdges(e, STRICT), F.size("channels") > 0
    loose = pairs.exact_of(near, e, STRICT).filter(~exact).join(true.lost(exact).select("s1_id", "target_id", F.lit(True).alias("_t")), ["s1_id", "target_id"], "left")
    per = loose.groupBy("s1_id").agg(*[F.count_if(w).alias(f"n_{k}") for k, w in sizes.items()], *[F.count_if(w & F.col("_t")).alias(f"t_{k}") for k, w in sizes.items()])
    return _s1(e).join(true.counts(exact), "s1_id", "left").join(pairs.n_exact(e, STRICT), "s1_id", "left").join(per, "s1_id", "left").fillna(0)


def candidate_metrics(spark, d):
    e = _e(spark, d)
    near = pairs.written(_both_fuzzy(e).select(*fusion.PAIR).distinct())
    per = _candidates_by_query(e, near, {"all": F.lit(True)})
    per = per.select("s1_id", "n_true", (F.col("n_exact") + F.col("n_all")).alias("n_pred"), (F.col("n_found") + F.col("t_all")).alias("tp"))
    rows = per.withColumn("f", metrics.f_beta(F.col("tp"), F.col("tp"), F.col("n_true"))).join(e.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    m = metrics.candidate_metrics(rows, ["country"])
    return m.select("grouping", "value", "entities", "truth_edges", "recalled", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in ("recall", "all_truth_rate", "mean", "median", "p90", "p95", "p99", "zero_rate", "oracle_f")], "max")


def volume_stats(spark, d):
    n = _evidence(_e(spark, d)).select("s1_id", "target_id").distinct().groupBy("s1_id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    v = metrics.volume(n, "k", "c")
    return v.select("count", F.round("mean", 9).alias("mean"), "median", F.round("p95", 9).alias("p95"), "max")


def duplicate_metrics(spark, d):
    keys = {"name": ["business_name"], "address": ["business_address"], "name_address": ["business_name", "business_address"], "all": ["business_name", "business_address", "country"], "content": ["content"]}
    return profile.duplicates(_e(spark, d), keys)


def profile_rates(spark, d):
    r = profile.rates(_e(spark, d), ["source", "country"], STRICT)
    return r.select("source", "country", "n_rows", *[F.round(c, 9).alias(c) for c in r.columns if c not in ("source", "country", "n_rows")])


def truth_structure(spark, d):
    e = _e(spark, d)
    return profile.truth_structure(_truth(e), e)


def edges_by_country(spark, d):
    e = _e(spark, d)
    return profile.edges_by_country(source.edges(e), e)


def oov_shift(spark, d):
    counted = profile.token_counts(_e(spark, d), "business_name", ["source"], STRICT)
    s = profile.shift(counted, "source", "S2", "S3")
    return s.select(F.round("oov_rate", 9).alias("oov_rate"), "total", "common_top")


def pareto_frontier(spark, d):
    """Exact pairs have rank 1 and are counted by their keys; of the others only those in a list are made."""
    e = _e(spark, d)
    sizes = (1, 2, 3, 5, 10)
    near = pairs.written(_both_fuzzy(e).groupBy(*fusion.PAIR).agg(F.min("channel_rank").alias("rank")))
    rows = _candidates_by_query(e, near, {str(k): F.col("rank") <= k for k in sizes})
    of_k = [F.struct(F.lit(k).alias("k"), (F.col("n_exact") + F.col(f"n_{k}")).alias("n_pred"), (F.col("n_found") + F.col(f"t_{k}")).alias("tp")) for k in sizes]
    rows = rows.select("n_true", F.explode(F.array(*of_k)).alias("_k")).select("n_true", "_k.*")
    rows = rows.withColumn("f", metrics.f_beta(F.col("tp"), F.col("tp"), F.col("n_true")))
    r = lambda c: F.round(c, 9)
    out = rows.groupBy("k").agg(r(F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("recall"), r(F.avg("f")).alias("oracle_f"), r(F.avg("n_pred")).alias("mean"), r(F.expr("percentile(n_pred, 0.95)")).alias("p95"))
    return metrics.pareto(pairs.written(out))


def miss_audit(spark, d):
    """Only the lost edges' channels are read: exact ones by their keys, and the lists of names and addresses of their queries."""
    e = _e(spark, d)
    true, by_address = audit.TrueEdges(e, STRICT), F.exists("channels", lambda c: c.startswith("exact_address_"))
    lost = pairs.written(true.lost(by_address).join(true.counts(by_address), "s1_id"))
    fuzzy = _both_fuzzy(e, lost).select("s1_id", "target_id", "channel").join(lost, ["s1_id", "target_id"], "left_semi")
    evidence = lost.select("s1_id", "target_id", F.explode("channels").alias("channel")).unionByName(fuzzy)
    return audit.flagged(lost, evidence, e, STRICT, country="en")


def miss_flag_table(spark, d):
    return audit.flag_table(miss_audit(spark, d))


def taxonomy_flags(spark, d):
    e = _e(spark, d)
    return audit.flag_table(audit.variations(_varied(e), e, STRICT), audit.TAXONOMY)


def _varied(e: DataFrame) -> DataFrame:
    """The best fuzzy name of each query and source; present where the address has a channel too."""
    best = pairs.written(_fuzzy(e, "business_name", "name_char_tfidf").filter("channel_rank = 1").select(*fusion.PAIR))
    by_address = F.exists("channels", lambda c: c.startswith("exact_address_"))
    return pairs.exact_of(best, e, STRICT).select("s1_id", "target_id", by_address.alias("present"))


def taxonomy_pairs(spark, d):
    """The flags that need no edit ratio and no script names."""
    e = _e(spark, d)
    names = [x for x in audit.TAXONOMY if x not in ("typographical_corruption", "cross_language_like", "other_unknown")]
    return audit.variations(_varied(e), e, STRICT).select("s1_id", "target_id", *names)


def miss_categories(spark, d):
    return audit.category_table(miss_audit(spark, d))


def miss_overlaps(spark, d):
    return audit.overlaps(miss_audit(spark, d))


def truth_summary(spark, d):
    return records.truth_summary(source.truth_file(_e(spark, d)))


def truth_onto_s2(spark, d):
    return records.onto_source(_truth(_e(spark, d)), "S2").select("s1_id", F.array_join("targets", ",").alias("targets"))


def fetched_targets(spark, d):
    """The records of all true targets; a target without one is an error."""
    e = _e(spark, d)
    return records.fetch(e, source.edges(e).select(F.col("target_id").alias("entity_id"))).select("entity_id", "business_name", "country")


def _sample(e: DataFrame) -> DataFrame:
    rows = sampling.lowest_hashes(_strata(e).select("s1_id", "tie"), "tie", 30)
    return rows.withColumn("_order", F.row_number().over(Window.orderBy("tie", "s1_id")))


def sampled_queries(spark, d):
    e = _e(spark, d)
    return records.sample_queries(e, _sample(e)).select("entity_id", "business_name", F.col("_order").alias("place"))


def sampled_truth(spark, d):
    e = _e(spark, d)
    return records.sample_truth(_truth(e), _sample(e)).select("s1_id", F.array_join("targets", ",").alias("targets"))


def hash_prefilter(spark, d):
    """Records whose content hash modulo 100 is below 3."""
    tie = hashing.tie_key(F.col("business_name"), F.col("business_address"), F.col("country"))
    return _e(spark, d).select("entity_id", hashing.bucket(tie, 100).alias("bucket")).filter("bucket < 3")


def seeded_order(spark, d):
    return source.edges(_e(spark, d)).select("s1_id", "target_id", hashing.seeded(13, F.col("s1_id"), F.col("target_id")).alias("order_key"))


def redacted_keys(spark, d):
    return _e(spark, d).select("entity_id", hashing.redacted(F.col("business_name"), F.col("business_address")).alias("redacted"))


def digit_agreement(spark, d):
    e = _e(spark, d)
    pairs = _exact(e).select("s1_id", "target_id").distinct()
    return blocking.with_digit_agreement(pairs, e, STRICT).select("s1_id", "target_id", "digit_overlap", "digits_equal")


def fold_counts(spark, d):
    t = sampling.fold_table(folds(spark, d), 5)
    return t.select("stratum", *[F.col(str(i)).cast("long").alias(f"fold_{i}") for i in range(5)])


def token_overlap_neutral(spark, d):
    """Token Jaccard and length ratio of name pairs, 1 where both are empty."""
    e = _e(spark, d)
    own = e.select("entity_id", views.field(F.col("business_name"), STRICT).alias("n"))
    pairs = source.edges(e).select("s1_id", "target_id")
    df = pairs.join(own.select(F.col("entity_id").alias("s1_id"), F.col("n").alias("q")), "s1_id").join(own.select(F.col("entity_id").alias("target_id"), F.col("n").alias("t")), "target_id")
    q, t = F.col("q"), F.col("t")
    return df.select("s1_id", "target_id", F.round(ratios.jaccard(q["tokens"], t["tokens"], 1.0), 9).alias("jaccard"), F.round(ratios.length_ratio(F.length(q["unicode"]), F.length(t["unicode"]), 1.0), 9).alias("lengths"))


def per_s1_scores(spark, d):
    """Counts and F0.5 of each S1 under the fallback decoder."""
    e = _e(spark, d)
    matches = decode.pairs(sinks.fallback_scores(fusion.observed(_exact(e).select(*COLUMNS), fusion.Budget())), sinks.FALLBACK)
    return metrics.per_s1(source.edges(e), matches, _s1(e)).withColumn("f", F.round("f", 9))


def source_specific_scores(spark, d):
    """Weighted fusion scores by source."""
    weights = {"S2": {"name": 1.0, "address": 0.5, "exact": 2.0}, "S3": {"name": 0.7, "address": 1.0, "exact": 1.5}}
    score = fusion.fusion_score(fusion.FusionSpec("source_specific", 40, weights=weights))
    return _gathered(_e(spark, d)).each(lambda x: fusion.aggregated(x).select("s1_id", "target_id", "target_source", F.round(score, 9).alias("fusion_score")))


def norm_views_strict_ascii(spark, d):
    """The strict views of names in ASCII, where case folding is lower-casing."""
    ascii_ids = _e(spark, d).filter(~F.col("business_name").rlike(r"[^\x00-\x7F]")).select("entity_id")
    return norm_views_strict(spark, d).join(ascii_ids, "entity_id", "left_semi")


def _strata(e):
    t = sampling.counts(_truth(e)).join(e.select(F.col("entity_id").alias("s1_id"), "country", hashing.tie_key(F.col("business_name"), F.col("business_address"), F.col("country")).alias("tie")), "s1_id")
    return t.select("s1_id", "country", "tie", sampling.cardinality(F.col("n")).alias("cardinality"), sampling.composition(F.col("n_s2"), F.col("n_s3")).alias("composition"), sampling.composition(F.col("n_s2"), F.col("n_s3"), sampling.FOLD_LABELS).alias("fold_composition"))


def stratified_round_robin(spark, d):
    return sampling.round_robin(_strata(_e(spark, d)), ["country", "cardinality", "composition"], "tie", 40).select("s1_id", "country", "cardinality", "composition")


def uniform_hash_sample(spark, d):
    e = _e(spark, d)
    rows = _strata(e).select("s1_id", "tie")
    return sampling.lowest_hashes(rows, "tie", 25, source.edges(e).select("s1_id"))


def folds(spark, d):
    s = _strata(_e(spark, d)).withColumn("stratum", F.concat_ws("_", "country", "cardinality", "fold_composition"))
    return sampling.folds(s, "stratum", 5, 13)


def hard_negatives(spark, d):
    e = _e(spark, d)
    o = _gathered(e).each(lambda x: fusion.observed(x, fusion.Budget()).select("s1_id", "target_id", "target_source", F.col("exact_match").cast("int").alias("exactness"), F.round("fusion_score", 9).alias("evidence")))
    labelled = ranker.labelled(o, source.edges(e))
    return sampling.hard_negatives(labelled, 2.0, 2, 4, 7).select("s1_id", "target_id", "target_source", "label")


def _plain(df: DataFrame, names) -> DataFrame:
    """Booleans as 0 and 1, numbers rounded."""
    kinds = {x.name: x.dataType.typeName() for x in df.select(*names).schema.fields}
    return df.select("s1_id", "target_id", "target_source", *[(F.round(c, 9) if kinds[c] == "double" else F.col(c) if kinds[c] == "string" else F.col(c).cast("int")).alias(c) for c in names])


def token_features(spark, d):
    f = features.field_features("name") | features.field_features("address") | features.name_features() | features.address_features()
    return _plain(features.exactly_joined(_e(spark, d), STRICT).withColumns(f), list(f))


def support_features(spark, d):
    f = features.support_features()
    return _gathered(_e(spark, d)).each(lambda x: _plain(fusion.observed(x, fusion.Budget()).withColumns(f), list(f)))


def string_ratio_features(spark, d):
    e = _e(spark, d)
    found = _fuzzy(e, "business_name", "name_char_tfidf").select("s1_id", "target_id", "target_source").distinct()
    return features.joined(found, e).select("s1_id", "target_id", *[c.alias(k) for k, c in features.ratio_features().items()])


def pair_features(spark, d):
    e = _e(spark, d)
    return features.compute(fusion.fuse(_gathered(e), fusion.Budget(top_k=6)), e)


def pair_analysis(spark, d):
    e = _e(spark, d)
    return features.group_means(features.analysis(source.edges(e), e, STRICT), "target_source")


def _scored(e, first: int | None = None):
    """Scores of all pairs, or of enough of them for the first of each query and source."""
    g = _gathered(e)
    score = F.aggregate("support", F.lit(0.0), lambda a, x: F.greatest(a, x["score"]))
    return (g if first is None else g.leading(first)).each(lambda x: fusion.observed(x, fusion.Budget()).select("s1_id", "target_id", "target_source", F.round(0.7 * score + 0.3 * F.col("n_channels") / 6, 6).alias("score")))


DECODER = decode.Decoder(threshold=0.5, source_thresholds={"S3": 0.55}, top_k=2, ownership=True, margin=0.01)


def decode_matches(spark, d):
    e = _e(spark, d)
    return decode.decode(_scored(e, DECODER.top_k), _s1(e), DECODER).select("s1_id", F.array_join("targets", ",").alias("targets"))


def threshold_search(spark, d):
    e = _e(spark, d)
    return decode.search(_scored(e), source.edges(e), _s1(e), (0.4, 0.6, 0.8), (1, 3)).select("threshold", "k", F.round("macro_f", 8).alias("macro_f"))


def macro_f05(spark, d):
    """Exact blocking, the fallback's scores and decoder, and macro F0.5."""
    e = _e(spark, d)
    fused = fusion.observed(_exact(e).select(*COLUMNS), fusion.Budget())
    matches = decode.pairs(sinks.fallback_scores(fused), sinks.FALLBACK)
    m = metrics.macro(metrics.per_s1(source.edges(e), matches, _s1(e)))
    return m.withColumn("macro_f", F.round("macro_f", 9))


def gbt_scores(spark, d):
    e = _e(spark, d)
    inputs = features.compute(fusion.fuse(_gathered(e), fusion.Budget(top_k=6)), e)
    # The trees' jobs and the scores read them; they are made once.
    rows = tfidf.stored(ranker.labelled(inputs, source.edges(e)))
    return ranker.score(ranker.fit(rows, iterations=5, depth=3), rows)


def ranker_diagnostics(spark, d):
    e = _e(spark, d)
    return ranker.diagnostics(_exact(e), source.edges(e), _s1(e)).withColumn("recall", F.round("recall", 9))


def submission_lists(spark, d):
    """Matches and candidates as their files have them."""
    e = _e(spark, d)
    candidates = fusion.fuse_exact(_exact(e))
    pairs = decode.pairs(sinks.fallback_scores(fusion.observed(_exact(e).select(*COLUMNS), fusion.Budget())), sinks.FALLBACK)
    m, c = sinks.lists_of(pairs, _s1(e)), sinks.lists_of(candidates, _s1(e))
    return m.select("s1_id", F.array_join("targets", ",").alias("matches")).join(c.select("s1_id", F.array_join("targets", ",").alias("candidates")), "s1_id")
