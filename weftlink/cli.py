"""Command line: validate, profile, candidates, features, train and infer over TSV sources and Parquet shards."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, views
from .operators import blocking, decode, features, fusion, profile, ranker, sinks, tfidf
from .session import session
from .sources import records

FIELDS = (("business_name", "name_char_tfidf"), ("business_address", "address_char_tfidf"))
#: Similarity joins of all profiles but the fast one, and the rescue of weak queries of two of them.
SPARSE = tfidf.Config(top_k=80, threshold=0.2)
RESCUE = {"competitive_adaptive": tfidf.Config(top_k=80, threshold=0.2), "max_score": tfidf.Config(top_k=2048, threshold=0.18)}
COLUMNS = ("s1_id", "target_id", "target_source", "channel", "retrieval_score", "channel_rank", "exact_match", "target_content_key")


def _sources(spark: SparkSession, a) -> DataFrame:
    return records.union_sources({s: records.load_source(spark, p, s) for s, p in (("S1", a.s1), ("S2", a.s2), ("S3", a.s3))})


def retrieve(e: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """(evidence, weak queries) of a profile; the fast one has exact keys of the plain views only."""
    budget = fusion.PROFILES[name]
    if name == "fast_submission":
        return blocking.exact(blocking.melted(e, view_names=("unicode_preserving",))).select(*COLUMNS), None
    out = blocking.exact(blocking.melted(e)).select(*COLUMNS)
    for column, channel in FIELDS:
        out = out.unionByName(tfidf.joined(tfidf.bags(e, column), SPARSE, channel).select(*COLUMNS))
    if budget.expanded_k is None:
        return out, None
    q = e.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), views.field(F.col("business_name"))["unicode"].alias("name_view"), views.field(F.col("business_address"))["unicode"].alias("address_view"))
    quality = fusion.query_quality(out, q)
    weak = quality.filter("weak").select("s1_id")
    if name in RESCUE:
        out = out.unionByName(tfidf.rescue(e, fusion.rescue_queries(quality), RESCUE[name]).select(*COLUMNS))
    return out, weak


def candidates(e: DataFrame, name: str, run_id: str) -> DataFrame:
    evidence, weak = retrieve(e, name)
    return fusion.fuse(evidence, fusion.PROFILES[name], weak).withColumn("run_id", F.lit(run_id))


def _s1(e: DataFrame) -> DataFrame:
    return e.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftlink", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *extra: str, sources: bool = True):
        c = sub.add_parser(name)
        for x in (*(("s1", "s2", "s3") if sources else ()), *extra):
            c.add_argument(f"--{x}", required=True)
        return c

    command("validate", "truth")
    command("profile", "out")
    c = command("candidates", "out")
    c.add_argument("--profile", choices=sorted(fusion.PROFILES), default="fast_submission")
    c.add_argument("--submission", help="also write the fallback's submission here")
    command("features", "candidates", "out")
    c = command("train", "features", "truth", "out", sources=False)
    c.add_argument("--folds", type=int, default=5)
    command("infer", "features", "candidates", "artifact", "out")
    a = p.parse_args(argv)
    spark = session(master=a.master)

    if a.command == "validate":
        e, truth = _sources(spark, a), records.check_truth(records.read_tsv(spark, a.truth, records.TRUTH))
        print(json.dumps({"sources": [r.asDict() for r in records.source_summary(e).orderBy("source").collect()], "truth": records.truth_summary(truth).first().asDict()}))
    elif a.command == "profile":
        e = _sources(spark, a)
        profile.rates(e, ["source", "country"]).write.parquet(f"{a.out}/rates")
        profile.duplicates(e, {"name": ["business_name"], "address": ["business_address"], "all": list(records.RECORD[1:])}).write.parquet(f"{a.out}/duplicates")
        profile.top_tokens(profile.token_counts(e, "business_name", ["source"]), ["source"]).write.parquet(f"{a.out}/tokens")
    elif a.command == "candidates":
        e = _sources(spark, a)
        run = {"profile": a.profile, "sources": [a.s1, a.s2, a.s3]}
        found = candidates(e, a.profile, hashing.fingerprint(run)[:16])
        print(json.dumps(sinks.write_candidates(fusion.support_json(found), a.out, run)))
        if a.submission:
            own = features.parse_support(sinks.read_candidates(spark, a.out))
            matches = decode.decode(sinks.fallback_scores(own), _s1(e), sinks.FALLBACK)
            sinks.write_submission(matches, sinks.lists_of(own, _s1(e)), _s1(e), e.select(F.col("entity_id").alias("target_id")), a.submission)
    elif a.command == "features":
        own = features.parse_support(sinks.read_candidates(spark, a.candidates))
        if features.support_violations(own).limit(1).count():
            raise records.DataError("support lists and candidates disagree")
        features.compute(own, _sources(spark, a)).write.option("compression", "zstd").parquet(a.out)
    elif a.command == "train":
        from .operators import sampling

        truth = records.truth_lists(records.check_truth(records.read_tsv(spark, a.truth, records.TRUTH)))
        edges = truth.select("s1_id", F.explode("targets").alias("target_id"))
        counted = sampling.counts(truth).withColumn("stratum", F.concat_ws("_", F.lit("unknown"), sampling.cardinality(F.col("n")), sampling.composition(F.col("n_s2"), F.col("n_s3"), sampling.FOLD_LABELS)))
        rows = ranker.labelled(spark.read.parquet(a.features), edges).join(sampling.folds(counted, "stratum", a.folds).select("s1_id", "fold"), "s1_id")
        model, decoder, _ = ranker.train(rows, edges, truth.select("s1_id"), a.folds)
        print(json.dumps({"artifact": ranker.save(model, decoder, a.out, features.feature_names()), "decoder": decoder.__dict__}))
    else:
        e, own = _sources(spark, a), sinks.read_candidates(spark, a.candidates)
        matches = ranker.infer(a.artifact, spark.read.parquet(a.features), _s1(e))
        sinks.write_submission(matches, sinks.lists_of(own, _s1(e)), _s1(e), e.select(F.col("entity_id").alias("target_id")), a.out)


if __name__ == "__main__":
    main()
