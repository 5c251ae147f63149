"""Files that leave the engine: submissions, candidate shards and manifests."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from . import decode


def submission_violations(matches: DataFrame, candidates: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(kind, s1_id): unknown or lacking S1 rows, repeated rows, unknown or repeated targets, and matches that aren't candidates. Inputs are (s1_id, targets)."""
    def of(lists: DataFrame, name: str) -> DataFrame:
        e = lists.select("s1_id", F.explode("targets").alias("target_id"))
        parts = [
            (lists.join(s1, "s1_id", "left_anti"), "unknown S1"), (s1.join(lists, "s1_id", "left_anti"), "lacking S1"), (lists.groupBy("s1_id").count().filter("count > 1"), "repeated S1"),
            (lists.filter(F.size("targets") != F.size(F.array_distinct("targets"))), "repeated target"), (e.join(targets.select("target_id"), "target_id", "left_anti"), "unknown target"),
        ]
        out = None
        for df, kind in parts:
            part = df.select(F.lit(f"{name}: {kind}").alias("kind"), "s1_id")
            out = part if out is None else out.unionByName(part)
        return out

    e = lambda d: d.select("s1_id", F.explode("targets").alias("target_id"))
    loose = e(matches).join(e(candidates), ["s1_id", "target_id"], "left_anti").select(F.lit("match without candidate").alias("kind"), "s1_id")
    return of(matches, "matches").unionByName(of(candidates, "candidates")).unionByName(loose)


def write_submission(matches: DataFrame, candidates: DataFrame, s1: DataFrame, targets: DataFrame, path: str) -> None:
    """Two tables, matching_results and candidate_pairs: tab-separated, sorted, one row for each S1. Nothing is written unless all checks hold; the directory must be new."""
    if bad := submission_violations(matches, candidates, s1, targets).orderBy("kind", "s1_id").limit(5).collect():
        raise ValueError("; ".join(f"{r['kind']}: {r['s1_id']}" for r in bad))
    for name, lists, column in (("matching_results", matches, "matched_entity_ids"), ("candidate_pairs", candidates, "candidate_entity_ids")):
        rows = lists.select(F.col("s1_id").alias("source1_entity_id"), F.array_join(F.array_sort("targets"), ",").alias(column))
        rows.repartitionByRange(1, "source1_entity_id").sortWithinPartitions("source1_entity_id").write.csv(f"{path}/{name}", sep="\t", header=True, quote="", emptyValue="", mode="errorifexists", lineSep="\n")


def lists_of(pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """(s1_id, targets sorted) of pairs, for every S1."""
    g = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_set("target_id")).alias("targets"))
    return s1.select("s1_id").join(g, "s1_id", "left").select("s1_id", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def fallback_scores(candidates: DataFrame) -> DataFrame:
    """Score 1 for pairs that have an exact name and an exact address channel (support list), else 0."""
    has = lambda part: F.exists("support", lambda x: x["exact"] & x["channel"].startswith(f"exact_{part}"))
    return candidates.select("s1_id", "target_id", "target_source", F.when(has("name") & has("address"), 1.0).otherwise(0.0).alias("score"))


#: Decoder of the fallback: certain pairs with one owner.
FALLBACK = decode.Decoder(threshold=1.0, ownership=True, margin=0.01)


def write_candidates(candidates: DataFrame, path: str, run: dict) -> dict:
    """Candidates as Parquet partitioned by source, and a manifest with the run's identity and rows; a second write of the same run is a no-op, of another an error."""
    spark: SparkSession = candidates.sparkSession
    identity = hashing.fingerprint(run)
    try:
        known = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:  # the path isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        if known["identity"] != identity:
            raise ValueError("the directory holds another run")
        return known
    candidates.write.partitionBy("target_source").option("compression", "zstd").parquet(f"{path}/rows", mode="overwrite")
    manifest = {"identity": identity, "run": run, "rows": spark.read.parquet(f"{path}/rows").count(), "written": datetime.now(UTC).isoformat()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    rows = spark.read.parquet(f"{path}/rows")
    if rows.count() != manifest["rows"]:
        raise ValueError("rows and manifest differ")
    return rows
