"""Source records, ground truth, and their strict checks.

All columns are non-null strings and the empty string is a value. Nothing is
inferred: headers, schemas and ids are checked and errors name at most five examples.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
SOURCES = ("S1", "S2", "S3")
#: Dataset keys of a configuration.
DATASETS = ("train_source1", "train_source2", "train_source3", "train_ground_truth", "test_source1", "test_source2", "test_source3")


class DataError(ValueError):
    """Input that breaks its contract."""


@dataclass(frozen=True)
class DataPaths:
    paths: dict[str, Path]

    def __getitem__(self, key: str) -> Path:
        if key not in self.paths:
            raise KeyError(f"unknown dataset: {key}")
        return self.paths[key]


def load_paths(config: str | Path, root: str | Path | None = None) -> DataPaths:
    """The seven datasets of a YAML file, relative to root; a missing key is an error."""
    import yaml

    given = yaml.safe_load(Path(config).read_text()) or {}
    base = Path(root) if root else Path(config).resolve().parent.parent
    if lacking := [k for k in DATASETS if k not in given]:
        raise DataError(f"missing dataset keys: {', '.join(lacking)}")
    return DataPaths({k: base / given[k] for k in DATASETS})


def _schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def check_header(spark: SparkSession, path: str, columns: tuple[str, ...]) -> None:
    first = spark.read.text(str(path)).limit(1).collect()
    if not first:
        raise DataError(f"{path}: empty file")
    got = tuple(first[0][0].lstrip("﻿").split("\t"))
    if got != columns:
        raise DataError(f"{path}: header {got}, expected {columns}")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...], quoted: bool = True) -> DataFrame:
    """An all-string table; fields may be quoted unless told otherwise. A row of another arity is an error.

    The reader turns empty fields to null, so they are made empty again.
    """
    check_header(spark, path, columns)
    quote = {"quote": '"', "escape": '"'} if quoted else {"quote": ""}
    df = spark.read.csv(str(path), sep="\t", header=True, schema=_schema(columns), mode="FAILFAST", enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **quote)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def id_violations(df: DataFrame, prefix: str, key: str = "entity_id") -> DataFrame:
    """(kind, id): empty ids, ids without the prefix or with nothing after it, and ids that occur twice."""
    ids = df.select(F.coalesce(F.col(key), F.lit("")).alias("id"))
    kinds = F.when(F.trim("id") == "", "empty").when(~F.col("id").startswith(prefix) | (F.length("id") <= len(prefix)), "prefix")
    wrong = ids.select(kinds.alias("kind"), "id").filter("kind is not null")
    twice = ids.groupBy("id").count().filter("count > 1").select(F.lit("duplicate").alias("kind"), "id")
    return wrong.unionByName(twice)


def check_ids(df: DataFrame, prefix: str, key: str = "entity_id") -> DataFrame:
    bad = id_violations(df, prefix, key).orderBy("kind", "id").limit(5).collect()
    if bad:
        raise DataError("; ".join(f"{r['kind']} id {r['id']!r}" for r in bad))
    return df


def load_source(spark: SparkSession, path: str, source: str) -> DataFrame:
    return check_ids(read_tsv(spark, path, RECORD), f"{source}-")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """One record table with a source column."""
    out = None
    for source, df in frames.items():
        part = df.select(F.lit(source).alias("source"), *RECORD)
        out = part if out is None else out.unionByName(part)
    return out


def source_summary(records: DataFrame) -> DataFrame:
    """Rows, distinct ids, and ids that break the rules, by source; one pass."""
    prefix = F.concat(F.col("source"), F.lit("-"))
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return records.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("n_ids"), bad(F.trim("entity_id") == "").alias("n_empty"), bad(~F.startswith("entity_id", prefix)).alias("n_bad_prefix"),
    )


def listed(ids: str = "matched_entity_ids"):
    """Items of a comma list, trimmed; an empty or blank list has none."""
    c = F.coalesce(F.col(ids), F.lit(""))
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ","), lambda x: F.trim(x)))


def truth_lists(truth: DataFrame) -> DataFrame:
    """(s1_id, targets sorted and distinct); S1 ids without targets stay."""
    return truth.select(F.col(TRUTH[0]).alias("s1_id"), F.array_sort(F.array_distinct(F.filter(listed(), lambda x: x != ""))).alias("targets"))


def truth_edges(truth: DataFrame) -> DataFrame:
    return truth_lists(truth).select("s1_id", F.explode("targets").alias("target_id"))


def check_truth(truth: DataFrame) -> DataFrame:
    """Empty items, repeats in a list, targets outside S2 and S3, repeated or foreign S1 ids are errors; a blank list that isn't empty too."""
    items = truth.select(F.col(TRUTH[0]).alias("s1"), F.col(TRUTH[1]).alias("text"), listed().alias("t"))
    wrong = (
        F.when(~F.startswith("s1", F.lit("S1-")), "S1 id").when((F.col("text") != "") & (F.trim("text") == ""), "blank list").when(F.exists("t", lambda x: x == ""), "empty item")
        .when(F.size("t") != F.size(F.array_distinct("t")), "repeated target").when(F.exists("t", lambda x: ~x.rlike("^S[23]-.")), "foreign target")
    )
    bad = items.select(wrong.alias("kind"), "s1").filter("kind is not null").unionByName(items.groupBy("s1").count().filter("count > 1").select(F.lit("repeated S1 id").alias("kind"), "s1"))
    if got := bad.orderBy("kind", "s1").limit(5).collect():
        raise DataError("; ".join(f"{r['kind']}: {r['s1']!r}" for r in got))
    return truth


def truth_summary(truth: DataFrame) -> DataFrame:
    return truth_lists(truth).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.size("targets")), F.lit(0)).cast("long").alias("positive_edges"))


def onto_source(truth: DataFrame, source: str) -> DataFrame:
    """Truth lists with one source's targets only; every S1 stays."""
    return truth.withColumn("targets", F.filter("targets", lambda t: t.startswith(f"{source}-")))


def validate_all(spark: SparkSession, paths: DataPaths) -> dict[str, dict]:
    """Check all seven files; rows (and edges) by dataset."""
    out = {}
    for k in DATASETS:
        if k.endswith("ground_truth"):
            out[k] = truth_summary(check_truth(read_tsv(spark, paths[k], TRUTH))).first().asDict()
        else:
            out[k] = {"n_rows": load_source(spark, paths[k], f"S{k[-1]}").count()}
    return out


def fetch(records: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """The records of the ids; an id without a record is an error."""
    wanted = ids.select(key).distinct()
    if lost := wanted.join(records, key, "left_anti").limit(5).collect():
        raise DataError(f"unknown ids: {', '.join(r[0] for r in lost)}")
    return records.join(wanted, key, "left_semi")


def sample_queries(records: DataFrame, sample: DataFrame) -> DataFrame:
    """S1 records of a sample, in the sample's order (column ``_order``)."""
    return records.join(sample.select("s1_id", "_order"), records.entity_id == F.col("s1_id")).drop("s1_id").orderBy("_order")


def sample_truth(truth: DataFrame, sample: DataFrame) -> DataFrame:
    """Truth lists of a sample; ids without truth have an empty list."""
    return sample.select("s1_id").join(truth, "s1_id", "left").select("s1_id", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
