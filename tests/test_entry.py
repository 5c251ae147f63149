"""The driver's entry module: every query runs on the smallest tables, and SQL agrees where it exists."""

import duckdb
import pytest

import __spark_entry__ as engine
from weftlink.operators import blocking
from weftlink.plans import catalogue
from weftlink.streaming import linkage as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["miss_categories", "taxonomy_pairs", "prefix_block_negatives", "per_s1_scores", "sampled_truth", "seeded_order", "norm_views_strict_ascii", "source_validation", "norm_views", "legal_suffix", "terminal_postal", "null_like_flags", "truth_lists", "exact_block_all", "tfidf_topn_join", "profile_rates", "truth_structure", "folds", "macro_f05", "submission_lists"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cells(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x != x or x is None else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_sql_agrees(spark, sql, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), sql.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry(spark):
    assert engine.entry(spark).count() == 1


def test_names_and_oracles():
    assert set(engine.oracle_sql()) <= set(engine.queries())
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", ["fuse_quota", "pair_features", "taxonomy_flags", "random_negatives", "pair_analysis", "string_ratio_features", "norm_views_strict", "field_scripts"])
def test_queries_without_sql_run(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert list(df.toPandas().columns) == df.columns


def test_streamed_queries_equal_the_batch(spark, tmp_path):
    from weftlink.sources.entities import entities

    e = entities(spark, SF)
    keys = blocking.melted(e)
    one = e.filter("source = 'S1'").drop("source", "content")
    one.write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))
    q = stream.exact(read, keys).writeStream.format("memory").queryName("linked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("linked").select("s1_id", "target_id", "channel").collect()))
    assert got == sorted(map(tuple, blocking.exact(keys).select("s1_id", "target_id", "channel").collect()))
