"""From TSV files to a submission through the command line, and the choice of settings."""

import json


from weftlink import cli
from weftlink.operators import experiments, fusion
from weftlink.plans import linkage
from weftlink.sources.entities import edges, entities

SF = "/root/testdata/sf0.001"
HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
FILES = {
    "s1": "S1-a\tCafe Alpha\t12 Main St\tUS\nS1-b\tnull\t\tUS\nS1-c\tBeta\t9 Road\tUS\n", "s2": "S2-a\tCafé Alpha\t12 Main St\tUS\nS2-b\tBeta\t9 Road\tUS\n", "s3": "S3-a\tCafe Alpha\t\tUS\nS3-b\tGamma\t9 Road\tUS\n",
}


def test_files_to_submission(spark, tmp_path, capsys):
    paths = []
    for k, v in FILES.items():
        (tmp_path / f"{k}.tsv").write_text(HEAD + v)
        paths += [f"--{k}", str(tmp_path / f"{k}.tsv")]
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-a\tS2-a\nS1-b\t\nS1-c\tS2-b\n")
    cli.main(["validate", *paths, "--truth", str(truth)])
    assert json.loads(capsys.readouterr().out)["truth"] == {"n_rows": 3, "positive_edges": 2}
    out, sub = str(tmp_path / "c"), tmp_path / "sub"
    cli.main(["candidates", *paths, "--out", out, "--submission", str(sub)])
    read = lambda name: next((sub / name).glob("part-*")).read_text().splitlines()[1:]
    assert read("matching_results") == ["S1-a\t", "S1-b\t", "S1-c\tS2-b"]
    assert read("candidate_pairs") == ["S1-a\tS2-a,S3-a", "S1-b\t", "S1-c\tS2-b,S3-b"]
    cli.main(["features", *paths, "--candidates", out, "--out", str(tmp_path / "f")])
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4
    cli.main(["profile", *paths, "--out", str(tmp_path / "p")])
    assert spark.read.parquet(str(tmp_path / "p" / "rates")).count() == 3


def test_adaptive_profile(spark):
    e = entities(spark, SF)
    got = cli.candidates(e.drop("content"), "stretch_adaptive", "r")
    assert got.filter("exact_match").count() >= 74


def test_settings_are_chosen_on_development_folds(spark):
    e = entities(spark, SF)
    pairs = fusion.aggregated(linkage._evidence(e))
    specs = [fusion.FusionSpec("rrf", b) for b in (1, 5)]
    got = experiments.evaluate(pairs, specs, edges(e), linkage.folds(spark, SF), (0, 1, 2), experiments.Gates(0.5, 0.5, 50, 50))
    assert got["chosen"]["key"] == "rrf:global=1" and set(got["by_fold"]) == {3, 4}
    table = experiments.depth_table(linkage._evidence(e), edges(e), linkage._s1(e), {"name": ["name_char_tfidf"], "all": None}, (1, 10)).collect()
    assert len(table) == 4
    by = {(r["channels"], r["depth"]): r for r in table}
    assert by["all", 10]["recall"] >= by["name", 1]["recall"]
    assert experiments.output_bytes(10, 3, 6) == 20 and experiments.output_bytes(0, 0, 5) == 0
    assert "| a |" in experiments.markdown([{"a": 1}], ["a"])
