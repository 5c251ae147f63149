"""Operators of record linkage on small fixtures, against hand-made results and plain Python."""

import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from weftlink.operators import audit, blocking, decode, features, fusion, metrics, pairs, ranker, sampling, sinks, tfidf
from weftlink.plans import linkage
from weftlink.sources import entities as entities_source
from weftlink.sources import evidence as checks
from weftlink.sources import records

ROWS = [
    ("S1-a", "S1", "Cafe Alpha", "12 Main St", "US"), ("S1-b", "S1", "null", "", "US"), ("S1-c", "S1", "Beta", "9 Road", "US"), ("S2-a", "S2", "Café Alpha", "12 Main St", "US"), ("S2-b", "S2", "Beta", "9 Road", "US"),
    ("S3-a", "S3", "Cafe Alpha", "", "US"), ("S3-b", "S3", "Gamma", "9 Road", "US"), ("S3-f", "S3", "Beta", "9 Road", "France"),
]
EVIDENCE = "s1_id string, target_id string, target_source string, channel string, retrieval_score double, channel_rank int, exact_match boolean, target_content_key string"


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ROWS, "entity_id string, source string, business_name string, business_address string, country string")


@pytest.fixture(scope="module")
def four(spark):
    rows = [("S1-a", "S2-a", "S2", "name", 0.8, 1, False, "a"), ("S1-a", "S2-b", "S2", "name", 0.7, 2, False, "b"), ("S1-a", "S3-a", "S3", "address", 0.1, 9, False, "c"), ("S1-a", "S3-x", "S3", "exact_name", 1.0, 1, True, "x")]
    return spark.createDataFrame(rows, EVIDENCE)


def targets(df):
    return {r["target_id"] for r in df.collect()}


def test_exact_blocking_and_fallback(spark, entities):
    exact = blocking.exact(blocking.melted(entities))
    s1 = entities.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    c = {r["s1_id"]: r["targets"] for r in sinks.lists_of(fusion.fuse_exact(exact), s1).collect()}
    assert c == {"S1-a": ["S2-a", "S3-a"], "S1-b": [], "S1-c": ["S2-b", "S3-b"]}
    pairs = decode.pairs(sinks.fallback_scores(fusion.observed(exact, fusion.Budget())), sinks.FALLBACK)
    m = {r["s1_id"]: r["targets"] for r in sinks.lists_of(pairs, s1).collect()}
    assert m == {"S1-a": ["S2-a"], "S1-b": [], "S1-c": ["S2-b"]}


def test_exact_results_do_not_depend_on_partitions(entities):
    one = sorted(map(tuple, blocking.exact_top_k(blocking.melted(entities), 1).collect()))
    two = sorted(map(tuple, blocking.exact_top_k(blocking.melted(entities.orderBy(F.rand(3)).repartition(7)), 1).collect()))
    assert one == two


@pytest.mark.parametrize(
    ("budget", "want"),
    [
        (fusion.Budget(top_k=3, source_quotas={"S2": 1, "S3": 2}), {"S2-a", "S3-a", "S3-x"}), (fusion.Budget(top_k=1), {"S3-x"}), (fusion.Budget(top_k=2, channel_quotas={"address": 1}), {"S3-x", "S3-a"}), (fusion.Budget(top_k=1, preserve_channel_union=True), {"S2-a", "S2-b", "S3-a", "S3-x"}),
    ],
)
def test_budgets(four, budget, want):
    assert targets(fusion.fuse(four, budget)) == want


def test_ties_at_the_budget_stay(spark):
    rows = [("S1-a", "S2-z", "S2", "exact_name", 1.0, 1, True, "z")] + [("S1-a", t, "S3", "name", 0.5, 1, False, "same") for t in ("S3-x", "S3-y")]
    assert targets(fusion.fuse(spark.createDataFrame(rows, EVIDENCE), fusion.Budget(top_k=2))) == {"S2-z", "S3-x", "S3-y"}


def brute_fuse(rows, b):
    pairs = {}
    for s1, t, src, ch, sc, rk, ex, key in rows:
        p = pairs.setdefault((t, src), {})
        if ch not in p or (rk, -sc) < (p[ch][0], -p[ch][1]):
            p[ch] = (rk, sc, ex, key)
    out = []
    for (t, src), p in pairs.items():
        score = sum(1 / (b.rrf_k + p[c][0]) for c in sorted(p))
        key = min((not x[2], x[0], c, x[3]) for c, x in p.items())[3]
        out.append({"t": t, "src": src, "ch": set(p), "o": (-score, -len(p), key), "exact": any(x[2] for x in p.values())})
    chosen = {p["t"] for p in out if p["exact"]}

    def stage(member, quota):
        room = max(0, b.top_k - len(chosen))
        take = room if quota is None else min(room, max(0, quota - sum(p["t"] in chosen and member(p) for p in out)))
        free = sorted((p["o"], p["src"], p["t"]) for p in out if p["t"] not in chosen and member(p))
        if take:
            edge = free[min(take, len(free)) - 1][0] if len(free) >= take else None
            for i, (o, _, t) in enumerate(free):
                if i < take or o == edge:
                    chosen.add(t)

    for s, q in sorted(b.source_quotas.items()):
        stage(lambda p, s=s: p["src"] == s, q)
    for c, q in sorted(b.channel_quotas.items()):
        stage(lambda p, c=c: c in p["ch"], q)
    stage(lambda p: True, None)
    return chosen


def test_quotas_against_brute_force(spark):
    rng = random.Random(2)
    b = fusion.Budget(top_k=5, source_quotas={"S2": 2, "S3": 1}, channel_quotas={"address": 1, "name": 1})
    rows = []
    for q in range(25):
        for i in range(rng.randint(1, 14)):
            src = rng.choice(["S2", "S3"])
            for ch in rng.sample(["name", "address", "exact_name"], rng.randint(1, 2)):
                rows.append((f"S1-{q}", f"{src}-{i}", src, ch, rng.random(), rng.randint(1, 4), ch == "exact_name" and rng.random() < 0.3, rng.choice("abc")))
    got = {}
    for r in fusion.fuse(spark.createDataFrame(rows, EVIDENCE), b).collect():
        got.setdefault(r["s1_id"], set()).add(r["target_id"])
    for q in range(25):
        own = [r for r in rows if r[0] == f"S1-{q}"]
        assert got.get(f"S1-{q}", set()) == brute_fuse(own, b), q


@pytest.mark.parametrize(("pred", "true", "f"), [(["S2-1", "S3-1"], ["S2-1"], 0.5556), (["S2-1"], ["S2-1", "S3-1"], 0.8333), ([], [], 1.0), (["S2-1"], [], 0.0), (["S2-1"], ["S2-2"], 0.0)])
def test_f_scores(spark, pred, true, f):
    df = lambda x: spark.createDataFrame([("S1-1", t) for t in x], "s1_id string, target_id string")
    got = metrics.per_s1(df(true), df(pred), spark.createDataFrame([("S1-1",)], "s1_id string")).first()["f"]
    assert round(got, 4) == f


def brute_decode(rows, d):
    best = {}
    for s1, t, src, sc in rows:
        if (s1, t) not in best or sc > best[s1, t][1]:
            best[s1, t] = (src, sc)
    left = [(s1, t, src, sc) for (s1, t), (src, sc) in best.items() if sc >= d.cut(src)]
    kept = []
    for s1, src in {(r[0], r[2]) for r in left}:
        kept += sorted((r for r in left if (r[0], r[2]) == (s1, src)), key=lambda r: (-r[3], r[0], r[1]))[: d.top_k]
    out = set()
    for t in {r[1] for r in kept}:
        own = sorted((r for r in kept if r[1] == t), key=lambda r: (-r[3], r[0]))
        gap = own[0][3] - own[1][3] if len(own) > 1 else 9
        if gap >= d.margin or abs(gap - d.margin) <= 1e-12 + 1e-12 * d.margin:
            out.add((own[0][0], t))
    return out


def test_decoder_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(f"S1-{rng.randint(0, 9)}", f"{s}-{rng.randint(0, 6)}", s, round(rng.random(), 2)) for s in rng.choices(["S2", "S3"], k=200)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, target_source string, score double")
    for d in (decode.Decoder(0.3, {"S3": 0.5}, 2, True, 0.05), decode.Decoder(0.6, {}, 1, True, 0.0)):
        got = {(r["s1_id"], r["target_id"]) for r in decode.pairs(df, d).collect()}
        assert got == brute_decode(rows, d)
    with pytest.raises(ValueError):
        decode.Decoder(margin=0.1)


def test_hard_negatives(spark):
    rows = [("S1-a", "S2-p", "S2", 1, 1, 0.9)] + [("S1-a", f"S{s}-{i}", f"S{s}", 0, int(i == 0), i / 10) for s in (2, 3) for i in range(6)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, target_source string, label int, exactness int, evidence double")
    got = targets(sampling.hard_negatives(df, ratio=3.0, least=1, cap=10))
    assert got == {"S2-p", "S2-0", "S3-0"} | (got & {"S2-5", "S3-5"}) and len(got) == 4
    with pytest.raises(ValueError):
        sampling.hard_negatives(df, max_rows=2)


def test_tfidf_against_brute_force(spark, entities):
    from math import log, sqrt

    config = tfidf.Config(top_k=3, threshold=0.1, min_df=1)
    g = tfidf.grams(entities, "business_name")
    got = {(r["s1_id"], r["target_id"]): r["retrieval_score"] for r in tfidf.top_n(g, config, "name").collect()}
    vec = {}
    for r in g.collect():
        vec.setdefault((r["entity_id"], r["source"], r["country"]), {})[r["gram"]] = r["tf"]
    want = {}
    for src in ("S2", "S3"):
        own = {k: v for k, v in vec.items() if k[1] == src}
        idf = {x: log((1 + len(own)) / (1 + sum(x in v for v in own.values()))) + 1 for v in own.values() for x in v}

        def unit(v, idf=idf):
            w = {x: (1 + log(n)) * idf[x] for x, n in v.items() if x in idf}
            s = sqrt(sum(a * a for a in w.values()))
            return {x: a / s for x, a in w.items()}

        for q, v in vec.items():
            for t, u in own.items():
                if q[1] == "S1" and q[2] == t[2]:
                    a, b = unit(v), unit(u)
                    if (c := sum(a[x] * b.get(x, 0) for x in a)) > 0.1:
                        want[q[0], t[0]] = round(c, 6)
    assert got == pytest.approx(want, abs=2e-6)


def test_source_files(spark, tmp_path):
    p = tmp_path / "s1.tsv"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-a\tCafé\t\tUS\nS1-b\t\"x \"\"y\"\"\"\t1 Rd\tUS\n")
    got = [tuple(r) for r in records.load_source(spark, str(p), "S1").collect()]
    assert got == [("S1-a", "Café", "", "US"), ("S1-b", 'x "y"', "1 Rd", "US")]
    p.write_text("entity_id\tbusiness_name\n")
    with pytest.raises(records.DataError):
        records.load_source(spark, str(p), "S1")
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-a\t\t\t\nS1-a\t\t\t\nS2-b\t\t\t\n")
    with pytest.raises(records.DataError, match="duplicate"):
        records.load_source(spark, str(p), "S1")


def test_truth_rules(spark):
    t = lambda rows: spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string")
    ok = t([("S1-1", ""), ("S1-2", "S2-1"), ("S1-3", "S3-3,S2-2")])
    assert {r["s1_id"]: r["targets"] for r in records.truth_lists(records.check_truth(ok)).collect()} == {"S1-1": [], "S1-2": ["S2-1"], "S1-3": ["S2-2", "S3-3"]}
    assert records.truth_summary(ok).first().asDict() == {"n_rows": 3, "positive_edges": 3}
    for bad in ([("S1-1", "S2-1,,S2-2")], [("S1-1", "S2-1,S2-1")], [("S1-1", "S1-2")], [("S1-1", " ")], [("S1-1", ""), ("S1-1", "")]):
        with pytest.raises(records.DataError):
            records.check_truth(t(bad))


def test_evidence_checks(spark, four):
    checks.check(four, contiguous=False)
    with pytest.raises(records.DataError, match="ranks"):
        checks.check(four)
    wrong = four.withColumn("retrieval_score", F.lit(float("nan")))
    with pytest.raises(records.DataError, match="score"):
        checks.check(wrong, contiguous=False)


def test_pair_features_shape_and_values(spark, entities, four):
    f = features.compute(fusion.fuse(blocking.exact(blocking.melted(entities)), fusion.Budget()), entities)
    assert f.columns == features.SCHEMA.names and [x.dataType for x in f.schema] == [x.dataType for x in features.SCHEMA]
    assert len(features.feature_names()) == 87
    row = f.filter("s1_id = 'S1-a' and target_id = 'S2-a'").first()
    assert (row["name_raw_exact"], row["name_normalized_exact"], row["name_accent_exact"], row["address_raw_exact"]) == (0, 0, 1, 1)
    assert row["country_agreement"] == 1 and row["both_names_usable"] == 1 and row["exact_name_and_address"] == 0


def test_support_contract(spark):
    c = spark.createDataFrame([("a", 0.5, 2, False, [("a", 0.5, 2, False)]), ("a", 0.5, 2, False, [("b", 0.5, 2, False)]), ("a", 0.5, 2, False, [])], f"channel string, retrieval_score double, channel_rank int, exact_match boolean, support {features.SUPPORT}")
    assert features.support_violations(c).count() == 2


def test_submission_is_checked_before_it_is_written(spark, tmp_path):
    lists = lambda x: spark.createDataFrame(x, "s1_id string, targets array<string>")
    s1, t = spark.createDataFrame([("S1-a",), ("S1-b",)], "s1_id string"), spark.createDataFrame([("S2-a",)], "target_id string")
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="match without candidate"):
        sinks.write_submission(lists([("S1-a", ["S2-a"]), ("S1-b", [])]), lists([("S1-a", []), ("S1-b", [])]), s1, t, path)
    assert not (tmp_path / "out").exists()
    good = lists([("S1-b", []), ("S1-a", ["S2-a"])])
    sinks.write_submission(good, good, s1, t, path)
    text = next((tmp_path / "out" / "matching_results").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-a\tS2-a\nS1-b\t\n"


def test_candidates_are_written_once(spark, tmp_path, four):
    c = fusion.support_json(fusion.fuse(four, fusion.Budget()))
    path = str(tmp_path / "c")
    first = sinks.write_candidates(c, path, {"profile": "x"})
    assert sinks.write_candidates(c, path, {"profile": "x"}) == first
    with pytest.raises(ValueError):
        sinks.write_candidates(c, path, {"profile": "y"})
    assert sinks.read_candidates(spark, path).count() == first["rows"] == 4


def test_trees_learn_and_reload(spark, tmp_path):
    rows = [(f"S1-{i}", f"S2-{j}", "S2", float(i == j), float((i * j) % 7), int(i == j)) for i in range(20) for j in range(6)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, target_source string, same double, noise double, label int")
    m = ranker.fit(df, ["target_source", "same", "noise"], iterations=3, depth=2)
    path = str(tmp_path / "artifact")
    ranker.save(m, decode.Decoder(0.5, {}, 1, True, 0.0), path, ["target_source", "same", "noise"])
    got = ranker.infer(path, df, df.select("s1_id").distinct())
    assert {r["s1_id"]: r["targets"] for r in got.collect()} == {f"S1-{i}": [f"S2-{i}"] if i < 6 else [] for i in range(20)}


def test_samples(spark):
    rows = spark.createDataFrame([(f"S1-{i}", "x" if i < 8 else "y", f"{i % 5}") for i in range(12)], "s1_id string, k string, h string")
    got = sampling.round_robin(rows, ["k"], "h", 6).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"x": 3, "y": 3}
    assert {r["h"] for r in sampling.lowest_hashes(rows, "h", 2).collect()} == {"0", "1"}
    f = sampling.folds(rows, "k", 3).groupBy("stratum", "fold").count().collect()
    assert sorted(r["count"] for r in f if r["stratum"] == "x") == [2, 3, 3] and sum(r["count"] for r in f) == 12
    with pytest.raises(ValueError):
        sampling.round_robin(rows, ["k"], "h", 99)


def test_pareto(spark):
    rows = [(1, 0.9, 0.9, 5.0, 9.0), (2, 0.9, 0.9, 6.0, 9.0), (3, 0.95, 0.9, 7.0, 9.0)]
    got = metrics.pareto(spark.createDataFrame(rows, "k int, recall double, oracle_f double, mean double, p95 double"))
    assert {r["k"] for r in got.collect()} == {1, 3}


def test_variations(spark):
    def rec(i, n, a):
        return [(f"S1-{i}", "S1", n[0], a[0], "US"), (f"S2-{i}", "S2", n[1], a[1], "US")]

    road = ("1 Rd", "1 Rd")
    cases = [
        (("Zoë Hill", "Zoe Hill"), road, "accent_unicode"),
        (("Green Moss", "Moss Green"), road, "token_reorder"),
        (("Fern Inc", "Fern LLC"), road, "legal_suffix"),
        (("Mill Pond", "Millpond"), road, "token_segmentation"),
        (("Grand Oak Yard", "GOY"), road, "abbreviation_initials"),
        (("Bramble Works", "Brambel Works"), road, "typographical_corruption"),
        (("Lark", "Ларк"), road, "cross_language_like"),
        (("", "Heron"), road, "missing_or_null_name"),
        (("Heron", "Heron"), ("", "2 Rd"), "missing_address"),
        (("Heron", "Heron"), ("12 Rd", "21 Rd"), "digit_address_conflict"),
        (("Ab", "Heron"), ("", "9 Long Road"), "both_fields_sparse"),
        (("Heron Bay", "Otter Works Depot"), road, "other_unknown"),
    ]
    df = spark.createDataFrame([r for i, (n, a, _) in enumerate(cases) for r in rec(i, n, a)], "entity_id string, source string, business_name string, business_address string, country string")
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", i % 2 == 0) for i in range(len(cases))], "s1_id string, target_id string, present boolean")
    got = {r["s1_id"]: r for r in audit.variations(pairs, df).collect()}
    for i, (*_, flag) in enumerate(cases):
        row = got[f"S1-{i}"]
        assert row[flag], flag
        assert row["fusion_truncation"] == (i % 2 == 0) and row["absent_every_channel"] == (i % 2 == 1)
        assert row["other_unknown"] == (not any(row[f] for f in audit.TAXONOMY[:11]))
    table = {r["flag"]: r for r in audit.flag_table(audit.variations(pairs, df), audit.TAXONOMY).collect()}
    assert table["token_reorder"]["n_rows"] == 2 and table["token_reorder"]["examples"] == "S1-0>S2-0;S1-1>S2-1"


def test_missed_categories(spark):
    records = [("S1-1", "S1", "Fern", "1 Rd", "India"), ("S2-1", "S2", "Fern", "", "India"), ("S2-2", "S2", "Fern Inc", "1 Rd", "India"), ("S3-1", "S3", "Fern", "9 Rd", "India"), ("S3-2", "S3", "Moss", "9 Rd", "India")]
    df = spark.createDataFrame(records, "entity_id string, source string, business_name string, business_address string, country string")
    edges = spark.createDataFrame([("S1-1", t, t[:2]) for t in ("S2-1", "S2-2", "S3-1", "S3-2")], "s1_id string, target_id string, target_source string")
    evidence = spark.createDataFrame([("S1-1", "S3-1", "name_char_tfidf"), ("S1-1", "S3-2", "address_char_tfidf")], "s1_id string, target_id string, channel string")
    got = {r["target_id"]: r for r in audit.missed(edges, edges.limit(0), evidence, df).collect()}
    want = {"S2-1": "absent_top80_target_address_missing", "S2-2": "absent_top80_weak_name", "S3-1": "name_evidence_fusion_truncation", "S3-2": "address_evidence_fusion_truncation"}
    assert {t: r["primary_category"] for t, r in got.items()} == want
    assert got["S2-2"]["legal_suffix_or_token_order_variation"] and got["S3-1"]["s3_specific_concentration"] and got["S2-1"]["india_specific_concentration"]
    kept = edges.filter("target_id = 'S2-1'")
    assert {r["primary_category"] for r in audit.missed(edges, kept, evidence, df).collect()} == {"absent_top80_weak_name", "multi_match_truncation"}
    table = {r["primary_category"]: r["n_rows"] for r in audit.category_table(audit.missed(edges, edges.limit(0), evidence, df)).collect()}
    assert table == {c: 1 for c in want.values()} and set(table) <= set(audit.CATEGORIES)


def test_specs_and_weights():
    weights = {s: {"name": 1.0, "address": 1.0, "exact": 1.0} for s in ("S2", "S3")}
    grid = fusion.specs((20, 40), ("rrf", "source_specific"), ((10, 30),), (20, 60), weights)
    assert len(grid) == 2 * 3 + 2 and len({x.key for x in grid}) == len(grid)
    assert {x.rescue_budget for x in grid} == {0, 60} and {"S2": 10, "S3": 30} in [x.source_budgets for x in grid]
    with pytest.raises(ValueError):
        fusion.fusion_score(fusion.FusionSpec("source_specific", 40))


def test_tune_searches_ownership_margins_and_sources(spark):
    scored = [("S1-1", "S2-1", "S2", 0.62), ("S1-1", "S3-1", "S3", 0.86), ("S1-2", "S2-1", "S2", 0.58), ("S1-2", "S3-2", "S3", 0.78), ("S1-2", "S3-1", "S3", 0.70)]
    df = spark.createDataFrame(scored, "s1_id string, target_id string, target_source string, score double")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S3-2")], "s1_id string, target_id string")
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    best = decode.tune(df, truth, s1, (0.5, 0.7), (1, 3))
    got = {r["s1_id"]: r["targets"] for r in decode.decode(df, s1, best).collect()}
    assert got == {"S1-1": ["S2-1", "S3-1"], "S1-2": ["S3-2"]}
    shared = truth.union(spark.createDataFrame([("S1-2", "S2-1"), ("S1-2", "S3-1")], truth.schema))
    assert not decode.tune(df, shared, s1, (0.5, 0.7), (1, 3)).ownership


def _brute(g, top_k, threshold, min_df=2):
    """Lists of (target, source, score, rank) by query out of gram rows, by plain loops."""
    from collections import Counter, defaultdict
    from math import log, sqrt

    rows = [(r["entity_id"], r["source"], r["country"], r["tie"], r["gram"], r["tf"]) for r in g.collect()]
    out = {}
    for src in ("S2", "S3"):
        n = len({r[0] for r in rows if r[1] == src})
        df = Counter(r[4] for r in rows if r[1] == src)
        idf = {x: log((1 + n) / (1 + c)) + 1 for x, c in df.items() if c >= min_df}
        raw = [(*r[:5], (1 + log(r[5])) * idf[r[4]]) for r in rows if r[4] in idf]
        norm = defaultdict(float)
        for r in raw:
            norm[r[0]] += r[5] ** 2
        of = defaultdict(list)
        for r in raw:
            if r[1] == src and r[2] is not None:
                of[r[2], r[4]].append((r[0], r[3], r[5] / sqrt(norm[r[0]])))
        score = defaultdict(float)
        for r in raw:
            for t, tie, w in of[r[2], r[4]] if r[1] == "S1" else ():
                score[r[0], t, tie] += r[5] / sqrt(norm[r[0]]) * w
        for q in {k[0] for k in score}:
            best = sorted((-round(s, 6), tie, t) for (a, t, tie), s in score.items() if a == q and round(s, 6) > threshold)[:top_k]
            out |= {(q, t, tie): (src, -s, i + 1) for i, (s, tie, t) in enumerate(best)}
    return out


def test_joined_in_tiles_against_brute_force(spark, monkeypatch):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdeo", k=draw.randint(1, 6))) for _ in range(60)]
    names = [" ".join(draw.choices(words, k=draw.randint(1, 6))) for _ in range(90)]
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", draw.choice(names), str(i % 7), draw.choice(["A", "A", "B", None])) for i in range(420)]
    # Many copies, a record that is there twice, ids that are there with several names and countries, names without a gram.
    rows += [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", names[0], "x", "A") for i in range(420, 480)] + [rows[0], rows[1]]
    rows += [(rows[i][0], rows[i][1], names[i + 5], "y", c) for i, c in ((3, "A"), (3, "B"), (4, "A"), (5, "B"))] + [("S1-e", "S1", "", "", "A"), ("S2-e", "S2", " - ", "", "A")]
    e = spark.createDataFrame(rows, "entity_id string, source string, business_name string, business_address string, country string")
    monkeypatch.setattr(tfidf, "TILE_Q", 16)
    monkeypatch.setattr(tfidf, "TILE_T", 24)
    config = tfidf.Config(top_k=4, threshold=0.3)
    g = tfidf.grams(e, "business_name")
    want = _brute(g, 4, 0.3)
    assert len(want) > 500
    for df in (tfidf.joined(tfidf.bags(e, "business_name"), config, "name"), tfidf.top_n(g, config, "name")):
        got = [((r["s1_id"], r["target_id"], r["target_content_key"]), (r["target_source"], r["retrieval_score"], r["channel_rank"])) for r in df.collect()]
        assert len(got) == len(dict(got)) and dict(got) == want


def test_joined_shuffles_texts_not_products(spark, tmp_path):
    """One common word in all names: each pair of records has products, but the rows between stages stay a few a record."""
    n = 1500
    e = spark.range(n).selectExpr("concat('S', id % 3 + 1, '-', id) as entity_id", "concat('S', id % 3 + 1) as source", "concat('common ', substr(md5(cast(id as string)), 1, 8)) as business_name", "'' as business_address", "'A' as country")
    df = tfidf.top_n(tfidf.grams(e, "business_name"), tfidf.Config(top_k=3, threshold=0.1), "name")
    assert max(_written(spark, df, tmp_path)) < 40 * n


def _written(spark, df, folder):
    """Records that each stage shuffles as df is written."""
    spark.sparkContext.setJobGroup(str(folder), "")
    df.write.parquet(str(folder / "out"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store, out = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), []
    for stage in {x for j in tracker.getJobIdsForGroup(str(folder)) for x in tracker.getJobInfo(j).stageIds}:
        try:
            out.append(store.lastStageAttempt(stage).shuffleWriteRecords())
        except Py4JJavaError:  # skipped
            pass
    return out


def test_best_is_exact_for_dense_and_rare_grams(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(3)

    class Side:
        def __init__(self, n):
            self.n, self.size = n, draw.integers(1, 12, n)
            self.start = np.cumsum(self.size) - self.size
            self.row = np.repeat(np.arange(n), self.size)
            self.ids = (draw.random(self.size.sum()) ** 3 * 50).astype(np.int64)
            self.w = draw.random(self.size.sum()) / 6

        def full(self):
            m = np.zeros((self.n, 50))
            np.add.at(m, (self.row, self.ids), self.w)
            return m

    q, t = Side(40), Side(70)
    place, config = draw.integers(0, 9, 70), tfidf.Config(top_k=5, threshold=0.05)
    score = np.round(q.full() @ t.full().T, 6)
    want = set()
    for i in range(40):
        order = np.lexsort((place, -score[i]))
        edge = order[4]
        want |= {(i, j, score[i, j]) for j in range(70) if score[i, j] > 0.05 and (-score[i, j], place[j]) <= (-score[i, edge], place[edge])}
    monkeypatch.setattr(tfidf, "STEP", 7)
    for part, dense in ((0.0, 2048), (0.1, 6), (2.0, 2048)):
        monkeypatch.setattr(tfidf, "PART", part)
        monkeypatch.setattr(tfidf, "DENSE", dense)
        got = {(a, b, round(c, 6)) for a, b, c in zip(*(v.tolist() for v in tfidf.best(q, t, place, 50, config)), strict=True)}
        assert {x[:2] for x in got} == {x[:2] for x in want}
        assert got == {(a, b, round(float(c), 6)) for a, b, c in want}


def test_exact_pairs_are_the_distinct_ones_and_not_shuffled(spark, monkeypatch, tmp_path):
    draw = random.Random(8)
    names, streets = ["Café One", "Cafe One", "cafe one ", "Two", "\uff9e", "\uff9e ", "", "null"], ["1 Rd", "1 rd.", "2 Rue É", "2 rue e", "", "n/a"]
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", draw.choice(names), draw.choice(streets), draw.choice(["A", "A", "B", None])) for i in range(150)]
    # A record that is there twice, and ids with several contents.
    rows += [rows[0], rows[1], (rows[3][0], rows[3][1], "Two", "9 Rd", "A"), (rows[4][0], rows[4][1], "Two", "", "B")]
    e = spark.createDataFrame(rows, "entity_id string, source string, business_name string, business_address string, country string")
    pairs = blocking.exact(blocking.melted(e, strict=False)).select("s1_id", "target_id", "target_source").distinct()
    columns = ["s1_id", "target_id", "target_source", "q.raw_name", "q.raw_address", "t.raw_name", "t.raw_address"]
    want = sorted(map(str, features.joined(pairs, e, False).select(*columns).collect()))
    for size in (40, 500_000):
        monkeypatch.setattr(features, "PART_PAIRS", size)
        assert sorted(map(str, features.exactly_joined(e, False).select(*columns).collect())) == want
    n = 900
    e = spark.range(n).selectExpr("concat('S', id % 3 + 1, '-', id) as entity_id", "concat('S', id % 3 + 1) as source", "'Common' as business_name", "cast(id as string) as business_address", "'A' as country")
    f = features.field_features("name") | features.name_features()
    assert max(_written(spark, features.exactly_joined(e, False).select("s1_id", "target_id", *[c.alias(k) for k, c in f.items()]), tmp_path)) < 10 * n


def test_gathered_pairs_say_what_evidence_says_and_are_not_shuffled(spark, monkeypatch, tmp_path):
    draw = random.Random(9)
    names, streets = ["Café One", "Cafe One", "cafe one ", "Two", "\uff9e", "", "null"], ["1 Rd", "1 rd.", "2 Rue É", "2 rue e", ""]
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", draw.choice(names), draw.choice(streets), draw.choice(["A", "A", "B", None])) for i in range(90)]
    # An id that occurs with several contents on both sides, and a record that is there twice.
    rows += [rows[1], (rows[3][0], "S1", "Two", "1 Rd", "A"), (rows[3][0], "S1", "Cafe One", "1 Rd", "A"), (rows[4][0], "S2", "Two", "1 Rd", "A"), (rows[4][0], "S2", "Café One", "1 rd.", "A")]
    schema = "entity_id string, source string, business_name string, business_address string, country string"
    e = spark.createDataFrame(rows, schema)
    found = [(f"S1-{i}", f"S{s}-{i + s - 1 + 3 * k}", f"S{s}", c, 0.9 - k / 10, k + 1, False, f"k{k}") for i in range(0, 60, 3) for s in (2, 3) for k in range(3) for c in ("name_char_tfidf", "address_char_tfidf")]
    fuzzy = spark.createDataFrame(found, EVIDENCE)
    evidence = blocking.exact(blocking.melted(e, strict=False)).select(*fuzzy.columns).unionByName(fuzzy)
    budget = fusion.Budget(top_k=4, source_quotas={"S2": 1, "S3": 2}, channel_quotas={"address_char_tfidf": 1})
    kinds = (fusion.provenance, lambda x: fusion.observed(x, fusion.Budget()).drop("exact_only"), lambda x: fusion.aggregated(x).drop("exact_only"), lambda x: fusion.fuse(x, budget), lambda x: fusion.select_candidates(fusion.aggregated(x), fusion.FusionSpec("rrf", 3, rescue_budget=1)))
    monkeypatch.setattr(features, "PART_PAIRS", 40)
    gathered = pairs.gathered(e, fuzzy, False)
    for f in kinds:
        want, got = f(evidence), f(gathered)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(features, "PART_PAIRS", 500_000)
    n = 900
    e = spark.range(n).selectExpr("concat('S', id % 3 + 1, '-', id) as entity_id", "concat('S', id % 3 + 1) as source", "'Common' as business_name", "cast(id as string) as business_address", "'A' as country")
    assert max(_written(spark, fusion.provenance(pairs.gathered(e, fuzzy, False)), tmp_path)) < 10 * n


def _mixed(spark):
    """Records with copies, without country, there twice, and ids with several contents."""
    draw = random.Random(10)
    texts = [(n, a) for n in ("Café One", "Cafe One", "Two", "", "null") for a in ("1 Rd", "2 Rue É", "")]
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", *draw.choice(texts), draw.choice(["A", "A", "B", None])) for i in range(120)]
    rows += [rows[0], rows[1], *[(rows[k][0], rows[k][1], *t, "A") for k in (3, 4, 6, 7) for t in texts[:7:2]]]
    return spark.createDataFrame([(*r, f"{r[2]}|{r[3]}") for r in rows], "entity_id string, source string, business_name string, business_address string, country string, content string")


def test_true_edges_by_class_are_those_of_records(spark, tmp_path):
    e = _mixed(spark)
    exact = blocking.exact(blocking.melted(e, strict=False))
    edges = entities_source.edges(e).distinct()
    seen = exact.groupBy("s1_id", "target_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    every = {(r["s1_id"], r["target_id"]): set(r["channels"] or ()) for r in edges.join(seen, ["s1_id", "target_id"], "left").collect()}
    true = audit.TrueEdges(e, False)
    for prefix in ("exact_address_", "exact_"):
        held = F.exists("channels", lambda c: c.startswith(prefix))  # noqa: B023
        keep = {k for k, v in every.items() if any(c.startswith(prefix) for c in v)}
        lost = true.lost(held).collect()
        assert 0 < len(lost) == len(every) - len(keep) and {(r["s1_id"], r["target_id"]): set(r["channels"]) for r in lost} == {k: v for k, v in every.items() if k not in keep}
        for r in true.counts(held).collect():
            assert r["n_true"] == sum(k[0] == r["s1_id"] for k in every) and r["n_found"] == sum(k[0] == r["s1_id"] for k in keep)
    near = pairs.exact_of(edges, e, False).collect()
    assert len(near) == len(every) and all(set(r["channels"]) == every[r["s1_id"], r["target_id"]] for r in near)
    # Copies that an address channel has are counted, their pairs aren't made.
    n = 900
    e = spark.range(n).selectExpr("concat('S', id % 3 + 1, '-', id) as entity_id", "concat('S', id % 3 + 1) as source", "'Common' as business_name", "'1 Rd' as business_address", "'A' as country", "'c' as content")
    held = F.exists("channels", lambda c: c.startswith("exact_address_"))
    true = audit.TrueEdges(e, False)
    assert true.lost(held).count() == 0 and true.counts(held).agg(F.sum("n_found")).first()[0] == 300 * 600
    assert max(_written(spark, true.counts(held), tmp_path)) < 10 * n


@pytest.mark.parametrize("few", [4, 1, 0])
def test_exact_targets_are_counted_without_their_pairs(spark, few):
    e = _mixed(spark)
    want = blocking.exact(blocking.melted(e, strict=False)).groupBy("s1_id").agg(F.countDistinct("target_id").alias("n_exact"))
    got = pairs.n_exact(e, False, few)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["miss_audit", "pareto_frontier", "taxonomy_pairs"])
def test_audits_make_no_exact_pairs(spark, monkeypatch, name):
    """The pairs of a frequent key are as many as the product of its sides."""
    monkeypatch.setattr(blocking, "exact", lambda *_: pytest.fail("all exact pairs"))
    assert linkage.__dict__[name](spark, "/root/testdata/sf0.01").count() > 0


def test_candidate_metrics_make_no_exact_pairs(spark, monkeypatch):
    """As the audits, and the figures are those of the pairs."""
    d = "/root/testdata/sf0.001"
    e = linkage._e(spark, d)
    rows = metrics.candidate_rows(entities_source.edges(e), linkage._evidence(e), linkage._s1(e)).join(e.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    columns = ["grouping", "value", "entities", "truth_edges", "recalled", "max", "median"]
    want = sorted(map(str, metrics.candidate_metrics(rows, ["country"]).select(*columns).collect()))
    monkeypatch.setattr(blocking, "exact", lambda *_: pytest.fail("all exact pairs"))
    assert sorted(map(str, linkage.candidate_metrics(spark, d).select(*columns).collect())) == want


def test_exact_pairs_are_told_and_counted_by_kind(spark):
    e = _mixed(spark)
    found = [(f"S1-{i}", f"S{s}-{i + s - 1 + 3 * k}", f"S{s}", c, 0.9 - k / 10, k + 1, False, f"k{k}") for i in range(0, 60, 3) for s in (2, 3) for k in range(3) for c in ("name_char_tfidf", "address_char_tfidf")]
    g = pairs.gathered(e, spark.createDataFrame(found, EVIDENCE), False)
    far = [(r["s1_id"], r["kind"]) for r in g.far.collect()]
    assert {(r["s1_id"], r["kind"]): r["n"] for r in g.counts().collect()} == {x: far.count(x) for x in far}
    assert len({kind for _, kind in far}) > 8
    # Of the far pairs, those that a decoder's first ones need.
    scored = lambda x: fusion.observed(x, fusion.Budget()).select(*fusion.PAIR, F.col("n_channels").cast("double").alias("score"))
    for k in (1, 2):
        d = decode.Decoder(0.5, {}, k, True, 0.0)
        want = sorted(map(str, decode.pairs(g.each(scored), d).collect()))
        assert want and sorted(map(str, decode.pairs(g.leading(k).each(scored), d).collect())) == want
    n = 900
    many = spark.range(n).selectExpr("concat('S', id % 3 + 1, '-', id) as entity_id", "concat('S', id % 3 + 1) as source", "'Common' as business_name", "cast(id as string) as business_address", "'A' as country")
    g = pairs.gathered(many, spark.createDataFrame([], EVIDENCE), False)
    assert g.counts().agg(F.sum("n")).first()[0] == 300 * 600 and g.first(2).count() == 300 * 2 * 2


def test_trees_read_rows_that_are_made_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(ranker, "fit", lambda rows, **_: read.append(rows))
    monkeypatch.setattr(ranker, "score", lambda _, rows: rows)
    assert linkage.gbt_scores(spark, "/root/testdata/sf0.001") is read[0]
    assert read[0].inputFiles() and not any("documents" in f for f in read[0].inputFiles())
