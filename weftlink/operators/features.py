"""Features of a candidate pair: a fixed contract of 87 model inputs and three further ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ratios, views

SUPPORT = "array<struct<channel:string,score:double,rank:int,exact:boolean>>"
MAX_SHORT = 32767
STRONG, WEAK = 0.85, 0.5

# The columns of the contract, in its order.
IDS = ("s1_id", "target_id", "target_source", "run_id")
CATEGORIES = ("target_source", "strongest_channel")
FLOATS = (
    "retrieval_score", "fusion_score", "reciprocal_rank", "support_best_score", "support_mean_score", "support_min_score", "support_max_score", "support_mean_rank",
    "name_char_similarity", "name_accent_char_similarity", "name_token_jaccard", "name_token_containment_s1", "name_token_containment_target", "name_token_set_similarity", "name_token_sort_similarity", "name_prefix_similarity",
    "name_suffix_similarity", "name_char_3gram_jaccard", "name_token_count_ratio", "name_char_length_ratio", "address_char_similarity", "address_token_jaccard", "address_token_containment_s1", "address_token_containment_target",
    "address_number_overlap", "address_token_count_ratio", "address_char_length_ratio", "combined_string_similarity", "retrieval_name_interaction", "retrieval_address_interaction",
)
SHORTS = (
    "channel_rank", "channel_support_count", "exact_support_count", "support_min_rank", "source_support_count", "s2_support_count", "s3_support_count", "name_support_count", "address_support_count", "exact_support_family_count",
    "fuzzy_support_count", "name_token_count_diff", "name_char_length_diff", "address_token_count_diff", "address_char_length_diff",
)
BYTES = (
    "exact_match", "has_source_support", "has_s2_support", "has_s3_support", "has_name_support", "has_address_support", "has_exact_support", "has_fuzzy_support", "independent_channel_agreement",
    "name_s1_missing", "name_target_missing", "name_s1_null_like", "name_target_null_like", "name_raw_exact", "name_normalized_exact", "name_casefold_exact", "name_accent_exact", "name_punctuation_agreement",
    "name_legal_suffix_agreement", "name_initials_agreement", "name_acronym_agreement", "name_digit_agreement", "address_s1_missing", "address_target_missing", "address_s1_null_like", "address_target_null_like",
    "address_raw_exact", "address_normalized_exact", "address_accent_exact", "address_number_exact", "address_house_number_agreement", "address_postal_agreement", "both_names_usable", "both_addresses_usable",
    "exact_name_and_address", "strong_name_weak_address", "strong_address_weak_name", "exact_name_conflicting_address_digits", "country_agreement", "country_both_present",
)

SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in (*IDS, "strongest_channel")] + [T.StructField(c, T.FloatType(), False) for c in FLOATS] + [T.StructField(c, T.ShortType(), False) for c in SHORTS] + [T.StructField(c, T.ByteType(), False) for c in BYTES]
)


def feature_names() -> list[str]:
    """The model's inputs: two categories, then numbers."""
    return [*CATEGORIES, *FLOATS, *SHORTS, *BYTES]


def record_views(records: DataFrame, strict: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(entity_id, r) and the columns to keep: everything a pair needs of one record, computed once for each record before the pair join."""
    n, a = F.col("business_name"), F.col("business_address")
    base = records.select(
        "entity_id", *keep, n.alias("raw_name"), a.alias("raw_address"), views.field(n, strict).alias("n"), views.field(a, strict).alias("a"), views.field(F.col("country"), strict).alias("c"), F.col("country"),
        views.lowered(n, strict).alias("case_name"), views.punctuation(n, strict).alias("punct_name"),
    )
    full = base.select("*", views.without_suffix(F.col("punct_name")).alias("bare_name"), views.initials(F.col("n.tokens")).alias("initials"), views.ngrams(F.col("n.folded")).alias("grams"), views.terminal_postal(F.col("raw_address")).alias("postal"))
    # Sizes of the sets that pairs compare.
    kinds = {"name_tokens": "n.tokens", "address_tokens": "a.tokens", "address_digits": "a.digits", "name_grams": "grams"}
    full = full.select("*", *[F.size(F.array_distinct(v)).alias(f"n_{k}") for k, v in kinds.items()])
    return full.select("entity_id", *keep, F.struct(*[c for c in full.columns if c not in keep]).alias("r"))


def joined(pairs: DataFrame, records: DataFrame, strict: bool = True, how: str = "inner") -> DataFrame:
    """Pairs with the views q of the S1 record and t of the target."""
    r = record_views(records, strict)
    q, t = r.select(F.col("entity_id").alias("s1_id"), F.col("r").alias("q")), r.select(F.col("entity_id").alias("target_id"), F.col("r").alias("t"))
    return pairs.join(q, "s1_id", how).join(t, "target_id", how)


#: Pairs of one key in one part, about.
PART_PAIRS = 500_000


def exactly_joined(records: DataFrame, strict: bool = True) -> DataFrame:
    """As ``joined``, of the pairs with an exact name or address in a country; the pairs are never shuffled.

    Records meet by key, a frequent key's queries and targets dealt to parts; a pair that
    shares several keys stays at the first. Texts of equal ``unicode`` view have equal
    ``folded`` ones, so a field's key is the folded view, or the other one where that is empty.
    """
    n, a = (views.field(F.col(c), strict) for c in ("business_name", "business_address"))
    own = lambda f, name: F.when(f["folded"] != "", F.concat(F.lit(f"{name} folded "), f["folded"])).when(f["unicode"] != "", F.concat(F.lit(f"{name} unicode "), f["unicode"]))
    keys = records.filter("country is not null").select("entity_id", F.explode(F.array_compact(F.array(own(n, "name"), own(a, "address")))).alias("key"), "country")
    keys = keys.select("entity_id", F.concat_ws("\u001f", "key", "country").alias("key")).groupBy("entity_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    texts = ["entity_id", "source", "business_name", "business_address", "country"]
    dealt = records.select(*texts).join(keys, "entity_id").withColumn("key", F.explode("keys"))
    is_q = F.col("source") == "S1"
    counted = dealt.groupBy("key").agg(F.count_if(is_q).alias("n_q"), F.count_if(~is_q).alias("n_t")).filter("n_q > 0 and n_t > 0")
    # Parts of a side, so that a part of each make a cell of about PART_PAIRS pairs.
    cells = F.ceil(F.sqrt(F.col("n_q") * F.col("n_t") / PART_PAIRS))
    dealt = dealt.join(counted.select("key", cells.alias("cells")), "key")
    part, others = F.pmod(F.xxhash64("entity_id"), "cells"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    # As many partitions as there are for shuffles: adaptive execution would join them by the size of what they read.
    n_parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(rows: DataFrame, mine: str, other: str, name: str) -> DataFrame:
        rows = rows.withColumn(mine, part).withColumn(other, others).repartition(n_parts, "key", "part_q", "part_t")
        return record_views(rows, strict, ["key", "keys", "part_q", "part_t", "source"]).select("key", "part_q", "part_t", F.col("keys").alias(f"{name}_keys"), F.col("source").alias(f"{name}_source"), F.col("entity_id").alias(f"{name}_id"), F.col("r").alias(name))

    q, t = side(dealt.filter(is_q), "part_q", "part_t", "q"), side(dealt.filter(~is_q), "part_t", "part_q", "t")
    pairs = q.join(t.hint("merge"), ["key", "part_q", "part_t"]).filter(F.col("key") == F.array_min(F.array_intersect("q_keys", "t_keys")))
    return pairs.select(F.col("q_id").alias("s1_id"), F.col("t_id").alias("target_id"), F.col("t_source").alias("target_source"), "q", "t")


def _capped(c: Column) -> Column:
    return F.least(c, F.lit(MAX_SHORT))


def _shared(a: Column, b: Column, equal: Column, n: Column) -> Column:
    """How many distinct items two arrays share: n, all of them, if the arrays are known to be equal."""
    return F.when(equal, n).otherwise(F.size(F.array_intersect(a, b)))


def _jaccard(both: Column, a: Column, b: Column) -> Column:
    """Of two sets by their sizes; 0 if both are empty."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise(both / (a + b - both))


def _containment(both: Column, a: Column) -> Column:
    return F.when(a == 0, F.lit(0.0)).otherwise(both / a)


def _usable(part: str) -> Column:
    q, t = F.col(f"q.{part}"), F.col(f"t.{part}")
    return ~(q["missing"] | q["null_like"] | t["missing"] | t["null_like"])


def field_features(name: str) -> dict[str, Column]:
    """What name and address have in common. A value of punctuation only is usable, and two such values are equal; lengths are of the raw text."""
    part, raw = name[0], f"raw_{name}"
    q, t, usable = F.col(f"q.{part}"), F.col(f"t.{part}"), _usable(part)
    dq, dt = F.col(f"q.n_{name}_tokens"), F.col(f"t.n_{name}_tokens")
    both = _shared(q["tokens"], t["tokens"], q["folded"] == t["folded"], dq)
    nq, nt, lq, lt = F.size(q["tokens"]), F.size(t["tokens"]), F.length(F.col(f"q.{raw}")), F.length(F.col(f"t.{raw}"))
    out = {
        "s1_missing": q["missing"], "target_missing": t["missing"], "s1_null_like": q["null_like"], "target_null_like": t["null_like"],
        "raw_exact": usable & (F.col(f"q.{raw}") == F.col(f"t.{raw}")), "normalized_exact": usable & (q["unicode"] == t["unicode"]), "accent_exact": usable & (q["folded"] == t["folded"]),
        "token_jaccard": _jaccard(both, dq, dt), "token_containment_s1": _containment(both, dq), "token_containment_target": _containment(both, dt),
        "token_count_diff": _capped(F.abs(nq - nt)), "token_count_ratio": ratios.length_ratio(nq, nt), "char_length_diff": _capped(F.abs(lq - lt)), "char_length_ratio": ratios.length_ratio(lq, lt),
    }
    return {f"{name}_{k}": v for k, v in out.items()}


def name_features() -> dict[str, Column]:
    """Of names alone, without edit ratios."""
    q, t, ok = F.col("q"), F.col("t"), _usable("n")
    equal = lambda a, b: ok & (a != "") & (a == b)
    return {
        "name_casefold_exact": ok & (q["case_name"] == t["case_name"]), "name_punctuation_agreement": ok & (q["punct_name"] == t["punct_name"]), "name_legal_suffix_agreement": equal(q["bare_name"], t["bare_name"]), "name_initials_agreement": equal(q["initials"], t["initials"]),
        "name_acronym_agreement": ok & (q["initials"] != "") & ((q["initials"] == t["n"]["compact"]) | (t["initials"] == q["n"]["compact"])), "name_digit_agreement": ok & (F.size(q["n"]["digits"]) > 0) & (q["n"]["digits"] == t["n"]["digits"]),
        "name_char_3gram_jaccard": _jaccard(_shared(q["grams"], t["grams"], q["n"]["folded"] == t["n"]["folded"], q["n_name_grams"]), q["n_name_grams"], t["n_name_grams"]),
    }


def ratio_features() -> dict[str, Column]:
    """Edit and token ratios of names and addresses (Arrow functions)."""
    q, t, ok = F.col("q.n.folded"), F.col("t.n.folded"), _usable("n")
    start, end = (lambda c: F.left(c, F.lit(8))), (lambda c: F.right(c, F.lit(8)))
    return {
        "name_char_similarity": ratios.indel_guarded("q.n.unicode", "t.n.unicode"), "address_char_similarity": ratios.indel_guarded("q.a.unicode", "t.a.unicode"), "name_accent_char_similarity": ratios.indel_guarded(q, t),
        "name_token_set_similarity": F.when(ok, ratios.token_set_ratio(q, t)).otherwise(0.0), "name_token_sort_similarity": F.when(ok, ratios.token_sort_ratio(q, t)).otherwise(0.0),
        "name_prefix_similarity": ratios.indel_guarded(start(q), start(t)), "name_suffix_similarity": ratios.indel_guarded(end(q), end(t)),
    }


def address_features() -> dict[str, Column]:
    q, t, ok = F.col("q.a.digits"), F.col("t.a.digits"), _usable("a")
    nq, nt = F.col("q.n_address_digits"), F.col("t.n_address_digits")
    return {
        "address_number_exact": ok & (F.size(q) > 0) & (q == t), "address_number_overlap": _jaccard(_shared(q, t, q == t, nq), nq, nt), "address_house_number_agreement": F.coalesce(ok & (F.get(q, F.lit(0)) == F.get(t, F.lit(0))), F.lit(False)),
        "address_postal_agreement": ok & (F.col("q.postal") != "") & (F.col("q.postal") == F.col("t.postal")),
    }


def support_violations(candidates: DataFrame) -> DataFrame:
    """Candidates whose support breaks its contract: empty or too long, nameless or repeated channels, scores that aren't finite, ranks out of range, or a primary observation that isn't in it."""
    s = F.col("support")
    same = F.exists(s, lambda x: (x["channel"] == F.col("channel")) & (F.abs(x["score"] - F.col("retrieval_score")) <= 1e-6) & (x["rank"] == F.col("channel_rank")) & (x["exact"] == F.col("exact_match")))
    odd = F.exists(s, lambda x: (x["channel"] == "") | F.isnan(x["score"]) | (F.abs(x["score"]) > 1e308) | (x["rank"] < 1) | (x["rank"] > MAX_SHORT))
    wrong = (F.size(s) < 1) | (F.size(s) > MAX_SHORT) | (F.size(s) != F.size(F.array_distinct(F.transform(s, lambda x: x["channel"])))) | odd | ~same | (F.col("exact_match") != F.exists(s, lambda x: x["exact"]))
    return candidates.filter(F.coalesce(wrong, F.lit(True)))


def parse_support(candidates: DataFrame) -> DataFrame:
    """Candidates with ``support`` as an array; where there is no support_json column, the primary observation alone."""
    one = F.array(F.struct(F.col("channel"), F.col("retrieval_score").cast("double").alias("score"), F.col("channel_rank").cast("int").alias("rank"), F.col("exact_match").alias("exact")))
    return candidates.withColumn("support", F.from_json("support_json", SUPPORT) if "support_json" in candidates.columns else one)


def _of_family(family: str):
    """Is a word part of the channel's name after a source prefix?"""
    return lambda x: F.lower(F.regexp_replace(x["channel"], "^[^:]*:", "")).contains(family)


def support_features(fused: bool = True) -> dict[str, Column]:
    """Counts, scores and ranks of the support list. Families are parts of a channel's name, so one channel can be of two and agree with itself; exact families are by name, exact support by flag."""
    s, n = F.col("support"), F.size("support")
    scores, ranks = F.transform(s, lambda x: x["score"]), F.transform(s, lambda x: x["rank"].cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    count = {f: F.size(F.filter(s, _of_family(f))) for f in ("source", "name", "address", "exact")}
    fuzzy, exact = n - count["exact"], F.size(F.filter(s, lambda x: x["exact"]))
    first = F.array_min(F.transform(s, lambda x: F.struct((~x["exact"]).alias("a"), (-x["score"]).alias("b"), x["rank"].alias("c"), x["channel"].alias("d"))))
    in_source = {x: F.col("target_source") == x.upper() for x in ("s2", "s3")}
    out = {
        "fusion_score": F.col("fusion_score" if fused else "retrieval_score").cast("double"), "reciprocal_rank": 1.0 / F.col("channel_rank"), "channel_support_count": n, "exact_support_count": exact, "support_best_score": F.array_max(scores),
        "support_mean_score": total(scores) / n, "support_min_score": F.array_min(scores), "support_max_score": F.array_max(scores), "support_min_rank": F.array_min(ranks), "support_mean_rank": total(ranks) / n, "exact_support_family_count": count["exact"],
        "fuzzy_support_count": fuzzy, "has_exact_support": exact > 0, "has_fuzzy_support": fuzzy > 0, "strongest_channel": first["d"],
        "independent_channel_agreement": sum((count[f] > 0).cast("int") for f in ("source", "name", "address")) > 1,
    }
    for f in ("source", "name", "address"):
        out |= {f"{f}_support_count": count[f], f"has_{f}_support": count[f] > 0}
    for x, own in in_source.items():
        out |= {f"{x}_support_count": F.when(own, n).otherwise(0), f"has_{x}_support": own}
    return out


def cross_features() -> dict[str, Column]:
    """Of name, address, country and retrieval together; they read features made before."""
    n, a, name, address = F.col("name_char_similarity"), F.col("address_char_similarity"), _usable("n"), _usable("a")
    exact, dq, dt, cq, ct = F.col("name_normalized_exact"), F.col("q.a.digits"), F.col("t.a.digits"), F.col("q.c"), F.col("t.c")
    return {
        "both_names_usable": name, "both_addresses_usable": address, "exact_name_and_address": exact & F.col("address_normalized_exact"),
        "strong_name_weak_address": (n >= STRONG) & (~address | (a < WEAK)), "strong_address_weak_name": (a >= STRONG) & (~name | (n < WEAK)),
        "exact_name_conflicting_address_digits": exact & (F.size(dq) > 0) & (F.size(dt) > 0) & ~F.arrays_overlap(dq, dt), "combined_string_similarity": F.when(name & address, (n + a) / 2).otherwise(F.greatest(n, a)),
        "retrieval_name_interaction": F.col("retrieval_score") * n, "retrieval_address_interaction": F.col("retrieval_score") * a,
        "country_both_present": ~(cq["missing"] | cq["null_like"] | ct["missing"] | ct["null_like"]), "country_agreement": (cq["unicode"] != "") & (cq["unicode"] == ct["unicode"]),
    }


def compute(candidates: DataFrame, records: DataFrame, strict: bool = True) -> DataFrame:
    """One row for each candidate, in the contract's columns and types. A candidate without its records is an error at run time."""
    df = candidates if "support" in candidates.columns else parse_support(candidates)
    df = df if "run_id" in df.columns else df.withColumn("run_id", F.lit(""))
    df = joined(df, records, strict, "left")
    lost = F.concat(F.lit("candidate without source record: "), "s1_id", F.lit("/"), "target_id")
    foreign = F.col("q").isNull() | F.col("t").isNull() | ~F.startswith("target_id", F.concat("target_source", F.lit("-")))
    df = df.withColumn("s1_id", F.when(foreign, F.raise_error(lost).cast("string")).otherwise(F.col("s1_id")))
    own = support_features("fusion_score" in df.columns)
    df = df.withColumns(own | field_features("name") | field_features("address") | name_features() | ratio_features() | address_features())
    df = df.withColumns(cross_features())
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA])


def analysis(edges: DataFrame, records: DataFrame, strict: bool = True) -> DataFrame:
    """Features of true pairs for study. Unlike the model's, two empty sides are fully alike here, ratios aren't guarded, and exactness is of stripped raw values."""
    df = joined(edges, records, strict)
    q, t = F.col("q"), F.col("t")
    return df.select(
        "s1_id", "target_id", "target_source", q["country"].alias("country"), (q["country"] == t["country"]).alias("country_agreement"), (F.trim(q["raw_name"]) == F.trim(t["raw_name"])).alias("name_raw_exact"), (F.trim(q["raw_address"]) == F.trim(t["raw_address"])).alias("address_raw_exact"),
        (q["n"]["unicode"] == t["n"]["unicode"]).alias("name_normalized_exact"), (q["a"]["unicode"] == t["a"]["unicode"]).alias("address_normalized_exact"),
        ((F.size(q["a"]["digits"]) > 0) & (F.size(t["a"]["digits"]) > 0) & ~F.arrays_overlap(q["a"]["digits"], t["a"]["digits"])).alias("digit_conflict"),
        (F.trim(q["raw_name"]) == "").alias("s1_name_missing"), (F.trim(t["raw_name"]) == "").alias("target_name_missing"), (F.trim(q["raw_address"]) == "").alias("s1_address_missing"), (F.trim(t["raw_address"]) == "").alias("target_address_missing"),
        ratios.indel(q["n"]["unicode"], t["n"]["unicode"]).alias("name_char_similarity"), ratios.indel(q["a"]["unicode"], t["a"]["unicode"]).alias("address_char_similarity"),
        ratios.jaccard(q["n"]["tokens"], t["n"]["tokens"], 1.0).alias("name_token_jaccard"), ratios.jaccard(q["a"]["tokens"], t["a"]["tokens"], 1.0).alias("address_token_jaccard"), ratios.jaccard(q["a"]["digits"], t["a"]["digits"], 1.0).alias("digit_overlap"),
        ratios.length_ratio(F.length(q["raw_name"]), F.length(t["raw_name"]), 1.0).alias("name_length_ratio"), ratios.length_ratio(F.length(q["raw_address"]), F.length(t["raw_address"]), 1.0).alias("address_length_ratio"),
    )


def group_means(df: DataFrame, group: str) -> DataFrame:
    """Means of every boolean and number by group."""
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), *[F.avg(F.col(f.name).cast("double")).alias(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.BooleanType, T.NumericType))])
