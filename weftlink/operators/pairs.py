"""Evidence by pair: one row for each, with what all channels say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, views
from . import blocking, features, fusion
from .tfidf import written

KEY = "array<struct<k:string,channel:string,tie:string>>"


def keyed(records: DataFrame, strict: bool) -> DataFrame:
    """(entity_id, source, keys, meets): all exact keys of an entity with their channels, and one for each field under which equal fields meet."""
    tie = hashing.tie_key(F.col("business_name"), F.col("business_address"), F.col("country"))
    base = records.filter("country is not null").select("entity_id", "source", "country", tie.alias("tie"), *[views.field(F.col(c), strict).alias(f) for f, c in blocking.FIELDS.items()])
    keys, meets = [], []
    for f in blocking.FIELDS:
        own = {}
        for v in ("accent_folded", "unicode_preserving"):
            key = views.key(F.col(f), v)
            own[v] = F.when(key != "", F.concat_ws("\u001f", F.lit(f), F.lit(v), F.length("country").cast("string"), "country", key))
            keys.append(F.when(key != "", F.struct(own[v].alias("k"), F.lit(f"exact_{f}_{v}").alias("channel"), F.col("tie").alias("tie"))))
        # Texts of equal unicode view have equal folded ones.
        meets.append(F.coalesce(*own.values()))
    held = base.select("entity_id", "source", F.array_compact(F.array(*keys)).alias("keys"), F.array_compact(F.array(*meets)).alias("meets"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return held.groupBy("entity_id", "source").agg(flat("keys"), flat("meets")).filter(F.size("keys") > 0)


def _exact(q: Column, t: Column) -> Column:
    """The exact channels of two entities' keys, each once."""
    ks = F.transform(q, lambda x: x["k"])
    both = F.filter(t, lambda x: F.array_contains(ks, x["k"]))
    seen = lambda channel, tie: F.struct(channel.alias("channel"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit(True).alias("exact"), tie.alias("key"))
    # Only an id that occurs with several texts has a channel twice.
    named = F.array_distinct(F.transform(both, lambda x: x["channel"]))
    least = F.transform(named, lambda c: seen(c, F.array_min(F.transform(F.filter(both, lambda x: x["channel"] == c), lambda x: x["tie"]))))
    return F.when(F.size(named) == F.size(both), F.transform(both, lambda x: seen(x["channel"], x["tie"]))).otherwise(least)


def channels(q: Column, t: Column) -> Column:
    """The names of the exact channels of two entities' keys."""
    return F.transform(_exact(q, t), lambda x: x["channel"])


def exact_of(some: DataFrame, records: DataFrame, strict: bool = True) -> DataFrame:
    """The pairs of ``some`` with ``channels``, the exact channels that have them.

    Only these pairs' keys are compared; the pairs of a key, as many as the product of its queries and targets, are never made.
    """
    own = keyed(records, strict)
    q = own.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), F.col("keys").alias("q_keys"))
    t = own.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), F.col("keys").alias("t_keys"))
    both = some.join(q, "s1_id", "left").join(t, ["target_id", "target_source"], "left")
    none = F.array().cast(KEY)
    return both.select(*some.columns, channels(F.coalesce("q_keys", none), F.coalesce("t_keys", none)).alias("channels"))


#: An entity has a key for its name and one for its address; only one that occurs with several texts has more.
FEW = 4


def n_exact(records: DataFrame, strict: bool = True, few: int = FEW) -> DataFrame:
    """(s1_id, n_exact): how many targets any exact channel has; queries without one are left out.

    Targets with some keys in common are counted by sets of keys, in and out by turns, so no pair is made but
    those with an entity of more than ``few`` keys.
    """
    own = keyed(records, strict).select("entity_id", "source", "meets", (F.size("meets") <= few).alias("small"))
    subsets = F.aggregate("meets", F.array(F.array().cast("array<string>")), lambda held, x: F.concat(held, F.transform(held, lambda y: F.array_append(y, x))))
    small = own.filter("small").withColumn("keys", F.explode(subsets)).filter(F.size("keys") > 0)
    n = small.filter("source <> 'S1'").groupBy("keys").agg(F.count("*").alias("n"))
    turned = F.when(F.size("keys") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    counted = small.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "keys").join(n, "keys").select("s1_id", turned.alias("n"))
    each = own.withColumn("key", F.explode("meets"))
    q = each.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), F.col("small").alias("small_q"), "key")
    t = each.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), F.col("small").alias("small_t"), "key")
    rest = q.filter("not small_q").join(t, "key").unionByName(q.filter("small_q").join(t.filter("not small_t"), "key"))
    rest = rest.select(*fusion.PAIR).distinct().select("s1_id", F.lit(1).cast("long").alias("n"))
    return counted.unionByName(rest).groupBy("s1_id").agg(F.sum("n").alias("n_exact"))


#: The exact channels, each with its bit of a kind.
EXACT = ("exact_name_accent_folded", "exact_name_unicode_preserving", "exact_address_accent_folded", "exact_address_unicode_preserving")
SHORT = ("nf", "nu", "af", "au")
SEEN = "array<struct<channel:string,score:double,rank:int,exact:boolean,key:string>>"


def _short(records: DataFrame, strict: bool) -> DataFrame:
    """``keyed``, with a digest of the key of each exact channel; ``plain`` are entities of one text, as all are but ids that occur with several."""
    own = keyed(records, strict)
    digest = lambda x: F.unhex(F.md5(x.cast("binary")))
    of = lambda c: F.get(F.filter("keys", lambda x: x["channel"] == c), F.lit(0))["k"]
    distinct = lambda field: F.size(F.array_distinct(F.transform("keys", lambda x: x[field])))
    plain = (distinct("channel") == F.size("keys")) & (distinct("tie") == 1)
    return own.select("entity_id", "source", "keys", F.transform("meets", digest).alias("meets"), plain.alias("plain"), F.get("keys", F.lit(0))["tie"].alias("tie"), *[digest(of(c)).alias(s) for s, c in zip(SHORT, EXACT, strict=True)])


def _kind(seen: Column, number: Column) -> Column:
    """The kind of a pair by its observations and its source's number."""
    held = F.transform(F.filter(seen, lambda x: x["exact"]), lambda x: x["channel"])
    bits = [F.when(F.array_contains(held, c), 1 << i).otherwise(0) for i, c in enumerate(EXACT)]
    return (16 * number + sum(bits, F.lit(0))).cast("int")


#: What two entities have at least in common of name and address: nothing, the folded view, the unicode view.
LEVELS = [(x, y) for x in range(3) for y in range(3) if x or y]


def _by_levels(own: DataFrame) -> DataFrame:
    """Plain entities, a row for each level that they have, with the key k of both fields; lone_n and lone_a are 1 where a folded view is empty.

    Equal unicode views have equal folded ones, so those of equal k have that level or more in common.
    """
    levels = lambda f, u: (F.coalesce(f, u), F.when(f.isNotNull(), u).otherwise(F.lit(None).cast("binary")))
    name, address = levels(F.col("nf"), F.col("nu")), levels(F.col("af"), F.col("au"))
    # A level that an entity lacks is null, and so is a key with it.
    key = lambda x, y: F.concat(*[k[i - 1] for k, i in ((name, x), (address, y)) if i])
    each = F.filter(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), key(x, y).alias("k")) for x, y in LEVELS]), lambda s: s["k"].isNotNull())
    lone = [F.col(f).isNull().cast("int").alias(f"lone_{f[0]}") for f in ("nf", "af")]
    return own.filter("plain").withColumn("e", F.explode(each)).select("entity_id", "source", "tie", *lone, "e.*")


def _bits(level: Column, alone: Column) -> Column:
    """A field's bits of a kind: the level's views, or where the folded one is empty the other alone."""
    return F.when(level == 0, 0).when(level == 1, 1 + alone).otherwise(3)


def _far_counts(own: DataFrame, near: DataFrame, number: Column) -> DataFrame:
    """(s1_id, kind, n): exact pairs of plain entities that aren't near, by query and kind.

    Targets with at least some level in common are counted by its key, and each kind is a difference of those; no pair is made.
    """
    plain = _by_levels(own)
    n_t = plain.filter("source <> 'S1'").select("k", number.alias("number")).groupBy("k", "number").agg(F.count("*").alias("n"))
    q = plain.filter("source = 'S1'").select("k", "x", "y", F.col("entity_id").alias("s1_id"), "lone_n", "lone_a")
    sums = [F.coalesce(F.sum(F.when((F.col("x") == x) & (F.col("y") == y), F.col("n"))), F.lit(0)).alias(f"g{x}{y}") for x, y in LEVELS]
    g = q.join(n_t, "k").groupBy("s1_id", "number", "lone_n", "lone_a").agg(*sums)
    least = lambda x, y: F.col(f"g{x}{y}") if x < 3 and y < 3 else F.lit(0)
    bits = lambda x, y: _bits(F.lit(x), F.col("lone_n")) + 4 * _bits(F.lit(y), F.col("lone_a"))
    kinds = [F.struct((16 * F.col("number") + bits(x, y)).cast("int").alias("kind"), (least(x, y) - least(x + 1, y) - least(x, y + 1) + least(x + 1, y + 1)).alias("n")) for x, y in LEVELS]
    counted = g.select("s1_id", F.explode(F.array(*kinds)).alias("x")).select("s1_id", "x.*")
    held = near.filter("plain").select("s1_id", _kind(F.col("seen"), F.col("number")).alias("kind")).filter("kind % 16 > 0").groupBy("s1_id", "kind").agg((-F.count("*")).alias("n"))
    return counted.filter("n > 0").unionByName(held).groupBy("s1_id", "kind").agg(F.sum("n").alias("n")).filter("n > 0")


def _far_first(own: DataFrame, found: DataFrame, number: Column, k: int) -> DataFrame:
    """Far pairs, for each query and source those that can be among the first k by kinds with more channels, then ids.

    Of the targets of a level only the first by id are read, k and as many as a query's near ones: each of them has that level or
    more, so those behind have k before them. One whose own level's list has no room for it, and that so counts as of a lower kind, has k before it too.
    """
    most = found.groupBy("s1_id", "target_source").count().agg(F.max("count")).first()[0] or 0
    plain = _by_levels(own)
    order = F.row_number().over(Window.partitionBy("k", "number").orderBy("target_id"))
    t = plain.filter("source <> 'S1'").select("k", number.alias("number"), F.col("source").alias("target_source"), F.col("entity_id").alias("target_id"), "tie").withColumn("_n", order).filter(F.col("_n") <= k + most)
    q = plain.filter("source = 'S1'").select("k", "x", "y", F.col("entity_id").alias("s1_id"), "lone_n", "lone_a")
    met = q.join(t, "k").groupBy(*fusion.PAIR, "number", "lone_n", "lone_a").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.first("tie").alias("key"))
    kind = (16 * F.col("number") + _bits(F.col("x"), F.col("lone_n")) + 4 * _bits(F.col("y"), F.col("lone_a"))).cast("int")
    return met.join(found.select(*fusion.PAIR), list(fusion.PAIR), "left_anti").select("s1_id", "target_id", kind.alias("kind"), "key")


def gathered(records: DataFrame, fuzzy: DataFrame, strict: bool = True) -> fusion.Gathered:
    """Each pair of an exact or fuzzy channel, once.

    ``fuzzy`` is evidence. Its pairs are gathered by a shuffle, with those of ids that occur with several texts. All others are exact in a
    name or an address only and as many as the product of a key's queries and targets: these are
    made where their keys meet, a frequent key's sides dealt to parts, and never shuffled; of each only its kind is told.
    """
    own = written(_short(records, strict))
    sources = sorted(r["source"] for r in own.filter("source <> 'S1'").select("source").distinct().collect())
    number = (F.array_position(F.array(*[F.lit(s) for s in sources or [""]]), F.col("source")) - 1).cast("int")
    rows = F.struct("channel", F.col("retrieval_score").cast("double").alias("score"), F.col("channel_rank").cast("int").alias("rank"), F.col("exact_match").alias("exact"), F.col("target_content_key").alias("key"))
    q, t = own.filter("source = 'S1'").withColumnRenamed("entity_id", "s1_id").drop("source"), own.filter("source <> 'S1'").withColumnsRenamed({"entity_id": "target_id", "source": "target_source"})
    met = lambda a, b: a.select("s1_id", F.explode("meets").alias("m")).join(b.select("target_id", "target_source", F.explode("meets").alias("m")), "m").select(*fusion.PAIR)
    rest = met(q.filter("not plain"), t).unionByName(met(q.filter("plain"), t.filter("not plain")))
    found = fusion.deduplicated(fuzzy).select(*fusion.PAIR, rows.alias("x"))
    found = found.unionByName(rest.select(*fusion.PAIR, F.lit(None).cast(found.schema["x"].dataType).alias("x"))).groupBy(*fusion.PAIR).agg(F.array_sort(F.collect_list("x")).alias("found"))
    found = written(found)
    none = F.array().cast(KEY)
    near = found.join(q.select("s1_id", F.col("keys").alias("q_keys"), F.col("plain").alias("q_plain")), "s1_id", "left")
    near = near.join(t.select("target_id", "target_source", F.col("keys").alias("t_keys"), F.col("plain").alias("t_plain")), ["target_id", "target_source"], "left")
    seen = F.array_sort(F.concat("found", _exact(F.coalesce("q_keys", none), F.coalesce("t_keys", none))))
    of_source = (F.array_position(F.array(*[F.lit(s) for s in sources or [""]]), F.col("target_source")) - 1).cast("int")
    near = near.select(*fusion.PAIR, seen.alias("seen"), (F.size("found") == 0).alias("exact_only"), F.coalesce(F.col("q_plain") & F.col("t_plain"), F.lit(False)).alias("plain"), of_source.alias("number"))

    # Most targets of a key aren't known: their hash says so.
    name, mark = F.concat_ws("\u001f", "target_source", "target_id"), F.xxhash64("target_source", "target_id")
    known = found.groupBy("s1_id").agg(F.collect_list(name).alias("known"), F.collect_list(mark).alias("marks"))
    q = q.filter("plain").join(known, "s1_id", "left").withColumns({"known": F.coalesce("known", F.array().cast("array<string>")), "marks": F.coalesce("marks", F.array().cast("array<long>"))})
    meets = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(*c).isNotNull(), F.struct(F.coalesce(*c).alias("key"), F.lit(f).alias("by_name"))) for f, c in ((True, ("nf", "nu")), (False, ("af", "au")))])))
    q = q.withColumn("m", meets).select("s1_id", "m.*", *[F.col(c).alias(f"q_{c}") for c in SHORT], "known", "marks")
    t = t.filter("plain").withColumn("m", meets).select("target_id", name.alias("name"), mark.alias("mark"), (16 * of_source).alias("base"), F.col("tie"), "m.key", *[F.col(c).alias(f"t_{c}") for c in SHORT])
    counted = q.groupBy("key").agg(F.count("*").alias("n_q")).join(t.groupBy("key").agg(F.count("*").alias("n_t")), "key")
    cells = written(counted.select("key", F.ceil(F.sqrt(F.col("n_q") * F.col("n_t") / features.PART_PAIRS)).alias("cells")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    n_parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(rows: DataFrame, entity: str, mine: str, other: str) -> DataFrame:
        rows = rows.join(cells, "key").withColumn(mine, F.pmod(F.xxhash64(entity), "cells")).withColumn(other, others).drop("cells")
        return rows.repartition(n_parts, "key", "part_q", "part_t")

    met = side(q, "s1_id", "part_q", "part_t").join(side(t, "target_id", "part_t", "part_q").hint("merge"), ["key", "part_q", "part_t"])
    equal = {c: F.coalesce(F.col(f"q_{c}") == F.col(f"t_{c}"), F.lit(False)) for c in SHORT}
    # A pair that shares both fields stays at the name.
    first = F.col("by_name") | ~(equal["nf"] | equal["nu"])
    met = met.filter(first & ~(F.array_contains("marks", F.col("mark")) & F.array_contains("known", F.col("name"))))
    kind = sum((F.when(equal[c], 1 << i).otherwise(0) for i, c in enumerate(SHORT)), F.col("base")).cast("int")
    far = met.select("s1_id", "target_id", kind.alias("kind"), F.col("tie").alias("key"))
    every = [(str(16 * i + bits), None, s, [(c, 1.0, 1, True, None) for c in sorted(EXACT) if bits >> EXACT.index(c) & 1], True) for i, s in enumerate(sources) for bits in range(1, 16)]
    kinds = records.sparkSession.createDataFrame(every, f"s1_id string, target_id string, target_source string, seen {SEEN}, exact_only boolean").coalesce(1)
    return fusion.Gathered(near.drop("plain", "number"), far, kinds, lambda: _far_counts(own, near, number), lambda k: _far_first(own, found, number, k))
