"""Top-N cosine similarity joins over TF-IDF vectors, in tiles.

Records of equal text have one vector, and of the targets with it only the first top_k
by content can be in a list, so texts are joined, not records. Within a country the
texts of queries and of one source's targets are dealt to tiles. In a tile the frequent
grams are a dense product and the others meet through lists of targets; what can be
among a query's first is scored again in double precision. So no product of two records
is ever shuffled: only texts' vectors are, once a tile. The vocabulary is fitted on the
targets of one source and field, and its size is a parameter: it goes to every task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, views


@dataclass(frozen=True)
class Config:
    top_k: int = 80
    threshold: float = 0.20
    min_df: int = 2
    max_features: int | None = 50_000
    inclusive: bool = False
    by_country: bool = True
    digits: int = 6


def _texts(records: DataFrame, column: str, strict: bool, view: str) -> DataFrame:
    text = views.key(views.field(F.col(column), strict), view)
    return records.select("entity_id", "source", "country", hashing.tie_key(F.col("business_name"), F.col("business_address"), F.col("country")).alias("tie"), text.alias("text"))


def grams(records: DataFrame, column: str, tokenizer=views.padded_ngrams, strict: bool = True, view: str = "unicode_preserving") -> DataFrame:
    """(entity_id, source, country, tie, gram, tf) of one field's view."""
    base = _texts(records, column, strict, view).select("entity_id", "source", "country", "tie", F.explode(tokenizer(F.col("text"))).alias("gram"))
    return base.groupBy("entity_id", "source", "country", "tie", "gram").agg(F.count("*").alias("tf"))


def _fitted(df: DataFrame, n: DataFrame, config: Config) -> DataFrame:
    df = df.filter(F.col("df") >= config.min_df)
    if config.max_features is not None:
        order = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("total"), "gram"))
        df = df.withColumn("_r", order).filter(F.col("_r") <= config.max_features)
    return df.join(F.broadcast(n), "source").select("source", "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vocabulary(target_grams: DataFrame, config: Config) -> DataFrame:
    """(source, gram, idf): grams in at least min_df targets of a source, the most frequent max_features of them; idf = ln((1 + N) / (1 + df)) + 1."""
    n = target_grams.groupBy("source").agg(F.countDistinct("entity_id").alias("n"))
    return _fitted(target_grams.groupBy("source", "gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), n, config)


def written(df: DataFrame) -> DataFrame:
    """df computed once: several plans read it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``written``, by columns: for wide rows that several jobs read."""
    folder = df.sparkSession.sparkContext.getCheckpointDir()
    if not folder:
        return df.localCheckpoint()
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Bags:
    """Rows (entity_id, source, country, tie, texts), dealt by entity_id, one for each distinct record, and what makes a text's grams (None: the texts are grams)."""

    rows: DataFrame
    tokenizer: object = None

    def tokens(self, lists: Column) -> Column:
        """The grams of each of some lists of texts."""
        return lists if self.tokenizer is None else F.transform(lists, lambda b: F.flatten(F.transform(b, lambda t: self.tokenizer(t))))


RECORD = ("entity_id", "source", "country", "tie")


def bags(records: DataFrame, column: str, tokenizer=views.padded_ngrams, strict: bool = True, view: str = "unicode_preserving") -> Bags:
    """The texts of one field's view; a record that occurs several times has its text as often."""
    base = _texts(records, column, strict, view).filter("text <> ''").repartition("entity_id")
    return Bags(written(base.groupBy(*RECORD).agg(F.array_sort(F.collect_list("text")).alias("texts"))), tokenizer)


def _of_grams(g: DataFrame) -> Bags:
    every = F.flatten(F.collect_list(F.expr("array_repeat(gram, cast(tf as int))")))
    return Bags(g.repartition("entity_id").groupBy(*RECORD).agg(F.array_sort(every).alias("texts")))


def _codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row of each bag, bag of each gram, code of each gram, the distinct grams) of a column of lists of bags of grams."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = rows.flatten()
    coded = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False))
    bag = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    return row, bag, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (source, m, bags): how many bags have a gram, how often it occurs, and as a null gram how many rows have any, each row m times."""
    for batch in batches:
        source, m = np.array(batch.column("source").to_pylist(), dtype=object), batch.column("m").to_numpy()
        row, bag, code, words = _codes(batch.column("bags"))
        for s in sorted(set(source)):
            ours = source[row][bag] == s
            b, c = bag[ours], code[ours]
            times = m[row[b]].astype(np.float64)
            total = np.bincount(c, times, len(words))
            pair = np.unique(b * len(words) + c) if len(b) else b
            df = np.bincount(pair % max(len(words), 1), m[row[pair // max(len(words), 1)]].astype(np.float64), len(words))
            at = np.flatnonzero(df)
            gram = pa.concat_arrays([words.take(pa.array(at)).cast(pa.string()), pa.nulls(1, pa.string())])
            n = m[np.unique(row[b])].sum() if len(b) else 0
            yield pa.RecordBatch.from_arrays([pa.array([s] * (len(at) + 1), pa.string()), gram, *[pa.array(np.append(x[at], y).astype(np.int64)) for x, y in ((df, n), (total, 0))]], ["source", "gram", "df", "total"])


def fitted(b: Bags, config: Config) -> DataFrame:
    """The vocabulary of these bags' targets, as ``vocabulary`` has it."""
    own = b.rows.filter("source <> 'S1'").groupBy("entity_id", "source").agg(F.array_sort(F.collect_list("texts")).alias("every"))
    distinct = own.groupBy("source", "every").agg(F.count("*").alias("m")).select("source", "m", b.tokens(F.col("every")).alias("bags"))
    counted = distinct.mapInArrow(_counted, "source string, gram string, df long, total long").groupBy("source", "gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    return _fitted(counted.filter("gram is not null"), counted.filter("gram is null").select("source", F.col("df").alias("n")), config)


class Vocabulary:
    """Grams by source with their weights, frequent ones first."""

    def __init__(self, vocab: DataFrame):
        held: dict[str, list] = {}
        for r in vocab.collect():
            held.setdefault(r["source"], []).append((r["idf"], r["gram"]))
        self.grams = {s: pa.array([g for _, g in sorted(x)], pa.string()) for s, x in sorted(held.items())}
        self.idf = {s: np.array([w for w, _ in sorted(x)]) for s, x in sorted(held.items())}


VECTOR = "country string, target_source string, query boolean, key binary, place long, norm double, ids binary, tfs binary"
VECTOR_NAMES = [c.split()[0] for c in VECTOR.split(", ")]


def _vectors(vocab: Vocabulary):
    """Vectors of texts over the vocabulary of each target source: (1 + ln tf) * idf of the grams of the unit's own bags, divided by the norm of all bags of its entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, bag, code, words = _codes(batch.column("bags"))
            # Bags after the unit's own ones are all bags of the entity; without any, its own are all.
            own_bags = batch.column("n_own").to_numpy()
            first = np.searchsorted(row, np.arange(batch.num_rows))
            nth = np.arange(len(row)) - first[row]
            mine = nth < own_bags[row]
            more = np.bincount(row, minlength=batch.num_rows) > own_bags
            query = batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            sources = np.array(batch.column("source").to_pylist(), dtype=object)
            for s, grams_ in vocab.grams.items():
                known = pc.index_in(words, value_set=grams_).fill_null(-1).to_numpy(zero_copy_only=False)
                at = known[code] if len(code) else code
                ok = (at >= 0) & (query | (sources == s))[row[bag]]
                # Sorted by bag, then gram.
                pair, tf = np.unique(bag[ok].astype(np.int64) * len(grams_) + at[ok], return_counts=True)
                in_bag, gram = pair // len(grams_), pair % len(grams_)
                w = (1 + np.log(tf.astype(np.float64))) * vocab.idf[s][gram]
                of = row[in_bag]
                norm = np.sqrt(np.bincount(of, np.where(mine[in_bag] ^ more[of], w * w, 0), batch.num_rows))
                keep = mine[in_bag]
                of, gram, tf = of[keep], gram[keep], tf[keep]
                there = np.unique(of)
                ends = 4 * np.append(0, np.searchsorted(of, there, side="right")).astype(np.int32)
                packed = [pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(ends), pa.py_buffer(x.astype(np.uint32))]) for x in (gram, tf)]
                held = {c: batch.column(c).take(pa.array(there)) for c in ("country", "query", "key", "place")}
                held |= {"target_source": pa.array([s] * len(there), pa.string()), "norm": pa.array(norm[there]), "ids": packed[0], "tfs": packed[1]}
                yield pa.RecordBatch.from_arrays([held[c] for c in VECTOR_NAMES], VECTOR_NAMES)

    return run


#: Texts of queries and targets in a tile, queries at once, and dense grams at most.
TILE_Q, TILE_T, STEP, DENSE = 4096, 8192, 512, 2048
#: A gram is dense where so large a part of all pairs has it: the two ways cost the same there.
PART = 0.002
#: Relative error of one operation in single precision.
EPS = 6e-8


class _Side:
    """Vectors of some texts, in a row."""

    def __init__(self, table: pa.Table, idf: np.ndarray):
        ids, tfs = (np.concatenate([np.empty(0, np.uint32), *[np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(n)]]) for n in ("ids", "tfs"))
        self.ids = ids.astype(np.int64)
        self.size = np.array([x.as_buffer().size // 4 for x in table.column("ids")], np.int64)
        self.n, self.start = len(self.size), np.cumsum(self.size) - self.size
        self.row = np.repeat(np.arange(self.n), self.size)
        norm = table.column("norm").to_numpy()
        self.w = (1 + np.log(tfs.astype(np.float64))) * idf[self.ids] / norm[self.row]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, so many."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def best(q: _Side, t: _Side, place: np.ndarray, n_grams: int, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, target, rounded score) of each query's first top_k targets over the threshold by (-score, place); equal ones at the cut stay."""
    of_q, of_t = np.bincount(q.ids, minlength=n_grams), np.bincount(t.ids, minlength=n_grams)
    meets = of_q * of_t
    dense = np.flatnonzero(meets > PART * q.n * t.n)
    dense = dense[np.argsort(-meets[dense], kind="stable")][:DENSE]
    column = np.full(n_grams, -1)
    column[dense] = np.arange(len(dense))
    at = column[t.ids]
    matrix = np.zeros((len(dense), t.n), np.float32)
    np.add.at(matrix, (at[at >= 0], t.row[at >= 0]), t.w[at >= 0].astype(np.float32))
    # Targets of the other grams.
    rare = np.flatnonzero((at < 0) & (of_q[t.ids] > 0))
    rare = rare[np.argsort(t.ids[rare], kind="stable")]
    n_rare = np.bincount(t.ids[rare], minlength=n_grams)
    first = np.cumsum(n_rare) - n_rare
    rare_row, rare_w = t.row[rare], t.w[rare].astype(np.float32)
    margin = 10.0**-config.digits + 4 * EPS * (max(q.size.max(initial=0), t.size.max(initial=0)) + 1)
    k, out = config.top_k, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    scratch = np.zeros(n_grams)
    for low in range(0, q.n, STEP):
        high = min(low + STEP, q.n)
        a, b = q.start[low], q.start[high - 1] + q.size[high - 1]
        ids, row, w = q.ids[a:b], q.row[a:b] - low, q.w[a:b].astype(np.float32)
        at = column[ids]
        left = np.zeros((high - low, len(dense)), np.float32)
        np.add.at(left, (row[at >= 0], at[at >= 0]), w[at >= 0])
        score = left @ matrix
        few = (at < 0) & (n_rare[ids] > 0)
        many = n_rare[ids[few]]
        if len(many):
            flat, edges = score.reshape(-1), np.append(0, np.cumsum(many))
            # So many at once that the lists stay small.
            cuts = np.unique(np.append(np.searchsorted(edges, np.arange(0, edges[-1], 1 << 20)), len(many)))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                some = _spread(first[ids[few][i:j]], many[i:j])
                np.add.at(flat, np.repeat(row[few][i:j] * t.n, many[i:j]) + rare_row[some], np.repeat(w[few][i:j], many[i:j]) * rare_w[some])
        floor = np.full(high - low, config.threshold)
        if t.n > k:
            floor = np.maximum(floor, np.partition(score, t.n - k, axis=1)[:, t.n - k])
        x, y = np.nonzero(score >= (floor - margin).astype(np.float32)[:, None])
        bounds = np.searchsorted(x, np.arange(high - low + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            ys = y[bounds[i] : bounds[i + 1]]
            mine = slice(q.start[low + i], q.start[low + i] + q.size[low + i])
            np.add.at(scratch, q.ids[mine], q.w[mine])
            some, sizes = _spread(t.start[ys], t.size[ys]), t.size[ys]
            raw = np.add.reduceat(scratch[t.ids[some]] * t.w[some], np.cumsum(sizes) - sizes)
            scratch[q.ids[mine]] = 0
            exact = _rounded(raw, config.digits)
            # Texts without a common gram don't meet, whatever the threshold.
            ok = (raw > 0) & (exact >= config.threshold if config.inclusive else exact > config.threshold)
            ys, exact = ys[ok], exact[ok]
            if len(ys) > k:
                order = np.lexsort((place[ys], -exact))
                last = order[k - 1]
                ok = (exact > exact[last]) | (exact == exact[last]) & (place[ys] <= place[ys[last]])
                ys, exact = ys[ok], exact[ok]
            if len(ys):
                out.append((np.full(len(ys), low + i), ys, exact))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


FOUND = "country string, target_source string, q binary, t binary, place long, retrieval_score double"


def _tile(idf: dict[str, np.ndarray], config: Config):
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        country, source = key[0].as_py(), key[1].as_py()
        is_q = table.column("query")
        mine, theirs = table.filter(is_q), table.filter(pc.invert(is_q))
        place = theirs.column("place").to_numpy()
        x, y, score = best(_Side(mine, idf[source]), _Side(theirs, idf[source]), place, len(idf[source]), config)
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.table([pa.array([country] * len(x), pa.string()), pa.array([source] * len(x), pa.string()), mine.column("key").take(pa.array(x)), theirs.column("key").take(pa.array(y)), pa.array(place[y], pa.int64()), pa.array(score, pa.float64())], names=names)

    return meet


def joined(b: Bags, config: Config, channel: str, target_filter: Column | None = None, query_filter: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """Evidence of the top_k targets of each query and source with a cosine above the threshold.

    Queries are the records of S1. target_filter holds on the targets before the join;
    query_filter is a table of s1_id. The vocabulary (by default that of these targets)
    is read when the plan is made.
    """
    words = Vocabulary(fitted(b, config) if vocab is None else vocab)
    every = F.collect_list("texts").over(Window.partitionBy("entity_id"))
    rows = b.rows.withColumn("every", F.array_sort(every))
    if config.by_country:
        rows = rows.filter("country is not null")
    else:
        rows = rows.withColumn("country", F.lit(""))
    is_q = F.col("source") == "S1"
    if target_filter is not None:
        rows = rows.filter(is_q | target_filter)
    unit = ["entity_id", "source", "country", "tie"]
    rows = rows.withColumn("tie", F.when(~is_q, F.col("tie"))).groupBy(*unit).agg(F.array_sort(F.collect_list("texts")).alias("own"), F.first("every").alias("every"))
    if query_filter is not None:
        wanted = query_filter.select(F.col("s1_id").alias("entity_id")).distinct().withColumn("_w", F.lit(True))
        rows = rows.join(wanted, "entity_id", "left").filter(~is_q | F.col("_w")).drop("_w")
    none = F.array().cast("array<array<string>>")
    rows = rows.withColumn("rest", F.when(F.size("every") == F.size("own"), none).otherwise(F.col("every"))).drop("every")
    rows = written(rows.withColumn("key", F.unhex(F.md5(F.to_json(F.struct("own", "rest")).cast("binary")))))
    # Of the targets with one text, no others than the first can be in a list.
    rank = F.row_number().over(Window.partitionBy("country", "source", "key").orderBy("tie", "entity_id"))
    targets = rows.filter(~is_q).withColumn("_r", rank).filter(F.col("_r") <= config.top_k)
    one = ["country", "source", "key"]
    place = F.conv(F.substring("tie", 1, 15), 16, 10).cast("long").alias("place")
    heads = targets.filter("_r = 1").select(*one, F.lit(False).alias("query"), place, "own", "rest")
    asked = rows.filter(is_q).groupBy(*one).agg(F.first("own").alias("own"), F.first("rest").alias("rest")).select(*one, F.lit(True).alias("query"), F.lit(0).cast("long").alias("place"), "own", "rest")
    texts = heads.unionByName(asked).select(*one, "query", "place", F.size("own").alias("n_own"), b.tokens(F.concat("own", "rest")).alias("bags"))
    vectors = texts.mapInArrow(_vectors(words), VECTOR)
    counted = heads.unionByName(asked).groupBy("country", "source", "query").count()
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1))
    n_q = F.broadcast(counted.filter("query").select("country", F.col("count").alias("_q")))
    n_t = F.broadcast(counted.filter("not query").select("country", F.col("source").alias("target_source"), F.col("count").alias("_t")))
    dealt = vectors.join(n_q, "country").join(n_t, ["country", "target_source"]).withColumns({"_q": parts("_q", TILE_Q), "_t": parts("_t", TILE_T)})
    own = F.pmod(F.xxhash64("key"), F.when(F.col("query"), F.col("_q")).otherwise(F.col("_t")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("_t")).otherwise(F.col("_q")) - 1))
    dealt = dealt.withColumns({"_own": own}).withColumn("_other", others)
    dealt = dealt.withColumns({"bq": F.when(F.col("query"), F.col("_own")).otherwise(F.col("_other")), "bt": F.when(F.col("query"), F.col("_other")).otherwise(F.col("_own"))}).drop("_own", "_other", "_q", "_t")
    found = dealt.groupBy("country", "target_source", "bq", "bt").applyInArrow(_tile(words.idf, config), FOUND)
    of_q = Window.partitionBy("country", "target_source", "q")
    found = found.withColumn("_r", F.rank().over(of_q.orderBy(F.desc("retrieval_score"), "place"))).filter(F.col("_r") <= config.top_k).drop("_r", "place")
    mates = targets.select("country", F.col("source").alias("target_source"), F.col("key").alias("t"), F.col("entity_id").alias("target_id"), F.col("tie").alias("target_content_key"))
    pairs = found.join(mates, ["country", "target_source", "t"]).drop("t")
    rank = F.row_number().over(of_q.orderBy(F.desc("retrieval_score"), "target_content_key", "target_id"))
    pairs = pairs.withColumn("_r", rank).filter(F.col("_r") <= config.top_k)
    queries = rows.filter(is_q).select("country", F.col("key").alias("q"), F.col("entity_id").alias("s1_id"))
    keys = ["s1_id", "target_id", "target_source", "target_content_key"]
    pairs = pairs.join(queries, ["country", "q"]).select(*keys, "retrieval_score")
    return ranked(pairs, config.top_k).withColumns({"channel": F.lit(channel), "exact_match": F.lit(False)})


def top_n(g: DataFrame, config: Config, channel: str, target_filter: Column | None = None, query_filter: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """As ``joined``, of the grams of queries (S1) and targets."""
    vocab = vocabulary(g.filter("source <> 'S1'"), config) if vocab is None else vocab
    return joined(_of_grams(g), config, channel, target_filter, query_filter, vocab)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The first k of each query and source by (-score, content, id), with their rank: a total order, so ties at the cut are settled."""
    rank = F.row_number().over(Window.partitionBy("s1_id", "target_source").orderBy(F.desc("retrieval_score"), "target_content_key", "target_id"))
    return pairs.withColumn("channel_rank", rank).filter(F.col("channel_rank") <= k)


def merged(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Two top-k lists as one: the best score of each target, ranked again."""
    keys = ["s1_id", "target_id", "target_source", "target_content_key"]
    both = a.select(*keys, "retrieval_score").unionByName(b.select(*keys, "retrieval_score"))
    return ranked(both.groupBy(*keys).agg(F.max("retrieval_score").alias("retrieval_score")), k)


def rescue(records: DataFrame, weak: DataFrame, config: Config, strict: bool = True) -> DataFrame:
    """Names of weak queries against targets without an address view; the vocabulary is that of all targets."""
    b = bags(records, "business_name", strict=strict)
    bare = records.filter(views.field(F.col("business_address"), strict)["unicode"] == "").select("entity_id").distinct().withColumn("_b", F.lit(True))
    kept = b.rows.join(bare, "entity_id", "left").filter("source = 'S1' or _b").drop("_b")
    return joined(Bags(kept, b.tokenizer), config, "missing_address_name_char", query_filter=weak, vocab=fitted(b, config))
