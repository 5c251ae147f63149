"""Exact n-gram Jaccard join: a size-aware heavy-light method.

Sets are the distinct five-word shingles. Small sets enumerate subsets: two sets
of sizes n and m are linked exactly if they share a subset of the overlap
ceil(t / (1 + t) * (n + m)), so each enumerates its subsets of the few sizes that
occur. Large sets scan inverted lists: shingles are ordered by how many documents
have them (rare ones first), and linked sets must share one among the first
n - ceil(t * n) + 1. The boundary is the size up to which enumeration costs less
than the scans. Shingles of one document link nothing and are never listed.

A list isn't expanded into all its pairs. First each set is compared with the few
pivots that it shares most lists with, and linked sets become one component; then
only sets of one list that lie in different components are compared. Every
comparison is exact.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as C
from .common import ROLL, Words, cut, mix, shuffles, trim
from .graph import components

WORDS = 5
#: Similarity in hundredths.
PERCENT = 75
MAX_SMALL = 16
#: Pivots that each set is compared with before the rest of its lists is looked at.
STARS = 3


def shingles(texts: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the texts' distinct shingles, ordered by both. Texts must be in lower case.

    A text of fewer words has one shingle of all of them; without words it has none.
    """
    w = Words(texts)
    h, at = w.grams(size)
    doc = w.doc[at]
    count = np.bincount(w.doc, minlength=len(texts))
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        first = np.searchsorted(w.doc, few)
        short = count[few].astype(np.uint64)
        for j in range(size - 1):
            k = j < count[few]
            short[k] = short[k] * np.uint64(ROLL) + w.hash[first[k] + j]
        h, doc = np.concatenate([h, mix(short)]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Least intersection with which sets of sizes n and m are linked."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """Overlaps that a set of size n can need with any linked set."""
    return sorted({overlap(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1)})


def boundary(mean_list: float, percent: int = PERCENT) -> int:
    """Largest size whose subsets cost less than scanning its lists and comparing what they hold."""
    best = 0
    for n in range(1, MAX_SMALL + 1):
        prefix = n - ceil(percent * n / 100) + 1
        if sum(comb(n, k) for k in subset_sizes(n, percent)) > prefix * (1 + mean_list * n):
            break
        best = n
    return best


#: Text compared at once.
CHECK_BYTES = 2 << 20


def _linked_pairs(pairs: list[tuple[bytes, bytes]], percent: int) -> np.ndarray:
    n = len(pairs)
    doc, h = shingles([p[0] for p in pairs] + [p[1] for p in pairs])
    size = np.bincount(doc, minlength=2 * n)
    pair = doc % n
    order = np.lexsort((h, pair))
    p, x = pair[order], h[order]
    inter = np.bincount(p[1:][(p[1:] == p[:-1]) & (x[1:] == x[:-1])], minlength=n)
    return 100 * inter >= percent * (size[:n] + size[n:] - inter)


def _linked(percent: int):
    """Pandas UDF over two columns of squeezed lower-case texts: are their sets linked?"""

    @F.pandas_udf(T.BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for x, y in zip(a, b, strict=True):
            held.append((C.unsqueeze(x), C.unsqueeze(y)))
            size += len(held[-1][0]) + len(held[-1][1])
            if size >= CHECK_BYTES:
                out.append(_linked_pairs(held, percent))
                held, size = [], 0
        if held:
            out.append(_linked_pairs(held, percent))
        trim()
        return pd.Series(np.concatenate(out) if out else np.empty(0, bool))

    return linked


class Ordered:
    """A chunk's sets with each shingle's place in the order (rare ones first), and what shows which sets may be linked."""

    def __init__(self, texts: list[bytes], reply: dict[int, bytes], buckets: int, percent: int):
        self.doc, self.hash = doc, h = shingles(texts)
        level = C.levels(h, reply, buckets) if len(h) else np.empty(0, np.uint8)
        self.n = np.bincount(doc, minlength=len(texts))
        order = np.lexsort((h, level, doc))
        place = np.arange(len(h)) - (np.cumsum(self.n) - self.n)[doc]
        prefix = self.n - -(-percent * self.n // 100) + 1
        keep = (place < prefix[doc]) & (level[order] > 0)
        # Shingles that others have too, their places among the first of each set's, and how many a set has.
        self.own, self.token, self.place = doc[order][keep], h[order][keep].view(np.int64), place[keep]
        self.some = np.bincount(self.own, minlength=len(texts))
        self.shared = np.bincount(doc[level > 0], minlength=len(texts))
        self.weight = np.bincount(doc, weights=level, minlength=len(texts)) / np.maximum(self.n, 1)


def _ask(buckets: int):
    def ask(chunk, at, _):
        doc, h = shingles([t.lower() for t in chunk.texts()])
        if len(h):
            yield C.ask(at, h, doc, buckets)

    return ask


SETS = "id long, n long, sig binary, body binary, text_md5 string"


def sets(docs: DataFrame, key: str, text: str, percent: int, chunk_bytes: int) -> DataFrame:
    """One row per document: id, size of its set, md5 of its text; for those that may be linked also a signature of the set and the squeezed text."""
    buckets = shuffles(docs.sparkSession)
    packed = C.pack(docs, key, text, chunk_bytes)
    levels = C.answer(C.per_chunk(packed, [], _ask(buckets), C.ASK))

    def signed(chunk, at, got):
        given = chunk.texts()
        texts = [t.lower() for t in given]
        s = Ordered(texts, got[0], buckets, percent)
        one, two = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        np.add.at(one, s.doc, mix(s.hash))
        np.add.at(two, s.doc, mix(s.hash ^ np.uint64(ROLL)))
        seen: set[bytes] = set()
        sigs, bodies = [], []
        for i, t in enumerate(texts):
            sig = one[i].tobytes() + two[i].tobytes() if s.some[i] else None
            sigs.append(sig)
            # Of equal sets in a chunk, one carries the text.
            bodies.append(C.squeeze(t) if sig is not None and sig not in seen else None)
            seen.add(sig)
        columns = [pa.array(chunk.ids, pa.int64()), pa.array(s.n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bodies, pa.binary()), pa.array([hashlib.md5(t).hexdigest() for t in given])]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sig", "body", "text_md5"])

    return cut(C.per_chunk(packed, [levels], signed, SETS, small=False))


LISTS = "node long, n long, shared long, weight double, tokens array<struct<token:long,place:int>>"


def inverted(nodes: DataFrame, percent: int, chunk_bytes: int) -> DataFrame:
    """One row per distinct set that may be linked with another: size, shingles that other sets have, mean level, and the prefix's shared shingles with their places.

    Levels are counted again over the distinct sets, so that copies make nothing common.
    """
    buckets = shuffles(nodes.sparkSession)
    packed = C.pack(nodes, "node", "body", chunk_bytes, squeezed=True)
    levels = C.answer(C.per_chunk(packed, [], _ask(buckets), C.ASK))

    def listed(chunk, at, got):
        s = Ordered(chunk.texts(), got[0], buckets, percent)
        edges = np.concatenate([[0], np.cumsum(s.some)])
        some = np.flatnonzero(s.some)
        tokens = pa.StructArray.from_arrays([pa.array(s.token, pa.int64()), pa.array(s.place, pa.int32())], ["token", "place"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(edges[:-1][some], edges[-1]), pa.int32()), tokens)
        yield pa.RecordBatch.from_arrays([pa.array(chunk.ids[some], pa.int64()), pa.array(s.n[some], pa.int64()), pa.array(s.shared[some], pa.int64()), pa.array(s.weight[some]), lists], ["node", "n", "shared", "weight", "tokens"])

    return cut(C.per_chunk(packed, [levels], listed, LISTS))


def _subset_keys(percent: int):
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("o", T.IntegerType()), T.StructField("k", T.LongType())])))
    def keys(bodies: pd.Series) -> pd.Series:
        out = []
        for b in bodies:
            _, h = shingles([C.unsqueeze(b)])
            own = []
            for size in subset_sizes(len(h), percent):
                for c in combinations(range(len(h)), size):
                    own.append({"o": size, "k": int(mix(np.array([np.bitwise_xor.reduce(mix(h[list(c)]))], np.uint64)).view(np.int64)[0])})
            out.append(own)
        return pd.Series(out, dtype=object)

    return keys


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """(key, n_shingles, component_id, text_md5, comp): each row's set size and the smallest key reachable over links; md5 of its text.

    Sets without shingles (no words, empty or null text) link with nothing. A null
    key is larger than all others; a component of null keys alone has a null id, as
    has a lone row with a null key. Rows that repeat a key each get a result. ``comp`` is
    a number of the component, for where keys are null or repeat; without shingles null.
    """
    rows = sets(docs, key, text, percent, chunk_bytes)
    nodes = rows.filter("body is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("body").alias("body"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    sized = inverted(nodes, percent, chunk_bytes)
    listed = sized.select("node", "n", "shared", "weight", F.explode("tokens").alias("t")).select("node", "n", "shared", "weight", "t.token", "t.place")
    shared = listed.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    total = shared.agg(F.count("*"), F.sum("c")).first()
    small = boundary((total[1] or 0) / max(total[0], 1), percent)

    few = nodes.filter(F.col("n") <= small).join(sized.select("node"), "node", "left_semi")
    subsets = few.select("node", "n", F.explode(_subset_keys(percent)("body")).alias("x")).select("node", "n", "x.o", "x.k")
    star = subsets.groupBy("o", "k").agg(F.min(F.struct("n", "node")).alias("r"), F.count("*").alias("c")).filter("c > 1")
    light = subsets.join(star, ["o", "k"]).filter((F.col("node") != F.col("r.node")) & ((100 + percent) * F.col("o") >= percent * (F.col("n") + F.col("r.n"))))
    light = light.select(F.col("r.node").alias("a"), F.col("node").alias("b"))

    # Lists that several sets share, without sets whose every partner is small.
    near = ceil(percent * (small + 1) / 100)
    lists = cut(listed.filter(F.col("n") >= near).join(shared.select("token"), "token"))
    linked = _verified(light.union(_stars(lists, small, percent)).distinct(), nodes, percent)
    comps = cut(sized.select("node").join(components(linked), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
    more = _verified(_across(lists, comps, small, percent), nodes, percent)
    if not more.isEmpty():
        comps = _merge(comps, more)

    own = nodes.select("sig", "node").join(comps, "node", "left").select("sig", F.coalesce("comp", "node").alias("comp"))
    ids = rows.filter("sig is not null").groupBy("sig").agg(F.min("id").alias("id")).join(own, "sig")
    least = ids.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = own.join(least, "comp").select("sig", "component_id", "comp")
    out = rows.select("id", "n", "sig", "text_md5").join(named, "sig", "left")
    known = lambda c: F.when(c != C.NO_ID, c)
    return out.select(known(F.col("id")).alias(key), F.col("n").alias("n_shingles"), known(F.coalesce("component_id", "id")).alias("component_id"), "text_md5", "comp")


def _fits(small: int, percent: int):
    """Sets (n, shared, place) and (m, shared2, place2) of one list that can be linked, and aren't both small.

    The intersection has at most the shingles that each shares with any set, and of
    those from the common one on; it needs percent / (100 + percent) of both sizes.
    """
    n, m = F.col("n"), F.col("m")
    most = F.least("shared", "shared2")
    # The list's shingle need not be the first they have in common; but if it is, nothing before it counts, and one list holds the first.
    after = F.least(n - F.col("place"), m - F.col("place2"))
    need = percent * (n + m)
    return ((100 + percent) * most >= need) & ((100 + percent) * after >= need) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.greatest(n, m) > small)


def _stars(lists: DataFrame, small: int, percent: int) -> DataFrame:
    """For each set the pivots that it shares most lists with. A list's pivot, for each step of sizes that can be linked, is its set of the commonest shingles: what others are copies of."""
    step = 100 / percent
    own = lists.withColumn("_s", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(step))))
    own = own.select("*", F.explode(F.array(F.col("_s"), F.col("_s") + 1)).alias("_k"))
    pivots = own.groupBy("token", "_k").agg(F.max(F.struct("weight", "n", "node", "shared", "place")).alias("p"), F.count("*").alias("c")).filter("c > 1")
    votes = own.join(pivots.select("token", "_k", F.col("p.n").alias("m"), F.col("p.node").alias("a"), F.col("p.shared").alias("shared2"), F.col("p.place").alias("place2")), ["token", "_k"])
    votes = votes.filter((F.col("node") != F.col("a")) & _fits(small, percent)).groupBy("node", "a").agg(F.count("*").alias("v"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("v"), "a"))
    return votes.withColumn("r", rank).filter(F.col("r") <= STARS).select("a", F.col("node").alias("b"))


def _across(lists: DataFrame, comps: DataFrame, small: int, percent: int) -> DataFrame:
    """Pairs of one list and different components; lists within one component have none."""
    own = lists.join(comps, "node")
    mixed = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    own = cut(own.join(mixed, "token"))
    other = own.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("d"), F.col("shared").alias("shared2"), F.col("place").alias("place2"))
    pairs = own.withColumnRenamed("node", "a").join(other, "token").filter((F.col("a") < F.col("b")) & (F.col("comp") != F.col("d")) & _fits(small, percent))
    return pairs.select("a", "b").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    body = nodes.select("node", "body")
    both = pairs.join(body.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(body.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return cut(both.filter(_linked(percent)("x", "y")).select("a", "b"))


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps with the components that the links join made one."""
    name = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    edges = links.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    new = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
    return comps.join(new, "comp", "left").select("node", F.coalesce("_new", "comp").alias("comp"))
