"""Benchmark decontamination by edit distance.

Texts are sequences of words. An item of W words leaks into a document that has a
stretch within ``allowed(W)`` word edits of it. Windows of an item's size start at
every word. Those that lack too many of the items' word pairs can't be within the
limit of any item (an edit breaks two pairs at most) and are passed over. All others
are embedded by CGK random walks, which turn edits into few Hamming differences, and
looked up by bit sampling: a window that agrees with an item on all sampled places of
any walk is a candidate. Candidates are aligned exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ROLL, Words, cut, mix, trim, tune

#: Edits allowed, in hundredths of an item's words.
PERCENT = 15
#: Walks, and places sampled from each. A window at the edit limit agrees with its item on one sampled
#: place of a walk in about half of the cases, so 40 walks of 2 places miss it with probability 0.75 ** 40, about 1e-5.
WALKS, BITS = 40, 2
#: Items are taken in blocks of at most so many bytes; a block is what goes to the workers.
BLOCK_BYTES = 16 << 20

_PUNCTUATION = bytes(32 if 0x21 <= i <= 0x2F or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7E else i for i in range(256))


def normal(text: str | None) -> bytes:
    """Lower case, ASCII punctuation as spaces."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION) if isinstance(text, str) else b""


def allowed(words: int, percent: int = PERCENT) -> int:
    """Edits allowed in an item: its share of the words."""
    return words * percent // 100


def sampled(sizes: np.ndarray) -> np.ndarray:
    """Places of each walk for windows of so many words; a walk takes two steps a word on average."""
    return (np.random.default_rng(11).random((WALKS, BITS))[None] * 2 * sizes[:, None, None]).astype(np.int64)


def signatures(words: np.ndarray, start: np.ndarray, stop: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of WALKS signatures for each window start..stop of the words, embedded as a window of its size.

    At step j of a CGK walk the word under the cursor is put out (0 past the end), and
    a hash of (walk, j, word) decides whether the cursor moves. A signature is made of
    the size, the walk, and what is put out at its sampled places.
    """
    order = np.argsort(-sizes, kind="stable")
    begin, n, size = start[order, None], (stop - start)[order, None], sizes[order]
    places = sampled(size)
    cursor = np.zeros((len(order), WALKS), np.int64)
    out = np.zeros((len(order), WALKS, BITS), np.uint64)
    walk = (np.arange(1, WALKS + 1, dtype=np.uint64) * np.uint64(ROLL))[None, :]
    for j in range(int(2 * size.max(initial=0))):
        k = int(np.searchsorted(-size, -j / 2))  # windows with 2 * size > j
        c, inside = cursor[:k], cursor[:k] < n[:k]
        w = np.where(inside, words[np.minimum(begin[:k] + c, len(words) - 1)], np.uint64(0))
        np.copyto(out[:k], w[:, :, None], where=places[:k] == j)
        step = ((w ^ mix(walk + np.uint64(j))) * np.uint64(ROLL) >> np.uint64(61)) & np.uint64(1)
        c += (step.astype(np.int64)) * inside
    h = mix(size.astype(np.uint64)[:, None] * np.uint64(ROLL) + walk)
    for b in range(BITS):
        h = mix(h ^ out[:, :, b]) * np.uint64(ROLL)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return h[back]


def edits(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int, int]:
    """(least edits of the item against any stretch of the text, its start, its end); limit + 1 edits if more than the limit."""
    m, n = len(item), len(text)
    at = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), at.copy()
    for i in range(1, m + 1):
        diagonal = cost[:-1] + (text != item[i - 1])
        up = cost[1:] + 1
        best, origin = np.minimum(diagonal, up), np.where(diagonal <= up, start[:-1], start[1:])
        best, origin = np.concatenate([[i], best]), np.concatenate([[0], origin])
        # Moves along the text: the least of cost - place so far, plus place.
        key = (best - at) * (n + 1) + at
        lead = np.minimum.accumulate(key) % (n + 1)
        cost, start = best[lead] + at - lead, origin[lead]
        if cost.min() > limit:
            return limit + 1, 0, 0
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def _grams(words: np.ndarray) -> np.ndarray:
    """Hash of each word and the next one; shorter by one."""
    return mix(words[:-1] * np.uint64(ROLL) + words[1:])


class Items:
    """A block of items: their words, limits, what a window must hold of them, and the signatures to look windows up by."""

    def __init__(self, texts: list[str], percent: int):
        w = Words([normal(t) for t in texts])
        edges = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        self.words = [w.hash[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        sizes = np.diff(edges)
        self.percent, self.limit = percent, [allowed(int(n), percent) for n in sizes]
        inside = np.flatnonzero(w.doc[1:] == w.doc[:-1])
        #: The items' word pairs and words, and for each size which of them its items have.
        self.pairs, self.words_known = Known(_grams(w.hash)[inside] if len(w.hash) else w.hash, w.doc[inside], sizes), Known(w.hash, w.doc, sizes)
        some = np.flatnonzero(sizes)
        sig = signatures(w.hash, edges[:-1][some], edges[1:][some], sizes[some])
        order = np.argsort(sig.ravel(), kind="stable")
        self.sig, self.item = sig.ravel()[order], np.repeat(some, WALKS)[order]


class Known:
    """What a block's items hold of one kind (words or pairs), by the items' size."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, sizes: np.ndarray):
        self.keys, kind = np.unique(keys, return_inverse=True)
        distinct = np.bincount(np.unique(np.stack([item, kind]), axis=1)[0], minlength=len(sizes))
        #: Size: (marks of the kinds that its items have, fewest distinct ones of an item).
        self.of = {}
        for n in np.unique(sizes[sizes > 0]).tolist():
            member = np.zeros(len(self.keys), bool)
            member[kind[sizes[item] == n]] = True
            self.of[n] = member, int(distinct[sizes == n].min())

    def spots(self, values: np.ndarray, ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places of known values, their kinds)."""
        if not len(self.keys) or not len(values):
            return (np.empty(0, np.int64),) * 2
        kind = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        hit = self.keys[kind] == values
        at = np.flatnonzero(hit if ok is None else hit & ok)
        return at, kind[at]


def windows(items: Items, hashes: np.ndarray, doc: np.ndarray, edges: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the item-sized windows that hold enough different word pairs of an item of their size.

    An edit breaks two pairs at most, so of an item's different pairs all but twice the
    limit are in a window and the limit's words behind it. Where an item has too few
    pairs, words are counted instead.
    """
    starts, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    words = None
    if not len(hashes):
        return starts[0], sizes[0]
    pairs = items.pairs.spots(_grams(hashes), doc[1:] == doc[:-1])
    for n, (member, distinct) in items.pairs.of.items():
        limit = allowed(n, percent)
        least, (spots, kinds), reach = distinct - 2 * limit, pairs, n + limit - 1
        if least < 1:
            words = words or items.words_known.spots(hashes)
            member, distinct = items.words_known.of[n]
            least, (spots, kinds), reach = max(1, distinct - limit), words, n + limit
        own = member[kinds]
        spots, kinds = spots[own], kinds[own]
        if len(spots) < least:
            continue
        # The least-th spot from one on is near enough to be in the same stretch.
        first, last = spots[: len(spots) - least + 1], spots[least - 1 :]
        near = (last - first < reach) & (doc[first] == doc[last])
        first, last = first[near], last[near]
        lo = np.maximum(last - reach + 1, edges[doc[first]])
        at = np.unique(_ranges(lo, first - lo + 1))
        # A spot counts for a window that doesn't hold the same kind before it.
        order = np.lexsort((spots, kinds))
        before = np.full(len(spots), -1)
        same = kinds[order][1:] == kinds[order][:-1]
        before[order[1:][same]] = spots[order[:-1][same]]
        counts_from = np.sort(np.maximum(np.maximum(before + 1, spots - reach + 1), 0))
        at = at[np.searchsorted(counts_from, at, side="right") - np.searchsorted(spots, at) >= least]
        starts.append(at)
        sizes.append(np.full(len(at), n))
    return np.concatenate(starts), np.concatenate(sizes)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


#: Windows embedded at once.
EMBEDDED = 1 << 12


def candidates(items: Items, hashes: np.ndarray, doc: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window start, item), distinct, that agree on all sampled places of any walk."""
    start, size = windows(items, hashes, doc, edges, items.percent)
    found = [np.empty((0, 2), np.int64)]
    for a in range(0, len(start), EMBEDDED):
        s, n = start[a : a + EMBEDDED], size[a : a + EMBEDDED]
        sig = signatures(hashes, s, np.minimum(s + n, edges[doc[s] + 1]), n).ravel()
        left, right = np.searchsorted(items.sig, sig), np.searchsorted(items.sig, sig, side="right")
        hit = np.flatnonzero(left < right)
        k = right[hit] - left[hit]
        which = _ranges(left[hit], k)
        found.append(np.unique(np.stack([np.repeat(s[hit // WALKS], k), items.item[which]], axis=1), axis=0))
    both = np.concatenate(found)
    return both[:, 0], both[:, 1]


def leaks(items: Items, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, end word): the closest stretch of each item in each text."""
    w = Words(texts)
    edges = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    start, item = candidates(items, w.hash, w.doc, edges)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    order = np.lexsort((start, item, w.doc[start])) if len(start) else ()
    reach = (-1, -1, -1)
    spans: list[list[int]] = []
    for s, i in zip(start[order].tolist(), item[order].tolist(), strict=True):
        # Stretches around neighbouring windows are searched as one.
        d, n, limit = int(w.doc[s]), len(items.words[i]), items.limit[i]
        lo, hi = max(s - limit, int(edges[d])), min(s + n + limit, int(edges[d + 1]))
        if reach[:2] == (d, i) and lo <= reach[2]:
            spans[-1][3] = hi
        else:
            spans.append([d, i, lo, hi])
        reach = (d, i, spans[-1][3])
    for d, i, lo, hi in spans:
        limit, own, text = items.limit[i], items.words[i], w.hash[lo:hi]
        # An edit changes one word, so the stretch must hold all but so many of the item's words.
        if found.get((d, i), (1,))[0] == 0 or np.count_nonzero(np.isin(own, text)) < len(own) - limit:
            continue
        e, s, t = edits(own, text, limit)
        if e <= limit and e < found.get((d, i), (limit + 1,))[0]:
            found[d, i] = (e, lo + s - int(edges[d]), lo + t - int(edges[d]))
    return [(d, i, *x) for (d, i), x in sorted(found.items())]


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, item key, edits, start_word, end_word): each item that leaks into each document, at its closest place.

    Words are counted from 0 in the normalised text; the end is exclusive. Null and
    empty texts, and items without words, leak nothing; empty tables give none. Items of
    fewer than seven words must occur unchanged. Repeated rows are each searched; equal
    items each leak. Keys keep their types; if both have one name, the item's column is
    called ``item_`` and that name. Other columns are ignored. Items go to the workers in
    blocks of bounded size, one after the other, each a pass over docs.
    """
    spark = docs.sparkSession
    tune(spark)
    named = f"item_{item_key}" if item_key == key else item_key
    own = items.select(F.col(item_key).alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    size = own.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-4 * size // BLOCK_BYTES))
    kinds = dict(docs.select(key).dtypes)[key], dict(items.select(item_key).dtypes)[item_key]
    schema = f"`{key}` {kinds[0]}, `{named}` {kinds[1]}, edits int, start_word int, end_word int"
    out = None
    for b in range(blocks):
        block = own.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(([r["i"] for r in block], [r["t"] for r in block]))
        part = docs.select(key, F.col(text).cast("string")).mapInArrow(_search(shared, percent, key, named, to_arrow_type(items.schema[item_key].dataType)), schema)
        if blocks > 1:  # the driver holds one block at a time
            part = cut(part)
            shared.destroy()
        out = part if out is None else out.union(part)
    return out


def _search(shared, percent: int, key: str, item_key: str, kind: pa.DataType):
    def work(batches):
        names, texts = shared.value
        items = Items(texts, percent)
        for batch in batches:
            got = leaks(items, [normal(t.as_py()) for t in batch.column(1)])
            trim()
            if got:
                d, i, e, s, t = (list(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array([names[x] for x in i], kind), *[pa.array(x, pa.int32()) for x in (e, s, t)]], [key, item_key, "edits", "start_word", "end_word"])

    return work
