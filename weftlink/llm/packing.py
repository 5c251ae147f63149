"""Best-fit packing by exact-complement hashing.

Only how many pieces have each length matters to the plan, so the plan is made
over the histogram of lengths (at most ``capacity`` entries, whatever the input).
Sums of one, two and three lengths are indexed; for each length, longest first,
combinations that exactly fill its gap are consumed as far as the counts go; the
residual pieces are packed best-fit. The plan is a list of runs: a pattern of
lengths used so many times. Pieces are then dealt to the runs by their rank
within their length, in parallel.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffles, trim, tune

CAPACITY = 2048
#: Pieces of one length are ranked within so many parts at least.
PARTS = 64


class Plan:
    """Runs of a packing; ``runs``: (first sequence, times, pattern of lengths)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = {n: c for n, c in histogram.items() if c > 0 and 0 < n <= capacity}
        self.capacity, self.runs, self.used = capacity, [], 0
        self._pairs = self._index()
        for n in sorted(self.left, reverse=True):
            self._fill(n)
        self._best_fit()

    def _take(self, pattern: list[int]) -> bool:
        """Use the pattern as often as its lengths are there."""
        need = {n: pattern.count(n) for n in pattern}
        times = min(self.left.get(n, 0) // k for n, k in need.items())
        if times:
            self.runs.append((self.used, times, list(pattern)))
            self.used += times
            for n, k in need.items():
                self.left[n] -= k * times
        return bool(times)

    def _index(self) -> dict[int, list[tuple[int, int]]]:
        """Pair sums: for each sum its pairs (a, b), a <= b."""
        lengths, out = sorted(self.left), {}
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b >= self.capacity:
                    break
                out.setdefault(a + b, []).append((a, b))
        return out

    def _fill(self, n: int) -> None:
        """Exact complements of n: none, one, two, then three lengths."""
        gap = self.capacity - n
        if gap == 0:
            self._take([n])
            return
        if self.left[n]:
            self._take([n, gap])
        if self.left[n]:
            for a, b in reversed(self._pairs.get(gap, ())):
                if self.left[a] and self.left[b]:
                    self._take([n, a, b])
                    if not self.left[n]:
                        return
        if self.left[n]:
            for c in sorted((x for x in self.left if self.left[x] and 3 * x >= gap and x < gap), reverse=True):
                if not self.left[n]:
                    return
                for a, b in reversed(self._pairs.get(gap - c, ())):
                    if b <= c and self.left[a] and self.left[b] and self.left[c]:
                        self._take([n, c, a, b])
                    if not (self.left[n] and self.left[c]):
                        break

    def _best_fit(self) -> None:
        """Residuals, longest first, each into the fullest open pattern with room; equal pieces go together."""
        gaps: list[int] = []
        open_: dict[int, list[list]] = {}

        def put(gap: int, times: int, pattern: list[int]) -> None:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append([times, pattern])

        for n in sorted((x for x in self.left if self.left[x]), reverse=True):
            count = self.left[n]
            while count:
                at = bisect_left(gaps, n)
                if at == len(gaps):
                    fit = self.capacity // n
                    if count >= fit:
                        put(self.capacity - fit * n, count // fit, [n] * fit)
                        count %= fit
                    else:
                        put(self.capacity - count * n, 1, [n] * count)
                        count = 0
                    continue
                gap = gaps[at]
                times, pattern = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
                fit = gap // n
                use = min(times, count // fit)
                if use:
                    put(gap - fit * n, use, pattern + [n] * fit)
                    count -= fit * use
                    times -= use
                elif count:
                    put(gap - count * n, 1, pattern + [n] * count)
                    count, times = 0, times - 1
                if times:
                    put(gap, times, pattern)
            self.left[n] = 0
        for gap in gaps:
            for times, pattern in open_[gap]:
                self.runs.append((self.used, times, pattern))
                self.used += times

    def slots(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, last rank + 1, first sequence, place): the rank r piece of the length lies in sequence first + r - first rank, at the place."""
        seen: dict[int, int] = {}
        out = []
        for first, times, pattern in self.runs:
            place = 0
            for n in pattern:
                r = seen.get(n, 0)
                out.append((n, r, r + times, first, place))
                seen[n] = r + times
                place += n
        return out


_ENCODERS: dict = {}
#: Beyond these characters two libraries' Unicode tables may differ.
_BEYOND = re.compile("[^\x00-\u024f]")


def encoder(vocabulary: str):
    """A function from a text to its ids, for one of the public byte-level vocabularies; kept in each worker.

    Texts in Latin letters go through the faster library where it has the same
    vocabulary as ranks (the ids are the same, and a test compares them); all
    others through the one that the vocabulary is made for.
    """
    if vocabulary not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        slow.encode_special_tokens = True
        ranks = public_tokenizers.path(vocabulary.removesuffix(".json") + ".tiktoken")
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}, special_tokens={}) if os.path.exists(ranks) else None

        def encode(text: str) -> list[int]:
            if fast is None or _BEYOND.search(text):
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _ENCODERS[vocabulary] = encode
    return _ENCODERS[vocabulary]


def pieces(docs: DataFrame, key: str, text: str, vocabulary: str, capacity: int, end: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document's ids and the end id; only longer ones are cut, and the first piece takes the remainder."""
    out = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"

    @F.pandas_udf(out)
    def cut_up(texts: pd.Series) -> pd.Series:
        encode, result = encoder(vocabulary), []
        for t in texts:
            ids = np.array([*(encode(t) if isinstance(t, str) and t else ()), end], "<u4")
            first = len(ids) % capacity or capacity
            edges = [0, *range(first, len(ids) + 1, capacity)]
            result.append([{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for i, (a, b) in enumerate(zip(edges, edges[1:]))])
        trim()
        return pd.Series(result, dtype=object)

    return docs.select(F.col(key), F.explode(cut_up(F.col(text))).alias("_p")).select(key, "_p.*")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone. Repeated rows are packed
    as often as they occur. Every piece lies in one sequence of at most ``capacity``
    ids, without gaps from 0. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    tune(spark)
    parts = max(PARTS, shuffles(spark))
    row = F.monotonically_increasing_id()
    cutted = cut(pieces(docs, key, text, vocabulary, capacity, end).withColumn("_part", F.pmod(row, F.lit(parts)).cast("int")).withColumn("_id", row))
    counts = cut(cutted.groupBy("length", "_part").agg(F.count("*").alias("_n")))  # at most capacity * parts rows
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_id")) - 1
    ranked = cutted.withColumn("_rank", rank).join(starts, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # The plan's slots depend on the lengths alone and so are few; a length's slots are one array.
    slots = spark.createDataFrame(plan.slots(), "length long, lo long, hi long, first long, place long")
    by_length = slots.groupBy("length").agg(F.collect_list(F.struct("lo", "hi", "first", "place")).alias("_slots"))
    slot = F.element_at(F.filter("_slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"])), 1)
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("_slot", slot)
    return placed.select(key, "piece", "start", "length", "ids_crc32", (F.col("_slot.first") + F.col("_rank") - F.col("_slot.lo")).alias("sequence_id"), F.col("_slot.place").alias("offset"))
