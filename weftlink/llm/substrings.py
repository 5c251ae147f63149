"""Exact-substring dedup by a depth-limited radix sort of suffixes.

All windows of ``width`` bytes are ordered by most-significant-digit passes that
stop at that depth; equal groups are exactly the repeated windows. The first
digit is a content-defined seed: of the ``SEED``-byte strings in a window, the one
of the smallest hash (the leftmost of equals). Equal windows have equal seeds at
equal places, so windows are dealt by seed. Seeds that a single document has are
dropped at once. The windows of the others are compared byte by byte: within a
seed, passes of eight bytes split the groups until they are single or 50 deep.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import cut, mix, rolling, shuffles, sliding_min, trim

WIDTH, SEED = 50, 20
_LOW = np.uint64((1 << 30) - 1)


class Runs:
    """The runs of windows that share a seed place: text, seed place, first and last window, hash of the seed."""

    def __init__(self, chunk: C.Chunk, width: int, seed: int):
        data = np.frombuffer(chunk.data, np.uint8)
        self.data, self.edges = data, chunk.edges
        sizes = np.diff(chunk.edges)
        n = len(data) - width + 1
        if n <= 0 or not (sizes >= width).any():
            self.doc = self.first = self.last = self.place = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            return
        h = rolling(data, seed)
        place = (sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width - seed + 1) & _LOW).astype(np.int64)
        valid = np.zeros(n + 1, np.int8)
        long = sizes >= width
        valid[chunk.edges[:-1][long]] = 1
        stops = np.minimum(chunk.edges[1:][long] - width + 1, n)
        np.add.at(valid, stops, -1)
        valid = np.cumsum(valid[:n]).astype(bool)
        same = np.zeros(n, bool)
        same[1:] = (place[1:] == place[:-1]) & valid[1:] & valid[:-1]
        self.first = np.flatnonzero(valid & ~same)
        ends = np.ones(n, bool)
        ends[:-1] = ~same[1:]
        self.last = np.flatnonzero(valid & ends)
        self.place = place[self.first]
        self.doc = np.searchsorted(chunk.edges, self.first, side="right") - 1
        self.hash = mix(h[self.place])

    def contexts(self, at: np.ndarray, width: int, seed: int) -> np.ndarray:
        """One row of bytes for each run: its windows' bytes padded with zeros, then the seed's place and the number of windows."""
        span = 2 * width - seed
        room = np.zeros(len(self.data) + span, np.uint8)
        room[: len(self.data)] = self.data
        out = room[self.first[at][:, None] + np.arange(span)[None, :]]
        count = self.last[at] - self.first[at] + 1
        out[np.arange(span)[None, :] >= (count + width - 1)[:, None]] = 0
        return np.concatenate([out, (self.place[at] - self.first[at]).astype(np.uint8)[:, None], count.astype(np.uint8)[:, None]], axis=1)


def _rows(a: np.ndarray) -> np.ndarray:
    a = np.ascontiguousarray(a)
    return a.view(np.dtype((np.void, a.shape[1]))).ravel()


def group_rows(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row of each group of equal rows, group of each row), by passes over eight-byte digits."""
    n, w = a.shape
    pad = np.zeros((n, -(-w // 8) * 8), np.uint8)
    pad[:, :w] = a
    words = pad.view(np.uint64)
    # Rows are ordered by a hash first; the digits then confirm each run of equal hashes.
    h = np.zeros(n, np.uint64)
    for j in range(words.shape[1]):
        h = mix(h ^ words[:, j])
    order = np.argsort(h, kind="stable")
    new = np.ones(n, bool)
    s = words[order]
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    if (new[1:] & (h[order][1:] == h[order][:-1])).any():
        _, head, group = np.unique(_rows(a), return_index=True, return_inverse=True)
        return head, group
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def window_groups(context: np.ndarray, hashes: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of distinct contexts: (context, offset, group), by MSD passes to the depth of width.

    A window's first digit is its seed and the seed's place in it.
    """
    span = 2 * width - seed
    count, place = context[:, span + 1].astype(np.int64), context[:, span].astype(np.int64)
    own = np.repeat(np.arange(len(context)), count)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    digit = mix(hashes[own] + (place[own] - offset).astype(np.uint64))
    group = np.unique(digit, return_inverse=True)[1]
    flat = np.concatenate([context.ravel(), np.zeros(8, np.uint8)])
    wide = context.shape[1]
    depth = 0
    alive = np.arange(len(own))
    while True:
        size = np.bincount(group)
        keep = size[group] > 1
        alive, group = alive[keep], group[keep]
        if depth >= width or not len(alive):
            return own[alive], offset[alive], group
        step = min(8, width - depth)
        at = own[alive] * wide + offset[alive] + depth
        word = np.zeros(len(alive), np.uint64)
        for j in range(step):
            word = (word << np.uint64(8)) | flat[at + j]
        order = np.lexsort((word, group))
        g, w = group[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        depth += step


SHARE = "bucket int, chunk long, body binary"


def _least(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Minimum of the values of each group."""
    out = np.full(int(groups.max()) + 1, C.NO_ID)
    np.minimum.at(out, groups, values)
    return out


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary): each text without the bytes that repeat a smaller document.

    A byte goes if a string of ``width`` bytes that covers it also starts in a
    document of a smaller key; strings are those of the input, and overlaps count.
    Null texts are empty. A null key is larger than all others and equal to other
    nulls; rows of one key don't take bytes from each other, but each loses those
    of smaller keys. Columns other than key and text are ignored.
    """
    spark = docs.sparkSession
    buckets = shuffles(spark)
    packed = C.pack(docs, key, text, chunk_bytes)

    def ask(chunk, at, _):
        runs = Runs(chunk, width, seed)
        if len(runs.hash):
            keys, owner = _distinct(runs.hash, runs.doc)
            yield C.ask(at, keys, owner, buckets)

    first = C.answer(C.per_chunk(packed, [], ask, C.ASK))

    def shared(chunk, reply):
        """Runs whose seed other documents have too, their distinct contexts, and the context of each."""
        runs = Runs(chunk, width, seed)
        if not len(runs.hash):
            return runs, np.empty(0, np.int64), np.empty((0, 2 * width - seed + 2), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(C.levels(runs.hash, reply, buckets) > 0)
        context = runs.contexts(at, width, seed)
        head, group = group_rows(context) if len(at) else (np.empty(0, np.int64), np.empty(0, np.int64))
        where = C.bucket_of(runs.hash[at[head]], buckets)
        order = np.argsort(where, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return runs, at, context[head[order]], rank[group], where[order]

    def send(chunk, number, got):
        runs, at, context, group, where = shared(chunk, got[0])
        if not len(at):
            return
        least = _least(chunk.ids[runs.doc[at]], group)
        hashes = np.empty(len(context), np.uint64)
        hashes[group] = runs.hash[at]
        own = np.unique(where)
        body = []
        for b in own:
            i = np.flatnonzero(where == b)
            body.append(C.squeeze(least[i].tobytes() + hashes[i].tobytes() + context[i].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([number] * len(own), pa.int64()), pa.array(body, pa.binary())], ["bucket", "chunk", "body"])

    wide = 2 * width - seed + 2

    def settle(table: pa.Table) -> pa.Table:
        least, hashes, contexts, sizes = [], [], [], []
        for x in table.column("body"):
            raw = C.unsqueeze(x.as_py())
            n = len(raw) // (16 + wide)
            least.append(np.frombuffer(raw, np.int64, n))
            hashes.append(np.frombuffer(raw, np.uint64, n, 8 * n))
            contexts.append(np.frombuffer(raw, np.uint8, n * wide, 16 * n).reshape(n, wide))
            sizes.append(n)
        sent = np.concatenate(least)
        all_contexts, all_hashes = np.concatenate(contexts), np.concatenate(hashes)
        head, group = group_rows(all_contexts)
        ids = _least(sent, group)
        context, hash_ = all_contexts[head], all_hashes[head]
        count = context[:, wide - 1].astype(np.int64)
        first_window = np.cumsum(count) - count
        best = np.repeat(ids, count)
        # Seeds with one context need no comparison of windows.
        seeds = np.unique(hash_, return_inverse=True)[1]
        many = np.flatnonzero(np.bincount(seeds)[seeds] > 1)
        if len(many):
            own, offset, same = window_groups(context[many], hash_[many], width, seed)
            if len(own):
                own = many[own]
                np.minimum.at(best, first_window[own] + offset, _least(ids[own], same)[same])
        reply, at = [], 0
        for n in sizes:
            g = group[at : at + n]
            k = count[g]
            window = np.repeat(first_window[g], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            reply.append(C.squeeze(np.packbits(best[window] < np.repeat(sent[at : at + n], k)).tobytes()))
            at += n
        trim()
        return pa.table({"bucket": pa.array(table.column("bucket").to_pylist(), pa.int32()), "chunk": pa.array(table.column("chunk").to_pylist(), pa.int64()), "reply": pa.array(reply, pa.binary())})

    second = cut(C.per_chunk(packed, [first], send, SHARE).groupBy("bucket").applyInArrow(settle, C.REPLY))

    def finish(chunk, number, got):
        runs, at, context, group, where = shared(chunk, got[0])
        gone = np.zeros(len(chunk.data) + 1, np.int32)
        if len(at):
            least = _least(chunk.ids[runs.doc[at]], group)
            count = context[:, -1].astype(np.int64)
            first_window = np.cumsum(count) - count
            older = np.zeros(int(count.sum()), bool)
            for b, r in got[1].items():
                lo, hi = np.searchsorted(where, [b, b + 1])
                n = int(count[lo:hi].sum())
                if n:
                    a = first_window[lo]
                    older[a : a + n] = np.unpackbits(np.frombuffer(C.unsqueeze(r), np.uint8), count=n).astype(bool)
            k = count[group]
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            removed = older[np.repeat(first_window[group], k) + step] | np.repeat(chunk.ids[runs.doc[at]] > least[group], k)
            starts = (np.repeat(runs.first[at], k) + step)[removed]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + width, -1)
        gone = np.cumsum(gone[:-1]) > 0
        data = np.frombuffer(chunk.data, np.uint8)
        rows = {x: [] for x in ("id", "n_bytes", "n_removed", "n_spans", "kept")}
        for i, (a, b) in enumerate(zip(chunk.edges, chunk.edges[1:], strict=False)):
            g = gone[a:b]
            rows["id"].append(None if chunk.ids[i] == C.NO_ID else int(chunk.ids[i]))
            rows["n_bytes"].append(int(b - a))
            rows["n_removed"].append(int(g.sum()))
            rows["n_spans"].append(int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and g[0])))
            rows["kept"].append(data[a:b][~g].tobytes())
        for i in range(0, len(rows["id"]), 256):
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 256], pa.binary() if x == "kept" else pa.int64()) for x, v in rows.items()], list(rows))

    done = C.per_chunk(packed, [first, second], finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("id", key)


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, doc) pairs."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return k[new], d[new]
