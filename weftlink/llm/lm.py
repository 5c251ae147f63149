"""Language-model scores from a log-frequency Bloom filter.

Word counts over the training documents are exact; counts of word pairs are
quantised to powers of two and held in a Bloom filter that grows with them: a
pair at level q is entered as (pair, 1) to (pair, q), and its
level is read back by probing level after level until one is missing. The
probability of a word mixes the pair's relative frequency with the smoothed word
frequency. Counts are gathered from all training text, chunk by chunk: a chunk
sends each distinct word and pair once.

The filter is built in parts, one for each bucket of pairs, sized by the bucket's
counted entries, so that the rate of false hits is the same at every size. All
pairs are held, those seen once too. A part is probed where it is built, for all
chunks that asked, held-out texts too; chunks get one byte a distinct pair back.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import ROLL, Words, cut, mix, trim

#: Probes of one entry: half of a part's bits are set, so a pair that isn't held reads as held once in 128 cases.
HASHES = 7
#: Weight of the word's own frequency in the mixture.
BACKOFF = 0.4
END = mix(np.array([7], np.uint64))[0]


def in_fold(key: int, folds: int, fold: int) -> bool:
    """Is crc32 of the key's text, modulo folds, the fold? A null key is in none."""
    return key != C.NO_ID and zlib.crc32(str(key).encode()) % folds == fold


class Tokens:
    """The tokens of a chunk: hashes of its words in lower case (A-Z), each text closed by END."""

    def __init__(self, chunk: C.Chunk, folds: int, fold: int):
        texts = [t.lower() for t in chunk.texts()]
        w = Words(texts)
        n = np.bincount(w.doc, minlength=len(texts))
        self.ends = np.cumsum(n + 1) - 1
        self.hash = np.insert(w.hash, np.cumsum(n), END)
        self.doc = np.repeat(np.arange(len(texts)), n + 1)
        self.held_out = np.array([in_fold(int(k), folds, fold) for k in chunk.ids], bool)
        self.learned = ~self.held_out[self.doc]

    def pairs(self) -> np.ndarray:
        """Hash of each token and the one before it; END stands before a text's first."""
        before = np.roll(self.hash, 1)
        before[np.concatenate([[0], self.ends[:-1] + 1])] = END
        return mix(before * np.uint64(ROLL) + self.hash)


def _words(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ordered by bucket, edges of the buckets, place of each input key)."""
    u, back = np.unique(keys, return_inverse=True)
    b = C.bucket_of(u, buckets)
    order = np.argsort(b, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return u[order], np.searchsorted(b[order], np.arange(buckets + 1)), rank[back]


def _level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)


def _places(key: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    h = mix(key.astype(np.uint64) * np.uint64(ROLL) + np.uint64(level))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)]


def part_bytes(counts: np.ndarray) -> int:
    """Bytes of a filter part that holds so many entries that half its bits are set."""
    entries = int(_level(counts[counts > 0]).sum())
    return max(1024, -(-int(entries * HASHES / np.log(2)) // 8))


def build_part(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """One part of the filter, of ``size`` bytes, from cut pair keys and their counts."""
    level = np.where(counts > 0, _level(counts), 0)
    part = np.zeros(size * 8, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for p in _places(keys[level >= q], q, size * 8):
            part[p] = True
    return np.packbits(part)


def read_levels(filter_: np.ndarray, buckets: int, pairs: np.ndarray) -> np.ndarray:
    """The level of each pair in the filter; 0 where it isn't held."""
    size = len(filter_) // buckets
    bucket, key = C.bucket_of(pairs, buckets), C.low(pairs)
    out, alive, q = np.zeros(len(pairs), np.int64), np.arange(len(pairs)), 1
    while len(alive):
        hit = np.ones(len(alive), bool)
        for p in _places(key[alive], q, size * 8):
            at = p.astype(np.int64)
            hit &= (filter_[bucket[alive] * size + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        alive = alive[hit]
        out[alive] = q
        q += 1
        if q > 64:
            break
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, fold: int = 0, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Learned from rows whose key's crc32 modulo ``folds`` is not ``fold``; null keys
    are learned from. Null and empty texts have the end token alone. ``base_score``
    and ``score`` are sums of log10 probabilities: of the smoothed words, and of the
    mixture. With nothing to learn from, every count is 0 and probabilities are
    those of the smoothing alone. Repeated rows are learned from, and scored, as often
    as they occur; an empty table gives none. Keys are integers; columns other than key
    and text are ignored.
    """
    packed = C.pack(docs, key, text, chunk_bytes)
    buckets = C.buckets(packed)

    def send(chunk, at, _):
        t = Tokens(chunk, folds, fold)
        u, edges, back = _words(t.hash, buckets)
        count = np.bincount(back[t.learned], minlength=len(u)).astype(np.uint32)
        own, number, keys, counts = [], [], [], []
        for i in range(buckets):
            if edges[i] < edges[i + 1]:
                own.append(i)
                keys.append(u[edges[i] : edges[i + 1]].tobytes())
                counts.append(C.squeeze(count[edges[i] : edges[i + 1]].tobytes()))
        p, edges, back = C.split(t.pairs(), buckets)
        count = np.bincount(back[t.learned], minlength=len(p)).astype(np.uint32)
        for i in range(buckets):
            if edges[i] < edges[i + 1]:
                own.append(buckets + i)
                keys.append(p[edges[i] : edges[i + 1]].astype(np.uint32).tobytes())
                counts.append(C.squeeze(count[edges[i] : edges[i + 1]].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([at] * len(own), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "chunk", "keys", "counts"])

    def settle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = [np.frombuffer(x.as_buffer(), np.uint64 if bucket < buckets else np.uint32) for x in table.column("keys")]
        counts = np.concatenate([np.frombuffer(C.unsqueeze(x.as_py()), np.uint32) for x in table.column("counts")])
        u, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, weights=counts, minlength=len(u)).astype(np.int64)
        if bucket >= buckets:
            answer = read_levels(build_part(u, total, part_bytes(total)), 1, u.astype(np.uint64)).astype(np.uint8)
        else:
            answer = total
        chunk, reply, at = table.column("chunk").to_pylist(), [], 0
        for k in keys:
            reply.append(C.squeeze(answer[back[at : at + len(k)]].tobytes()))
            at += len(k)
        if bucket < buckets:
            chunk.append(-1)
            reply.append(np.array([total.sum(), (total > 0).sum()], np.int64).tobytes())
        trim()
        return pa.table({"bucket": pa.array([bucket] * len(chunk), pa.int32()), "chunk": pa.array(chunk, pa.int64()), "reply": pa.array(reply, pa.binary())})

    replies = cut(C.per_chunk(packed, [], send, "bucket int, chunk long, keys binary, counts binary").groupBy("bucket").applyInArrow(settle, C.REPLY))
    n, v = 0, 0
    for r in replies.filter("chunk = -1").collect():  # two sums of each bucket of words
        a, b = np.frombuffer(bytes(r["reply"]), np.int64)
        n, v = n + int(a), v + int(b)

    def rate(chunk, number, got):
        t = Tokens(chunk, folds, fold)
        u, edges, back = _words(t.hash, buckets)
        c = np.zeros(len(u), np.int64)
        p, p_edges, p_back = C.split(t.pairs(), buckets)
        level = np.zeros(len(p), np.int64)
        for i, r in got[0].items():
            if i >= buckets:
                level[p_edges[i - buckets] : p_edges[i - buckets + 1]] = np.frombuffer(C.unsqueeze(r), np.uint8)
                continue
            c[edges[i] : edges[i + 1]] = np.frombuffer(C.unsqueeze(r), np.int64)
        c = c[back]
        word = (c + 0.1) / (n + 0.1 * (v + 1))
        # A pair at level q is counted 2 ** (q - 1) times or more; taking the least keeps the sum over next words within 1.
        level = level[p_back]
        pair = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        before = np.roll(c, 1)
        end = c[t.ends[0]] if len(t.ends) else 0
        before[np.concatenate([[0], t.ends[:-1] + 1])] = end
        # After a token that was never seen the word's own frequency is all there is.
        p = np.where(before > 0, (1 - BACKOFF) * np.minimum(pair / np.maximum(before, 1), 1.0) + BACKOFF * word, word)
        add = lambda x: np.bincount(t.doc, weights=x, minlength=len(chunk.ids))
        known, total = np.bincount(t.doc[c > 0], minlength=len(chunk.ids)), np.bincount(t.doc, minlength=len(chunk.ids))
        yield pa.RecordBatch.from_arrays([
            pa.array(chunk.ids, pa.int64(), mask=chunk.ids == C.NO_ID), pa.array(t.held_out), pa.array(total, pa.int64()), pa.array(known, pa.int64()),
            pa.array(np.full(len(chunk.ids), n), pa.int64()), pa.array(add(np.log10(word))), pa.array(add(np.log10(p))),
        ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = C.per_chunk(packed, [replies.filter("chunk >= 0")], rate, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", small=False)
    return out.withColumnRenamed("id", key)
