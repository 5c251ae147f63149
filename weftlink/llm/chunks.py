"""Documents packed into chunks, and the question which keys several chunks share.

A chunk is some megabytes of whole texts in one row. Work that needs arrays over
millions of positions runs on a chunk at a time, so memory is bounded by the
chunk (or by one longer text). To learn which 64-bit keys of its texts occur
elsewhere, a chunk sends its distinct keys, sorted and cut to 32 bits within
their bucket, to the buckets' owners, and gets one small code for each key back.
Keys travel packed: three or four bytes each, one row for each chunk and bucket. A cut key can only look more common than it is,
so callers verify what they get.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffles, trim, tune

CHUNK_BYTES = 1 << 20
#: A chunk has fewer documents than 2 ** DOC_BITS, a partition fewer chunks than 2 ** CHUNK_BITS.
DOC_BITS, CHUNK_BITS = 16, 20
#: Squeezed text whose keys share a bucket, about.
BUCKET_BYTES = 8 << 20
#: Replies of at most so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20
#: Stands for a null id: larger than every other.
NO_ID = np.iinfo(np.int64).max


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed(ids: list[int], texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    return np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), squeeze(b"".join(texts))


def pack(docs: DataFrame, key: str, text: str, chunk_bytes: int = CHUNK_BYTES, squeezed: bool = False) -> DataFrame:
    """(chunk long, ids binary, sizes binary, texts binary), written to the checkpoint folder.

    Null texts are empty; null ids are NO_ID. Every row is in one chunk. The text
    column may hold squeezed bytes instead of strings.
    """
    spark = docs.sparkSession
    tune(spark)

    def work(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row():
            a, b, c = _packed(ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([(part << CHUNK_BITS) | n], pa.int64()), pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([c], pa.large_binary() if len(c) > 1 << 30 else pa.binary())], ["chunk", "ids", "sizes", "texts"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_buffer().to_pybytes() if t.is_valid else b""
                t = unsqueeze(t) if squeezed and t else t
                if (size and size + len(t) > chunk_bytes) or len(ids) >= (1 << DOC_BITS) - 1:
                    yield row()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i.as_py() if i.is_valid else NO_ID)
                texts.append(t)
                size += len(t)
        if ids:
            yield row()

    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("binary" if squeezed else "string")).mapInArrow(work, "chunk long, ids binary, sizes binary, texts binary")
    return cut(rows)


class Chunk:
    """ids, the texts' bytes end to end, and where each text begins (with the end of the last)."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.edges = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        self.data = unsqueeze(texts)

    def texts(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.edges, self.edges[1:], strict=False)]


def buckets(packed: DataFrame) -> int:
    """Into how many buckets the keys of packed texts are dealt: each is one table in one worker, so there are more for more text."""
    size = packed.agg(F.sum(F.length("texts"))).first()[0] or 0
    return max(shuffles(packed.sparkSession), -(-size // BUCKET_BYTES))


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, doc) pairs."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return k[new], d[new]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def low(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct cut keys ordered by bucket and key, edges of the buckets, place of each input key among them)."""
    both = (bucket_of(keys, buckets).astype(np.uint64) << np.uint64(32)) | low(keys)
    u, back = np.unique(both, return_inverse=True)
    edges = np.searchsorted(u, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    return u, edges, back


def per_chunk(chunks: DataFrame, replies: list[DataFrame], work, schema: str, small: bool = True, most: int = BROADCAST_BYTES) -> DataFrame:
    """work(Chunk, chunk id, [replies of the chunk]) -> iterator of record batches, over each chunk.

    replies: written DataFrames of (chunk, bucket, reply binary); each chunk gets
    {bucket: reply}. Replies of ``most`` bytes in all go to every worker; more are dealt by
    chunk, as are those known not to be small.
    """
    joined = chunks
    for i, r in enumerate(replies):
        own = r.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias(f"reply{i}"))
        if small and (r.agg(F.sum(F.length("reply"))).first()[0] or 0) <= most:
            own = F.broadcast(own)
        joined = joined.join(own, "chunk", "left")
    k = len(replies)

    def each(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(x)) for x in ("chunk", "ids", "sizes", "texts", *[f"reply{i}" for i in range(k)])]
            for r in range(batch.num_rows):
                got = [{x["bucket"]: x["reply"] for x in (c[r].as_py() or ())} for c in cols[4:]]
                yield from work(Chunk(cols[1][r].as_py(), cols[2][r].as_py(), cols[3][r].as_py()), cols[0][r].as_py(), got)
                trim()

    return joined.mapInArrow(each, schema)


def steps(keys: np.ndarray) -> bytes:
    """Ordered keys of one bucket as squeezed differences: these have leading zeros."""
    low_ = keys.astype(np.uint32)
    return squeeze(np.diff(low_, prepend=np.uint32(0)).tobytes())


def unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unsqueeze(data), np.uint32), dtype=np.uint32)


def ask(chunk: int, keys: np.ndarray, docs: np.ndarray, buckets: int):
    """Record batch of requests: for each bucket the chunk's distinct keys and in how many of its documents each is.

    (keys, docs) pairs must be distinct.
    """
    u, edges, back = split(keys, buckets)
    count = np.minimum(np.bincount(back, minlength=len(u)), 255).astype(np.uint8)
    own = [i for i in range(buckets) if edges[i] < edges[i + 1]]
    body = [squeeze(count[edges[i] : edges[i + 1]].tobytes()) for i in own]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([chunk] * len(own), pa.int64()), pa.array([steps(u[edges[i] : edges[i + 1]]) for i in own], pa.binary()), pa.array(body, pa.binary())], ["bucket", "chunk", "keys", "counts"])


ASK = "bucket int, chunk long, keys binary, counts binary"
REPLY = "bucket int, chunk long, reply binary"


def _levels(n: np.ndarray) -> np.ndarray:
    """0 for one document, else 1 + log2 of the count, in whole steps."""
    return np.where(n < 2, 0, 1 + np.log2(np.maximum(n, 1)).astype(np.int64)).astype(np.uint8)


def answer(requests: DataFrame, bits: bool = False) -> DataFrame:
    """(bucket, chunk, reply): a level for each key of the request, from the number of documents that have it (0: one); with ``bits`` only whether several have it."""

    def work(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        keys = [unsteps(x.as_py()) for x in table.column("keys")]
        counts = [np.frombuffer(unsqueeze(x.as_py()), np.uint8) for x in table.column("counts")]
        u, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(counts), minlength=len(u))
        level = _levels(total)[back]
        out, at = [], 0
        for k in keys:
            own = level[at : at + len(k)]
            out.append(squeeze((np.packbits(own > 0) if bits else own).tobytes()))
            at += len(k)
        trim()
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int32()), "chunk": pa.array(chunks, pa.int64()), "reply": pa.array(out, pa.binary())})

    return cut(requests.groupBy("bucket").applyInArrow(work, REPLY))


def levels(keys: np.ndarray, reply: dict[int, bytes], buckets: int) -> np.ndarray:
    """The level of each key, from the chunk's replies."""
    u, edges, back = split(keys, buckets)
    level = np.zeros(len(u), np.uint8)
    for i, r in reply.items():
        level[edges[i] : edges[i + 1]] = np.frombuffer(unsqueeze(r), np.uint8)
    return level[back]


def several(keys: np.ndarray, reply: dict[int, bytes], buckets: int) -> np.ndarray:
    """Do several documents have the key? From the chunk's replies in bits."""
    u, edges, back = split(keys, buckets)
    out = np.zeros(len(u), bool)
    for i, r in reply.items():
        out[edges[i] : edges[i + 1]] = np.unpackbits(np.frombuffer(unsqueeze(r), np.uint8), count=edges[i + 1] - edges[i])
    return out[back]
