"""What the corpus operators share: session settings, checkpoints, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that a Python worker gets at once. Texts can be long, so batches are small.
BATCH_ROWS = 512
BATCH_BYTES = 3 << 20

#: Characters that separate words: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A temporary one only where none is set and the master is local."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="weftlink-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop what no plan refers to any more, shuffle files and broadcasts with it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory back: Python workers stay for later tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, n: int):
    """crc32 of a column's text, modulo n; null where the column is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def lower_ascii(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and all else untouched."""
    return text.encode("utf-8", "surrogatepass").lower()


# ---- 64-bit hashes over byte arrays -------------------------------------------------

#: Multiplier of the rolling hash (odd; the golden ratio in 64 bits).
ROLL = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 for 64 bits."""
    x = x ^ (x >> _S)
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


#: A random value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ROLL))


def power(n: int) -> np.uint64:
    return np.uint64(pow(ROLL, n, 1 << 64))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), ROLL, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k bytes of a uint8 array, by doubling; shorter by k - 1."""
    if len(data) < k:
        return np.empty(0, np.uint64)
    h, n, out, done = BYTE_VALUE[data], 1, None, 0
    while True:
        if k & n:
            out = h if out is None else _append(out, done, h, n)
            done += n
        if done == k:
            return out[: len(data) - k + 1]
        h = h[:-n] * power(n) + h[n:]
        n *= 2


def _append(out: np.ndarray, done: int, h: np.ndarray, n: int) -> np.ndarray:
    m = min(len(out), len(h) - done)
    return out[:m] * power(n) + h[done : done + m]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling; shorter by w - 1."""
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


class Words:
    """The words of many texts as arrays.

    ``data`` holds the texts' bytes, each text ended by a space; ``start`` and
    ``stop`` the words' places, ``doc`` each word's text, ``hash`` its 64-bit hash.
    """

    IS_SPACE = np.zeros(256, bool)
    IS_SPACE[[32, *range(9, 14)]] = True

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.data = data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        ws = self.IS_SPACE[data]
        edge = np.flatnonzero(np.diff(ws, prepend=True))
        self.start, self.stop = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        if len(self.start):
            inside = np.flatnonzero(~ws)
            length = self.stop - self.start
            place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
            value = BYTE_VALUE[data[inside]] * powers(int(length.max()))[place]
            self.hash = mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each n words in a row, and the index of its first word; none cross texts."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = h * np.uint64(ROLL) + self.hash[j : j + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(h[at]), at


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "array<long>": T.ArrayType(T.LongType()), "array<int>": T.ArrayType(T.IntegerType()), "array<string>": T.ArrayType(T.StringType())}


def fields(spec: str) -> T.StructType:
    """A struct type from "name kind, ..."; works where no session exists, as in workers that import a module."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in spec.split(", "))])
