"""Vectorised text primitives over Arrow string columns.

Everything works on the column's UTF-8 buffer, so a batch costs a few numpy
passes instead of a Python loop over words. Memory is bounded by cutting the
buffer into blocks of about a megabyte, at white space inside a long text.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: What isn't an ASCII letter or digit nor part of a non-ASCII character.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i below n; kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 64)
        up, down = np.full(size, _R), np.full(size, _R_INV)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (b[t] + 1) R**t over i <= t < j; one longer than b."""
    up, _ = powers(len(b) + 1)
    p = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same wherever the span lies."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start])


def gram_hash(p: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n-byte window of the buffer behind p."""
    m = len(p) - n
    _, down = powers(len(p))
    return mix((p[n:] - p[:m]) * down[:m])


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def doc_blocks(off: np.ndarray, limit: int = BLOCK):
    """Ranges of rows whose texts have about limit bytes together (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_spans(b: np.ndarray, off: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a word never crosses a row's border."""
    word = ~between[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(b: np.ndarray, off: np.ndarray, between: np.ndarray = _IS_SPACE, begins: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of the rows, and the number of words before each row.

    between: marks the bytes that separate words. begins: lengths in bytes; the
    hashes then are a matrix with one more line a length, which has the hash of
    each longer word's first bytes, and 0 for words that aren't longer.
    """

    def hashed(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        p = prefix_hash(part)
        full = span_hash(p, s, e)
        if not begins:
            return full
        out = np.zeros((1 + len(begins), len(s)), np.uint64)
        out[0] = full
        for k, n in enumerate(begins, 1):
            long = e - s > n
            out[k, long] = span_hash(p, s[long], s[long] + n) + np.uint64(n)
        return out

    if len(b) <= 2 * BLOCK:
        s, e = word_spans(b, off, between)
        return hashed(b, s, e), np.searchsorted(s, off)
    parts, starts, at = [], [], 0
    while at < len(b):
        to = min(at + BLOCK, len(b))
        if to < len(b):  # move to a separator, backwards if there is any
            back = np.flatnonzero(between[b[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(between[b[to:]])
                to = to + int(ahead[0]) + 1 if len(ahead) else len(b)
        inner = off[(off > at) & (off < to)] - at
        s, e = word_spans(b[at:to], np.concatenate([[0], inner, [to - at]]), between)
        parts.append(hashed(b[at:to], s, e))
        starts.append(s + at)
        at = to
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.concatenate(parts, axis=-1), np.searchsorted(s, off)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; in local mode, one of our own where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            where = "file://" + tempfile.mkdtemp(prefix="emberlode-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


class Rounds:
    """Tables that rounds of jobs write in the shared folder and read again.

    A written table cuts the lineage and outlives lost executors; dropping it frees
    its disk at once. Reading also packs many small parts into few tasks. What isn't
    dropped goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", 0
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.at))
        self._fs.deleteOnExit(self._path(self.at))
        # tables are held with their folders: a freed one's id might be given to another
        self._where: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame) -> DataFrame:
        where, self.n = f"{self.at}/{self.n}", self.n + 1
        df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self._where[id(out)] = out, where
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that put returned, not others, and let the driver free finished jobs' shuffle files."""
        for t in tables:
            if t is not None and id(t) in self._where:
                self._fs.delete(self._path(self._where.pop(id(t))[1]), True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_holdout(doc_id) -> "F.Column":
    """Rows whose labels are never learnt: crc32 of the id as text is divisible by 5."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(5)) == 0
