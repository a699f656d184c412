"""What the corpus operators share: scratch tables and flat, vectorised text."""

from __future__ import annotations

import ctypes
import gc
import struct
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one round of numpy work covers (a longer text is one round); rows and bytes of a batch that goes back to Spark.
ROUND_BYTES, BATCH_ROWS, BATCH_BYTES = 1 << 18, 4096, 2 << 20
#: Bytes of a row group of a scratch table: what a writing task holds.
ROW_GROUP = 8 << 20
#: Powers of the hash base that a worker keeps; a longer run of bytes makes its own.
KEPT_POWERS = 1 << 16
#: The white space that separates words: space and the five controls from tab on.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only for a session in one process that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the scratch tables behind ``tables`` once nothing reads them."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession, times: int = 4, pause: float = 0.5) -> None:
    """Lets Spark's cleaner drop the shuffle files of jobs that nothing refers to any more.

    Python's references reach the JVM with a delay, so it is asked more than once.
    """
    for _ in range(times):
        gc.collect()
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()
    time.sleep(pause)


def _give_back() -> None:
    """Memory that Arrow and the C library hold without use goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` over batches cut to BATCH_ROWS rows and about BATCH_BYTES; a worker that Spark uses again keeps no free memory after it."""
    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(small(batches))
        finally:
            _give_back()

    return inner


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most BATCH_ROWS rows and about BATCH_BYTES (a longer row is a batch)."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(BATCH_ROWS, int(n * BATCH_BYTES / max(batch.nbytes, 1)))) if n else 1
        for a in range(0, n, step):
            yield batch.slice(a, step)


def text_bytes(docs: DataFrame) -> int:
    """Total UTF-8 bytes of the texts (one narrow aggregate, no shuffle of rows)."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return every[begin[0] : begin[-1]], begin - begin[0]


def rounds(begin: np.ndarray, limit: int = ROUND_BYTES):
    """Row ranges of about ``limit`` bytes, each with one row at least."""
    a, n = 0, len(begin) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + limit, "right")) - 1)
        yield a, b
        a = b


def powers(n: int) -> np.ndarray:
    """Powers of the hash base, grown by doubling; KEPT_POWERS of them at most are kept."""
    global _powers
    found = _powers
    while len(found) < n:
        found = np.concatenate([found, found * (found[-1:] * _BASE)])
    if len(found) <= KEPT_POWERS:
        _powers = found
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each run (runs ascend and do not overlap; none is empty)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    within = np.arange(at[-1]) - np.repeat(at[:-1], size)
    value = _BYTE[data[within + np.repeat(start, size)]] * powers(int(size.max()))[within]
    return mix(np.add.reduceat(value, at[:-1]) + size.astype(np.uint64))


def words(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begin] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(begin, start, "right") - 1


def next_gram(gram: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash: from hashes of (n-1)-grams to those of n-grams; one fewer at the end."""
    return mix(gram[: len(word) - n + 1] * np.uint64(0xD6E8FEB86659FD93) + word[n - 1 :])


def per_row(flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise indicator over each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[begin[1:]] - total[begin[:-1]]


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, one place of each, and for every key its number among them."""
    order = np.argsort(key)
    sorted_ = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return sorted_[fresh], order[fresh], back


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: planes of bytes, compressed."""
    out = [struct.pack("<B", len(arrays))]
    for x in arrays:
        x = np.ascontiguousarray(x)
        planes = pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True)
        out += [struct.pack("<2sQQ", x.dtype.str[1:].encode(), len(x), len(planes)), planes]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    at, out = 1, []
    for _ in range(blob[0]):
        kind, n, size = struct.unpack_from("<2sQQ", blob, at)
        at += 18
        dtype = np.dtype(kind.decode())
        planes = pa.decompress(blob[at : at + size], n * dtype.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += size
    return out


def runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of each run of an ascending array."""
    cut = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
        if b > a:
            yield int(part[a]), a, b
