"""Operator 6: token ids in directly addressable codes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import tokens as T

MAGIC = b"TDAC1\0\0\0"
#: Bits of a chunk (a byte a chunk); positions between two entries of a rank directory; ids that fill a block.
CHUNK_BITS, RANK_STEP, BLOCK_IDS = 8, 512, 1 << 20


def encode_block(ids: np.ndarray, begin: np.ndarray) -> bytes:
    """One block: document bounds, then for each level its chunks, continuation bitmap and rank directory.

    Level k holds the k-th byte of every id that has one; a set bit says that the id goes on in the
    next level, at the position that the rank of the bit gives.
    """
    ids = ids.astype(np.uint32)
    levels, rest = [], ids
    while True:
        more = (rest >> CHUNK_BITS) > 0
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            break
    out = [MAGIC, struct.pack("<QQI", len(begin) - 1, len(ids), len(levels)), begin.astype("<u8").tobytes()]
    for chunk, more in levels:
        directory = np.concatenate([[0], np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.int64).cumsum()]) if len(more) else np.zeros(1)
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), np.packbits(more, bitorder="little").tobytes(), directory.astype("<u4").tobytes()]
    return b"".join(out)


class Block:
    """Reads a block: any id by its position, or all of them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        docs, self.n, levels = struct.unpack_from("<QQI", data, 8)
        at = 28
        self.begin = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            at += 8 + n + len(bits)
            directory = np.frombuffer(data, "<u4", -(-n // RANK_STEP) + 1, at)
            at += 4 * len(directory)
            self.levels.append((chunk, bits, directory))

    def _rank(self, level: int, i: int) -> int:
        """How many of the first i ids of a level go on in the next one: an entry of the directory and the bits after it."""
        _, bits, directory = self.levels[level]
        first = i // RANK_STEP * RANK_STEP
        inside = np.unpackbits(bits[first >> 3 : (i + 7) >> 3], bitorder="little")[: i - first]
        return int(directory[i // RANK_STEP]) + int(inside.sum())

    def get(self, i: int) -> int:
        """The id at position i, without decoding any other."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
            shift += CHUNK_BITS
        return value

    def span(self, a: int, b: int) -> np.ndarray:
        """The ids at positions a to b, without decoding any other: at each level they are one run, which ranks find."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        out, at, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level, (chunk, bits, _) in enumerate(self.levels):
            out[at] |= chunk[a:b].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            at = at[more]
            if not len(at):
                break
            a = self._rank(level, a)
            b, shift = a + len(at), shift + CHUNK_BITS
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the block, and no others."""
        return self.span(int(self.begin[k]), int(self.begin[k + 1]))

    def all(self) -> np.ndarray:
        return self.span(0, self.n)


def write_codes(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all texts, in ascending doc_id order (null first; then by text), as a table of blocks at ``path``.

    A row is a block: ``part`` and ``place`` order blocks, ``doc_ids`` names its documents, ``n_ids`` counts its
    ids, ``block`` is its bytes.  Rows are dealt by ranges of doc_id before they are encoded, so every
    task encodes its own range once.  Null text is the end id alone; rows with equal doc_id stay apart, ordered by a hash of their texts;
    an empty table writes no block; a text of any length is one document of one block.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, place int, doc_ids array<{kind}>, n_ids long, block binary"

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = T.encoder(tokenizer or T.path_of()).encode_column
        names, ids, total, part, place = [], [], 0, None, 0

        def block() -> pa.RecordBatch:
            begin = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            values = [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([names], type_), pa.array([total], pa.int64()), pa.array([encode_block(np.concatenate(ids), begin)], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names=["part", "place", "doc_ids", "n_ids", "block"])

        for batch in batches:
            type_ = pa.list_(batch.column("doc_id").type)
            flat, begin = T.with_end(*encode(batch.column("text")), end_id)
            for k, (name, at) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                if ids and (total >= block_ids or at != part):
                    yield block()
                    names, ids, total, place = [], [], 0, place + 1
                part = at
                names.append(name)
                ids.append(flat[begin[k] : begin[k + 1]])
                total += len(ids[-1])
        if ids:
            yield block()

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    rows.mapInArrow(run, schema).write.parquet(path)


def block_starts(table: DataFrame) -> DataFrame:
    """part, place, before: ids of all blocks before each block.

    Blocks are added up inside their part, which a task each can do; only one sum a part, as many as the writer had tasks, is ordered as a whole.
    """
    inner = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    skip = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("skip"))
    within = table.select("part", "place", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("within"))
    return within.join(skip, "part").select("part", "place", (F.col("skip") + F.col("within")).alias("before"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the table at ``path``, each read by itself from its block.

    Rows with equal doc_id stay apart; a block without documents gives none; an empty table gives an empty result.
    """
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, before, data in zip(batch.column("doc_ids"), batch.column("before").to_pylist(), batch.column("block"), strict=True):
                block = Block(data.as_py())
                begin = block.begin
                crc = [zlib.crc32(block.document(k).astype("<u4", copy=False)) for k in range(len(begin) - 1)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(before + begin[:-1]), pa.array(np.diff(begin)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    starts = block_starts(table)
    joined = table.join(F.broadcast(starts) if table.count() < 200_000 else starts, ["part", "place"])  # three numbers a block
    return joined.select("doc_ids", "before", "block").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op6_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.new_path(spark, "codes")
    write_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_codes(spark, path)
