"""Operator 5: sequence packing by non-negative least squares over length patterns."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import tokens as T

#: Tokens of a sequence; tokens of a bin of the histogram that patterns are fitted to; documents of a pattern at most; for each fit, tokens that its sequences may leave free.
CAPACITY, GRAIN, PARTS, SLACKS = 2048, 16, 3, (0, 1, 3, 8, 24, 64)
Kinds = list[tuple[tuple[int, ...], int]]


def length_patterns(bins: int, parts: int = PARTS) -> np.ndarray:
    """Every way to fill a sequence of ``bins`` bins with one to three documents, ascending; 0: no document."""
    found = [(0, 0, bins)]
    if parts > 1:
        found += [(0, a, bins - a) for a in range(1, bins // 2 + 1)]
    if parts > 2:
        found += [(a, b, bins - a - b) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    return np.array(found)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Non-negative least squares: how often each pattern repeats, so that their lengths add to the histogram.

    An active-set method: its solutions have no more patterns than the histogram has bins, so repeats are large and
    little is lost when they are rounded.  histogram[i] counts documents of i bins; [0] is ignored.  A bin weighs as
    its documents are long, so that what the fit leaves over is short and finds room.
    """
    width, target = len(histogram), histogram.astype(float)
    weight = np.arange(width) / max(width - 1, 1)
    target *= weight
    x, used = np.zeros(len(patterns)), np.zeros(0, np.int64)
    columns = np.zeros((width, 0))
    scale = max(1.0, np.abs(target).max())

    def column(i: int) -> np.ndarray:
        return np.bincount(patterns[i], minlength=width) * weight

    for _ in range(6 * width):
        left = (target - columns @ x[used]) * weight
        gain = left[patterns].sum(1)
        gain[used] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance * scale:
            break
        used, columns = np.append(used, best), np.column_stack([columns, column(best)])
        while True:
            try:
                now = np.linalg.solve(columns.T @ columns, columns.T @ target)
            except np.linalg.LinAlgError:
                now = np.linalg.lstsq(columns, target, rcond=None)[0]
            if (now > 0).all():
                x[used] = now
                break
            old, bad = x[used], now <= 0
            step = (old[bad] / np.maximum(old[bad] - now[bad], 1e-300)).min()
            x[used] = old + step * (now - old)
            stay = (x[used] > 1e-12 * scale) & ~(bad & (x[used] <= 1e-9 * scale))
            x[used[~stay]] = 0
            used, columns = used[stay], columns[:, stay]
            if not len(used):
                break
    return x


def realise(patterns: np.ndarray, repeat: np.ndarray, left: dict[int, int], capacity: int, grain: int, slack: int) -> Kinds:
    """Sequences of real lengths, taken from ``left``, for each pattern as often as it repeats or documents are there.

    The shorter documents of a pattern come from their bins, and the last is the longest one that fits into what they leave; of all
    such choices the fullest is made, and none that leaves more than ``slack`` tokens free.
    """
    kinds: Kinds = []
    stock: dict[int, list[int]] = {}
    for k in sorted(left):
        stock.setdefault(-(-k // grain), []).append(k)

    def last(room: int, taken: tuple[int, ...]) -> int:
        """The longest document that leaves at most ``slack`` of ``room``; 0: there is none."""
        return next((k for k in range(room, max(room - slack, 1) - 1, -1) if left.get(k, 0) > taken.count(k)), 0)

    def choices(short: list[int]) -> Iterator[tuple[int, ...]]:
        if not short:
            yield ()
            return
        for taken in choices(short[:-1]):
            for k in reversed(stock.get(short[-1], [])):
                if left[k] > taken.count(k):
                    yield (*taken, k)

    for i in np.argsort(-repeat, kind="stable"):
        n = int(repeat[i])
        if n <= 0:
            break
        short = [int(b) for b in patterns[i] if b][:-1]
        while n:
            best: tuple[int, ...] = ()
            for taken in choices(short):
                room = capacity - sum(taken)
                k = last(room, taken)
                if k and sum(taken) + k > sum(best):
                    best = (*taken, k)
                    if k == room:
                        break
            if not best:
                break
            m = min([n, *(left[k] // best.count(k) for k in best)])
            for k in best:
                left[k] -= m
            for k in set(best):
                if not left[k]:
                    stock[-(-k // grain)].remove(k)
            kinds.append((best, m))
            n -= m
    return kinds


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, slacks: tuple[int, ...] = SLACKS) -> Kinds:
    """Kinds of sequences (their lengths, how many) that hold exactly ``counts`` documents of each length; see pattern_plan."""
    return pattern_plan(counts, capacity, grain, slacks)[0]


def pattern_plan(counts: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, slacks: tuple[int, ...] = SLACKS) -> tuple[Kinds, int]:
    """The kinds of sequences, and how many documents the patterns placed.

    Works on counts only, so its cost does not follow the number of documents.  Patterns are fitted to the histogram, their
    repeats are rounded down and realised, and patterns are fitted to what is left, a few times; in the last fit repeats are
    rounded up.  The residual goes to the fullest open sequence that still has room, longest first.
    """
    left = {k: v for k, v in counts.items() if v}
    bins = -(-capacity // grain)
    kinds: Kinds = []
    if (n := left.pop(capacity, 0)) > 0:
        kinds.append(((capacity,), n))
    patterns, whole = length_patterns(bins), sum(left.values())
    for slack in slacks:
        if not (left := {k: v for k, v in left.items() if v}):
            break
        histogram = np.bincount([-(-k // grain) for k in left], list(left.values()), bins + 1)
        fitted = fit_counts(patterns, histogram)
        repeat = np.floor(fitted + 1e-6) if slack < slacks[-1] else np.ceil(fitted - 0.25)
        kinds += realise(patterns, repeat.astype(np.int64), left, capacity, grain, slack)
    placed = whole - sum(left.values())
    # best fit: the open sequence with the least room that is enough
    rooms: list[int] = []
    open_: dict[int, Kinds] = {}

    def put(kind: tuple[int, ...], n: int) -> None:
        room = capacity - sum(kind)
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((kind, n))

    for kind, n in kinds:
        put(kind, n)
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            at = bisect_left(rooms, k)
            if at < len(rooms):
                room = rooms[at]
                kind, m = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                used = min(m, n)
                if used < m:
                    put(kind, m - used)
                put((*kind, k), used)
            else:
                fit = capacity // k
                used = n if n < fit else n - n % fit
                put((k,) * min(n, fit), 1 if n < fit else n // fit)
            n -= used
    return [x for room in rooms for x in open_[room]], placed


def slots_of(kinds: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the documents of a length go by rank."""
    out, rank, base = [], {}, 0
    for kind, n in kinds:
        at = 0
        for k in kind:
            lo = rank.get(k, 0)
            out.append((k, lo, lo + n, base, at))
            rank[k] = lo + n
            at += k
        base += n
    return out


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document (null text: the end id only)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long"

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = T.encoder(tokenizer).encode_column
        for batch in batches:
            ids, begin = T.with_end(*encode(batch.column("text")), end_id)
            count = -(-np.diff(begin) // capacity)
            row = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(np.diff(begin)[row] - start, capacity)
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip((begin[row] + start).tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pattern_pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, rows_a_group: int = 20_000) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens; one row per piece.

    Lengths are counted in a histogram of ``capacity`` numbers, the only thing the driver sees.  A
    piece finds its place by its rank among pieces of its length; ranks are counted in hashed groups of
    about ``rows_a_group`` rows, so no length gathers in one task.  Null text is empty; every row gives
    one piece at least; equal rows are packed apart; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = C.written(token_pieces(docs, capacity, tokenizer or T.path_of(), end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    kinds = plan_sequences(counts, capacity)  # a histogram of ``capacity`` counts
    slots = spark.createDataFrame(slots_of(kinds) or [(0, 0, 0, 0, 0)], "length int, lo long, hi long, base long, offset long")
    groups = max(16, sum(counts.values()) // rows_a_group)
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = keyed.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("rank", rank).join(sizes, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("skip"))
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= lo and rank < hi")  # slots: bounded by the lengths there can be
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
