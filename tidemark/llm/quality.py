"""Operator 2: quality rules on repetition coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Most characters, as a share of the words' characters, inside duplicated n-grams of each length, and inside duplicated lines.
GRAM_SHARE = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}
LINE_SHARE = 0.20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_share double, dup_line_share double, base_failed boolean, kept boolean"


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen twice or more, seen before) for each key, in order."""
    n = len(key)
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return twice, later
    slot = (key & np.uint64((1 << max(8, n.bit_length() + 2)) - 1)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot)[slot] > 1)  # the rest are alone in their slot
    sub = key[maybe]
    order = np.argsort(sub, kind="stable")
    same = sub[order][1:] == sub[order][:-1]
    later[maybe[order[1:][same]]] = True
    twice[maybe[order[1:][same]]] = True
    twice[maybe[order[:-1][same]]] = True
    return twice, later


def _covered(hit: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside a window that is hit; windows are n words long."""
    step = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, begin: np.ndarray, gram_share: dict[int, float], line_share: float) -> list[np.ndarray]:
    """All columns of SCHEMA for a run of texts."""
    rows = len(begin) - 1
    lead = (data & 0xC0) != 0x80
    start, end, row = C.words(data, begin)
    salt = C.mix(np.arange(1, rows + 1, dtype=np.uint64))
    n_words = np.bincount(row, minlength=rows)
    points = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    chars = points[end] - points[start]
    word_chars = np.bincount(row, chars, rows).astype(np.int64)
    n_symbols = C.per_row(SYMBOLS[data], begin)
    # lines
    cut = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([begin[:-1], cut + 1]))
    first = first[first < len(data)]
    last = np.append(first[1:], len(data))
    last = last - ((last > first) & (data[last - 1] == 10)) if len(first) else last
    ink = np.concatenate([[0], np.cumsum(~C.SPACE[data], dtype=np.int64)])
    real = ink[last] > ink[first]
    first, last = first[real], last[real]
    of = np.searchsorted(begin, first, "right") - 1
    twice, later = _repeated(C.hash_runs(data, first, last) ^ salt[of])
    n_dup_lines = np.bincount(of[later], minlength=rows)
    inked = np.concatenate([[0], np.cumsum(lead & ~C.SPACE[data], dtype=np.int64)])
    line_chars = np.bincount(of[twice], (inked[last] - inked[first])[twice], rows)
    # n-grams of words
    word = C.hash_runs(data, start, end)
    base = np.maximum(word_chars, 1)
    repeat_words, worst, broken = np.zeros(rows, np.int64), np.zeros(rows), line_chars > line_share * base
    gram = word
    for n in range(2, max([5, *gram_share]) + 1):
        if len(word) < n:
            break
        gram = C.next_gram(gram, word, n)
        if n != 5 and n not in gram_share:
            continue
        inside = row[: len(gram)] == row[n - 1 :]
        at = np.flatnonzero(inside)
        hit = np.zeros(len(gram), bool)
        hit[at] = _repeated(gram[at] ^ salt[row[at]])[0]
        under = _covered(hit, n, len(word))
        if n == 5:
            repeat_words = np.bincount(row[under], minlength=rows)
        if n in gram_share:
            share = np.bincount(row[under], chars[under], rows) / base
            worst = np.maximum(worst, share)
            broken |= share > gram_share[n]
    failed = (n_words < 10) | (100 * repeat_words > 20 * n_words)
    return [n_words, word_chars, n_symbols, n_dup_lines, repeat_words, worst, line_chars / base, failed, ~failed & ~broken]


def repetition_rules(docs: DataFrame, gram_share: dict[int, float] | None = None, line_share: float = LINE_SHARE) -> DataFrame:
    """Repetition coverage of every text, by rolling hashes of several n-gram lengths.

    A narrow map over Arrow batches: no shuffle, memory bounded by a batch.  Words are maximal runs
    without space, tab, \\n, \\v, \\f or \\r.  For each length of ``gram_share`` the characters of words
    inside n-grams found twice or more are counted once, and so are those in lines found twice or
    more; a text whose share exceeds a limit is not kept.  Columns of SCHEMA follow the given ones
    (given columns of those names are replaced).  Null or empty text: all counts 0, base_failed, not kept.  Equal rows give
    equal rows, null ids are carried, a share that equals its limit is kept; an empty table gives an empty result.
    """
    share = dict(GRAM_SHARE if gram_share is None else gram_share)
    new = [x.strip().split()[0] for x in SCHEMA.split(",")]
    given = [c for c in docs.columns if c not in new]
    frame = docs.select(given)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = C.flat(batch.column("text"))
            parts = [measure(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a], share, line_share) for a, b in C.rounds(begin)]
            if parts:
                found = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*given, *new])

    return frame.mapInArrow(run, f"{fields}, {SCHEMA}")


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("repeat_share", 6).alias("repeat_share"))
