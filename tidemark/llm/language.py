"""Operator 8: language identification by rank-order profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: n-grams of a profile; letters of the longest n-gram.
PROFILE, LONGEST = 300, 3
SCHEMA = "lang_pred string, score double"
#: Letters that one round covers.
ROUND = 1 << 17
#: Counted n-grams that a task holds before it sums those alike.
HELD = 1 << 19
#: For the pipeline's rule (see learn_limit): share of labelled texts that may lie below the low end of clean scores, and of random ones above the high end of theirs; random texts drawn; steps that scores are counted by.
TAIL, DRAWN, STEPS = 0.05, 400, 10_000


def _fold_table() -> np.ndarray:
    """Code point of the BMP -> its lower-case letter, 0 for anything else."""
    out = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        s = chr(c)
        if unicodedata.category(s)[0] == "L":
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


_tables: list[np.ndarray] = []


def letters(data: bytes) -> np.ndarray:
    """Folded letters of a UTF-8 text, 0 between words; letters beyond the BMP stand as one."""
    if not _tables:
        _tables.append(_fold_table())
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out = _tables[0][np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]):
        if chr(p).isalpha():
            out[points == p] = 0xFFFE
    return out


def gram_counts(data: np.ndarray, begin: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and count of every n-gram of 1 to ``longest`` (3 at most) letters; a word carries a blank at either side, alone no n-gram."""
    if longest > 3:
        raise ValueError("three letters and a row number fill 64 bits")
    rows = len(begin) - 1
    blank = np.zeros(1, np.uint16)
    symbol = np.concatenate([blank[:0], *[x for a, b in zip(begin[:-1], begin[1:], strict=True) for x in (blank, letters(data[a:b].tobytes()), blank)]])
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.repeat(np.arange(rows), lead[begin[1:]] - lead[begin[:-1]] + 2)
    code, keys = symbol.astype(np.uint64), []
    high = row.astype(np.uint64) << np.uint64(48)
    for n in range(1, longest + 1):
        if n > 1:
            code = (code[:-1] << np.uint64(16)) | symbol[n - 1 :].astype(np.uint64)
        last, first = symbol[n - 1 :], symbol[: len(code)]
        ok = (code != 0) & (row[: len(code)] == row[n - 1 :])
        if n == 1:
            ok &= first != 0
        elif n > 2:  # blanks at the ends only
            ok &= symbol[1 : len(code) + 1] != 0
        keys.append((code[ok] | high[: len(code)][ok], n))
    found = []
    for key, n in keys:
        key = np.sort(key)
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        where = np.flatnonzero(fresh)
        found.append((key[where], np.diff(np.append(where, len(key))), n))
    key = np.concatenate([k for k, _, _ in found])
    count = np.concatenate([c for _, c, _ in found])
    n = np.concatenate([np.full(len(k), n, np.uint64) for k, _, n in found])
    # the length keeps "a" apart from " a": three blanks of width in the code are never all used by shorter ones
    gram = ((key & np.uint64((1 << 48) - 1)) << np.uint64(2)) | n
    return (key >> np.uint64(48)).astype(np.int64), gram.astype(np.int64), count


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and rank (from 0) of each row's most frequent n-grams; ties by n-gram."""
    order = np.lexsort((gram, -count, row))
    row, gram = row[order], gram[order]
    first = np.searchsorted(row, row, "left")
    rank = np.arange(len(row)) - first
    keep = rank < top
    return row[keep], gram[keep], rank[keep]


def _row_rounds(begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rounds of at most 60000 rows (a row number has 16 bits)."""
    for a, b in C.rounds(begin, ROUND):
        for x in range(a, b, 60_000):
            yield x, min(b, x + 60_000)


def _summed(key: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of each key's n-grams, summed; by key and n-gram."""
    order = np.lexsort((gram, key))
    key, gram, n = key[order], gram[order], n[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(fresh)
    return key[at], gram[at], np.add.reduceat(n, at) if len(at) else n


def learn_profiles(labelled: DataFrame, profile: int = PROFILE, longest: int = LONGEST, held: int = HELD) -> dict[str, list[int]]:
    """Each language's most frequent n-grams, in rank order, over all rows with text and lang.

    Counts are summed in tasks first, which hold ``held`` of them at most, so a shuffle carries about a task's distinct
    n-grams; ``profile`` n-grams a language come to the driver.
    """
    rows = labelled.where("text is not null and lang is not null")

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            key, gram, n = parts.pop()
            names = pa.DictionaryArray.from_arrays(pa.array(key), pa.array(list(numbers), pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            data, begin = C.flat(batch.column("text"))
            lang = np.array([numbers.setdefault(str(x), len(numbers)) for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in _row_rounds(begin):
                row, gram, count = gram_counts(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a], longest)
                parts.append(_summed(lang[a:b][row], gram, count))
                if sum(len(x[1]) for x in parts) > held:
                    parts[:] = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
                    if len(parts[0][1]) > held // 2:
                        yield out()
        if parts:
            parts[:] = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
            yield out()

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predictor(profiles: dict[str, list[int]], profile: int = PROFILE, longest: int = LONGEST):
    """A function of flat texts: names of languages, and scores (see identify_language)."""
    names = sorted(profiles)
    tables = []
    for name in names:
        gram = np.array(profiles[name][:profile], np.int64)
        order = np.argsort(gram)
        tables.append((gram[order], order))

    def predict(data: np.ndarray, begin: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(begin) - 1
        row, gram, rank = ranked(*gram_counts(data, begin, longest), profile)
        used = np.bincount(row, minlength=rows)
        far = np.zeros((len(names), rows))
        for k, (grams, ranks) in enumerate(tables):
            if not len(grams):
                far[k] = used * profile
                continue
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            off = np.where(grams[at] == gram, np.abs(ranks[at] - rank), profile)
            far[k] = np.bincount(row, off, rows)
        best = far.argmin(0) if len(names) else np.zeros(rows, int)
        known = (used > 0) & bool(names)
        score = np.where(known, 1 - (far.min(0) if len(names) else 0) / np.maximum(used * profile, 1), 0.0)
        return [names[b] if ok else "und" for b, ok in zip(best, known, strict=True)], score

    return predict


def _low_end(labelled: DataFrame, profiles: dict[str, list[int]]) -> float | None:
    """The score, rounded down to a step, that all but TAIL of the labelled texts with letters reach; None without any.

    Every such text counts; a task gives a row a step at most, so how rows lie in tasks changes nothing.
    """
    predict = predictor(profiles)

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            data, begin = C.flat(batch.column("text"))
            for a, b in _row_rounds(begin):
                lang, score = predict(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
                known = np.array(lang, object) != "und"
                found += np.bincount((np.clip(score[known], 0, 1) * STEPS).astype(np.int64), minlength=STEPS + 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["step", "n"])

    rows = labelled.where("text is not null and lang is not null").select("text").mapInArrow(run, "step long, n long")
    counts = sorted(rows.groupBy("step").agg(F.sum("n").alias("n")).collect())  # a row a step at most
    if not counts:
        return None
    total = np.cumsum([r["n"] for r in counts])
    return counts[int(np.searchsorted(total, np.ceil(TAIL * total[-1])))]["step"] / STEPS


def learn_limit(labelled: DataFrame, profiles: dict[str, list[int]]) -> float:
    """The least score of a text in one of the languages: half way from what random letters reach to what labelled texts fall to.

    The letters are the profiles' own, drawn alike often, in words of five on average, 20 to 2000 letters a text; all but TAIL of such texts
    score less than the one end, all but TAIL of all labelled texts reach the other.  Where the two
    don't lie apart, or nothing was learned, nothing can be told: 0.
    """
    alphabet = sorted({chr(g >> 2) for grams in profiles.values() for g in grams if g & 3 == 1})
    if not alphabet:
        return 0.0
    low = _low_end(labelled, profiles)
    draw, made = np.random.default_rng(8), []
    for n in np.exp(draw.uniform(np.log(20), np.log(2000), DRAWN)).astype(int):
        letter = draw.choice(alphabet, n)
        made.append("".join(x + " " * e for x, e in zip(letter, (draw.random(n) < 0.2).tolist(), strict=True)))
    data, begin = C.flat(pa.array(made))
    high = float(np.quantile(predictor(profiles)(data, begin)[1], 1 - TAIL))
    return (low + high) / 2 if low is not None and low > high else 0.0


def identify_language(docs: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE, longest: int = LONGEST) -> DataFrame:
    """lang_pred and score after the given columns (given columns of those names are replaced); a narrow map.

    A text's ``profile`` most frequent n-grams are compared with each language's by out-of-place
    distance: the difference of ranks, or ``profile`` where the language lacks the n-gram.  The nearest
    language wins (ties: the first by name); score is 1 less its distance as a share of the most
    possible.  Null, a text without letters, or no profiles at all: ``und``, score 0.  Equal rows give equal rows, null ids are
    carried; an empty table gives an empty result.
    """
    predict = predictor(profiles, profile, longest)
    given = [c for c in docs.columns if c not in ("lang_pred", "score")]
    frame = docs.select(given)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = C.flat(batch.column("text"))
            lang, score = [], [np.zeros(0)]
            for a, b in _row_rounds(begin):
                p, s = predict(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
                lang += p
                score.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.concatenate(score))], names=[*given, "lang_pred", "score"])

    return frame.mapInArrow(run, f"{fields}, {SCHEMA}")


def held_out(docs: DataFrame, of: int, at: int):
    """Whether crc32 of doc_id as text leaves ``at`` modulo ``of`` (null doc_id: as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of == at


def op8_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(docs.where(~held_out(docs, 5, 0)))
    return identify_language(docs.select("doc_id", "text"), profiles).select("doc_id", held_out(docs, 5, 0).alias("held_out"), "lang_pred", "score")
