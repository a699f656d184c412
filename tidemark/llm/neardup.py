"""Operator 10: near duplicates by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.components import components, joined

#: Minima of a signature; minima of a band (32 bands: at a likeness of 0.8, 3 pairs in a million share none; at 0.85, 7 in a thousand million).
MINIMA, BAND = 160, 5
#: Bits kept of a minimum; standard errors by which an estimate may fall short before a pair is passed over; members of a block.
BITS, SLACK, MEMBERS = 4, 5.0, 1024
#: Parts of a bucket, by a hash of its members, when it meets what was counted of it (bits of a long).
SALTS = 32
_rng = np.random.default_rng(7)
_ODD = _rng.integers(1, 2**63, MINIMA, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, MINIMA, dtype=np.int64).astype(np.uint64)
_ONES = np.uint64(0x1111111111111111)
_WORDS = MINIMA * BITS // 64


def shingles(data: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every distinct shingle of n words, rows ascending; a text of fewer words is one shingle."""
    data = C.LOWER[data]
    start, end, row = C.words(data, begin)
    word = C.hash_runs(data, start, end)
    rows = len(begin) - 1
    count = np.bincount(row, minlength=rows)
    at_, hash_ = [], []
    gram = word
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    for k in range(1, n + 1):
        if k > 1:
            gram = C.next_gram(gram, word, k) if len(word) >= k else gram[:0]
        if k < n:
            short = np.flatnonzero(count == k)
            at_.append(short)
            hash_.append(C.mix(gram[first[short]] + np.uint64(k)))
        else:
            inside = np.flatnonzero(row[: len(gram)] == row[k - 1 :]) if len(gram) else np.zeros(0, int)
            at_.append(row[inside])
            hash_.append(C.mix(gram[inside] + np.uint64(k)))
    at, h = np.concatenate(at_), np.concatenate(hash_)
    if len(at_) > 1:
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
    keep = np.zeros(len(at), bool)
    keep[C.distinct(h ^ C.mix(at.astype(np.uint64) + np.uint64(1)))[1]] = True
    return at[keep], h[keep]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a and set_b (the set's own 128-bit digest), packed signature, band keys; a narrow map."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, set_a long, set_b long, sig array<long>, keys array<long>"
    bands = MINIMA // BAND

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = C.flat(batch.column("text"))
            for a, b in C.rounds(begin, 1 << 18):
                row, h = shingles(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a], n)
                rows = b - a
                count = np.bincount(row, minlength=rows)
                full = np.flatnonzero(count)
                first = (np.cumsum(count) - count)[full]
                low = np.zeros((MINIMA, rows), np.uint64)
                sums = np.zeros((2, rows), np.uint64)
                if len(full):
                    for k in range(MINIMA):
                        low[k, full] = np.minimum.reduceat((h ^ _FLIP[k]) * _ODD[k], first)
                    sums[0, full] = np.add.reduceat(h, first)
                    sums[1, full] = np.bitwise_xor.reduceat(C.mix(h), first)
                low = C.mix(low)
                keys = np.zeros((bands, rows), np.uint64)
                for k in range(bands):
                    keys[k] = np.uint64(k + 1)
                    for part in low[k * BAND : (k + 1) * BAND]:
                        keys[k] = C.mix(keys[k] * np.uint64(31) + part)
                nibble = (low & np.uint64(15)).reshape(_WORDS, 16, rows)
                packed = np.zeros((_WORDS, rows), np.uint64)
                for k in range(16):
                    packed |= nibble[:, k] << np.uint64(4 * k)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(x), dtype=np.int32)), pa.array(np.ascontiguousarray(x.T).view(np.int64).ravel()))
                named = [batch.column(c).slice(a, rows) for c in ("doc_id", "text_hash")]
                found = [pa.array(count), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists(packed), lists(keys)]
                yield pa.RecordBatch.from_arrays([*named, *found], names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sig", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def corrected(same):
    """Likeness from the number of equal b-bit minima: those that agree by chance are taken off."""
    chance = 1 / (1 << BITS)
    return (same / MINIMA - chance) / (1 - chance)


def estimate(x: Column, y: Column) -> Column:
    """The likeness of two packed signatures, by bit counts."""
    def unlike(p: Column, q: Column) -> Column:
        d = p.bitwiseXOR(q)
        for k in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    same = MINIMA - F.aggregate(F.zip_with(x, y, unlike), F.lit(0), lambda s, c: s + c)
    return corrected(same.cast("double"))


def least_estimate(percent: int) -> float:
    """An estimate under this is SLACK standard errors short of the likeness asked for."""
    chance = 1 / (1 << BITS)
    p = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - SLACK * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def _linked(left: pa.Array, right: pa.Array, n: int, percent: int) -> np.ndarray:
    """Exact test of pairs of texts on their whole sets of shingles."""
    rows, out, a = len(left), [np.zeros(0, bool)], 0
    (xd, xb), (yd, yb) = C.flat(left), C.flat(right)
    both = xb + yb
    for a, b in C.rounds(both):
        xr, xh = shingles(xd[xb[a] : xb[b]], xb[a : b + 1] - xb[a], n)
        yr, yh = shingles(yd[yb[a] : yb[b]], yb[a : b + 1] - yb[a], n)
        row = np.concatenate([xr, yr])
        key = np.concatenate([xh, yh])
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        again = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
        inter = np.bincount(row[1:][again], minlength=b - a)
        union = np.bincount(row, minlength=b - a) - inter
        out.append((100 * inter >= percent * union) & (union > 0))
    return np.concatenate(out)[:rows]


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike enough; texts: (id, text)."""
    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array(_linked(batch.column("a"), batch.column("b"), n, percent))
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], names=["u", "v"])

    left = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    return left.join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A table for each run of equal ``task`` in a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task").to_numpy()
        cut = np.flatnonzero(task[1:] != task[:-1]) + 1
        bounds = [0, *cut.tolist(), len(task)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if held and a == 0 and held[-1].column("task")[0].as_py() != task[0]:
                yield pa.Table.from_batches(held)
                held = []
            elif a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components that may be alike enough and that meet in no earlier band, the likest first."""
    m = table.num_rows
    matrix = lambda name: np.stack([np.asarray(x) for x in table[name].combine_chunks().flatten().to_numpy().reshape(m, -1)]).view(np.uint64) if m else np.zeros((0, 1), np.uint64)
    sig, keys = matrix("sig"), matrix("keys")
    comp, side, band = table["comp"].to_numpy(), table["side"].to_numpy(), int(table["band"][0].as_py())
    i_, j_, e_ = [], [], []
    for i in range(m - 1):
        d = sig[i + 1 :] ^ sig[i]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        likeness = corrected(MINIMA - np.bitwise_count(d & _ONES).sum(1))
        # two blocks: only across them (side 0: a block by itself)
        at = np.flatnonzero((likeness >= least) & (comp[i + 1 :] != comp[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 0)))
        if len(at):
            earlier = (keys[i + 1 + at, :band] == keys[i, :band]).any(1)
            at, likeness = at[~earlier], likeness[at[~earlier]]
            i_.append(np.full(len(at), i))
            j_.append(i + 1 + at)
            e_.append(likeness)
    if not i_:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    i, j, e = map(np.concatenate, (i_, j_, e_))
    order = np.argsort(-e, kind="stable")
    return i[order], j[order], e[order]


def _active(least: float):
    """Members of a block with some pair to test."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_blocks(batches):
            if pa.compute.count_distinct(table["comp"]).as_py() < 2:
                continue
            i, j, _ = _pairs(table, least)
            if len(i):
                yield from table.take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()

    return run


def _resolve(least: float, n: int, percent: int):
    """Exact links of a block that join components, at most one fewer than its members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_blocks(batches):
            ids, comp = table["id"].to_numpy(), table["comp"].to_numpy()
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            data, begin = C.flat(table["text"])
            row, h = shingles(data, begin, n)
            bounds = np.searchsorted(row, np.arange(table.num_rows + 1))
            sets = [np.sort(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            u, v = [], []
            for i, j, _ in zip(*_pairs(table, least), strict=True):
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a == b:
                    continue
                inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                    root[max(a, b)] = min(a, b)
                    u.append(ids[i])
                    v.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def per_salt(counted: DataFrame) -> DataFrame:
    """A row for each part of a bucket that has members; ``salts`` has a bit for each."""
    return counted.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> shiftright(salts, s) & 1 = 1)"))).drop("salts")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, members: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents whose sets of n-word shingles are ``percent`` alike.

    Two more columns name rows: text_hash, and ``stays``, true for one (doc_id, text) of each component.

    1. A map gives every document its b-bit MinHash signature and band keys; equal sets become one class, named by the
       hash of a text, so doc_ids may be of any type, repeated or null.
    2. In a bucket (equal band key) every class is paired with one centre that a hash picks anew for
       each band, so pairs grow with the members, not their square.  Each class's likest centre by the
       collision-corrected estimate is confirmed on whole sets; links give first components.
    3. Centres not yet confirmed that estimates allow and that would join two components are confirmed too.
    4. In buckets that still hold several components, blocks of ``members`` classes test every remaining pair by signature:
       the classes outside the bucket's largest component meet each other and that component, whose own classes never
       meet.  Where a pair may be alike enough, texts follow, and exact links that join components come out, fewer than the block has members.
    So no pair that shares a bucket is passed over unless its estimate is SLACK standard errors short.

    Null text or no words: empty set, linked with nothing, its own component.  Null doc_id: takes the
    component of its set's class (null where no member has an id), not kept.  Rows with equal doc_id and different texts are rows of
    their own.  Empty table: empty result.
    """
    spark = docs.sparkSession
    least = least_estimate(percent)
    signed = C.written(signatures(docs, n), "signatures")
    # classes of equal sets; the least row of a class is its first by doc_id (null last) and text
    row = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")
    classes = signed.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min(row).alias("row"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = C.written(classes.withColumn("id", F.col("row.text_hash")), "classes")
    # buckets of two classes or more, each with a centre
    salts = F.expr("bit_or(shiftleft(1L, salt))").alias("salts")
    entries = classes.select("id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), F.posexplode("keys").alias("band", "key"))
    heads = entries.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id"))["id"].alias("centre"), salts).where("m > 1")
    crowded = C.written(entries.join(per_salt(heads), ["key", "salt"]), "buckets")
    stars = crowded.where("id <> centre").select("id", "centre").distinct()
    sigs = classes.select("id", "sig")
    stars = stars.join(sigs, "id").join(sigs.select(F.col("id").alias("centre"), F.col("sig").alias("centre_sig")), "centre")
    stars = C.written(stars.select("id", "centre", estimate(F.col("sig"), F.col("centre_sig")).alias("near")).where(F.col("near") >= least), "stars")
    # texts of the classes in question, once: that of a class's first row
    ask = crowded.select("id").distinct().join(classes.select("id", F.col("row.doc_id").alias("_doc")), "id")
    mine = docs.select("doc_id", "text", F.xxhash64("text").alias("id"))
    texts = mine.join(ask, (mine["id"] == ask["id"]) & mine["doc_id"].eqNullSafe(ask["_doc"])).groupBy(mine["id"].alias("id")).agg(F.min("text").alias("text"))
    texts = C.written(texts, "texts")
    best = stars.groupBy("id").agg(F.max(F.struct("near", F.xxhash64("centre").alias("h"), "centre")).alias("b")).select(F.col("id").alias("u"), F.col("b.centre").alias("v"))
    links = C.written(confirmed(best, texts, n, percent), "links")
    label = C.written(components(links), "labels")
    # centres not confirmed yet, between components
    def labelled(rows: DataFrame, by: str, name: str) -> DataFrame:
        return rows.join(label.select(F.col("id").alias(by), F.col("component").alias("_c")), by, "left").withColumn(name, F.coalesce("_c", by)).drop("_c")

    def relabelled(more: DataFrame) -> DataFrame:
        if more.isEmpty():
            return label
        new = C.written(joined(label, more), "labels")
        C.forget(spark, label)
        return new

    rest = stars.select(F.col("id").alias("u"), F.col("centre").alias("v")).join(best, ["u", "v"], "left_anti")
    rest = labelled(labelled(rest, "u", "cu"), "v", "cv").where("cu <> cv").select("u", "v")
    more = C.written(confirmed(rest, texts, n, percent), "links")
    label = relabelled(more)
    # buckets of three or more that still hold several components
    large = labelled(crowded.where("m > 2"), "id", "comp")
    sizes = large.groupBy("key", "comp").agg(F.count("*").alias("size"), salts)
    open_ = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("size").alias("all"), F.expr("bit_or(salts)").alias("salts")).where("comps > 1")
    open_ = open_.select("key", F.col("top.comp").alias("top"), "all", F.col("top.size").alias("top_size"), "salts")
    large = large.join(per_salt(open_), ["key", "salt"]).join(classes.select("id", "sig", "keys"), "id")
    # blocks 0, 1, ...: of the classes outside the largest component; then of that component
    outside, inside = (F.greatest(F.ceil(x / members), F.lit(1)).cast("int") for x in (F.col("all") - F.col("top_size"), F.col("top_size")))
    whole, in_top = F.col("all") <= members, F.col("comp") == F.col("top")
    own = F.when(whole, 0).when(in_top, outside + F.pmod(F.xxhash64("id"), inside)).otherwise(F.pmod(F.xxhash64("id"), outside)).cast("int")
    other = F.when(whole, F.array(F.lit(0))).when(in_top, F.sequence(F.lit(0), outside - 1)).otherwise(F.sequence(F.lit(0), outside + inside - 1))
    tasks = large.withColumn("own", own).withColumn("other", F.explode(other))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tasks = tasks.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), side.alias("side"), "band", "id", "comp", "sig", "keys")
    kind = "task long, side int, band int, id long, comp long, sig array<long>, keys array<long>"
    active = C.written(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_active(least), kind), "active")
    last = active.join(texts, "id").repartition("task").sortWithinPartitions("task").select("task", "side", "band", "id", "comp", "sig", "keys", "text").mapInArrow(_resolve(least, n, percent), "u long, v long")
    last = C.written(last, "links")
    label = relabelled(last)
    # the first row of each component
    label = labelled(classes.select("id", "set_a", "set_b", "n_shingles", "row"), "id", "component")
    first = label.groupBy("component").agg(F.min("row").alias("first"))
    found = C.written(label.join(first, "component").select("set_a", "set_b", "n_shingles", "first"), "components")
    C.forget(spark, classes, crowded, stars, texts, links, more, active, last)
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(found, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    stays = (F.col("n_shingles") == 0) | F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_hash", stays.alias("stays"))


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")
