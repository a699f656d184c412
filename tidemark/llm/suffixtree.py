"""Operator 1: language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.language import held_out

#: Words of the longest context; times that a string of two words or more must occur to count, at any size of the corpus.
DEPTH, TWICE = 3, 2
#: Nats by which a context's distribution must improve on that of its longest shorter state, over all its occurrences; discount of a count.
GAIN, DISCOUNT = 2.0, 0.75
#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
#: A context of more occurrences is a state untested (GAIN is nothing beside them), and its strings are dealt by themselves.
#: There can't be more than BUSIEST of them a length: the limit grows where the corpus would allow more.
BUSY, BUSIEST = 1_000_000, 200_000
#: Steps of a nat in which a block names a probability to the table that tests contexts.
STEPS = 256.0
#: Low bits that a context's key does without beside its part, and a string's beside its context (pairs, whose contexts have the most followers; longer ones).
CONTEXT_CUT, PAIR_CUT, LONG_CUT = np.uint64(16), np.uint64(24), np.uint64(32)
_END_KEY = np.uint64(0)
_NEXT = np.uint64(0xD6E8FEB86659FD93)
STATE = "block long, held array<boolean>, sizes array<int>, ids binary, keys binary"
TOLD = "level int, block long, part int, blob binary, context long, seen long, kinds long"


def tokens(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts, one after another (each text's words, then its end), and how many each text has."""
    keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in C.rounds(begin):
        part = C.LOWER[data[begin[a] : begin[b]]]
        start, end, row = C.words(part, begin[a : b + 1] - begin[a])
        key = np.full(len(start) + b - a, _END_KEY)
        key[np.arange(len(start)) + row] = C.hash_runs(part, start, end)
        keys.append(key)
        sizes.append(np.bincount(row, minlength=b - a) + 1)
    return np.concatenate(keys), np.concatenate(sizes)


def root(c: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """The empty context's distribution over V + 1 outcomes, from counts (0: the unknown token).

    Discounts free a mass of DISCOUNT * V / N: one half goes to the unknown token, the other evenly to the known ones.
    """
    if not total:
        return np.ones(len(c))
    free = DISCOUNT * kinds / total / 2
    return np.where(c > 0, (c - DISCOUNT) / total + free / kinds, free)


class Block:
    """The tokens of some texts, and what the corpus has told of their strings of growing length.

    A string is a context and a token; ``index`` numbers the block's distinct strings (of the length reached) that end at each
    token, after an end that stands before the first text.  ``known``: found TWICE or more in training texts.
    """

    def __init__(self, ids: np.ndarray, keys: np.ndarray, held: np.ndarray, sizes: np.ndarray):
        n = int(sizes.sum())
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.learn = ~held[self.row]
        end = int(np.flatnonzero(keys == _END_KEY)[0])
        self.index = np.concatenate([[end], ids.astype(np.int64)])
        self.ids, self.words, self.key = self.index[1:], keys, keys
        self.level = 1

    def ask_words(self, parts: int) -> Iterator[tuple[int, bytes]]:
        own = np.bincount(self.ids, self.learn, len(self.key)).astype(np.uint32)
        part, order = self._word_order(parts)
        for p, a, b in C.runs(part[order]):
            yield p, C.pack(np.diff(self.key[order[a:b]], prepend=np.uint64(0)), own[order[a:b]])

    def _word_order(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        part = (C.mix(self.key) % np.uint64(parts)).astype(np.int32)
        return part, np.lexsort((self.key, part))

    def words_told(self, blobs: list[bytes], parts: int, total: int, kinds: int) -> None:
        _, order = self._word_order(parts)
        c = np.empty(len(self.key), np.int64)
        c[order] = np.concatenate([C.unpack(x)[0] for x in blobs])
        self.count, self.known, self.c = c, (c >= TWICE)[self.index], c[self.ids]
        self.p = root(self.c, total, kinds)

    def _strings(self, parts: int, busy: int) -> None:
        """The distinct strings one token longer whose context and whose own suffix are known, and all known contexts (entries).

        Entries go by part and key, strings by entry; a busy context has an entry in each part that has strings of it.
        """
        self.after = np.flatnonzero(self.known[:-1] & (self.place >= self.level - 1))  # tokens with a known context
        context = self.index[:-1][self.after]
        self.both = np.flatnonzero(self.known[1:][self.after])
        at = self.after[self.both]
        code, first, self.back = C.distinct(context[self.both] * np.int64(len(self.words)) + self.ids[at])
        self.first = at[first]
        of = code // len(self.words)
        self.longer = C.mix(self.key[of] * _NEXT + self.words[code % len(self.words)])
        there = np.zeros(len(self.key), bool)
        there[context] = True
        calm = np.flatnonzero(there & (self.count <= busy))
        spread = np.flatnonzero(self.count[of] > busy)
        split, back = np.unique((self.longer[spread] % np.uint64(parts)).astype(np.int64) * len(self.key) + of[spread], return_inverse=True)
        self.entry_of = np.concatenate([calm, split % len(self.key)])
        self.entry_part = np.concatenate([(C.mix(self.key[calm] + np.uint64(1)) % np.uint64(parts)).astype(np.int64), split // len(self.key)]).astype(np.int32)
        order = np.lexsort((self.key[self.entry_of], self.entry_part))
        self.entry_of, self.entry_part = self.entry_of[order], self.entry_part[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        calm_place = np.zeros(len(self.key), np.int64)
        calm_place[calm] = place[: len(calm)]
        entry = calm_place[of]
        entry[spread] = place[len(calm) :][back]
        self.order = np.argsort(entry, kind="stable")
        self.per = np.bincount(entry, minlength=len(order))

    def ask(self, parts: int, busy: int) -> Iterator[tuple[int, bytes]]:
        """For each part: contexts (key, count, strings of each), strings (key, own count, what their suffix's state gives)."""
        self._strings(parts, busy)
        own = np.bincount(self.back, self.learn[self.after[self.both]], len(self.longer)).astype(np.uint32)[self.order]
        given = np.minimum(np.rint(-np.log(self.p[self.first]) * STEPS), 65535).astype(np.uint16)[self.order]
        key = (self.longer >> (PAIR_CUT if self.level == 1 else LONG_CUT))[self.order]
        context = self.key[self.entry_of] >> CONTEXT_CUT
        n, per = self.count[self.entry_of].astype(np.uint64), self.per.astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.per)])
        for p, a, b in C.runs(self.entry_part):
            x, y = ends[a], ends[b]
            yield p, C.pack(np.diff(context[a:b], prepend=np.uint64(0)), n[a:b], per[a:b], key[x:y], own[x:y], given[x:y])

    def told(self, blobs: list[bytes], parts: int, busy: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Takes the counts of the strings and the rest of each context's mass (NaN: no state); hot: keys, seen and kinds of the busy contexts."""
        self._strings(parts, busy)
        got = [C.unpack(x) for x in blobs]
        m, rest = np.zeros(len(self.longer), np.int64), np.full(len(self.key), np.nan)
        if got:
            m[self.order] = np.concatenate([x[0] for x in got])
            rest[self.entry_of] = np.concatenate([x[1] for x in got])
        keys, seen, kinds = hot
        name = np.flatnonzero(self.count > busy)
        if len(name) and len(keys):
            mine = self.key[name] >> CONTEXT_CUT
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            ok = keys[at] == mine
            rest[name[ok]] = 1 - (seen[at[ok]] - DISCOUNT * kinds[at[ok]]) / self.count[name[ok]]
        context = self.index[:-1][self.after]
        left = rest[context]
        share = np.zeros(len(self.after))
        share[self.both] = np.maximum(m[self.back] - DISCOUNT, 0) / self.count[context[self.both]]
        state = np.flatnonzero(~np.isnan(left))
        at = self.after[state]
        self.p[at] = self.p[at] * left[state] + share[state]
        index, known = np.zeros(len(self.index), np.int64), np.zeros(len(self.index), bool)
        at = self.after[self.both] + 1
        index[at], known[at] = self.back, (m >= TWICE)[self.back]
        self.index, self.known, self.key, self.count = index, known, self.longer, m
        self.level += 1


def block_states(docs: DataFrame, block_bytes: int) -> DataFrame:
    """STATE and doc_id of blocks of about ``block_bytes``, as texts lie in the input: no row is shuffled.

    ids: each token's number among the block's keys, the most frequent first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(number: int, parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
        table = pa.Table.from_batches([b for b, _, _ in parts]).combine_chunks()
        key, size = np.concatenate([np.zeros(1, np.uint64), *[k for _, k, _ in parts]]), np.concatenate([s for _, _, s in parts])
        keys, _, ids = C.distinct(key)  # the end is always there
        often = np.argsort(-np.bincount(ids), kind="stable")
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        keys, ids = keys[often], rank[ids]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        flat = lambda name: table[name].combine_chunks() if table[name].num_chunks else pa.array([], schema.field(name).type)
        plain = lambda x: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        fields = [pa.array([number]), one(plain(flat("doc_id"))), one(plain(flat("held"))), one(pa.array(size, pa.int32())), pa.array([C.pack(ids[1:].astype(np.uint32))]), pa.array([C.pack(keys)])]
        return pa.RecordBatch.from_arrays(fields, names=["block", "doc_ids", "held", "sizes", "ids", "keys"])

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            data, begin = C.flat(batch.column("text"))
            parts.append((batch.select(["doc_id", "held"]), *tokens(data, begin)))
            size += len(data)
            if size >= block_bytes:
                yield block(number, parts, batch.schema)
                number, parts, size = number + 1, [], 0
        if parts:
            yield block(number, parts, batch.schema)

    return docs.select("doc_id", "held", "text").mapInArrow(run, f"block long, doc_ids array<{kind}>, {STATE.split(', ', 1)[1]}")


def _answer(level: int, part: int, blocks: list[int], blobs: list[bytes]) -> pa.Table:
    n = len(blocks)
    return pa.table({"level": pa.array([level] * n, pa.int32()), "block": pa.array(blocks, pa.int64()), "part": pa.array([part] * n, pa.int32()), "blob": pa.array(blobs, pa.binary()),
                     "context": pa.nulls(n, pa.int64()), "seen": pa.nulls(n, pa.int64()), "kinds": pa.nulls(n, pa.int64())})


def _told(level: int, block: int, part: int, context: np.ndarray, seen: np.ndarray, kinds: np.ndarray) -> pa.Table:
    n = len(context)
    return pa.table({"level": pa.array([level] * n, pa.int32()), "block": pa.array([block] * n, pa.int64()), "part": pa.array([part] * n, pa.int32()), "blob": pa.nulls(n, pa.binary()),
                     "context": context.astype(np.uint64).view(np.int64), "seen": seen.astype(np.int64), "kinds": kinds.astype(np.int64)})


def settle_words(table: pa.Table) -> pa.Table:
    """Counts of a part's words, for each block that asked; in a row of block -1 the part's tokens and distinct words."""
    asked = [C.unpack(x) for x in table["blob"].to_pylist()]
    sizes = [len(k) for k, _ in asked]
    keys, _, back = C.distinct(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in asked]))
    c = np.bincount(back, np.concatenate([n for _, n in asked]), len(keys)).astype(np.int64)
    ends = np.cumsum(sizes)
    part = table["part"][0].as_py()
    blobs = [C.pack(c[back[b - n : b]].astype(np.uint64)) for n, b in zip(sizes, ends.tolist(), strict=True)]
    return pa.concat_tables([_answer(1, part, table["block"].to_pylist(), blobs), _told(1, -1, part, np.zeros(1), np.array([c.sum()]), np.array([(c > 0).sum()]))])


def settle_strings(table: pa.Table, level: int, gain: float, busy: int) -> pa.Table:
    """Counts of a part's strings and the test of its contexts, for each block that asked; rows of block -1: sums of busy contexts.

    A context is a state if over all its occurrences the distribution after it gains ``gain`` nats on its longest shorter state's.
    A string found TWICE or more has its discounted share; the rest goes by the shorter state's distribution.
    """
    asked = [C.unpack(x) for x in table["blob"].to_pylist()]
    part = table["part"][0].as_py()
    entry = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked])
    n_entry, per, key, own, given = (np.concatenate([x[k] for x in asked]) for k in range(1, 6))
    contexts, first, of_entry = C.distinct(entry)
    n = n_entry[first].astype(np.float64)
    of = np.repeat(of_entry, per)
    _, first, back = C.distinct(C.mix(contexts[of] + key * _NEXT))
    m = np.bincount(back, own, len(first))
    m[m < TWICE] = 0
    hit = np.flatnonzero(m)
    m_, of_ = m[hit], of[first[hit]]
    seen, kinds = np.bincount(of_, m_, len(contexts)), np.bincount(of_, minlength=len(contexts))
    rest = 1 - (seen - DISCOUNT * kinds) / n
    ratio = (m_ - DISCOUNT) / n[of_] * np.exp(given[first[hit]] / STEPS) + rest[of_]
    better = np.bincount(of_, m_ * np.log(ratio), len(contexts)) + (n - seen) * np.log(rest)
    rest = np.where((kinds > 0) & (better >= gain) & (n <= busy), rest, np.nan).astype(np.float32)
    m = m.astype(np.uint64)
    blobs, a, x = [], 0, 0
    for e, _, p, k, _, _ in asked:
        b, y = a + len(e), x + len(k)
        blobs.append(C.pack(m[back[x:y]], rest[of_entry[a:b]]))
        a, x = b, y
    hot = np.flatnonzero((n > busy) & (kinds > 0))
    return pa.concat_tables([_answer(level, part, table["block"].to_pylist(), blobs), _told(level, -1, part, contexts[hot], seen[hot], kinds[hot])])


def suffix_tree_scores(docs: DataFrame, learned_from, depth: int = DEPTH, gain: float = GAIN, block_bytes: int = BLOCK_BYTES, busy: int = BUSY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    ``learned_from``: a condition on rows; the model comes from those that meet it.  The model has the base's V + 1 outcomes.
    Contexts are the up to ``depth`` tokens before a token, in its text and the end before it; every string found TWICE or more
    counts, at any size.  A context is a state if its distribution gains ``gain`` nats on that of its longest shorter state; a token
    is scored by the longest state that ends before it, smoothed into the shorter ones and the root (see root, settle_strings).

    Texts become blocks of tokens where they lie.  Length by length a block asks for its distinct strings whose context and whose
    suffix were found TWICE, by parts of the contexts' keys; a part adds up the counts, tests its contexts, and answers each block
    in the order it was asked, so no key travels back.  Nothing is broadcast but the sums of busy contexts, BUSIEST at most a
    length.  Words are compared by 64-bit hashes, contexts by 48 bits beside
    their part, strings by their context's and 40 bits (pairs) or 32.
    Null text is empty (one token, the end); equal rows are scored alike; null doc_id is carried; nothing to learn from: one
    outcome, scores 0; an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (~learned_from).alias("held"), "text")
    state = C.written(block_states(rows, block_bytes), "blocks")
    parts = max(1, state.count() // 2)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rebuilt(row: pa.Table, told: pa.Table, facts: list) -> Block:
        """The block of a state's row, and all it has been told, level by level."""
        (ids,), (keys,) = C.unpack(row["ids"][0].as_py()), C.unpack(row["keys"][0].as_py())
        block = Block(ids, keys, np.array(row["held"][0].as_py(), bool), np.array(row["sizes"][0].as_py(), np.int64))
        told = told.sort_by([("level", "ascending"), ("part", "ascending")])
        level, blobs = told["level"].to_numpy(), told["blob"].to_pylist()
        for k, fact in enumerate(facts, 1):
            mine = blobs[np.searchsorted(level, k) : np.searchsorted(level, k, "right")]
            if k == 1:
                block.words_told(mine, parts, *fact)
            else:
                block.told(mine, parts, fact[0], fact[1:])
        return block

    def asking(number: int, asked) -> pa.Table:
        asked = list(asked)
        return pa.table({"part": pa.array([p for p, _ in asked], pa.int32()), "block": pa.array([number] * len(asked), pa.int64()), "blob": pa.array([b for _, b in asked], pa.binary())})

    @C.lean
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (pa.Table.from_batches([batch.slice(k, 1)]) for k in range(batch.num_rows)):
                yield from asking(row["block"][0].as_py(), rebuilt(row, pa.table({"level": [], "part": [], "blob": []}), []).ask_words(parts)).to_batches()

    asked = state.select("block", "held", "sizes", "ids", "keys").mapInArrow(words, "part int, block long, blob binary")
    tells = [C.written(asked.groupBy("part").applyInArrow(settle_words, TOLD), "told")]
    total, kinds = tells[0].where("block = -1").agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    facts: list = [(total, kinds)]
    limit = max(busy, total // BUSIEST)

    def answers() -> DataFrame:
        out = tells[0]
        for x in tells[1:]:
            out = out.unionAll(x)
        return out.where("block >= 0").select("level", "block", "part", "blob")

    def longer(known: list):
        return lambda row, told: asking(row["block"][0].as_py(), rebuilt(row, told, known).ask(parts, limit))

    def settled(level: int):
        return lambda table: settle_strings(table, level, gain, limit)

    for level in range(2, depth + 2):
        asked = state.drop("doc_ids").groupBy("block").cogroup(answers().groupBy("block")).applyInArrow(longer(list(facts)), "part int, block long, blob binary")
        tells.append(C.written(asked.groupBy("part").applyInArrow(settled(level), TOLD), "told"))
        sums = tells[-1].where("block = -1").groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("kinds").alias("kinds")).toArrow()  # BUSIEST rows at most
        key = sums["context"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        facts.append((limit, key[order], sums["seen"].to_numpy()[order], sums["kinds"].to_numpy()[order]))
        del asked
        C.collect_garbage(spark)  # shuffle files of tables that are written by now can go

    final = list(facts)

    def score(row: pa.Table, told: pa.Table) -> pa.Table:
        block = rebuilt(row, told, final)
        n = row["sizes"][0].as_py()
        add = lambda x: np.bincount(block.row, x, len(n))
        base = add(np.log10((block.c + 1) / (total + kinds + 1)))
        columns = {"doc_id": row["doc_ids"].combine_chunks().flatten(), "held_out": row["held"].combine_chunks().flatten(), "n_tokens": pa.array(n, pa.int64()), "n_known": add(block.c > 0).astype(np.int64)}
        return pa.table({**columns, "train_tokens": np.full(len(n), total, np.int64), "base_score": base, "score": add(np.log10(block.p))})

    return state.groupBy("block").cogroup(answers().groupBy("block")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_tree_scores(docs, ~held_out(docs, 7, 2))
