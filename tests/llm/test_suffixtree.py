"""Operator 1 against the same model in plain Python."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common as C, suffixtree
from tidemark.llm.language import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts():
    r = random.Random(11)
    words = ["".join(r.choice("abcdeéÀ") for _ in range(r.randrange(1, 5))) for _ in range(60)]
    follows = {w: r.sample(words, 4) for w in words}
    out = []
    for _ in range(120):
        w, t = r.choice(words), []
        for _ in range(r.randrange(1, 60)):
            t.append(w)
            w = r.choice(follows[w]) if r.random() < 0.8 else r.choice(words)
        out.append(" ".join(t))
    return [*out, None, "", "  \n", "only", "ONLY once", out[3], out[3].upper(), out[5] + " never seen before"]


class Tree:
    """The model by its definition."""

    def __init__(self, training, depth, gain, busy):
        self.c = collections.Counter(w for x in training for w in x)
        self.total, self.kinds = sum(self.c.values()), len(self.c)
        strings = collections.Counter()
        for x in training:
            seq = ["\n", *x]
            strings.update(tuple(seq[j - k + 1 : j + 1]) for j in range(1, len(seq)) for k in range(2, depth + 2) if j - k + 1 >= 0)
        self.m = {g: n for g, n in strings.items() if n > 1}
        self.rest, self.depth = {}, depth
        for k in range(2, depth + 2):
            after = collections.defaultdict(dict)
            for g, n in self.m.items():
                if len(g) == k:
                    after[g[:-1]][g[-1]] = n
            for context, found in after.items():
                n = self.n(context)
                seen = sum(found.values())
                rest = 1 - (seen - 0.75 * len(found)) / n
                given = {w: round(-math.log(self.p(context[1:], w)) * 256) for w in found}
                better = sum(m * math.log((m - 0.75) / n * math.exp(given[w] / 256) + rest) for w, m in found.items()) + (n - seen) * math.log(rest)
                if better >= gain or n > busy:
                    self.rest[context] = rest

    def n(self, context):
        return self.c[context[0]] if len(context) == 1 else self.m.get(context, 0)

    def p(self, context, w):
        if not context:
            free = 0.75 * self.kinds / self.total / 2
            return (self.c[w] - 0.75) / self.total + free / self.kinds if w in self.c else free
        short = self.p(context[1:], w)
        if context not in self.rest:
            return short
        return max(self.m.get((*context, w), 0) - 0.75, 0) / self.n(context) + self.rest[context] * short

    def score(self, x):
        seq = ["\n", *x]
        return sum(math.log10(self.p(tuple(seq[max(0, j - self.depth) : j]), seq[j])) for j in range(1, len(seq)))


def tokens_of(t):
    return [*WORD.findall((t or "").translate(LOW)), "\n"]


@pytest.mark.parametrize(("depth", "gain", "busy", "block"), [(3, 2.0, 10**6, 1000), (1, 2.0, 10**6, 1 << 20), (3, 0.5, 12, 700)])
def test_scores(spark, depth, gain, busy, block):
    ts = texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ts)], "doc_id long, text string, block int, held string").repartition(3)
    got = {r.doc_id: r for r in suffixtree.suffix_tree_scores(df, ~held_out(df, 7, 2), depth, gain, block, busy).collect()}
    out = {i for i in range(len(ts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    tree = Tree([tokens_of(t) for i, t in enumerate(ts) if i not in out], depth, gain, busy)
    assert len(tree.rest) > 30 and {len(x) for x in tree.rest} == set(range(1, depth + 1))
    for i, t in enumerate(ts):
        x, g = tokens_of(t), got[i]
        base = sum(math.log10((tree.c[w] + 1) / (tree.total + tree.kinds + 1)) for w in x)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (i in out, len(x), sum(w in tree.c for w in x), tree.total)
        assert g.base_score == pytest.approx(base) and g.score == pytest.approx(tree.score(x), rel=1e-4), i
    vocabulary = [*tree.c, "unheard"]
    for context in [(), *random.Random(1).sample(sorted(tree.rest), 20)]:
        assert sum(tree.p(context, w) for w in vocabulary) == pytest.approx(1)


def test_odd_tables(spark):
    kind = "doc_id string, text string"
    none = spark.createDataFrame([], kind)
    assert suffixtree.suffix_tree_scores(none, F.lit(True)).count() == 0
    df = spark.createDataFrame([(None, "a b"), ("x", None), ("x", None)], kind)
    got = suffixtree.suffix_tree_scores(df, F.lit(False)).collect()  # nothing to learn from
    assert len(got) == 3 and all((r.held_out, r.train_tokens, r.n_known, r.score, r.base_score) == (True, 0, 0, 0, 0) for r in got)
    got = suffixtree.suffix_tree_scores(df, F.lit(True)).collect()
    assert sorted((r.doc_id or "", r.n_tokens, r.n_known) for r in got) == [("", 3, 3), ("x", 1, 1), ("x", 1, 1)]
    long = spark.createDataFrame([(1, "w" * 3_000_000), (2, "a b c " * 100_000), (2, "a b c")], "doc_id long, text string")
    got = suffixtree.suffix_tree_scores(long, F.lit(True), block_bytes=1 << 16).collect()
    assert sorted(r.n_tokens for r in got) == [2, 4, 300_001]


def test_rare_strings_count_at_any_size(spark):
    """A pair counts from two occurrences on, however large the corpus."""
    data = [(k, "aa bb " * 500_000) for k in range(2)] + [(k, "zig zag zog") for k in range(4, 8)] + [(8, "zig zag zog"), (9, "zog zag zig")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in suffixtree.suffix_tree_scores(df, F.col("doc_id") < 8).collect()}
    assert got[8].score > -2 and got[9].score < -8


def test_pack():
    r = np.random.default_rng(3)
    arrays = [r.integers(0, 2**63, 1000).astype(np.uint64), r.integers(0, 5, 7).astype(np.uint16), np.array([1.5, np.nan], np.float32), np.zeros(0, np.uint32)]
    for x, y in zip(arrays, C.unpack(C.pack(*arrays)), strict=True):
        assert x.dtype == y.dtype and np.array_equal(x, y, equal_nan=x.dtype.kind == "f")
