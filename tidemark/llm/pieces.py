"""Operator 9: byte-fallback BPE by a prefix table of last tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common as C
from tidemark.llm.tokens import Memory

PIECE_BPE = "piece_bpe_32k.model"
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_SPACE = "▁"


class PieceEncoder:
    """Encodes and decodes as a sentencepiece BPE model with identity normalisation, a dummy prefix and byte fallback.

    For every prefix of a run the encoding ends in one token only: a piece that ends there, whose
    rest is a prefix with a last token of its own, and which no merge would join or take apart at the
    seam (the pair, merged alone, stays these two tokens).  An automaton finds the pieces that end at
    each place; the table keeps the last token of each prefix, and ids come out backwards.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        if m.normalize("\ufb01 \uff21\t  x ") != "\u2581\ufb01\u2581\uff21\t\u2581\u2581x\u2581":
            raise ValueError("the model normalises texts: they can't be encoded as they are")
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.piece = {i: m.id_to_piece(i) for i in plain}
        self.score = {self.piece[i]: m.get_score(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        if any(_SPACE in p.lstrip(_SPACE) for p in self.id):
            raise ValueError("a piece goes on after a space: runs can't be taken apart")
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.letters = {p for p in self.id if len(p) == 1}
        self.end = m.eos_id()
        self.fits: dict[tuple[int, int], bool] = {}
        # bytes that stand side by side in some piece; nothing merges over any other seam of ASCII
        self.joined = np.ones((256, 256), bool)
        self.joined[:128, :128] = False
        for p in self.id:
            b = p.replace(_SPACE, " ").encode()
            self.joined[list(b[:-1]), list(b[1:])] = True
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merged(p) == [p]:  # else no text becomes it
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.runs = Memory(self._run)

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost among equals: what a short text becomes."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            left, right = self.piece[a], self.piece[b]
            known = self.fits[key] = self.merged(left + right) == [left, right]
        return known

    def table(self, text: str) -> list[int]:
        """Ids of a text of known letters by the prefix table."""
        last: list[tuple[int, int] | None] = [None] * len(text)
        fits, known = self.compatible, self.fits.get
        for at, token in self.automaton.iter(text):
            if last[at] is None:
                before = at - token[1]
                if before < 0:
                    last[at] = token
                elif (p := last[before]) is not None:
                    fit = known((p[0], token[0]))
                    if fits(p[0], token[0]) if fit is None else fit:
                        last[at] = token
        out, at = [], len(text) - 1
        while at >= 0:
            i, n = last[at]
            out.append(i)
            at -= n
        return out[::-1]

    def _run(self, run: bytes) -> list[int]:
        text, out, a = run.decode().replace(" ", _SPACE), [], 0
        for k, c in enumerate(text):
            if c not in self.letters:
                if k > a:
                    out += self.table(text[a:k])
                out += [self.byte[b] for b in c.encode()]
                a = k + 1
        return out + (self.table(text[a:]) if a < len(text) else [])

    def encode_round(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each with the end id; where each begins."""
        rows = len(begin) - 1
        size = np.diff(begin)
        # the dummy prefix of every text that isn't empty
        bounds = begin + np.concatenate([[0], np.cumsum(size > 0)])
        wide = np.full(bounds[-1], 32, np.uint8)
        inside = np.ones(bounds[-1], bool)
        inside[bounds[:-1][size > 0]] = False
        wide[inside] = data
        if len(wide):
            fresh = np.ones(len(wide), bool)
            fresh[1:] = ~self.joined[wide[:-1], wide[1:]]
            fresh[bounds[bounds < len(wide)]] = True
            start = np.flatnonzero(fresh)
        else:
            start = np.zeros(0, np.int64)
        ids, n = self.runs.lookup(wide, start, np.append(start[1:], len(wide)))
        per = np.bincount(np.searchsorted(bounds, start, "right") - 1, n, rows).astype(np.int64) + 1
        out_bounds = np.concatenate([[0], np.cumsum(per)])
        out = np.full(out_bounds[-1], self.end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[out_bounds[1:] - 1] = False
        out[inside] = ids
        return out, out_bounds

    def encode(self, text: str | None) -> list[int]:
        data = np.frombuffer((text or "").replace(_SPACE, " ").encode(), np.uint8)
        return self.encode_round(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process."""
    return PieceEncoder(path)


def piece_round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encodes every text, decodes the ids, and gives digests of both; a narrow map.

    Null or empty text: the end id alone, decoded to the empty text.  doc_id is carried as it is, so equal rows give equal rows; among
    equal merges the leftmost goes first, as in the library; a text of any length is one round; an empty table gives an empty result.
    """
    model = model or public_tokenizers.path(PIECE_BPE)

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        names = [str(i) for i in range(coder.library.get_piece_size())]
        for batch in batches:
            data, begin = C.flat(batch.column("text"))
            for a, b in C.rounds(begin, 1 << 20):
                part, at = data[begin[a] : begin[b]], begin[a : b + 1] - begin[a]
                if b"\xe2\x96\x81" in part.tobytes():  # the mark itself, which stands for a space
                    texts = [part[x:y].tobytes().replace(b"\xe2\x96\x81", b" ") for x, y in zip(at[:-1], at[1:], strict=True)]
                    part, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
                ids, bounds = coder.encode_round(part, at)
                each = [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                shown = [hashlib.sha256(" ".join(map(names.__getitem__, x)).encode()).hexdigest() for x in each]
                texts = [hashlib.sha256(x.encode()).hexdigest() for x in coder.library.decode(each)] if each else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(shown, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op9_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
