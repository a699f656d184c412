"""Exact ids of a word-level BPE file, with one library call per distinct piece of text."""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers

from tidemark.llm import common as C

WORD_BPE = "word_bpe_49k.json"
#: Bytes of distinct pieces that a worker remembers before it begins anew.
REMEMBERED = 24 << 20
# Byte classes of the fast path: 0 white space, 1 letter, 2 digit, 3 the rest.
_KIND = np.full(256, 3, np.uint8)
_KIND[C.SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[48:58] = 2
_FOLD = C.LOWER.copy()
_FOLD[0x80:0x9F] += 32  # after 0xC3: the capitals of Latin-1
_FOREIGN = np.zeros(256, bool)
_FOREIGN[[0x97, 0xB7, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True


class Memory:
    """Ids of pieces by a 64-bit hash of their bytes: flat arrays of ``limit`` bytes at most, emptied when they are full."""

    def __init__(self, learn: Callable[[bytes], list[int]], limit: int = REMEMBERED):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.key, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # keys ascending; the number of each piece
        self.begin, self.ids = array("q", [0]), array("I")

    def nbytes(self) -> int:
        return 12 * len(self.key) + 8 * len(self.begin) + 4 * len(self.ids)

    def _learned(self, key: np.ndarray, runs: list[bytes]) -> None:
        """Adds pieces under new keys, which ascend."""
        number = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(key), dtype=np.int32)
        for run in runs:
            self.ids.extend(self.learn(run))
            self.begin.append(len(self.ids))
        at = np.searchsorted(self.key, key)
        self.key, self.place = np.insert(self.key, at, key), np.insert(self.place, at, number)

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs data[start:end], one after another, and how many each run has."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.nbytes() > self.limit:
            self.clear()
        key, first, back = C.distinct(C.hash_runs(data, start, end))
        at = np.searchsorted(self.key, key)
        new = np.flatnonzero((at == len(self.key)) | (self.key[np.minimum(at, len(self.key) - 1)] != key)) if len(self.key) else np.arange(len(key))
        if len(new):
            self._learned(key[new], [data[a:b].tobytes() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        number = self.place[np.searchsorted(self.key, key)][back]
        begin, ids = np.frombuffer(self.begin, np.int64), np.frombuffer(self.ids, np.uint32)
        head = begin[number]
        size = begin[number + 1] - head
        end_ = np.cumsum(size)
        return (ids[np.arange(end_[-1]) + np.repeat(head - end_ + size, size)] if end_[-1] else np.zeros(0, np.uint32)), size


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes whole texts; each distinct piece goes through the library once.

    A text of ASCII and Latin-1 letters is lower-cased and split as the file's normaliser and
    pre-tokeniser do (canonical composition changes nothing there), and the library's model tokenises
    each piece.  Any other text is cut at white space, which the file drops and which composes with
    nothing, and the whole library encodes each chunk.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model, letters = self.library.model, _byte_letters()
        self.pieces = Memory(lambda piece: [t.id for t in model.tokenize(piece.decode("latin-1").translate(letters))])
        self.foreign = Memory(lambda chunk: self.library.encode(chunk.decode(), add_special_tokens=False).ids, REMEMBERED // 4)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text (null: none)."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_round(data, np.array([0, len(data)]))[0]

    def _by_chunk(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text, by the whole library."""
        start, end, _ = C.words(data, np.array([0, len(data)]))
        return self.foreign.lookup(data, start, end)[0]

    def encode_round(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin."""
        rows = len(begin) - 1
        odd = _FOREIGN[data]
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # "<|" may name a special token
        slow = np.flatnonzero(C.per_row(odd, begin))
        if len(slow):
            data_ = data.copy()
            for i in slow:
                data_[begin[i] : begin[i + 1]] = 32
        else:
            data_ = data
        low = _FOLD[data_]
        kind = _KIND[low]
        start, end = self._bounds(low, kind, begin)
        ids, size = self.pieces.lookup(low, start, end)
        per = np.bincount(np.searchsorted(begin, start, "right") - 1, size, rows).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per)])
        if len(slow):
            parts = np.split(ids, bounds[1:-1])
            for i in slow:
                parts[i] = self._by_chunk(data[begin[i] : begin[i + 1]])
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds

    @staticmethod
    def _bounds(low: np.ndarray, kind: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, single digits, contractions and runs of the rest."""
        n = len(low)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh = np.ones(n, bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        fresh[begin[begin < n]] = True
        mark = np.flatnonzero(fresh & (low == 39))  # an apostrophe that begins a run
        if len(mark):
            after = np.concatenate([low, np.zeros(2, np.uint8)])
            stop = begin[np.searchsorted(begin, mark, "right")]
            one, two = after[mark + 1], after[mark + 2]
            short = np.isin(one, list(b"stmd")) & (mark + 1 < stop)
            long = (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))) & (mark + 2 < stop)
            fresh[mark[short | long] + 1] = False
            cut = np.concatenate([mark[short] + 2, mark[long] + 3])
            fresh[cut[cut < n]] = True
        at = np.flatnonzero(fresh)
        end = np.append(at[1:], n)
        real = kind[at] != 0
        return at[real], end[real]

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """As encode_round, for an Arrow column of any size (null: no ids)."""
        data, begin = C.flat(column)
        ids, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in C.rounds(begin):
            found, bounds = self.encode_round(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
            ids.append(found)
            size.append(np.diff(bounds))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(size))])


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by ``end_id``."""
    bounds = begin + np.arange(len(begin))
    out = np.full(bounds[-1], end_id, "<u4")
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    out[inside] = ids
    return out, bounds


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path)


def path_of(name: str = WORD_BPE) -> str:
    return public_tokenizers.path(name)
