"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemark.llm.kernels import U, hasher, pieces, text_bytes, words

#: Words remembered by a worker, about 60 bytes each; then those stay that have come again. Most words of a large
#: corpus are rare, so more memory finds few more of them.
REMEMBERED = 300_000
#: Words that the pre-tokenizer leaves whole.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII letters, and ASCII marks between which and letters the pre-tokenizer always cuts: not the apostrophe of
#: contractions, nor the marks of special tokens.
LETTERS, MARKS = (bytes(range(65, 91)) + bytes(range(97, 123))), b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(LETTERS)], out[list(MARKS)] = 1, 2
    return out


KINDS = _kinds()


def units(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of letters and marks only are cut between these, so that a word is the same with a comma or without."""
    kind = KINDS[data]
    other = np.append(0, np.cumsum(kind == 0, dtype=np.int32))
    inside = np.zeros(len(data) + 1, np.int8)
    some = other[end] == other[start]
    inside[start[some]] += 1  # no word begins where another one does
    inside[end[some]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) & inside[1:] & inside[:-1]
    cut[start] = False
    cut[end] = False
    first, last = cut.copy(), cut
    first[start], last[end] = True, True
    return np.flatnonzero(first), np.flatnonzero(last)


class Remembered:
    """Ids of texts that fall into units, each of which has its ids whatever stands beside it. Units are known by a
    64-bit hash; unseen ones are encoded together. A subclass says how texts are split and what ids units have."""

    def __init__(self):
        self.forget()

    def split(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """start and end of every unit, in order."""
        raise NotImplementedError

    def ids_of(self, own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of units, their ids in that order, and how many each has."""
        raise NotImplementedError

    def forget(self) -> None:
        self.known, self.at = np.zeros(0, U), np.zeros(0, np.int64)  # sorted hashes, and their place in first
        self.first, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def shrink(self) -> None:
        """Forgets what has not come again."""
        keep = self.again[self.at]
        if keep.sum() > REMEMBERED // 2:
            return self.forget()
        slots = self.at[keep]
        n = self.count[slots]
        ends = np.cumsum(n)
        self.pool = self.pool[np.repeat(self.first[slots] - (ends - n), n) + np.arange(n.sum())]
        self.known, self.at, self.first, self.count, self.again = self.known[keep], np.arange(len(n)), ends - n, n, np.zeros(len(n), bool)

    def learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        """New units, sorted by hash."""
        if len(self.known) + len(hashes) > REMEMBERED:
            self.shrink()
        order, ids, count = self.ids_of([x.decode("utf-8", "replace") for x in texts])
        first = np.zeros(len(order), np.int64)
        first[order] = len(self.pool) + np.cumsum(count) - count
        place = np.searchsorted(self.known, hashes)
        self.at = np.insert(self.at, place, np.arange(len(self.first), len(self.first) + len(hashes)))
        self.known = np.insert(self.known, place, hashes)
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count[np.argsort(order)]])
        self.pool, self.again = np.concatenate([self.pool, ids]), np.append(self.again, np.zeros(len(texts), bool))

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        return i, (self.known[i] == hashes) if len(self.known) else np.zeros(len(hashes), bool)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        start, end = self.split(data, bounds)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        text = np.searchsorted(bounds, start, "right") - 1
        h = hasher(1)
        distinct, some, which = np.unique(h.of_ranges(data, start, end), return_index=True, return_inverse=True)
        place, there = self._place(distinct)
        self.again[self.at[place[there]]] = True
        for anew in (False, True):  # what was known may be forgotten meanwhile; then all are learnt together
            if not there.all():
                if anew:
                    self.forget()
                whole, new = data.tobytes(), np.arange(len(distinct)) if anew else np.flatnonzero(~there)
                self.learn(distinct[new], [whole[s:e] for s, e in zip(start[some[new]], end[some[new]], strict=True)])
                place, there = self._place(distinct)
        own = self.at[place][which]
        n = self.count[own]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.first[own] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.bincount(text, n, minlength=len(bounds) - 1).astype(np.int64)


class WordIds(Remembered):
    """For a tokenizer that never joins across white space: its normalizer makes white space single and its
    pre-tokenizer drops it, so the ids of a text are those of its words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        super().__init__()

    def split(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, _ = words(data, bounds)
        return units(data, start, end) if len(start) else (start, end)

    def ids_of(self, own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = np.array([PLAIN.fullmatch(x) is not None for x in own], bool)
        ids, counts, order = [], [np.zeros(0, np.int64)], [np.flatnonzero(plain), np.flatnonzero(~plain)]
        for some, of in zip(order, (self._plain, self._any), strict=True):
            for k in range(0, len(some), 4096):
                got, n = of([own[i] for i in some[k : k + 4096]])
                ids.append(got)
                counts.append(n)
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def _plain(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only: each has one id that ends a word, its last."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(own) and ends[-1] == len(ids) else self._any(own)

    def _any(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words; offsets tell whose ids are whose."""
        starts = np.cumsum([0, *(len(x) + 1 for x in own[:-1])])
        e = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
        whose = np.searchsorted(starts, np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
        return np.array(e.ids, np.uint32), np.bincount(whose, minlength=len(own))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encoded(column: pa.Array, path: str, end_id: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, row after the last, their ids in a row, and the bounds of
    rows in them. Each text is followed by end_id."""
    data, bounds = text_bytes(column)
    for i, j in pieces(bounds):
        ids, n = word_ids(path).encode(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        ends = np.cumsum(n)
        if end_id is not None:
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(n) + 1)
        yield i, j, ids, np.concatenate([[0], ends])
