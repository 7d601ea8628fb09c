"""Byte-level BPE with content-defined chunks.

Special tokens part a text before anything else. Each stretch between them is cut where a rolling hash of the last 16 bytes
has zeros in given places, so texts that share a passage share its chunks. Texts are dealt and sorted by the smallest hash of their chunks: those that agree in most
chunks, as copies and near copies do, mostly agree in the smallest and meet in one task, one after the other, where a chunk
that is remembered is not encoded again. Where very many agree Spark may split them over tasks. A cut may fall within
a word, so the joins are repaired: the pre-tokens of a chunk that its end can have touched are set
aside, and scanned again with the beginning of the next chunk until a pre-token begins where one
begins in that chunk's own scan. A scan depends only on what follows its position, so from
there on both agree exactly; where they don't within the beginning, the whole next chunk is scanned again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import hasher, pieces, text_bytes
from tidemark.llm.tables import small_batches

#: The pre-token pattern of this family of vocabularies (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WINDOW = 16
#: Entries and characters of a generation of a cache; two generations are held. Longer keys are not remembered.
WORDS, CHUNKS, HELD, LONG = 250_000, 20_000, 1 << 23, 1 << 12
#: A chunk has at most so many times the mean number of bytes.
MOST = 16
#: Pre-tokens at the beginning of a chunk at which a join may meet its scan, and the characters
#: from its start on which the choice of a pre-token can depend.
HEAD, REACH = 6, 3


class Generations(dict):
    """A dict that forgets what was not used while it filled up once, by entries or by characters of the keys."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old, self.held = make, size, {}, 0

    def __missing__(self, key):
        n = len(key) if isinstance(key, str) else sum(map(len, key))
        if n > LONG:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size or self.held > HELD:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += n
        return value


class Chunk:
    """Scan of a chunk: its first pre-tokens, the ids of the rest, and the tail its end can change."""

    __slots__ = ("head", "starts", "core", "tail", "text")

    def __init__(self, text: str, coder: Coder):
        parts = coder.scan(text)
        n, at = len(parts), len(text)
        while n and max(at + 1, at - len(parts[n - 1]) + REACH) > len(text):
            n -= 1
            at -= len(parts[n])
        self.text, self.tail = text, text[at:]
        self.starts = [0]
        for w in parts[: min(HEAD, n)]:
            self.starts.append(self.starts[-1] + len(w))
        self.head = [coder.words[w] for w in parts[: min(HEAD, n)]]
        self.core = ",".join([coder.words[w] for w in parts[HEAD:n]])


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special}
        self.bytes_of = self._bytes()
        self.merge = self._merger(path)
        self.words = Generations(self._word, WORDS)
        self.chunks = Generations(lambda t: Chunk(t, self), CHUNKS)
        self.joins = Generations(self._join, CHUNKS)

    def _bytes(self) -> dict[int, bytes]:
        """Bytes of every id. The vocabulary writes the printable bytes as themselves and the others as
        the characters from 256 on, in order."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        special = set(self.special.values())
        return {i: t.encode() if i in special else bytes(of[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}

    def _merger(self, path: str):
        """Ids of one pre-token: by merge ranks, which are the ids, where the vocabulary is of that
        kind, else by the tokenizer itself."""
        special = set(self.special.values())
        ranks = {b: i for i, b in self.bytes_of.items() if i not in special}
        try:
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            return own.encode_ordinary
        except (ImportError, ValueError):
            return lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids

    def scan(self, text: str) -> list[str]:
        """Pre-tokens, which leave nothing out; by the tokenizer's own tables where letters of newer scripts may occur."""
        if text.isascii() or max(text) < "ɐ":
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _word(self, w: str) -> str:
        return ",".join(map(str, self.merge(w)))

    def _join(self, key: tuple[str, str]) -> tuple[str, int] | None:
        """For a tail and the beginning of the next chunk: ids up to a place in that chunk where both
        scans begin a pre-token, and which of the chunk's pre-tokens that is."""
        tail, ahead = key
        chunk = self.chunks[ahead]
        limit = chunk.starts[-1]
        text = tail + ahead[: limit + REACH]
        meet = {s + len(tail): k for k, s in enumerate(chunk.starts)}
        out, a = [], 0
        for w in self.scan(text):
            if a in meet:
                return ",".join(out), meet[a]
            if max(a + len(w) + 1, a + REACH) > len(text):
                return None
            out.append(self.words[w])
            a += len(w)
        return None

    def ids(self, chunks: list[str]) -> list[str]:
        """Decimal ids of a text without special tokens, in parts to be joined by commas."""
        out: list[str] = []
        tail, i = "", 0
        while i < len(chunks):
            c = chunks[i]
            i += 1
            k, e = 0, self.chunks[c]
            if tail:
                met = self.joins[tail, c]
                if met is None:  # no agreement yet: scan on, into as much as the tail holds, so a long pre-token is scanned a few times only
                    j, n = i, len(c)
                    while j < len(chunks) and n < len(tail):
                        n, j = n + len(chunks[j]), j + 1
                    e, i = Chunk("".join([tail, c, *chunks[i:j]]), self), j
                else:
                    if met[0]:
                        out.append(met[0])
                    k = met[1]
            out += e.head[k:]
            if e.core:
                out.append(e.core)
            tail = e.tail
        return out + [self.words[w] for w in self.scan(tail)]

    def text_ids(self, chunks: list[str], special: set[int] = frozenset()) -> str:
        """Ids of a text from its chunks; special: which of these are special tokens."""
        out, part = [], []
        for i, c in enumerate(chunks):
            if i in special:
                out += [*self.ids(part), str(self.special[c])]
                part = []
            else:
                part.append(c)
        return ",".join(out + self.ids(part))

    def decode(self, ids: str) -> str:
        return b"".join(map(self.bytes_of.__getitem__, map(int, ids.split(",")))).decode("utf-8", "replace") if ids else ""


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def cuts(data: np.ndarray, bounds: np.ndarray, mean: int) -> list[np.ndarray]:
    """For each text the bounds of its chunks in data, at characters' beginnings. Where no cut comes for MOST
    times the mean, cuts follow at that distance from the last one."""
    at = np.concatenate([np.zeros(0, np.int64), *(k + np.flatnonzero((w & np.uint64(mean - 1)) == 0) + WINDOW for k, w in hasher(2).each_window(data, WINDOW))])
    at = at[(at < len(data))]
    at = at[(data[at] & 0xC0) != 0x80]
    out, most = [], MOST * mean
    lo, hi = np.searchsorted(at, bounds[:-1] + WINDOW), np.searchsorted(at, bounds[1:])
    for i in range(len(bounds) - 1):
        own = np.concatenate([bounds[i : i + 1], at[lo[i] : max(lo[i], hi[i])], bounds[i + 1 : i + 2]])
        far = np.flatnonzero(np.diff(own) > most)
        if len(far):
            more = np.concatenate([np.arange(own[k] + most, own[k + 1], most) for k in far])
            for _ in range(3):
                more = more - ((data[more] & 0xC0) == 0x80)
            own = np.union1d(own, more)
        out.append(own)
    return out


def stretches(data: np.ndarray, bounds: np.ndarray, special: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all texts and of the special tokens in them, and which of the stretches between them are special tokens. Of
    tokens that overlap the first counts, of those that begin together the longest."""
    raw, found = data.tobytes(), []
    for t in map(str.encode, special):
        at = raw.find(t)
        while at >= 0:
            found.append((at, -len(t)))
            at = raw.find(t, at + 1)
    kept, until = [], 0
    for at, n in sorted(found):
        inside = bounds[min(np.searchsorted(bounds, at, "right"), len(bounds) - 1)] >= at - n  # within one text
        if at >= until and inside:
            kept.append((at, at - n))
            until = at - n
    if not kept:
        return bounds, np.zeros(len(bounds) - 1, bool)
    first, last = np.array(kept, np.int64).T
    inner = np.setdiff1d(np.concatenate([first, last]), bounds)
    out = np.sort(np.concatenate([bounds, inner]))
    own = np.zeros(len(out) - 1, bool)
    own[np.searchsorted(out, first, "right") - 1] = True  # the last of equal bounds: after empty texts
    return out, own


def chunked(data: np.ndarray, bounds: np.ndarray, mean: int, special: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the bounds of its chunks, and which of these are special tokens."""
    places, is_special = stretches(data, bounds, special)
    if not is_special.any():
        return [(x, np.zeros(0, np.int64)) for x in cuts(data, bounds, mean)]
    parts = [np.array([x[0], x[-1]]) if own else x for x, own in zip(cuts(data, places, mean), is_special, strict=True)]
    # a text's stretches begin in it; empty ones are empty texts
    text = np.searchsorted(bounds[:-1], places[:-1], "right") - 1
    empty = np.flatnonzero(np.diff(bounds) == 0)
    out: list[tuple[np.ndarray, np.ndarray]] = [(bounds[k : k + 2], np.zeros(0, np.int64)) for k in range(len(bounds) - 1)]
    full = np.flatnonzero(np.diff(places) > 0)
    for k in np.setdiff1d(np.arange(len(bounds) - 1), empty):
        own = full[np.searchsorted(text[full], k) : np.searchsorted(text[full], k, "right")]
        at = np.concatenate([parts[own[0]][:1], *(parts[i][1:] for i in own)])
        chunks = np.cumsum([len(parts[i]) - 1 for i in own])
        out[k] = at, chunks[is_special[own]] - 1
    return out


def encode_decode(docs: DataFrame, tokenizer: str, mean: int = 256, digests: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (decimal, joined by commas), n_tokens and decoded, one row per row of docs; with
    digests the SHA-256 of ids and of decoded instead of them.

    A null or empty text has no ids and decodes to the empty text. Repeated rows are encoded each (from remembered
    chunks), doc_id is copied as it is (null and tied ids too), other columns are ignored, whatever their names, and an
    empty table gives an empty result. A very long text is cut into chunks of at most MOST * mean bytes; a pre-token that
    goes on over many chunks is scanned a few times and encoded whole. mean: mean bytes of a chunk, a power of two
    from 2 on. What is remembered is bounded by entries and characters and changes no result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    special = list(coder(tokenizer).special)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for i, j in pieces(bounds):
                own, places = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                at, tokens = zip(*chunked(own, places, mean, special), strict=True)
                start, end = np.concatenate([x[:-1] for x in at]), np.concatenate([x[1:] for x in at])
                some = np.flatnonzero(end > start)  # an empty text has no chunk
                first, key = np.searchsorted(start[some], places[:-1]), np.zeros(j - i, np.uint64)
                full = np.flatnonzero(np.diff(places) > 0)
                if len(full):
                    key[full] = np.minimum.reduceat(hasher(6).of_ranges(own, start[some], end[some]), first[full])
                cut = pa.array([(x - x[0]).astype(np.int32).tobytes() for x in at], pa.binary())
                apart = pa.array([x.astype(np.int32).tobytes() if len(x) else None for x in tokens], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), pa.array(key.view(np.int64)), cut, apart], ["doc_id", "text", "chunk", "cuts", "special"])

    rows = rows.mapInArrow(routed, "doc_id long, text string, chunk long, cuts binary, special binary")
    rows = rows.hint("rebalance", F.col("chunk")).sortWithinPartitions("chunk")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for i, j in pieces(bounds):
                n, ids, texts = [], [], []
                for k in range(i, j):
                    raw, at = data[bounds[k] : bounds[k + 1]].tobytes(), np.frombuffer(b.column(3)[k].as_buffer(), np.int32).tolist()
                    tokens = b.column(4)[k]
                    apart = set(np.frombuffer(tokens.as_buffer(), np.int32).tolist()) if tokens.is_valid else set()
                    s = c.text_ids([raw[x:y].decode() for x, y in zip(at, at[1:]) if y > x], apart)
                    t = c.decode(s)
                    n.append(s.count(",") + 1 if s else 0)
                    ids.append(hashlib.sha256(s.encode()).hexdigest() if digests else s)
                    texts.append(hashlib.sha256(t.encode()).hexdigest() if digests else t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", *names])

    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")
