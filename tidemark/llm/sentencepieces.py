"""SentencePiece encoding that keeps, for every piece, the bytes of the text it stands for.

A text is normalised as the model says: at each character the longest prefix in the compiled character map is
replaced, white space is trimmed and marked. Beside every normalised byte stands the range of source bytes it came from. The normalised text
is cut between characters that no piece has side by side; no merge crosses such a place, so each unit has its own pieces and a
unit that has come before is not merged again. Lengths of pieces give their normalised bytes, and those their source spans.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import pieces, text_bytes
from tidemark.llm.tables import small_batches
from tidemark.llm.tokens import Remembered

MARK = "▁"
#: Fixed values of the model file: numbers of its fields, of kinds of pieces and of the merging kind of model.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
#: Ids whose digits or bytes are put together at a time.
BLOCK = 1 << 17


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            out |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return out

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[i : i + n]
            i += n


class CharacterMap:
    """Prefixes and what they are normalised to, from their compiled form: the size of a double-array trie, its units
    (one for each node: a label, an offset to its children by exclusive or, a mark where a value follows) and replacements that end in a zero byte."""

    def __init__(self, compiled: bytes):
        n = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", n // 4, 4) if n else np.zeros(0, np.uint32)
        self.pool = np.frombuffer(compiled, np.uint8, offset=4 + n) if n else np.zeros(0, np.uint8)
        self.zeros = np.flatnonzero(self.pool == 0)

    def longest(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range its longest prefix in the map (0: none) and where its replacement begins. All ranges go down
        the trie together, a byte at a time."""
        length, value = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        live, node, depth = np.arange(len(start)), np.full(len(start), self._child(self.units[:1])[0], np.int64), 0
        while len(live):
            on = start[live] + depth < end[live]
            live, node = live[on], node[on]
            c = data[start[live] + depth].astype(np.int64)
            at = node ^ c
            unit = self.units[np.minimum(at, len(self.units) - 1)]
            on = (at < len(self.units)) & ((unit & np.uint32(0x800000FF)) == c)
            live, node = live[on], (at ^ self._child(unit))[on]
            leaf = (unit[on] >> np.uint32(8)) & np.uint32(1) > 0
            depth += 1
            length[live[leaf]] = depth
            value[live[leaf]] = self.units[node[leaf]] & np.uint32(0x7FFFFFFF)
        return length, value

    @staticmethod
    def _child(unit: np.ndarray) -> np.ndarray:
        unit = unit.astype(np.int64)
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def replacements(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start and length of what is replaced, and first place and length of what stands instead."""
        start = np.flatnonzero((data & 0xC0) != 0x80)
        end = bounds[np.searchsorted(bounds, start, "right")]
        length, value = self.longest(data, start, end)
        width = np.append(start[1:], len(data)) - start
        hit = np.flatnonzero(length)
        if (length[hit] > width[hit]).any():  # a match of several characters hides those that begin in it
            keep, until = [], 0
            for k in hit.tolist():
                if start[k] >= until:
                    keep.append(k)
                    until = start[k] + length[k]
            hit = np.array(keep, np.int64)
        return start[hit], length[hit], value[hit], self.zeros[np.searchsorted(self.zeros, value[hit])] - value[hit]


@dataclass
class Normalised:
    """Bytes of normalised texts, their bounds, and for each byte the source bytes it came from."""

    data: np.ndarray
    bounds: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def rewritten(self, at: np.ndarray, width: np.ndarray, pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> Normalised:
        """With width bytes at each place replaced by size bytes of the pool from first on. What stands instead came
        from all bytes that were there; other bytes from where they did."""
        if not len(at):
            return self
        n = np.ones(len(self.data), np.int32)
        inside = np.repeat(at - (np.cumsum(width) - width), width) + np.arange(width.sum())
        n[inside] = 0
        n[at] = size
        end = self.end.copy()
        end[at] = self.end[at + width - 1]
        ends = np.append(0, np.cumsum(n, dtype=np.int64))
        data = np.repeat(self.data, n)
        data[spread_places(ends[at], size)] = pool[spread_places(first, size)]
        return Normalised(data, ends[self.bounds], np.repeat(self.begin, n), np.repeat(end, n))

    def without(self, gone: np.ndarray) -> Normalised:
        ends = np.append(0, np.cumsum(~gone, dtype=np.int64))
        return Normalised(self.data[~gone], ends[self.bounds], self.begin[~gone], self.end[~gone])

    def led(self, which: np.ndarray, places: np.ndarray) -> Normalised:
        """With a space before each text in which, that came from nothing: the empty range at its source place."""
        at = self.bounds[:-1][which]
        put = [np.insert(x, at, v) for x, v in ((self.data, 0x20), (self.begin, places[which]), (self.end, places[which]))]
        return Normalised(put[0], self.bounds + np.append(0, np.cumsum(which)), *put[1:])


def spread_places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Model(Remembered):
    """A merging model and how it normalises. Models with pieces of the user's own, unused pieces, marks at the
    ends of words or no pieces for bytes are refused."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            fields = list(message(file.read()))
        self.pieces = [(dict(message(v)).get(1, b""), dict(message(v)).get(3, NORMAL)) for f, v in fields if f == PIECE]
        trainer, spec = ({k: v for f, x in fields if f == wanted for k, v in message(x)} for wanted in (TRAINER, NORMALIZER))
        kinds = [k for _, k in self.pieces]
        if trainer.get(3, 1) != MERGES or trainer.get(24) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256 or not spec.get(5, 1):
            raise ValueError(f"not a model of merges and bytes alone, with marks before words: {path}")
        self.map, self.lead, self.trim = CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        # Units are merged by the library, which is told not to normalise them again.
        plain = b"".join(_field(f, v) for f, v in fields if f != NORMALIZER) + _field(NORMALIZER, _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5)))
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=plain)
        self._beside()
        unknown = trainer.get(44, " ⁇ ".encode())
        said = [p.replace(MARK.encode(), b" ") if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else unknown if k == UNKNOWN else b"" for p, k in self.pieces]
        self.said = Pool(said)
        self.digits = Pool([b"%d," % i for i in range(len(said))])
        self.size = np.array([len(p) if k == NORMAL else 1 for p, k in self.pieces], np.int64)
        super().__init__()

    def _beside(self) -> None:
        """Which characters stand side by side in a piece: a number for each character of longer pieces, and a table."""
        texts = [t for p, k in self.pieces if k == NORMAL and len(t := p.decode()) > 1]
        letters = sorted(set("".join(texts)))
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs = {x for t in texts for x in zip(t, t[1:])}
        a, b = (self.number[[ord(x[k]) for x in pairs]] for k in (0, 1))
        self.beside[a, b] = True

    def normalise(self, data: np.ndarray, bounds: np.ndarray) -> Normalised:
        places = np.arange(len(data), dtype=np.int32)
        out = Normalised(data, bounds, places, places + np.int32(1))
        if len(self.map.units) and len(data):
            out = out.rewritten(*(lambda s, n, v, m: (s, n, self.map.pool, v, m))(*self.map.replacements(data, bounds)))
        full = np.diff(bounds) > 0
        if self.trim:
            space = out.data == 0x20
            before = np.append(True, space[:-1])
            before[out.bounds[:-1][out.bounds[:-1] < len(space)]] = True
            out = out.without(space & before)
            # At the end a mark of the text itself counts as white space, too.
            white = out.data == 0x20
            marks = find(out.data, MARK.encode())
            for k in range(3):
                white[marks + k] = True
            solid = np.append(-1, np.flatnonzero(~white))
            last = solid[np.searchsorted(solid, out.bounds[1:], "left") - 1] + 1
            last = np.maximum(last, out.bounds[:-1])
            gone = np.zeros(len(out.data), bool)
            gone[spread_places(last, out.bounds[1:] - last)] = True
            out = out.without(gone)
            full = np.diff(out.bounds) > 0
        if self.lead:
            out = out.led(full, bounds[:-1].astype(np.int32))
        at = np.flatnonzero(out.data == 0x20)
        one = np.ones(len(at), np.int64)
        return out.rewritten(at, one, np.frombuffer(MARK.encode(), np.uint8), 0 * one, 3 * one)

    def split(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero((data & 0xC0) != 0x80)
        own = self.number[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        cut = np.append(True, ~self.beside[own[:-1], own[1:]])[: len(first)]
        cut[np.searchsorted(first, bounds[:-1][bounds[:-1] < len(data)])] = True
        start = first[cut]
        return start, np.append(start[1:], len(data))[: len(start)]

    def ids_of(self, own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.merger.encode(own, num_threads=1)
        return np.arange(len(own)), np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def spans(self, text: Normalised, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes of each id of all texts in a row: from the first source byte of its first normalised byte to the
        last one of its last."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return text.begin[ends - size], text.end[ends - 1]

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The text of ids that encode() gave, in parts. The space that was put before it goes."""
        for k in range(0, len(ids), BLOCK):
            part = self.said.of(ids[k : k + BLOCK])
            yield part[1:] if not k and (self.lead or self.trim) and part[:1] == b" " and self.pieces[ids[0]][1] == NORMAL else part


class Pool:
    """Byte strings by number."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([len(x) for x in parts], np.int64)
        self.first, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(parts), np.uint8)

    def of(self, numbers: np.ndarray) -> bytes:
        """Those of numbers, joined."""
        return self.data[spread_places(self.first[numbers], self.size[numbers])].tobytes()


def find(data: np.ndarray, what: bytes) -> np.ndarray:
    hit = np.ones(max(0, len(data) - len(what) + 1), bool)
    for k, c in enumerate(what):
        hit &= data[k : k + len(hit)] == c
    return np.flatnonzero(hit)


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(key: int, value: int | bytes) -> bytes:
    return _number(key << 3) + _number(value) if isinstance(value, int) else _number(key << 3 | 2) + _number(len(value)) + value


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode_pieces(docs: DataFrame, model_file: str, digests: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, begins, ends (the bytes of text that each id stands for) and decoded, one row per row of
    docs; with digests the SHA-256 of the decimal ids joined by commas (ids_sha256) and of decoded (decoded_sha256), and the CRC-32 of begins and
    ends as little-endian 32-bit numbers (spans_crc32) instead of ids, begins, ends and decoded.

    Without begin or end ids, no sampling. The mark put before a text stands for its empty beginning, a piece of a byte that has no
    other piece for that byte, and what a map put in place of some characters for all of them, so spans of neighbours may overlap
    there. A null or empty text has no ids and decodes to the empty text. Repeated rows are encoded each, doc_id is copied
    as it is (null and tied ids, too), other columns are ignored, whatever their names, and an empty table gives an empty
    result. Texts are encoded where they lie, some hundred kilobytes at a time or one longer text; a stretch in which all neighbours may merge is
    merged whole, however long. Units are remembered in bounded number; that changes no result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["ids_sha256", "decoded_sha256", "spans_crc32"] if digests else ["ids", "begins", "ends", "decoded"]
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string, spans binary" if digests else "ids array<int>, begins array<int>, ends array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for i, j in pieces(bounds):
                places = bounds[i : j + 1] - bounds[i]
                own = m.normalise(data[bounds[i] : bounds[j]], places)
                ids, n = m.encode(own.data, own.bounds)
                begin, end = m.spans(own, ids)
                base = np.repeat(places[:-1], n).astype(np.int32)
                ends = np.append(0, np.cumsum(n))
                columns = _digests(m, ids, begin - base, end - base, ends) if digests else _whole(m, ids, begin - base, end - base, ends)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), *columns], [x.split()[0] for x in schema.split(", ")])

    out = rows.mapInArrow(run, schema)
    return out.withColumn("spans_crc32", F.crc32("spans")).select("doc_id", "n_tokens", *names) if digests else out


def _whole(m: Model, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, begin, end)]
    return [*lists, pa.array([b"".join(m.decode(ids[a:z])).decode("utf-8", "replace") for a, z in zip(bounds, bounds[1:])], pa.string())]


def _digests(m: Model, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    shown, said, spans = [], [], []
    for a, z in zip(bounds, bounds[1:]):
        h, d = hashlib.sha256(), hashlib.sha256()
        for k in range(a, z, BLOCK):
            digits = m.digits.of(ids[k : min(z, k + BLOCK)])
            h.update(digits if k + BLOCK < z else digits[:-1])
        for part in m.decode(ids[a:z]):
            d.update(part)
        shown.append(h.hexdigest())
        said.append(d.hexdigest())
        spans.append(np.concatenate([begin[a:z], end[a:z]]).astype("<u4").tobytes())
    return [pa.array(shown), pa.array(said), pa.array(spans, pa.binary())]
