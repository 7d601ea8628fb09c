"""Exact n-gram Jaccard links between whole texts by a grouped prefix join.

A document is the set of its word shingles. All shingles have one total order: rarest first, by a
counting sketch that grows with the corpus within bounds, then by hash. Two sets that are similar enough share a shingle among the
first |set| - ceil(t |set|) + 1 of each, the prefix (Chaudhuri et al., 2006), at places that still allow
the overlap (Xiao et al., 2008). Equal sets are one class; classes of one size and prefix are one group
(Bouros et al., 2012). Groups meet in the lists of the shingles of their prefixes; a pair of groups that
passes the filters is expanded to its classes. Classes are compared in place, in blocks of fixed size, by
parities of their shingles, which bound the difference of two sets from below; only pairs within what the
threshold allows become rows, and their shingles are compared.

Only what connects is wanted, so lists are walked twice: first each group with the most central group of
the list only, then all pairs that are not connected by then. A group of copies thus costs in proportion
to its size, and no link is lost: pairs left out are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import U, couples, hasher, mix, pieces, runs, text_bytes, words
from tidemark.llm.tables import components, dropped, small_batches, written

#: Cells of the counting sketch at least and at most, powers of two, and bytes of text for each cell in between. A cell is a
#: byte of a broadcast, and four of a task that counts.
CELLS, MOST_CELLS, CELL_BYTES = 1 << 22, 1 << 25, 100
BLOCK = 1 << 16
#: Bits of the map that keeps texts nobody asks for out of a shuffle, a power of two; fixed.
BITS = 1 << 26
#: Rows of a list that are compared in a task with rows of the same or of another part of the list.
PART = 512
#: Rows that a task remembers to have sent.
HAD = 1 << 18
#: Parities have so many cells at least, and as many times what two sets of one size may differ in.
FOLD, SPARE = 64, 2.5


def shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, each text's in ascending order, and the texts' bounds in
    them. Fewer words than width make one shingle, no word makes none."""
    n = len(bounds) - 1
    start, end, text = words(data, bounds)
    h = hasher(3, True)
    w = h.of_ranges(data, start, end)
    k = len(w) - width + 1
    whole = np.zeros(0, U)
    own = np.zeros(0, np.int64)
    if k > 0:
        whole = mix(w[width - 1 :] + U(width))
        for i in range(width - 2, -1, -1):
            whole = mix(whole * U(3) + w[i : i + k])
        inside = text[width - 1 :] == text[:k]
        whole, own = whole[inside], text[:k][inside]
    count = np.bincount(text, minlength=n)
    for t in np.flatnonzero((count > 0) & (count < width)):
        i = np.searchsorted(text, t)
        x = np.full(1, count[t], U)
        for j in range(i + count[t] - 1, i - 1, -1):
            x = mix(x * U(3) + w[j])
        whole, own = np.append(whole, x), np.append(own, t)
    o = np.lexsort((whole, own))
    whole, own = whole[o], own[o]
    first = np.ones(len(whole), bool)
    first[1:] = (whole[1:] != whole[:-1]) | (own[1:] != own[:-1])
    whole, own = whole[first], own[first]
    return whole, np.searchsorted(own, np.arange(n + 1))


def _cell(x: np.ndarray, cells: int) -> np.ndarray:
    return (x >> U(64 - cells.bit_length() + 1)).astype(np.int64)


def least(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of sizes n and m whose Jaccard similarity reaches percent."""
    return -(-percent * (n + m) // (100 + percent))


def _sketch(rows: DataFrame, width: int) -> np.ndarray:
    """How common the shingles of each cell are: twice the binary logarithm of their sightings."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST_CELLS, max(CELLS, 1 << int(size / CELL_BYTES).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for b in batches:
            data, bounds = text_bytes(b.column(0))
            for i, j in pieces(bounds):
                x, _ = shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], width)
                np.add.at(total, _cell(x, cells), 1)
        if not total.any():
            return
        press = zstandard.ZstdCompressor(level=1)
        for k in range(0, cells, BLOCK):
            # bytes of one place together: high ones are mostly zero
            part = total[k : k + BLOCK].view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([press.compress(part)], pa.binary())], ["block", "counts"])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["block"], b["counts"], strict=True):
                got = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0]
                sums[k] = sums.get(k, 0) + got.astype(np.int64)
        for k, x in sums.items():
            yield pd.DataFrame({"block": [k], "common": [np.floor(2 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes()]})

    got = rows.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInPandas(summed, "block int, common binary")
    out = np.zeros(cells, np.uint8)
    for r in got.toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["common"], np.uint8)
    return out


def _asked_for(rows: DataFrame, keys: DataFrame, shares: list) -> DataFrame:
    """Rows (k1, k2, text) without most of those whose key is not in keys, by a bit for each hash of a key, and without those
    that a task has had already. The map has a fixed size, so at a very large size it lets more through; the join that
    follows decides."""
    spark = rows.sparkSession

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, x in zip(b["block"], b["bits"], strict=True):
                bits = np.zeros(BLOCK, bool)
                bits[np.asarray(x)] = True
                yield pd.DataFrame({"block": [k], "bits": [np.packbits(bits).tobytes()]})

    h = F.pmod(F.col("k1"), F.lit(BITS)).cast("int")
    got = keys.select(h.alias("h")).select(F.shiftright("h", BLOCK.bit_length() - 1).alias("block"), F.col("h").bitwiseAND(BLOCK - 1).alias("bit"))
    blocks = got.groupBy("block").agg(F.collect_set("bit").alias("bits")).mapInPandas(packed, "block int, bits binary")
    bits = np.zeros(BITS // 8, np.uint8)
    for r in blocks.toLocalIterator():
        bits[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    shares.append(shared)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[tuple[int, int]] = set()
        for b in batches:
            at = b.column(3).to_numpy()
            keep = np.flatnonzero((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            each = [(i, x) for i, x in zip(keep.tolist(), zip(*(b.column(k).take(pa.array(keep)).to_pylist() for k in (0, 1)), strict=True), strict=True)]
            if len(had) > HAD:  # a row that is sent again does no harm
                had.clear()
            new = pa.array([i for i, x in each if x not in had and not had.add(x)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k).take(new) for k in range(3)], ["k1", "k2", "text"])

    return rows.select("k1", "k2", "text", h.alias("h")).mapInArrow(kept, "k1 long, k2 long, text string")


def _sums(x: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Sizes of sets and two sums of hashes of their members, which together name a set."""
    sums = [np.append(U(0), np.cumsum(mix(x + U(k)), dtype=U)) for k in (11, 12)]
    return [pa.array(np.diff(at), pa.int32()), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums)]


def _cells(n: np.ndarray, percent: int) -> np.ndarray:
    """How many cells the parities of sets of n members have: a power of two that grows with what they may differ in."""
    room = 2 * n - 2 * least(n, n, percent)
    return np.maximum(FOLD, 1 << np.ceil(np.log2(np.maximum(1, SPARE * room))).astype(np.int64))


def _parities(x: np.ndarray, at: np.ndarray, percent: int) -> pa.Array:
    """For each set the cells with an odd number of its members. A member of one set only changes one cell, so two
    sets differ in at least as many members as in cells."""
    n = np.diff(at)
    size = _cells(n, percent)
    ends = np.append(0, np.cumsum(size))
    cell = np.repeat(ends[:-1], n) + (x & np.repeat(size - 1, n).astype(U)).astype(np.int64)
    odd = np.bincount(cell, minlength=ends[-1]) & 1
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd.astype(bool), bitorder="little"))])


class Parities:
    """The parities of some sets, for comparing pairs of them at a time. Where two have different numbers of cells
    the larger one is folded: its upper half meets the lower."""

    def __init__(self, odd: list[bytes | None]):
        size = np.array([len(x) if x is not None else 0 for x in odd])
        self.there, self.size = size > 0, size
        self.at: dict[int, np.ndarray] = {}
        self.of: dict[int, np.ndarray] = {}
        for f in np.unique(size[self.there])[::-1]:  # from the largest on
            own = np.flatnonzero(size == f)
            rows = np.frombuffer(b"".join(odd[i] for i in own), U).reshape(len(own), -1)
            if 2 * f in self.of:
                more, wide = np.flatnonzero(self.at[2 * f] >= 0), self.of[2 * f]
                rows, own = np.concatenate([rows, wide[:, : f // 8] ^ wide[:, f // 8 :]]), np.concatenate([own, more[np.argsort(self.at[2 * f][more])]])
            self.at[f] = np.full(len(size), -1)
            self.at[f][own] = np.arange(len(own))
            self.of[f] = rows

    def within(self, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Where sets x and y differ in no more cells than room, or can't be compared."""
        ok = np.ones(len(x), bool)
        f = np.minimum(self.size[x], self.size[y])
        f[np.maximum(self.size[x], self.size[y]) > 2 * f] = 0
        for k in np.unique(f[f > 0]):
            s = np.flatnonzero(f == k)
            for i in range(0, len(s), 1 << 14):
                t = s[i : i + (1 << 14)]
                ok[t] = np.bitwise_count(self.of[k][self.at[k][x[t]]] ^ self.of[k][self.at[k][y[t]]]).sum(1, dtype=np.int64) <= room[t]
        return ok


def _signatures(rows: DataFrame, common, width: int, percent: int) -> DataFrame:
    """id and key of a row, n, two sums of hashes of the set, its parities, and its prefix in the total order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = common.value
        for b in batches:
            data, bounds = text_bytes(b.column(3))
            for i, j in pieces(bounds):
                x, at = shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], width)
                n = np.diff(at)
                own = np.repeat(np.arange(len(n)), n)
                o = np.lexsort((x, rank[_cell(x, len(rank))], own))
                size = np.where(n > 0, n + 1 - -(-percent * n // 100), 0)
                keep = np.arange(len(x)) - np.repeat(at[:-1], n) < np.repeat(size, n)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(k).slice(i, j - i) for k in range(3)),
                        *_sums(x, at),
                        _parities(x, at, percent),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[o][keep].view(np.int64))),
                    ],
                    ["id", "k1", "k2", "n", "s1", "s2", "odd", "prefix"],
                )

    return rows.select("id", "k1", "k2", "text").mapInArrow(run, "id long, k1 long, k2 long, n int, s1 long, s2 long, odd binary, prefix array<long>")


def _runs(fn, names: list[str]):
    """Applies fn to each run of rows that agree in names, over batches that are sorted by them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            k = b[names].to_numpy()
            cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            if held and (held[-1][names].to_numpy()[-1] == k[0]).all() and not len(cut):
                held.append(b)
                continue
            if held:
                if (held[-1][names].to_numpy()[-1] == k[0]).all():
                    held.append(b.iloc[: cut[0]])
                    b, cut = b.iloc[cut[0] :], cut[1:] - cut[0]
                if (x := fn(pd.concat(held))) is not None:
                    yield x
            # runs that end here in one go
            if len(cut):
                if (x := fn(b.iloc[: cut[-1]])) is not None:
                    yield x
                b = b.iloc[cut[-1] :]
            held = [b]
        if held and (x := fn(pd.concat(held))) is not None:
            yield x

    return run


def _pairs(percent: int):
    """Pairs of groups within runs of (token, i, j) that lie in different components and pass the size and place filters.
    Where both are of one class (odd is there), their parities must allow the pair, too."""

    def of(g: pd.DataFrame) -> pd.DataFrame | None:
        i, j = (g[c].to_numpy() for c in ("i", "j"))
        n, p, comp, part, ids = (g[c].to_numpy(np.int64) for c in ("n", "p", "comp", "part", "g"))
        odd = Parities(g["odd"].tolist())
        out = []
        for a, b in couples(*runs([g[c].to_numpy() for c in ("token", "i", "j")])):
            need = least(n[a], n[b], percent)
            ok = (comp[a] != comp[b]) & (np.minimum(n[a] - p[a], n[b] - p[b]) >= need) & (np.minimum(n[a], n[b]) >= need) & ((i[a] == j[a]) | (part[a] != part[b]))
            a, b, need = a[ok], b[ok], need[ok]
            ok = odd.within(a, b, n[a] + n[b] - 2 * need)
            a, b = a[ok], b[ok]
            out.append((ids[a], ids[b], odd.there[a] & odd.there[b]))
        a, b, single = (np.concatenate(x) for x in zip(*out)) if out else (ids[:0], ids[:0], ids[:0])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "single": single.astype(bool)}).drop_duplicates() if len(a) else None

    return _runs(of, ["token", "i", "j"])


def _near(percent: int):
    """Pairs of classes of two sides within runs of (a, b, i, j) that lie in different components and whose parities
    differ in no more cells than similar sets may differ in members."""

    def of(g: pd.DataFrame) -> pd.DataFrame | None:
        a, b, i, j, side, c, comp, n = (g[x].to_numpy(np.int64) for x in ("a", "b", "i", "j", "side", "c", "comp", "n"))
        odd = Parities(g["odd"].tolist())
        once = (a == b) & (i == j)  # both sides have the same classes
        out = []
        for x, y in couples(*runs([a, b, i, j])):
            ok = (side[x] != side[y]) & (comp[x] != comp[y])
            x, y = x[ok], y[ok]
            x, y = np.where(side[x] == 0, x, y), np.where(side[x] == 0, y, x)
            room = n[x] + n[y] - 2 * least(n[x], n[y], percent)
            ok = (~once[x] | (c[x] < c[y])) & (np.abs(n[x] - n[y]) <= room)
            x, y, room = x[ok], y[ok], room[ok]
            ok = odd.within(x, y, room)
            out.append((c[x[ok]], c[y[ok]]))
        x, y = (np.concatenate(x) for x in zip(*out)) if out else (c[:0], c[:0])
        return pd.DataFrame({"x": x, "y": y}) if len(x) else None

    return _runs(of, ["a", "b", "i", "j"])


def _allowed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) with sizes and parities of both (n, odd and m, even) those whose parities allow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 4))
            odd, i = Parities(b.column(3).to_pylist() + b.column(5).to_pylist()), np.arange(len(n))
            keep = pa.array(odd.within(i, i + len(n), n + m - 2 * least(n, m, percent)))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in (0, 1)], ["x", "y"])

    return pairs.select("x", "y", "n", "odd", "m", "even").mapInArrow(run, "x long, y long")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) of classes those whose sets are similar, as a, b. The class of a pair that is in more pairs stays at
    home: its pairs come to it, with the other classes' sets, in parts of PART pairs or so. So its set is there once for each
    part, and not once for each pair."""
    often = pairs.select(F.explode(F.array("x", "y")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    of = lambda c, k: often.select(F.col("c").alias(c), F.col("k").alias(k))
    home = F.expr("kx > ky OR (kx = ky AND x < y)")
    dealt = pairs.select("x", "y").join(of("x", "kx"), "x").join(of("y", "ky"), "y")
    dealt = dealt.select(F.when(home, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(home, F.col("y")).otherwise(F.col("x")).alias("b"))
    size = dealt.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    guests = dealt.join(size, "a").select("a", F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("part"), "b").join(sets.select(F.col("c").alias("b"), "set"), "b")
    hosts = size.join(sets.select(F.col("c").alias("a"), "set"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "set")
    work = hosts.unionByName(guests).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, p = None, np.zeros(0, U)
        for batch in batches:
            out = []
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                q = np.frombuffer(x.as_buffer(), U)
                if b is None:
                    host, p = a, q.copy()  # a batch's memory goes with it
                elif host == a:  # a class whose text is not there has no set
                    both = np.concatenate([p, q])
                    both.sort(kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= percent * (len(p) + len(q) - same):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return work.mapInArrow(verify, "a long, b long")


def row_keys(doc_id: str, text: str) -> dict[str, Column]:
    """Two hashes that name a row by its id and text; rows that repeat both share them."""
    own, t = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return {"row_key_1": F.xxhash64(own, t), "row_key_2": F.xxhash64(F.lit(7), t, own)}


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = 3, doc_id: str = "doc_id", text: str = "text", keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs, for links where the Jaccard similarity of
    the sets of width-word shingles is at least percent in a hundred.

    component_id is the smallest doc_id that links reach. Texts without a word (null, empty, white
    space) have no shingles and link with nothing. Rows with equal sets, repeated rows and tied ids among them, are
    linked; a null doc_id takes part, but is no component_id unless it is alone (then null). A very long text is one set
    like any other; a task holds the shingles of one such text at a time. Other columns are ignored, whatever their
    names; an empty table gives an empty result. Sets are told apart by their size and two 64-bit sums, shingles are
    compared as 64-bit hashes. With keys also row_keys() and kept: true for the rows of one text of each component (that
    of its smallest id; where this id has several, that of the smallest key) and for rows without shingles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = [c.alias(n) for n, c in zip(("k1", "k2"), row_keys(doc_id, text).values(), strict=True)]
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *named)
    common = spark.sparkContext.broadcast(_sketch(rows, width))
    shares = [common]
    signed = written(_signatures(rows, common, width, percent), "signatures")
    # equal sets are a class, known by the text of its smallest id
    known_by = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")).alias("x")
    classes = signed.where("n > 0").groupBy("n", "s1", "s2").agg(known_by, F.any_value("odd").alias("odd"), F.any_value("prefix").alias("prefix"))
    classes = classes.select("n", "s1", "s2", F.col("x.id").alias("low"), "x.k1", "x.k2", "odd", "prefix", F.xxhash64("n", "prefix").alias("p1"), F.xxhash64("prefix", F.lit(7), "n").alias("p2"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    narrow = written(signed.select("id", "n", "s1", "s2", *(["k1", "k2"] if keys else [])), "narrow")
    dropped(spark, signed)

    # classes of one size and prefix are a group, known by its smallest class; different sets of one size can be similar
    # only if the overlap may be less than the size
    able = F.expr(f"cast(ceil({2 * percent} * n / {100 + percent}) as int) < n").alias("able")
    groups = classes.groupBy("p1", "p2").agg(F.min(F.struct("c", "odd")).alias("r"), F.count("*").alias("k"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"))
    groups = written(groups.select(F.col("r.c").alias("g"), "r.odd", "k", "n", able, "p1", "p2", "prefix"), "groups")
    members = written(classes.select("p1", "p2", "c", F.col("odd").alias("even")).join(groups.where("k > 1").drop("prefix"), ["p1", "p2"]).select("g", "c", "n", "odd", "even", "k", "able"), "members")

    # the lists of shingles that two groups have in their prefixes
    spread = groups.select("g", "n", F.posexplode("prefix").alias("p", "token"))
    # counted before they are dealt, so a shingle of very many groups is one row a task, and a join may split its rows
    bare = written(spread.join(spread.groupBy("token").count().where("count > 1").select("token"), "token"), "lists")
    lists = written(bare.join(bare.groupBy("g").agg(F.count("*").alias("centre")), "g"), "lists")
    dropped(spark, bare)
    used = [classes, groups, members, lists]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(0))
            for i, j in pieces(bounds):
                x, at = shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], width)
                raw = memoryview(x.tobytes())
                own = pa.array([raw[8 * s : 8 * e] for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
                same = np.all([x.to_numpy() == b.column(k).slice(i, j - i).to_numpy() for k, x in zip((2, 3, 4), _sums(x, at), strict=True)], axis=0)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i).filter(pa.array(same)), own.filter(pa.array(same))], ["c", "set"])

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among pairs of classes, whose sets come from the texts that the classes are known by."""
        met = pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct()
        lows = classes.join(met, "c", "left_semi").select("c", "k1", "k2", "n", "s1", "s2")
        texts = _asked_for(rows, lows, shares).groupBy("k1", "k2").agg(F.any_value("text").alias("text")).join(lows, ["k1", "k2"])
        used.append(written(texts.select("text", "c", "n", "s1", "s2").mapInArrow(packed, "c long, set binary"), "sets"))
        return _similar(pairs, used[-1], percent)

    # first the first class of each group with that of the most central group of a list, and with its own group
    heads = lists.groupBy("token").agg(F.max(F.struct("centre", "g", "n", "p")).alias("h"))
    star = lists.join(heads, "token").where("g <> h.g").withColumn("need", F.expr(f"cast(ceil({percent} * (n + h.n) / {100 + percent}) as int)"))
    star = star.where("least(n, h.n) >= need AND least(n - p, h.n - h.p) >= need").select(F.least("g", "h.g").alias("x"), F.greatest("g", "h.g").alias("y")).distinct()
    star = star.join(groups.select(F.col("g").alias("x"), "n", "odd"), "x").join(groups.select(F.col("g").alias("y"), F.col("n").alias("m"), F.col("odd").alias("even")), "y")
    own = members.where("able AND c <> g").select(F.col("c").alias("x"), F.col("g").alias("y"), "n", "odd", F.col("n").alias("m"), "even")
    first = written(_allowed(star.select(own.columns).unionByName(own), percent), "pairs")
    links = written(linked(first), "links")
    comp = written(components(links), "components")
    used += [first, links, comp]

    # then all pairs that are not connected by then; a group that isn't in one component stands for itself
    found = comp.select(F.col("node").alias("c"), "component")
    single = groups.where("k = 1").select(F.col("g").alias("c"), "odd").join(found, "c", "left").select(F.col("c").alias("g"), F.coalesce("component", "c").alias("comp"), F.lit(False).alias("apart"), "odd")
    known = written(members.join(found, "c", "left").select("g", "c", "n", "k", "able", F.col("even").alias("odd"), F.coalesce("component", "c").alias("comp")), "known")
    several = known.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).select("g", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("g")).alias("comp"), (F.col("low") != F.col("high")).alias("apart"), F.lit(None).cast("binary").alias("odd"))
    of_group = written(single.unionByName(several), "groups")
    used += [known, of_group]
    marked = written(lists.join(of_group.drop("apart", "odd"), "g"), "marked")
    used.append(marked)
    open_ = marked.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("lo <> hi")
    mixed = marked.join(open_.select("token", "parts"), "token")
    work = (
        mixed.join(of_group.select("g", "odd"), "g")
        .withColumn("part", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "g", "n", "p", "comp", "odd")
    )
    left = written(work.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInPandas(_pairs(percent), "a long, b long, single boolean").distinct(), "pairs")
    # where a group of several classes takes part, or one that is not in one component, the classes meet in parts of both
    inside = of_group.where("apart").select(F.col("g").alias("a"), F.col("g").alias("b"))
    inside = inside.join(groups.where("able").select(F.col("g").alias("a")), "a", "left_semi")
    of_class = known.select("g", "c", "n", "odd", "comp", "k").unionByName(
        groups.where("k = 1").join(left.where("NOT single").select(F.explode(F.array("a", "b")).alias("g")).distinct(), "g", "left_semi").join(of_group.select("g", "comp"), "g").select("g", F.col("g").alias("c"), "n", "odd", "comp", "k")
    )
    parts = F.ceil(F.col("k") / PART).cast("int")
    size = of_class.groupBy("g").agg(F.max(parts).alias("parts"))
    meet = left.where("NOT single").select("a", "b").unionByName(inside).join(size.select(F.col("g").alias("a"), F.col("parts").alias("pa")), "a").join(size.select(F.col("g").alias("b"), F.col("parts").alias("pb")), "b")
    names = ["a", "b", "i", "j", "side", "c", "comp", "n", "odd"]
    own_part = lambda of: F.expr(f"cast(pmod(xxhash64(c), {of}) as int)")
    x = meet.join(of_class.withColumnRenamed("g", "a"), "a").withColumn("i", own_part("pa")).withColumn("j", F.expr("explode(sequence(if(a = b, i, 0), pb - 1))")).withColumn("side", F.lit(0))
    y = meet.join(of_class.withColumnRenamed("g", "b"), "b").withColumn("j", own_part("pb")).withColumn("i", F.expr("explode(sequence(0, if(a = b, j, pa - 1)))")).withColumn("side", F.lit(1))
    blocks = x.select(names).unionByName(y.select(names)).repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j")
    rest = blocks.mapInPandas(_near(percent), "x long, y long").unionByName(left.where("single").select(F.col("a").alias("x"), F.col("b").alias("y")))
    rest = written(rest, "pairs")
    used += [left, rest]

    final = written(components(found.select(F.col("c").alias("a"), F.col("component").alias("b")).unionByName(linked(rest))), "components")
    named = classes.select("c", "n", "s1", "s2", F.struct(F.col("low").isNull().alias("no"), "low", "k1", "k2").alias("first")).join(final.withColumnRenamed("node", "c"), "c", "left").select("n", "s1", "s2", "first", F.coalesce("component", "c").alias("k"))
    lowest = named.groupBy("k").agg(F.min("first").alias("x")).select("k", F.col("x.low").alias("component_id"), F.col("x.k1").alias("r1"), F.col("x.k2").alias("r2"))
    by_class = written(named.join(lowest, "k").select("n", "s1", "s2", "component_id", "r1", "r2"), "classes")
    # what the result doesn't read goes now
    for x in (*used, final):
        dropped(spark, x)
    for x in shares:
        x.destroy()
    got = narrow.where("n > 0").join(by_class, ["n", "s1", "s2"], "left")
    empty = narrow.where("n = 0")  # by no key, as all of these would share one
    got = got.unionByName(empty.select("*", *[F.lit(None).cast("long").alias(c) for c in by_class.columns if c not in narrow.columns]))
    more = [F.col("k1").alias("row_key_1"), F.col("k2").alias("row_key_2"), F.expr("n = 0 OR (k1 = r1 AND k2 = r2)").alias("kept")] if keys else []
    return got.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *more)
