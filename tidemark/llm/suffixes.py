"""Removal of long strings that occur more than once, by sorted suffixes.

Every window of length bytes has an anchor: the leftmost of its 64-byte grams with the smallest
hash, so equal windows have equal anchors at equal places. Only occurrences whose anchor occurs more
than once are brought together, each with the bytes that the windows of that anchor cover. In a group of an anchor the
suffixes that begin at the anchor are sorted by a mergesort whose comparisons take a binary search over
prefix polynomial hashes for the common extension, and so are the reversed beginnings that end there.
Neighbours' common extensions, verified byte by byte, then tell for each window which others agree with it to the
right and to the left. Texts that are equal as a whole are looked at once.

Groups of very many occurrences are split by the bytes that neighbouring windows share. Those that are
as large even then are not brought together at all: their windows are counted one by one, by a 256-bit digest
of all their bytes (texts are told apart by SHA-256).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.kernels import PIECE, U, hasher, mix, pieces, text_bytes
from tidemark.llm.tables import dropped, new_path, removed, small_batches, written

GRAM = 64
#: Groups of more occurrences are split by what their windows have in common: so many places of the
#: anchor in the window go together.
HOT, STEP = 2048, 32
#: Occurrences sorted at once, unless one group has more.
TOGETHER = 4096
#: Bits of the map of groups that are above HOT when split, a power of two; fixed, so at a very large size other
#: groups are taken for such, and their windows are counted too.
FLAGS = 1 << 20
#: Bytes of what a text is named by.
KEY = 32


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every width consecutive values."""
    f, edge = (np.minimum, np.iinfo(x.dtype).max) if least else (np.maximum, np.iinfo(x.dtype).min)
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    a = np.full(rows * width, edge, x.dtype)
    a[: len(x)] = x
    a = a.reshape(rows, width)
    ahead = f.accumulate(a, axis=1).ravel()
    back = f.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of all texts: text number, anchor's hash, its place in data, and the first and last of the
    windows that have it. A long text is looked at in pieces that overlap."""
    out = []
    for k in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[k : k + PIECE + length - 1]
        inside = np.clip(bounds - k, 0, len(piece))
        n, h, *places = _anchors(piece, inside, length)
        out.append((n, h, *(x + k for x in places)))
    n, h, q, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(out) > 1:  # what two pieces share is one
        cut = np.append(True, (n[1:] != n[:-1]) | (q[1:] != q[:-1]) | (s[1:] != e[:-1] + 1))
        n, h, q, s, e = n[cut], h[cut], q[cut], s[cut], e[np.append(np.flatnonzero(cut)[1:], len(e)) - 1]
    return n, h, q, s, e


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(U), none, none, none
    h = hasher(4)
    g = mix(h.windows(h.prefix(data), GRAM))
    span = length - GRAM + 1
    m = sliding(g, span, True)
    ends = bounds[1:]
    text = np.searchsorted(bounds, np.arange(len(m)), "right") - 1
    s = np.flatnonzero((text < len(ends)) & (np.arange(len(m)) + length <= ends[np.minimum(text, len(ends) - 1)]))
    if not len(s):
        return none, none.astype(U), none, none, none
    # a gram is an anchor if it is as small as the largest minimum of the windows around it
    wide = np.concatenate([np.zeros(span - 1, U), m, np.zeros(span - 1, U)])
    spots = np.flatnonzero(g == sliding(wide, span, False)[: len(g)])
    i = np.searchsorted(spots, s)
    todo = np.arange(len(s))
    while len(todo):
        todo = todo[g[spots[i[todo]]] != m[s[todo]]]
        i[todo] += 1
    q = spots[i]
    new = np.append(True, (q[1:] != q[:-1]) | (text[s[1:]] != text[s[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return text[s[first]], g[q[first]], q[first], s[first], s[last]


def common(prefix: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows x and y, by binary search over hashes of beginnings."""
    low, high = np.zeros(len(x), np.int64), np.minimum(size[x], size[y])
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = prefix[x, mid] == prefix[y, mid]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _before(rows: np.ndarray, prefix: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """True where row x sorts before row y; ties decide for equal rows."""
    n = common(prefix, size, x, y)
    end_x, end_y = n == size[x], n == size[y]
    at = np.minimum(n, rows.shape[1] - 1)
    return np.where(end_x & end_y, ties, np.where(end_x, True, np.where(end_y, False, rows[x, at] < rows[y, at])))


def suffix_order(rows: np.ndarray, size: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows within each group (rows start, start + 1, ... of count), and the common beginning of
    each with the one before it (0 for the first of a group)."""
    n = len(rows)
    h = hasher(5)
    h._powers(rows.shape[1] + 1)
    prefix = np.zeros((n, rows.shape[1] + 1), U)
    np.cumsum(h.of[rows] * h.up[: rows.shape[1]], axis=1, out=prefix[:, 1:])
    order = np.arange(n)
    group = np.repeat(np.arange(len(start)), count)
    rank = np.arange(n) - start[group]
    width = 1
    while width < count.max(initial=0):
        live = np.flatnonzero(count[group] > width)
        g, r = group[live], rank[live]
        own = r // width
        sibling = own ^ 1
        s0 = np.minimum(sibling * width, count[g])
        s1 = np.minimum(s0 + width, count[g])
        low, high = s0.copy(), s1.copy()
        left = sibling < own
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) // 2
            go = _before(rows, prefix, size, order[start[g[todo]] + mid], order[live[todo]], left[todo])
            low[todo[go]] = mid[go] + 1
            high[todo[~go]] = mid[~go]
        to = start[g] + np.minimum(own, sibling) * width + (r - own * width) + (low - s0)
        after = order.copy()
        after[to] = order[live]
        order = after
        width *= 2
    lcp = np.zeros(n, np.int64)
    inner = np.flatnonzero(rank > 0)
    for k in range(0, len(inner), 4096):
        some = inner[k : k + 4096]
        x, y = order[some - 1], order[some]
        lcp[some] = common(prefix, size, x, y)
        differ = rows[x] != rows[y]
        exact = np.minimum(np.where(differ.any(1), differ.argmax(1), rows.shape[1]), np.minimum(size[x], size[y]))
        if (exact != lcp[some]).any():  # a hash collision: sort by the bytes themselves
            order = np.concatenate([s + np.array(sorted(range(c), key=lambda i: rows[s + i, : size[s + i]].tobytes()), np.int64) for s, c in zip(start, count, strict=True)])
            x, y = order[inner - 1], order[inner]
            differ = rows[x] != rows[y]
            lcp[inner] = np.minimum(np.where(differ.any(1), differ.argmax(1), rows.shape[1]), np.minimum(size[x], size[y]))
            break
    return order, lcp


def repeated(contexts: list[bytes], at: np.ndarray, count: np.ndarray, length: int) -> list[np.ndarray]:
    """For occurrences in groups of count: which of their windows (by place in the context) occur in another
    occurrence of the group. at: the anchor's place in the context."""
    n = len(contexts)
    size = np.array(list(map(len, contexts)))
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, length - GRAM), np.uint8)
    for i, x in enumerate(contexts):
        b = np.frombuffer(x, np.uint8)
        right[i, : size[i] - at[i]] = b[at[i] :]
        left[i, : at[i]] = b[at[i] - 1 :: -1] if at[i] else b[:0]
    start = np.cumsum(count) - count
    order_r, lcp_r = suffix_order(right, size - at, start, count)
    order_l, lcp_l = suffix_order(left, at, start, count)
    head = np.zeros(n, bool)
    head[start] = True
    low, high = at - (size - length), at  # places of the anchor in its windows
    out = [np.zeros(size[i] - length + 1, bool) for i in range(n)]
    flat = np.concatenate(out) if n else np.zeros(0, bool)
    base = np.cumsum(size - length + 1) - (size - length + 1)
    cls_r, cls_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t in range(int(low.min()), int(high.max()) + 1):
        live = np.flatnonzero((low <= t) & (t <= high))
        if len(live) < 2:
            continue
        cls_r[order_r] = np.cumsum(head | (lcp_r < length - t))
        cls_l[order_l] = np.cumsum(head | (lcp_l < t))
        key = cls_r[live] * (n + 1) + cls_l[live]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        some = live[times[which] > 1]
        flat[base[some] + at[some] - t] = True
    return np.split(flat, base[1:]) if n else []


def _runs(flags: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """Runs of bytes that the marked windows cover."""
    s = np.flatnonzero(flags)
    if not len(s):
        return []
    cut = np.flatnonzero(np.diff(s) > length)
    return [(first + int(s[a]), first + int(s[b]) + length) for a, b in zip(np.append(0, cut + 1), np.append(cut, len(s) - 1), strict=True)]


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, shorter: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per row of docs (with keep_text also kept, the
    remaining bytes): every byte goes that lies in a string of length bytes which also starts anywhere else,
    in this or another row. With shorter also n_repeated, the bytes in strings of so many bytes that also start
    elsewhere; none of these go.

    A null text is empty. Repeated rows, and rows of one id, remove each other's bytes if they have length bytes in common.
    A very long text is searched in overlapping pieces, so its matches are found as in any other. doc_id is copied as
    it is (null, too); other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    least = min(length, shorter or length)
    texts, name = _distinct(rows.where(F.octet_length("t") >= least), "texts")
    names = [name]
    found = _spans(texts, least)
    used = [found]
    if least < length:  # a longer string that repeats lies in a run of shorter ones
        runs = texts.select("c", "t").join(found, "c").select("c", "t", F.explode(F.filter("spans", lambda x: x["e"] - x["s"] >= length)).alias("x"))
        place = F.unhex(F.lpad(F.hex("x.s"), 8, "0"))
        parts = runs.select(F.concat("c", place).alias("c"), F.substring(F.col("t").cast("binary"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("t"))
        parts, name = _bucketed(parts, "parts")
        names.append(name)
        used.append(_spans(parts, length))
        at = F.conv(F.hex(F.substring("c", KEY + 1, 4)), 16, 10).cast("int")
        moved = used[-1].select(F.substring("c", 1, KEY).alias("c"), at.alias("at"), F.explode("spans").alias("x"))
        spans = moved.groupBy("c").agg(F.collect_list(F.struct((F.col("x.s") + F.col("at")).alias("s"), (F.col("x.e") + F.col("at")).alias("e"))).alias("spans"))
        judged = texts.join(spans, "c", "left").join(found.withColumnRenamed("spans", "wide"), "c", "left")
    else:
        judged = texts.join(found, "c", "left").withColumn("wide", F.col("spans"))
    judged = judged.select("c", "t", "copies", "spans", "wide")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for c, t, copies, spans, wide in zip(b.column(0).to_pylist(), b.column(1), *(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                raw = t.as_buffer().to_pybytes()
                gone, also = ([(x["s"], x["e"]) for x in y or ()] if copies < 2 else [(0, len(raw))] if len(raw) >= n else [] for y, n in ((spans, length), (wide, least)))
                gone = _merged(gone)
                left = [(a, z) for a, z in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(raw)], strict=True) if a < z]
                rest = b"".join(raw[a:z] for a, z in left)
                for col, v in zip(cols, (c, len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), sum(e - s for s, e in _merged(also)), [{"s": a, "n": z - a} for a, z in left] if gone else None), strict=True):
                    col.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], fields)

    fields = ["c", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "rest"]
    result = written(judged.mapInArrow(kept, "c binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, rest array<struct<s:int,n:int>>"), "judged")
    for x in used:
        dropped(spark, x)
    for name in names:
        files = spark.table(name).inputFiles()
        spark.sql(f"DROP TABLE {name}")
        removed(spark, files)
    raw = F.col("t").cast("binary")
    whole = rows.where(F.octet_length("t") < least).select("doc_id", "t", F.octet_length("t").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), F.lit(0).cast("long").alias("n_repeated"), F.lit(None).cast(result.schema["rest"].dataType).alias("rest"))
    keyed = rows.where(F.octet_length("t") >= least).select("doc_id", *(["t"] if keep_text else []), _key("t").alias("c"))
    out = keyed.join(result, "c").drop("c").unionByName(whole if keep_text else whole.drop("t"))
    # strings of bytes, whatever they are cut to
    left = F.array_join(F.transform("rest", lambda x: F.substring(F.col("t").cast("binary"), x["s"] + 1, x["n"]).cast("string")), "").cast("binary")
    more = ["n_repeated"] * (shorter is not None) + [F.when(F.col("rest").isNull(), raw).otherwise(left).alias("kept")] * keep_text
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *more)


def _spans(long: DataFrame, length: int) -> DataFrame:
    """c and spans (s, e) of its bytes that lie in strings of length bytes which also start elsewhere among long (c, t)."""
    spark = long.sparkSession

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for i, j in pieces(bounds):
                n, h, *places = anchors(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], length)
                o = np.lexsort((places[0], h, n))
                n, h = n[o], h[o]
                first = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (h[1:] != h[:-1]))) if len(n) else np.zeros(0, np.int64)
                own = (bounds[i : j + 1] - bounds[i])[n]
                spots = np.stack([x[o] - own for x in places], axis=1).astype(np.int32).ravel()
                ends = pa.array(3 * np.append(first, len(n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(n[first])), pa.array(h[first].view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(spots))], ["c", "h", "spots"])

    # a text's occurrences of an anchor travel as one row: place, first and last window of each. Occurrences are counted before
    # they are dealt, and a join may split those of an anchor that is very common
    met = written(long.where(F.octet_length("t") >= length).select("c", "t").mapInArrow(found, "c binary, h long, spots array<int>"), "anchors")
    often = met.groupBy("h").agg(F.sum(F.size("spots") / 3).cast("long").alias("size")).where("size > 1")
    seen = written(met.join(often, "h").groupBy("c").agg(F.collect_list(F.struct("h", "spots", "size")).alias("a")), "anchors")
    dropped(spark, met)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes around each anchor; equal ones of a batch go once, and are known to repeat."""
        schema = pa.schema([("k", pa.int64()), ("c", pa.binary()), ("lo", pa.int32()), ("at", pa.int32()), ("known", pa.bool_()), ("len", pa.int32()), ("ctx", pa.binary())])
        for b in (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256)):
            first: dict[tuple[int, bytes], list] = {}
            out: list[list] = []
            for c, t, found_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw, a = t.as_buffer().to_pybytes(), found_.values
                each = ((h, *spots[k : k + 3], size) for h, spots, size in zip(*(a.field(i).to_pylist() for i in range(3)), strict=True) for k in range(0, len(spots), 3))
                for h, q, lo, hi, size in each:
                    for key, x, y in _split(raw, h, q, lo, hi, length) if size > HOT else ((h, lo, hi),):
                        ctx = raw[x : y + length]
                        row = [key, c, x, q - x, False, len(ctx), ctx]
                        if (same := first.setdefault((key, ctx), row)) is not row:
                            same[4] = row[4] = True
                            row[6] = None
                        out.append(row)
            for k in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[k : k + 4096], strict=True), schema, strict=True)], schema=schema)

    around = written(long.join(seen, "c").select("c", "t", "a").mapInArrow(contexts, "k long, c binary, lo int, at int, known boolean, len int, ctx binary"), "contexts")
    dropped(spark, seen)
    # occurrences that had an equal one in their batch: all their bytes repeat
    whole = around.where("known").select("c", F.col("lo").alias("s"), (F.col("lo") + F.col("len")).alias("e"))
    flag = F.pmod(F.xxhash64("k"), F.lit(FLAGS))
    large = around.where("ctx IS NOT NULL").groupBy("k").count().where(F.col("count") > HOT).select(flag.alias("flag"))
    large = written(large.groupBy(F.expr("flag div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(flag % 64 AS int)))").alias("bits")), "large")
    each = around.where("ctx IS NOT NULL").withColumn("flag", flag)
    each = each.join(F.broadcast(large), F.expr("flag div 64 = word"), "left").withColumn("large", F.expr("getbit(coalesce(bits, 0L), cast(flag % 64 AS int)) = 1"))
    together = each.where("NOT large").select(around.columns).repartition("k").sortWithinPartitions("k")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows by their hash; one that comes again goes without it, and both are known to repeat."""
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, TOGETHER):
                b = whole_batch.slice(k, TOGETHER)
                first: dict[bytes, int] = {}
                keys, texts_, starts, known = [], [], [], []
                for c, lo, ctx in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    for i in range(len(ctx) - length + 1):
                        w = hashlib.blake2b(ctx[i : i + length], digest_size=32).digest()
                        n = first.setdefault(w, len(keys))
                        again = n < len(keys)
                        known.append(again)
                        known[n] = again
                        keys.append(None if again else w)
                        texts_.append(c)
                        starts.append(lo + i)
                out = [pa.array(keys, pa.binary()), pa.array(texts_, pa.binary()), pa.array(starts, pa.int32()), pa.array(known, pa.bool_())]
                for j in range(0, len(keys), 1 << 14):
                    yield pa.RecordBatch.from_arrays([x.slice(j, 1 << 14) for x in out], ["w", "c", "s", "known"])

    single = written(each.where("large").select("c", "lo", "ctx").mapInArrow(windows, "w binary, c binary, s int, known boolean"), "windows")
    often = single.where("w IS NOT NULL").groupBy("w").count().where(F.col("count") > 1).select("w")
    counted = single.where("known").select("c", "s").unionByName(single.where("NOT known").join(often, "w", "left_semi").select("c", "s"))
    # windows fewer than GRAM bytes apart overlap, so what lies between them goes as well
    counted = counted.groupBy("c", F.expr(f"s div {GRAM}")).agg(F.min("s").alias("s"), (F.max("s") + length).alias("e")).select("c", "s", "e")

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def out(g: pd.DataFrame) -> pd.DataFrame:
            k = g["k"].to_numpy()
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            count = np.diff(np.append(first, len(k)))
            g, count, spans = g[np.repeat(count > 1, count)], count[count > 1], []
            ends, at = np.cumsum(count), 0
            while at < len(count):  # whole groups, some thousand occurrences at a time
                b0 = ends[at] - count[at]
                to = max(at + 1, int(np.searchsorted(ends, b0 + TOGETHER, "right")))
                some = g.iloc[b0 : ends[to - 1]]
                flags = repeated(some["ctx"].tolist(), some["at"].to_numpy(np.int64), count[at:to], length)
                for c, lo, f in zip(some["c"], some["lo"], flags, strict=True):
                    spans += [(c, s, e) for s, e in _runs(f, lo, length)]
                at = to
            return pd.DataFrame(spans, columns=["c", "s", "e"])

        for b in batches:
            b = b if held is None else pd.concat([held, b])
            k = b["k"].to_numpy()
            end = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if end:
                yield out(b.iloc[:end])
            held = b.iloc[end:]
        if held is not None and len(held):
            yield out(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[{"s": s, "e": e} for s, e in _merged([(x["s"], x["e"]) for x in y])] for y in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["c", "spans"])

    spans = together.mapInPandas(marked, "c binary, s int, e int")
    per = spans.unionByName(whole).unionByName(counted).groupBy("c").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    per = written(per.mapInArrow(joined, "c binary, spans array<struct<s:int,e:int>>"), "spans")
    for used in (around, large, single):
        dropped(spark, used)
    return per


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _split(raw: bytes, h: int, q: int, lo: int, hi: int, length: int) -> Iterator[tuple[int, int, int]]:
    """Cuts the windows of an anchor by its place in them; each part is keyed by the bytes that all its
    windows have, so windows that are equal stay together."""
    for b in range((q - hi) // STEP, (q - lo) // STEP + 1):
        core = raw[q - b * STEP : q - b * STEP + length - STEP + 1]
        key = hashlib.blake2b(core, digest_size=8, key=(h & (2**64 - 1)).to_bytes(8, "little") + bytes([b])).digest()
        yield int.from_bytes(key, "little", signed=True), max(lo, q - b * STEP - STEP + 1), min(hi, q - b * STEP)


def _key(t: str) -> Column:
    """Names a text: its SHA-256, as bytes."""
    return F.unhex(F.sha2(F.col(t).cast("binary"), 256))


def _distinct(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """c, copies and t, each text once, as a bucketed table. Equal texts of a batch are counted before they are sent."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[bytes, list[int]] = {}
            for i, c in enumerate(b.column(0).to_pylist()):
                n.setdefault(c, [i, 0])[1] += 1
            some = pa.array([i for i, _ in n.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), pa.array([k for _, k in n.values()], pa.int64())], ["c", "t", "copies"])

    return _bucketed(rows.select(_key("t").alias("c"), "t").mapInArrow(counted, "c binary, t string, copies long"), name)


def _buckets(spark: SparkSession, partitions: int) -> int:
    """As many as the input has partitions, within what Spark allows; fewer than shuffle partitions would be dealt anew by
    every join. Where the limit is lower than the input wants, buckets are read as tasks of several files."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions))


def _bucketed(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """rows (c, t, ...) once per c as a table bucketed by c, so that later joins on c move no texts; and its name in
    the catalog, from which it is to be dropped."""
    spark = rows.sparkSession
    buckets = _buckets(spark, rows.rdd.getNumPartitions())
    name = f"{name}_{uuid.uuid4().hex}"
    once = rows.repartition(buckets, "c").groupBy("c").agg(*([F.sum("copies").alias("copies")] if "copies" in rows.columns else []), F.first("t").alias("t"))
    once.write.bucketBy(buckets, "c").option("parquet.block.size", 32 << 20).option("path", new_path(spark, "texts")).saveAsTable(name)
    return spark.table(name), name
