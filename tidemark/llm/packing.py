"""Hierarchical packing of token ids into windows of several lengths.

Documents are cut into whole windows of the largest tier and a rest; a rest is routed to the smallest tier
that holds it. From the longest rest on, each opens a window of its tier; the gap is filled with
the longest shorter rests that fit, and at last by a cut of the shortest one. Windows are therefore full. What is
left at the end of a task is cut at powers of two. Over the whole table the windows of a tier are then dealt in order to
step groups of equally many ids.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import small_batches, written
from tidemark.llm.tokens import encoded

TIERS = (256, 512, 1024, 2048, 4096)
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, part int, before long"
Piece = tuple[int, int, int]  # document, start, length


def pack(rests: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of the last window, which nothing is left to fill."""
    pool = sorted((n, d, s) for d, s, n in rests)
    full: list[list[Piece]] = []
    while pool:
        n, d, s = pool.pop()
        gap = tiers[bisect_left(tiers, n)] - n
        window = [(d, s, n)]
        while gap and pool:
            i = bisect_left(pool, (gap + 1,)) - 1
            if i >= 0:
                n, d, s = pool.pop(i)
                window.append((d, s, n))
                gap -= n
            else:
                n, d, s = pool.pop(0)
                window.append((d, s, gap))
                insort(pool, (n - gap, d, s + gap))
                gap = 0
        if gap:
            return full, window
        full.append(window)
    return full, []


def closed(rest: list[Piece], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Windows at powers of two that hold all of rest."""
    out: list[list[Piece]] = []
    left = sum(n for _, _, n in rest)
    room, todo = 0, rest[::-1]
    while todo:
        if not room:
            room = min(tiers[-1], 1 << (left.bit_length() - 1))
            out.append([])
        d, s, n = todo.pop()
        take = min(n, room)
        out[-1].append((d, s, take))
        room, left = room - take, left - take
        if take < n:
            todo.append((d, s + take, n - take))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_ids: int = 1 << 20, hold_ids: int = 1 << 22, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset, tier (the smallest that holds the sequence) and step_group, which has windows of one tier.

    Every partition packs its own documents, about hold_ids ids at a time, and hands what does not fill a
    window on to the next round; no shuffle is needed and memory is bounded. Then each tier gets as many step groups as
    come nearest to step_ids ids a group, and they differ by less than two windows. A null text is empty (its only
    id is end_id); a very long text fills windows of the largest tier, and its rest goes with the others; documents of one
    length are taken in the order they come. doc_id is copied as it is, null too; repeated rows are packed each; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        seen, held, rests = 0, 0, []
        steps: dict[int, int] = defaultdict(int)  # ids so far, by tier

        def out(windows: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal seen
            cols: list[list] = [[] for _ in range(10)]
            for w in windows:
                size = sum(n for _, _, n in w)
                tier, at = tiers[bisect_left(tiers, size)], 0
                for d, s, n in w:
                    for c, v in zip(cols, (names[d], s, n, ids[d][s : s + n].astype("<u4").tobytes(), len(ids[d]), (part << 40) + seen, at, tier, part, steps[tier]), strict=True):
                        c.append(v)
                    at += n
                steps[tier] += size
                seen += 1
                if len(cols[0]) >= 1024:
                    yield batch(cols)
                    cols = [[] for _ in range(10)]
            if cols[0]:
                yield batch(cols)

        def batch(cols: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, rests, names, ids
            top = tiers[-1]
            whole = [[(d, s, top)] for d, s, n in rests for s in range(s, s + n - top + 1, top)]  # noqa: B020
            tails = [(d, s + n // top * top, n % top) for d, s, n in rests if n % top]
            full, left = pack(tails, tiers)
            yield from out(whole + full)
            kept = sorted({d for d, _, _ in left})
            names, ids = [names[d] for d in kept], [ids[d] for d in kept]
            rests = [(kept.index(d), s, n) for d, s, n in left]
            held = sum(n for _, _, n in rests)

        for b in batches:
            own = b.column(0).to_pylist()
            for i, _, flat, ends in encoded(b.column(1), tokenizer, end_id):
                for k in range(len(ends) - 1):
                    rests.append((len(names), 0, int(ends[k + 1] - ends[k])))
                    names.append(own[i + k])
                    ids.append(flat[ends[k] : ends[k + 1]])
                held += len(flat)
                if held >= hold_ids:
                    yield from flush()
        yield from flush()
        yield from out(closed(rests, tiers))

    got = written(rows.mapInArrow(packed, PIECES), "packed", row_group=8 << 20, codec="zstd")
    # ids of a tier in the parts before, and in all: a row for each part and tier, however large the parts are
    own = got.groupBy("part", "tier").agg(F.sum("length").alias("ids"))
    of_tier = Window.partitionBy("tier")
    all_ids = F.sum("ids").over(of_tier)
    own = own.select("part", "tier", (F.sum("ids").over(of_tier.orderBy("part")) - F.col("ids")).alias("earlier"), all_ids.alias("all"), F.greatest(F.lit(1), F.round(all_ids / step_ids)).cast("long").alias("groups"))
    group = F.expr("(earlier + before) * groups div all")
    return got.join(F.broadcast(own), ["part", "tier"]).select(*[x.split()[0] for x in PIECES.split(", ")][:8], (F.col("tier").cast("long") * (1 << 40) + group).alias("step_group"))
