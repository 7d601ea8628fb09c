"""Exact top-k inner products over a pivot-distance index.

Integer vectors v get one more component, sqrt(M^2 - |v|^2) with M the largest norm, and queries a
zero there; then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so the highest scores are the nearest points. Each
vector is keyed by its nearest pivot and its distance to it; sorted runs of a pivot's keys are
the annuli, stored as blocks, and consecutive blocks are a group that a task holds. Queries, far fewer than vectors,
travel in blocks: first to the few annuli that are nearest, which bounds the distance of their k-th best; then, in waves, to the
groups of these annuli and to sixteen times as many of the nearest ones each time, until the bound, which each wave tightens, reaches
no other group. So a query gets some multiple of k rows a wave, not k rows a group. There the annuli are expanded outwards, and one is left out for a query
whose k-th best distance so far is below |d(q, pivot) - r| for every radius r in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import dropped, small_batches, written
from tidemark.llm.vectors import finite, stacked

#: Groups of the second wave, and how much larger each wave is than the one before.
GROWTH = 16
EXACT = 2.0**53  # doubles hold every integer up to here
NONE = np.iinfo(np.int64).min


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where those are exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < EXACT else a @ b.T


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row; NONE where there are fewer."""
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(s), NONE)


class Space:
    """Pivots and the largest norm, which every task needs."""

    def __init__(self, pivots: np.ndarray, top: float, kind: type):
        self.top, self.pivots, self.kind, self.dim = top, pivots.astype(float), kind, pivots.shape[1]
        self.lift = np.sqrt(np.maximum(0, top - (self.pivots**2).sum(1)))
        self.slack = 1e-6 * (1 + np.sqrt(top))  # far above the rounding of distances

    def vectors(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dim).astype(np.int64)

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        """To every pivot, from vectors or from queries."""
        v = v.astype(float)
        own = (v**2).sum(1)
        up = 0 * own if query else np.sqrt(np.maximum(0, self.top - own))
        flat = own[:, None] - 2 * v @ self.pivots.T + (self.pivots**2).sum(1)
        return np.sqrt(np.maximum(0, flat) + (up[:, None] - self.lift) ** 2)

    def reach(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Distance beyond which no vector scores as high as the k-th."""
        far = np.sqrt(np.maximum(0, (q.astype(float) ** 2).sum(1) + self.top - 2 * kth.astype(float)))
        return np.where(kth == NONE, np.inf, far) + self.slack


class Best:
    """The k best of each query of a block, ties to the smaller id."""

    def __init__(self, qids: np.ndarray, floor: np.ndarray, k: int):
        self.qids, self.floor, self.k, self.n = qids, floor.copy(), k, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, live: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Scores of the queries live with the vectors ids."""
        s = np.where(self.qids[live][:, None] == ids, NONE, s)
        low = self.floor[live] == NONE  # else the bound is as good as what one annulus gives
        if low.any():
            self.floor[live[low]] = _kth(s[low], self.k)
        row, col = np.nonzero((s >= self.floor[live][:, None]) & (s != NONE))
        self.parts.append((live[row], ids[col], s[row, col]))
        self.n += len(row)
        if self.n > 4 * self.k * len(self.qids):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of the best; what can't be among them is forgotten."""
        q, ids, s = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3
        o = np.lexsort((ids, -s, q))
        q, ids, s = q[o], ids[o], s[o]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        keep = nth < self.k
        self.parts, self.n = [(q[keep], ids[keep], s[keep])], int(keep.sum())
        return self.parts[0]


def _searched(space: Space, k: int):
    """For each group in turn: its annuli are held, then the query blocks that follow them are asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, []
        for b in batches:
            for r in b.itertuples(index=False):
                if group != r.own:
                    group, held = r.own, []
                v, ids = space.vectors(r.vs), np.frombuffer(r.ids, np.int64)
                if r.kth is None:
                    held.append((r.pivot, r.low, r.high, ids, v))
                    continue
                best = Best(ids, np.frombuffer(r.kth, np.int64), k)
                d = space.distances(v, True)[:, [x[0] for x in held]]
                lower = np.maximum(0, np.maximum(d - [x[2] for x in held], [x[1] for x in held] - d))
                for i in np.argsort(lower.min(0), kind="stable"):  # outwards from the queries
                    live = np.flatnonzero(lower[:, i] <= space.reach(v, best.floor))
                    if len(live):
                        best.add(live, held[i][3], _scores(v[live], held[i][4]))
                q, vec, s = best.cut()
                yield pd.DataFrame({"query_id": ids[q], "vec_id": vec, "score": s})

    return run


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = 32, block: int = 1024, queries: int = 1024, group_bytes: int = 32 << 20, nearest: int = 4, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors where is_query, the k rows of another
    id with the highest inner product of floor(scale * x), ties to the smaller id.

    Rows with a null id, and vectors that are null or hold a null or non-finite component, take no
    part; a shorter vector counts as filled with zeros, an empty one scores 0; repeated rows are
    separate candidates; of the rows of an id that ask, the least vector does, so a repeated query has one result; other
    columns (texts, too) are ignored, whatever their names; an empty table gives an empty result. Scores must fit in 64 bits.
    Pivots are at most so many rows, the smallest by hash of id; every row is indexed and the result is exact for any
    pivots. block, queries: rows of an annulus and of a query block; group_bytes: bytes of vectors that a task holds;
    nearest: annuli of the first bound.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = vectors.where(F.col(vec_id).isNotNull() & finite(embedding)).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top, dim, most = v.agg(F.max(norm), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = next(x for x in (np.int16, np.int32, np.int64) if most <= np.iinfo(x).max)
    got = v.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).collect()
    space = Space(stacked([r["v"] for r in got], dim, np.int64), top, kind)
    in_group = max(1, group_bytes // (np.dtype(kind).itemsize * dim * block))

    def keyed(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = stacked(b["v"], dim, np.int64)
                d = space.distances(x, query)
                near = d.argmin(1)
                yield pd.DataFrame({"pivot": near.astype(np.int32), "r": d[np.arange(len(x)), near], "id": b["id"], "v": list(map(bytes, x.astype(kind)))})

        return run

    def packed(rows: int):
        """Consecutive rows of one pivot become blocks, consecutive blocks groups."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            part, n = TaskContext.get().partitionId() << 32, 0

            def out() -> dict:
                nonlocal n
                g = pd.concat(held)
                held.clear()
                n += 1
                return {"block": part + n - 1, "own": part + (n - 1) // in_group, "pivot": g["pivot"].iloc[0], "low": g["r"].iloc[0], "high": g["r"].iloc[-1], "ids": g["id"].to_numpy(np.int64).tobytes(), "vs": b"".join(g["v"])}

            for b in batches:
                done = []
                cut = np.flatnonzero(np.diff(b["pivot"])) + 1
                for i, j in zip([0, *cut], [*cut, len(b)], strict=True):
                    if held and i < j and held[0]["pivot"].iloc[0] != b["pivot"].iloc[i]:
                        done.append(out())
                    while i < j:
                        m = min(j - i, rows - sum(map(len, held)))
                        held.append(b.iloc[i : i + m])
                        i += m
                        if sum(map(len, held)) == rows:
                            done.append(out())
                yield pd.DataFrame(done, columns=["block", "own", "pivot", "low", "high", "ids", "vs"])
            if held:
                yield pd.DataFrame([out()])

        return run

    def blocks(rows: DataFrame, query: bool, size: int, name: str) -> DataFrame:
        keys = rows.select("id", "v").mapInPandas(keyed(query), "pivot int, r double, id long, v binary")
        ordered = keys.repartitionByRange("pivot", "r", "id").sortWithinPartitions("pivot", "r", "id")
        return written(ordered.mapInPandas(packed(size), "block long, own long, pivot int, low double, high double, ids binary, vs binary"), name)

    data = blocks(v, False, block, "annuli")
    asked = blocks(v.where("q").groupBy("id").agg(F.min("v").alias("v")), True, queries, "queries")

    # the annuli of its own pivot that are nearest to a query block
    mid = (F.col("low") + F.col("high")) / 2
    close = asked.select(F.col("block").alias("qblock"), "pivot", mid.alias("r")).join(data.select("block", "pivot", mid.alias("m")), "pivot")
    nth = F.row_number().over(Window.partitionBy("qblock").orderBy(F.abs(F.col("r") - F.col("m")), "block"))
    near = close.withColumn("nth", nth).where(F.col("nth") <= nearest).select("qblock", "block")
    close = asked.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vs").alias("qvs")).join(near, "qblock", "left").join(data.select("block", "ids", "vs"), "block", "left")

    def bounded(g: pd.DataFrame) -> pd.DataFrame:
        """For a query block the k-th scores among its nearest annuli, and for each pivot the ring that may hold more."""
        q, ids = space.vectors(g["qvs"].iloc[0]), np.frombuffer(g["qids"].iloc[0], np.int64)
        there = g[g["vs"].notna()]
        s = [np.where(ids[:, None] == np.frombuffer(i, np.int64), NONE, _scores(q, space.vectors(x))) for i, x in zip(there["ids"], there["vs"], strict=True)]
        kth = _kth(np.concatenate(s, axis=1), k) if s else np.full(len(q), NONE)
        d, far = space.distances(q, True), space.reach(q, kth)[:, None]
        return pd.DataFrame({"block": [g["qblock"].iloc[0]], "kth": [kth.tobytes()], "inner": [(d - far).min(0)], "outer": [(d + far).max(0)]})

    kind_of_bounds = "block long, kth binary, inner array<double>, outer array<double>"
    bounds = written(close.groupBy("qblock").applyInPandas(bounded, kind_of_bounds), "bounds")
    spans = data.groupBy("own", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    names = ["own", "block", "pivot", "low", "high", "ids", "vs", "kth"]

    def reached(b: DataFrame) -> DataFrame:
        """Query blocks and the groups that their bounds reach."""
        rings = b.select("block", F.posexplode(F.arrays_zip("inner", "outer")).alias("pivot", "ring")).select("block", "pivot", "ring.*")
        middle = (F.col("inner") + F.col("outer")) / 2
        gap = F.greatest(F.col("low") - middle, middle - F.col("high"))
        return rings.join(spans, "pivot").where("low <= outer AND high >= inner").groupBy("block", "own").agg(F.min(gap).alias("gap"))

    def searched(b: DataFrame, pairs: DataFrame) -> DataFrame:
        """What these groups have for these blocks that the bound leaves open. Groups that no block asks are not read."""
        asks = asked.select("block", "pivot", "low", "high", "ids", "vs").join(b.select("block", "kth"), "block").join(pairs, "block")
        held = data.withColumn("kth", F.lit(None).cast("binary")).join(pairs.select("own").distinct(), "own", "left_semi")
        work = held.select(names).unionByName(asks.select(names)).repartition("own").sortWithinPartitions("own", F.col("kth").isNotNull(), "block")
        return written(work.mapInPandas(_searched(space, k), "query_id long, vec_id long, score long"), "found")

    def tightened(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """A block's bounds from the k-th scores found so far, where these are better."""
        q, ids, kth = space.vectors(left["vs"].iloc[0]), np.frombuffer(left["ids"].iloc[0], np.int64), np.frombuffer(left["kth"].iloc[0], np.int64).copy()
        o = np.argsort(ids)
        at = o[np.searchsorted(ids, right["query_id"].to_numpy(np.int64), sorter=o)]
        kth[at] = np.maximum(kth[at], right["kth"].to_numpy(np.int64))
        d, far = space.distances(q, True), space.reach(q, kth)[:, None]
        return pd.DataFrame({"block": left["block"], "kth": [kth.tobytes()], "inner": [(d - far).min(0)], "outer": [(d + far).max(0)]})

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, ids in zip(b["block"], b["ids"], strict=True):
                yield pd.DataFrame({"query_id": np.frombuffer(ids, np.int64)}).assign(block=block)

    queried = written(asked.select("block", "ids").mapInPandas(members, "query_id long, block long"), "queried")
    own = near.join(data.select("block", "own"), "block").select(F.col("qblock").alias("block"), "own").distinct()
    wave = written(reached(bounds).join(own, ["block", "own"]).select("block", "own"), "pairs")
    done, found, n = [wave], [], GROWTH
    while True:
        found.append(searched(bounds, wave))
        best = reduce(DataFrame.unionByName, found).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
        best = best.select("query_id", F.get("s", F.lit(k - 1)).alias("kth")).where("kth IS NOT NULL").join(queried, "query_id")
        left = asked.select("block", "ids", "vs").join(bounds.select("block", "kth"), "block")
        before, bounds = bounds, written(left.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(tightened, kind_of_bounds), "bounds")
        dropped(spark, before)
        rest = reached(bounds).join(reduce(DataFrame.unionByName, done), ["block", "own"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("block").orderBy("gap", "own"))
        wave = written(rest.withColumn("nth", nth).where(F.col("nth") <= n).select("block", "own"), "pairs")
        if wave.isEmpty():
            break
        done.append(wave)
        n *= GROWTH
    for x in (data, asked, bounds, queried, wave, *done):
        dropped(spark, x)
    found = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
