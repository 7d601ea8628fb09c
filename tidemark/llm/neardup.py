"""Near-duplicate embeddings by lattice hashing.

Each table projects unit vectors with fixed Gaussian numbers to one or several times 8 dimensions and decodes each
eight to the nearest point of the E8 lattice (Conway and Sloane, 1982); the points together are the cell. The more vectors,
the smaller the cells (a narrower lattice, then two eights), and the number of tables follows from how often two vectors
at the threshold meet in one. A vector is entered in its own cell and in neighbouring cells, those whose points are next
nearest, and it is compared with the vectors of a cell where one of the two is at home. Entries travel with the signs of
some projections only; vectors follow where these leave a pair possible. Cosines are computed from the whole vectors, so
what is linked is right; what a vector's cells miss is not linked (see the measured recall in the README).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import U, couples, mix, runs
from tidemark.llm.tables import components, dropped, small_batches, written
from tidemark.llm.vectors import finite, stacked

#: Vectors from which on cells become smaller, and from which on they are of two eights.
FEW, MANY = 5_000, 1_500_000
#: Share of the pairs at the threshold that the tables are to bring together.
RECALL = 0.985
#: Signs that travel with an entry, and how many standard deviations from what is expected at the threshold they may be.
SIGNS, SURE = 128, 4.5


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(out, pairs, strict=True):
        row[i], row[j] = a, b
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.vstack([out, halves])


SHORTEST = _shortest()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    y = np.rint(x)
    e = x - y
    odd = np.flatnonzero(y.sum(1) % 2)
    k = np.abs(e[odd]).argmax(1)
    y[odd, k] += np.where(e[odd, k] >= 0, 1, -1)
    return y


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of D8, or of D8 shifted by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(points.shape[:-1], salt, U)
    for i in range(points.shape[-1]):
        h = mix(h + (2 * points[..., i]).astype(np.int64).astype(U) + U(i + 1))
    return h


@lru_cache
def _gauss(seed: int, table: int, dim: int, to: int) -> np.ndarray:
    return np.random.default_rng([seed, table, dim]).normal(size=(dim, to))


def cells(u: np.ndarray, tables: int, probes: int, width: float, eights: int = 1, seed: int = 11) -> np.ndarray:
    """Keys of unit vectors: for each table the home cell, then its probes; the lowest bit marks a home."""
    dim, out = u.shape[1], []
    for t in range(tables):
        x = (u @ _gauss(seed, t, dim, 8 * eights) / width).reshape(len(u), eights, 8)
        y = e8(x.reshape(-1, 8)).reshape(x.shape)
        # all neighbours are as far from y, so those are nearest to x that lie in its direction
        toward = ((x - y).astype(np.float32) @ SHORTEST.T.astype(np.float32)).reshape(len(u), -1)
        points = np.repeat(y[:, None], 1 + probes, axis=1)
        rows = np.arange(len(u))
        for k in range(probes):
            near = toward.argmax(1)
            points[rows, k + 1, near // len(SHORTEST)] += SHORTEST[near % len(SHORTEST)]
            toward[rows, near] = -np.inf
        h = _key(points.reshape(len(u), 1 + probes, 8 * eights), t * 1_000_003 + dim) & ~U(1)
        h[:, 0] |= U(1)
        out.append(h)
    return np.concatenate(out, axis=1)


def signs(u: np.ndarray, seed: int = 12) -> np.ndarray:
    """Signs of fixed projections, as 64-bit words."""
    return np.packbits(u @ _gauss(seed, 0, u.shape[1], SIGNS) > 0, axis=1).view(U)


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of keys of two vectors whether they share a cell where one is at home."""
    same = ((a[:, :, None] & ~U(1)) == (b[:, None, :] & ~U(1))) & (((a[:, :, None] | b[:, None, :]) & U(1)) == U(1))
    return same.any((1, 2))


def at_threshold(dim: int, cosine: float, n: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors of just this cosine, in random directions."""
    rng = np.random.default_rng([13, dim])
    u, w = rng.normal(size=(2, n, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    return u, cosine * u + math.sqrt(1 - cosine**2) * w


def cell_shape(n: int) -> tuple[int, float]:
    """Eights of a cell, and width of the lattice, for n vectors: what a vector meets by chance grows more slowly than n,
    at the price of more tables."""
    return (1, 2.0 * min(1.0, FEW / max(n, 1)) ** (1 / 12)) if n <= MANY else (2, 2.4 * (MANY / n) ** (1 / 20))


def tables_for(dim: int, cosine: float, probes: int, width: float, eights: int) -> int:
    """Tables that bring together RECALL of the pairs at the threshold."""
    if dim < 2:
        return 2
    u, v = at_threshold(dim, cosine)
    one = np.mean([meet(cells(u, 1, probes, width, eights, seed), cells(v, 1, probes, width, eights, seed)).mean() for seed in (21, 22)])
    return max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - min(max(one, 1e-3), 0.999))))


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.9, probes: int = 2, shape: tuple[int, float] | None = None, block: int = 2048, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each row of vectors.

    Equal vectors are one class that is hashed once. Within a cell of at most block classes, or
    between two such parts of a larger cell, links are counted in place: a pair counts in the
    smallest of the cells that it shares, and leaves no row of its own. Vectors that are null, empty
    or zero, or hold a null or non-finite component, and rows with a null id link with nothing and are kept
    (component_id is their own id). Vectors of different lengths don't link. Repeated rows, and rows of one id, link with
    each other if their vectors do. Other columns (texts, too) are ignored, whatever their names; an empty table gives an
    empty result. shape: how many eights of dimensions make a cell, and the width of the lattice; by the number of vectors
    where it is None.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    norm = F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = F.when(F.col(vec_id).isNotNull() & finite(embedding) & (norm > 0), F.col(embedding))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(7), "v")})
    able = rows.where("v IS NOT NULL")
    classes = written(able.groupBy("k1", "k2").agg(F.any_value("v").alias("v"), F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("c", F.monotonically_increasing_id()), "classes")
    n, dims = classes.agg(F.count("*"), F.slice(F.collect_set(F.size("v")), 1, 64)).first()
    eights, width = shape or cell_shape(n)
    known = {d: tables_for(d, cosine, probes, width, eights) for d in dims}  # other lengths get their number where they are met
    q = math.acos(min(1, max(-1, cosine))) / math.pi
    apart = math.ceil(SIGNS * q + SURE * math.sqrt(SIGNS * q * (1 - q)))

    def entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, g in b.groupby(b["v"].map(len)):
                if d not in known:
                    known[d] = tables_for(d, cosine, probes, width, eights)
                for k in range(0, len(g), 1024):
                    some = g.iloc[k : k + 1024]
                    x = np.stack(some["v"].to_numpy()).astype(float)
                    x /= np.sqrt((x**2).sum(1))[:, None]
                    yield pd.DataFrame({"c": some["c"].to_numpy(), "keys": [r.tobytes() for r in cells(x, known[d], probes, width, eights)], "signs": [r.tobytes() for r in signs(x)]})

    hashed = written(classes.select("c", "v").mapInPandas(entered, "c long, keys binary, signs binary"), "cells")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):
                some = b.iloc[k : k + 256]
                keys = [np.frombuffer(x, np.int64) for x in some["keys"]]
                times, keys = list(map(len, keys)), np.concatenate(keys)
                yield pd.DataFrame({"key": keys & ~1, "home": (keys & 1).astype(bool), "c": np.repeat(some["c"].to_numpy(), times), "signs": np.repeat(some["signs"].to_numpy(), times)})

    def dealt(entries: DataFrame) -> DataFrame:
        """Cells with two vectors, one at home, in pairs of parts of at most about block rows."""
        full = entries.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 AND homes > 0").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
        return (
            entries.join(full, "key")
            .withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .drop("parts")
            .withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
            .drop("other")
        )

    def in_cells(fn):
        """Applies fn to whole cells (or pairs of parts of one), many at a time."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for b in batches:
                b = b if held is None else pd.concat([held, b], ignore_index=True)
                start, _ = runs([b[x].to_numpy() for x in ("key", "i", "j")])
                last = start[-1] if len(start) else 0
                if last:
                    yield from fn(b.iloc[:last])
                held = b.iloc[last:].reset_index(drop=True)
            if held is not None and len(held):
                yield from fn(held)

        return run

    def found_in(g: pd.DataFrame, of_pairs, of_block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs of rows of a cell, one at home in it, that pass: of_pairs looks at many cells with few rows,
        of_block at the rows a against the rows b of one with many."""
        home, part, i, j = (g[x].to_numpy() for x in ("home", "part", "i", "j"))
        start, size = runs([g["key"].to_numpy(), i, j])
        few = size <= 64
        out = []
        for a, b in couples(start[few], size[few]):
            ok = (home[a] | home[b]) & ((i[a] == j[a]) | (part[a] != part[b]))
            a, b = a[ok], b[ok]
            ok = of_pairs(a, b)
            out.append((a[ok], b[ok]))
        if out:
            yield tuple(map(np.concatenate, zip(*out, strict=True)))
        for s, n in zip(start[~few], size[~few], strict=True):
            rows = np.arange(s, s + n)
            left, right = rows[part[rows] == i[s]], rows[part[rows] == j[s]]
            for k in range(0, len(left), 256):
                a = left[k : k + 256]
                ok = of_block(a, right) & (home[a][:, None] | home[right])
                if i[s] == j[s]:
                    ok &= a[:, None] < right
                a, b = np.nonzero(ok)
                yield left[k + a], right[b]

    def possible(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Entries that have another one in the cell whose signs are near enough."""
        s = np.frombuffer(b"".join(g["signs"]), U).reshape(len(g), -1)
        has = np.zeros(len(g), bool)
        for a, b in found_in(g, lambda a, b: np.bitwise_count(s[a] ^ s[b]).sum(1, dtype=np.int64) <= apart, lambda a, b: np.bitwise_count(s[a][:, None] ^ s[b]).sum(2, dtype=np.int64) <= apart):
            has[a] = has[b] = True
        yield g.loc[has, ["key", "home", "c"]]

    entries = hashed.mapInPandas(spread, "key long, home boolean, c long, signs binary")
    near = dealt(entries).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = written(near.select("key", "i", "j", "part", "home", "c", "signs").mapInPandas(in_cells(possible), "key long, home boolean, c long").distinct(), "near")

    def linked(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Links that belong to no smaller cell, and what the links of a cell connect."""
        size = g["v"].map(len).to_numpy()
        x = stacked(g["v"], int(size.max()), float)
        x /= np.sqrt((x**2).sum(1))[:, None]
        c, copies, key, keys = g["c"].to_numpy(), g["copies"].to_numpy(), g["key"].to_numpy(), [np.frombuffer(k, np.int64) for k in g["keys"]]
        similar = lambda a, b: (np.einsum("ij,ij->i", x[a], x[b]) >= cosine) & (size[a] == size[b])
        for a, b in found_in(g, similar, lambda a, b: (x[a] @ x[b].T >= cosine) & (size[a][:, None] == size[b])):
            links = np.zeros(len(g), np.int64)
            for d in np.unique(size[a]):  # vectors of one length have as many keys
                of_size = size[a] == d
                for s in range(0, of_size.sum(), 1024):
                    y, z = a[of_size][s : s + 1024], b[of_size][s : s + 1024]
                    p, q = (np.stack([keys[i] for i in rows_]) for rows_ in (y, z))
                    same = ((p[:, :, None] & ~1) == (q[:, None, :] & ~1)) & (((p[:, :, None] | q[:, None, :]) & 1) == 1)
                    own = np.where(same.any(2), p & ~1, np.iinfo(np.int64).max).min(1) == key[y]
                    np.add.at(links, y[own], copies[z[own]])
                    np.add.at(links, z[own], copies[y[own]])
            low, was = c.copy(), None
            while was is None or (was != low).any():  # the smallest class that these links reach
                was = low.copy()
                np.minimum.at(low, a, low[b])
                np.minimum.at(low, b, low[a])
            ends = np.unique(np.concatenate([a, b]))
            yield pd.DataFrame({"c": c[ends], "links": links[ends], "hub": low[ends]})

    work = dealt(near).join(classes.select("c", "v", "copies"), "c").join(hashed.select("c", "keys"), "c").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = written(work.select("key", "i", "j", "part", "home", "c", "keys", "v", "copies").mapInPandas(in_cells(linked), "c long, links long, hub long"), "found")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("c").alias("a"), F.col("hub").alias("b")))
    named = classes.select("k1", "k2", "c", "low", "copies").join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    per = named.join(lowest, "component").join(links, "c", "left").select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    per = written(per, "classes")
    for x in (classes, hashed, near, found):
        dropped(spark, x)
    # rows of a class that is very large are many short rows of one key: the join may split them
    ours = able.select("id", "k1", "k2").join(per, ["k1", "k2"]).select("id", "n", "component_id")
    others = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id"))
    return ours.unionByName(others).select(F.col("id").alias("vec_id"), F.col("n").cast("long").alias("n_links"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
