"""Top-k and near duplicates of embeddings against all pairs, and connected components."""

import math
import random

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from tidemark.llm import neardup, topk
from tidemark.llm.queries import ORACLE_SQL, QUERIES
from tidemark.llm.tables import components

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


@pytest.mark.parametrize("name", ["op5_exact_topk", "op7_embedding_neardup"])
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), 0, 0) for i in range(120)]
    rows += [(200 + i, rows[3][1], 0, 0) for i in range(30)] + [(300 + i, (np.array(rows[5][1]) + rng.normal(size=8) * 0.05).tolist(), 0, 0) for i in range(30)]
    odd = [None, [], [1.0, None], [float("nan")] * 8, [float("inf")] * 8, [0.0] * 8, [1.0, 2.0], [1e30] * 8]
    return rows + [(400 + i, x, 0, 0) for i, x in enumerate(odd[:-1])] + [(None, [1.0] * 8, 0, 0), (7, rows[7][1], 0, 0)]


def usable(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def test_topk_by_hand(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0, k=5, pivots=4, block=16, queries=4, group_bytes=700).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    flat = [(i, np.array([math.floor(64 * float(np.float32(v))) for v in x])) for i, x, *_ in rows if i is not None and usable(x)]
    pad = lambda v: np.pad(v, (0, 8 - len(v)))
    for q, qv in flat:
        if q % 20 == 0:
            best = sorted((-int(pad(qv) @ pad(v)), i) for i, v in flat if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.exact_topk(df.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0], 0, 0), (1, [2.0], 0, 0)], SCHEMA)
    assert [tuple(r) for r in topk.exact_topk(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 64 * 128)]


def test_topk_of_queries_that_repeat(spark):
    """A repeated row asks once, of two vectors of an id the least does; candidates that repeat count each."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [3.0, 9.0]), (2, [4.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (20, [0.0, 5.0]), (20, [0.0, -5.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    got = sorted(map(tuple, topk.exact_topk(df, F.col("vec_id") % 20 == 0, k=4, block=2, queries=1, group_bytes=8).collect()))
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 2), (0, 2, 1), (0, 3, 3), (0, 4, 3), (20, 1, 0), (20, 2, 0), (20, 3, 2), (20, 4, 3)]


def test_topk_leaves_little_to_write(spark, tmp_path):
    """Each wave has the k-th scores of those before it: a query has some k rows left of each, however many groups."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, x.tolist(), 0, 0) for i, x in enumerate(rng.normal(size=(6000, 16)).astype(np.float32))], SCHEMA)
    sizes = []
    whole = topk.written

    def watched(frame, name):
        out = whole(frame, name)
        sizes.append((name, out.count()))
        return out

    topk.written = watched
    try:
        got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, block=64, queries=32, group_bytes=64 * 16 * 2).collect()
    finally:
        topk.written = whole
    found = [n for name, n in sizes if name == "found"]
    assert len(got) == 300 * 20 and len(found) == 3 and sum(found) < 300 * 20 * 4 * len(found) < 300 * 20 * 94 / 4


def test_topk_of_large_numbers(spark):
    big = spark.createDataFrame([(0, [3e6, 1.0], 0, 0), (1, [3e6, 1.0], 0, 0), (2, [3e6, 2.0], 0, 0)], SCHEMA)
    got = topk.exact_topk(big, F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, (64 * 3_000_000) ** 2 + 64 * 128), (1, (64 * 3_000_000) ** 2 + 64 * 64)]


def all_pairs(rows):
    n = len(rows)
    unit = [np.array(x, float) / np.linalg.norm(x) if i is not None and usable(x) and np.linalg.norm(x) > 0 else None for i, x, *_ in rows]
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(n)]
    return links


def test_near_duplicates_by_hand(spark, monkeypatch):
    rows = [(i, [float(np.float32(v)) if v is not None else None for v in x] if x else x, a, b) for i, x, a, b in vectors()]
    links = all_pairs(rows)
    for block, shape in ((2048, None), (8, None), (64, (2, 2.0))):  # also with cells in parts
        got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block, shape=shape).collect()
        found = sum(r.n_links for r in got)
        most = sum(map(len, links))
        assert 0.9 * most <= found <= most
        by_id = {r.vec_id: r for r in got}
        assert all(by_id[200 + i].component_id == 3 and by_id[200 + i].n_links >= 30 for i in range(30))
        for i in range(7):
            if i != 6:
                assert by_id[400 + i].n_links == 0 and by_id[400 + i].kept
        assert len(got) == len(rows) and sum(r.vec_id == 7 for r in got) == 2
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planted_pairs_among_many(spark):
    """20,000 vectors of 64 dimensions with 600 pairs planted just above the threshold, chains among them: links and
    components against all pairs, at least 0.95 of them found and none that is not one."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(20_000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    for k in range(600):
        a, b = 2 * k, 2 * k + 1 if k % 5 else (2 * k + 2) % 1200  # every fifth makes a chain with the next pair
        side = rng.normal(size=64)
        side -= (side @ base[a]) * base[a]
        c = rng.uniform(0.901, 0.93)
        base[b] = c * base[a] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x = base.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = {(int(i), int(j)) for k in range(0, len(x), 2000) for i, j in zip(*np.nonzero(unit[k : k + 2000] @ unit.T >= 0.9)) for i in [i + k] if i < j}
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA)).collect()}
    found = sum(r.n_links for r in got.values()) / 2
    assert 500 < len(links) and 0.95 * len(links) <= found <= len(links)
    parent = {i: i for i in range(len(x))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in sorted(links):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    wrong = [i for i, r in got.items() if r.component_id != root(i)]
    assert len(wrong) <= 0.1 * len(links) and all(r.component_id >= root(i) and root(r.component_id) == root(i) for i, r in got.items())


def test_e8_points_are_nearest():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    y = neardup.e8(x)
    assert ((2 * y == np.rint(2 * y)).all()) and (((y.sum(1)) % 2) == 0).all()
    for v in neardup.SHORTEST:
        assert (((x - y) ** 2).sum(1) <= ((x - y - v) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("n", [5_000, 50_000, 200_000, 100_000_000])
def test_recall_at_the_threshold(n):
    eights, width = neardup.cell_shape(n)
    u, v = neardup.at_threshold(64, 0.9, 3000)
    tables = neardup.tables_for(64, 0.9, 2, width, eights)
    got = neardup.meet(neardup.cells(u, tables, 2, width, eights), neardup.cells(v, tables, 2, width, eights))
    assert got.mean() > 0.95
    q = math.acos(0.9) / math.pi
    apart = math.ceil(neardup.SIGNS * q + neardup.SURE * math.sqrt(neardup.SIGNS * q * (1 - q)))
    differ = np.bitwise_count(neardup.signs(u) ^ neardup.signs(v)).sum(1, dtype=int)
    assert (differ <= apart).mean() > 0.999


def test_share_of_pairs_falls():
    """The more vectors, the smaller the share of unrelated pairs that meet, in all tables together."""
    rng = np.random.default_rng(3)
    u = rng.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    share = []
    for n in (5_000, 50_000, 200_000, 100_000_000):
        eights, width = neardup.cell_shape(n)
        k = neardup.cells(u, neardup.tables_for(64, 0.9, 2, width, eights), 2, width, eights)
        home = ((k & np.uint64(1)) == 1).ravel()
        key, n = np.unique((k & ~np.uint64(1)).ravel(), return_inverse=True)
        homes, all_ = np.bincount(n[home], minlength=len(key)), np.bincount(n, minlength=len(key))
        share.append((homes * (all_ - homes) + homes * (homes - 1) / 2).sum() / (len(u) * (len(u) - 1) / 2))
    print([round(float(x), 5) for x in share])
    assert share[0] > 1.5 * share[1] and share[1] > 1.3 * share[2] and share[2] > 8 * share[3], share


def test_components(spark):
    rnd = random.Random(0)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 300), rnd.randrange(100, 300)) for _ in range(120)] + [(500, 400 + i) for i in range(50)] + [(5, 5), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            root[find(a)] = find(b)
    low = {}
    for x in root:
        low[find(x)] = min(low.get(find(x), x), x)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: low[find(x)] for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
