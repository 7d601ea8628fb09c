"""Jaccard components against all pairs."""

import random
import re

import numpy as np

from tidemark.llm import jaccard
from tidemark.llm.queries import QUERIES


def shingle_set(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, percent=90):
    """(number of shingles, component) of each row, by all pairs of distinct sets with a common shingle."""
    sets = [shingle_set(t) for _, t in rows]
    root, classes, by_shingle = {}, {}, {}
    for k, s in enumerate(sets):
        classes.setdefault(s, []).append(k)

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s in classes:
        for g in s:
            by_shingle.setdefault(g, []).append(s)
    for s in classes:
        common = {}
        for g in s:
            for o in by_shingle[g]:
                common[o] = common.get(o, 0) + 1
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(o) - n):
                root[find(s)] = find(o)
    low = {}
    for s, own in classes.items():
        if s:
            ids = [rows[k][0] for k in own if rows[k][0] is not None]
            low[find(s)] = min([*ids, *([low[find(s)]] if low.get(find(s)) is not None else [])], default=None)
    return [(len(s), low[find(s)] if s and low[find(s)] is not None else rows[k][0]) for k, s in enumerate(sets)]


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(parts)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard.jaccard_components(df).collect())
    want = sorted((i if i is not None else -1, n, c if c is not None else -1) for (i, _), (n, c) in zip(rows, brute(rows)))
    assert got == want


def test_random_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 8)  # lists in several parts
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = rnd.choices(words, k=60)
    rows = []
    for base in range(12):
        text = rnd.choices(words, k=rnd.choice([4, 30, 60, 120])) + (passage if base % 3 == 0 else [])
        for _ in range(rnd.choice([1, 3, 40])):
            t = list(text)
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), " ".join(t)))
    check(spark, rows)


def test_edges(spark):
    long = " ".join(f"x{i % 977}y{i % 1009}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "two one"), (12, "One\x0bTwo"), (3, long), (4, long + " more"), (13, "a a a a a"), (14, "a a a"), (15, "é É x"), (16, "é é x"), (None, "one two"), (None, "alone here now"), (9, "ONE"), (1, "same text of words"), (2, "Same text of words")]
    check(spark, rows)
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_of_one_prefix(spark, monkeypatch):
    """Sets of one size that agree in the rarest tenth but not in the rest."""
    common = [f"c{i}" for i in range(30)]
    rows, rnd = [], random.Random(1)
    for k in range(40):
        rows.append((k, " ".join(["r1 r2 r3 r4 r5 r6 r7 r8", *rnd.sample(common, 12 + k % 2)])))
    check(spark, rows)


def test_no_list_is_gathered_in_a_task(spark, monkeypatch):
    """Only parts of lists and of groups reach a Python task in whole runs."""
    monkeypatch.setattr(jaccard, "PART", 8)
    plain = jaccard._runs

    def watched(fn, names):
        def small(g):
            assert g.groupby(names).size().max() <= 40, names
            return fn(g)

        return plain(small, names)

    monkeypatch.setattr(jaccard, "_runs", watched)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    bodies = [" ".join(rnd.sample(words, 24)) for _ in range(45)]
    check(spark, list(enumerate(["r1 r2 r3 " + x for x in bodies] + [x for x in bodies for _ in range(50)])))


def test_one_shingle_in_very_many_sets(spark, monkeypatch):
    """Sets that share nothing but a shingle of their prefixes: no window over shingles gathers them, none are linked but the
    two that are alike, and the sketch has more cells for more text."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('one shared shingle w', if(id = 19999, 7, id)) AS text")
    plans, plain = [], jaccard.written

    def watched(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return plain(frame, name)

    monkeypatch.setattr(jaccard, "written", watched)
    got = jaccard.jaccard_components(df, percent=50)
    assert not any("Window" in x for x in plans) and len(plans) > 10
    assert {r.doc_id: r.component_id for r in got.where("component_id <> doc_id").collect()} == {19_999: 7}
    monkeypatch.undo()
    rows = df.select("text")
    for bytes_, cells in ((jaccard.CELL_BYTES, 1 << 22), (1 << 30, 1 << 22), (0.1, 1 << 23)):
        monkeypatch.setattr(jaccard, "CELL_BYTES", bytes_)
        assert len(jaccard._sketch(rows, 3)) == cells


def test_only_near_classes_become_pairs(spark, monkeypatch):
    """Classes of one prefix and size, and of two groups that meet, that agree in nothing but the prefix."""
    monkeypatch.setattr(jaccard, "PART", 8)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    bodies = [" ".join(["s t", *rnd.sample(words, 22 + k % 2)]) for k in range(40)]
    texts = ["r1 r2 r3 " + x for x in bodies] + [x for x in bodies for _ in range(50)]  # the bodies' shingles are the common ones
    near = "r1 r2 r3 " + bodies[0].rsplit(" ", 1)[0] + " "
    rows = list(enumerate(texts + [near + "other", near + "last"]))
    plain, pairs = jaccard._similar, []

    def watched(some, sets, percent):
        pairs.append(some.count())
        return plain(some, sets, percent)

    monkeypatch.setattr(jaccard, "_similar", watched)
    check(spark, rows)
    assert pairs[0] <= 2 * len(bodies) + 10 and pairs[1] <= 10, pairs


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(0)
    for n, m, both in ((3, 4, 3), (50, 60, 40), (900, 1000, 890)):
        x = rnd.integers(0, 2**63, n + m - both).astype(np.uint64)
        sets = np.concatenate([x[:n], x[n - both :]])
        for percent in (90, 60):
            odd = jaccard.Parities([v.as_py() for v in jaccard._parities(sets, np.array([0, n, n + m]), percent)] + [None])
            x, y = np.array([0, 0, 2]), np.array([1, 1, 1])
            assert odd.within(x, y, np.array([n + m - 2 * both, -1, -1])).tolist() == [True, False, True]


def test_parities_tell_unlike_sets_apart():
    rnd = np.random.default_rng(1)
    for n, m in ((100, 95), (1000, 1030), (20_000, 21_000), (1020, 1030)):
        for percent in (90, 80):
            x = rnd.integers(0, 2**63, n + m).astype(np.uint64)
            odd = jaccard.Parities([v.as_py() for v in jaccard._parities(x, np.array([0, n, n + m]), percent)])
            room = n + m - 2 * jaccard.least(np.array([n]), np.array([m]), percent)
            assert not odd.within(np.array([0]), np.array([1]), room).any()


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_jaccard_join"](spark, sf).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute(rows))}
