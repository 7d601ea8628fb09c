"""Both audits against SQL on tables and against plain loops on small ones."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from tidemark.llm import divergence, filter_audit
from tidemark.llm.queries import ORACLE_SQL, QUERIES

LONG = "word " * 250
ODD = [
    (5, "Copy of a text", "en", "a"), (3, "Copy of a text", "de", "b"), (3, "Copy of a text", "en", "a"), (9, "Copy of a text", "en", None), (None, "Copy of a text", "en", "a"),
    (None, None, None, None), (1, None, None, "a"), (2, "", "", "a"), (4, " \t\n", "en", "a"), (6, "A B C D # % x", "en", "c"), (7, LONG, "en", "a"), (8, LONG + "!", "de", "a"),
    (10, " ".join(f"w{i}" for i in range(300)), "en", "a"), (11, "Äpfel ÄPFEL äpfel naïve it's one-two K 中文 中文", "de", "b"), (12, "one one one two two \x00three", "de", "b"), (13, "one two three", "de", "c"), (14, "one", "de", "d"), (15, "12 34", "fr", "x"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (5, 1, 0), (6, 0, 1), (7, 1, None), (7, 1, 1), (None, 1, 1), (77, 1, 1)]
DOCS = "doc_id long, text string, lang string, source string, docs string"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_source_divergence"])
def test_queries_agree_with_sql(spark, name, sf):
    compare(spark, QUERIES[name], ORACLE_SQL[name], f"/root/testdata/{sf}")


def expected_filters(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails, seen = [], defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            seen[t or ""].append(i)
    for i, t, lang, *_ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        own = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and min(seen[t]) < i,
        }
        fails.append((lang or "", i, own))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if x[2][f]]
                left = [x for x in left if not x[2][f]]
                removed_by[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(x[2][f] for x in mine) - len(gone), sum(x[2][f] and sum(x[2].values()) == 1 for x in mine), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)
                ]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(removed_by[order[k - 1]])
    return out


def test_filters_on_odd_rows(spark):
    """Nulls, ties, repeated ids in two languages, labels that contradict, a column named like a result's."""
    docs = spark.createDataFrame([(*r, "clash") for r in ODD] * 2, DOCS)
    got = filter_audit.audit_filters(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    want = expected_filters(ODD * 2, LABELS)
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want and len(got) == len(want) == 4 * 600
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs.limit(0), empty).count() == 0
    assert {r.good_lost + r.toxic_lost for r in filter_audit.audit_filters(docs, empty).collect()} == {0}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**6 - 1), min_size=1, max_size=40))
def test_contractions_against_loops(codes):
    """Six filters: every row of a report against documents that are filtered one after the other."""
    fails, n = np.unique(codes, return_counts=True)
    got = filter_audit.report("p", fails, np.array([n, n, 0 * n]), "ABCDEF").to_pylist()
    for r in got[:: max(1, len(got) // 50)]:
        left = codes
        for f in r["filter_order"][: r["step"]]:
            before, left = left, [x for x in left if not x >> (5 - "ABCDEF".index(f)) & 1]
        assert (r["kept"], r["removed"], r["good_lost"], r["toxic_lost"]) == (len(left), len(before) - len(left), len(before) - len(left), 0)
    assert sum({r["filter_order"][r["step"] - 1]: r["shapley"] for r in got}.values()) == 720 * sum(c > 0 for c in codes)


def test_long_text_and_hot_copies(spark):
    """Over 21 million words and letters in a row (more than an int holds a hundred times), and one text in most rows."""
    df = spark.range(3).selectExpr("id AS doc_id", "CASE id WHEN 0 THEN repeat('A b ', 11000000) WHEN 1 THEN repeat('x', 30000000) ELSE '' END AS text", "'en' AS lang", "'s' AS source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.failures(df, labels).select("fails", "docs").collect()
    assert sorted(map(tuple, got)) == [(0b01100, 1), (0b10000, 2)]
    hot = spark.range(40_000).selectExpr("id AS doc_id", "if(id % 3 > 0, 'same', cast(id AS string)) AS text", "if(id % 2 = 0, 'a', 'b') AS lang", "'s' AS source")
    got = {(r.part, r.fails): r.docs for r in filter_audit.failures(hot, labels).collect()}
    n = sum(i % 3 > 0 for i in range(40_000))
    assert sum(x for (_, f), x in got.items() if f % 2) == n - 1 and sum(got.values()) == 40_000


def expected_sources(rows, least=3, ranks=200):
    unit = divergence.UNIT
    texts = [(l or "", s or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for _, t, l, s, *_ in rows]
    out = []
    for lang in {x[0] for x in texts}:
        own = [x for x in texts if x[0] == lang]
        held = Counter(w for *_, ws in own for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= least)
        count = defaultdict(Counter)
        for _, s, ws in own:
            count[s].update({w: 0 for w in ()})
            count[s].update(w for w in ws if held[w] >= least)
            count[None].update(w for w in ws if held[w] >= least)
        p = {s: {w: 1 + unit * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in p.keys() - {None}:
            peers = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in p.keys() - {None, s}]
            terms = [(-f(p[s][w], p[None][w]), w.encode()) for w in kept if count[s][w] and p[s][w] > p[None][w]]
            for part, found in (("pair", sorted(peers)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_sources_on_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ODD] * 2, DOCS)
    assert sorted(map(tuple, divergence.audit_sources(docs).collect())) == expected_sources(ODD * 2)
    assert sorted(map(tuple, divergence.audit_sources(docs, least=1, ranks=2).collect())) == expected_sources(ODD * 2, 1, 2)
    assert divergence.audit_sources(docs.limit(0)).count() == 0


def test_bands_and_blocks(spark, monkeypatch):
    """Accumulators of a few rows and blocks of a few postings give the same; most rows lie in one source."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"{'abcdefghij'[x % 10]}{'klmnop'[x % 6]}{'qrstu'[x % 5]}" for x in rng.zipf(1.3, 60)), "en" if i % 7 else "de", f"s{0 if i % 3 else i % 40}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = expected_sources(rows)
    for cells, block in ((1 << 22, 1 << 20), (100, 64)):
        monkeypatch.setattr(divergence, "CELLS", cells)
        monkeypatch.setattr(divergence, "BLOCK", block)
        assert sorted(map(tuple, divergence.audit_sources(docs).collect())) == want


def test_shares_are_exact(spark):
    """Counts beyond what a double or a long holds a thousand million times."""
    cases = [(0, 0, 1), (10**15, 3 * 10**15, 7), (7 * 10**12, 9 * 10**17, 10**9), (5, 11, 3)]
    df = spark.createDataFrame(cases, "n long, total long, terms long")
    got = [r.p for r in df.select("n", divergence.share("n", "total", "terms").alias("p")).collect()]
    assert got == [1 + divergence.UNIT * (n + 1) // (t + v) for n, t, v in cases]


def test_terms_of_a_batch():
    """Texts across pieces, terms across batches of one source, a text of twenty million bytes."""
    t = pa.table({"lang": ["a", "a", "b"], "source": ["x", "x", ""], "text": ["One two" + " one" * 5_000_000, "one", "é1É_é"]})
    got = sorted(tuple(r.values()) for b in divergence.counted(t) for r in b.to_pylist())
    assert got == sorted([("a", "x", "one", 5_000_001, 1), ("a", "x", "two", 1, 1), ("a", "x", "one", 1, 1), ("b", "", "é", 2, 1), ("b", "", "É", 1, 1)])
