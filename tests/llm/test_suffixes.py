"""Repeated strings against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffixes
from tidemark.llm.queries import QUERIES


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(hash(r[i : i + length]) for r in raw for i in range(len(r) - length + 1))
    for r in raw:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if count[hash(r[i : i + length])] > 1:
                gone[i] += 1
                gone[min(i + length, len(r))] -= 1
        gone = np.cumsum(gone)[: len(r)] > 0
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        yield len(r), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()


def check(spark, texts, length=100, parts=3, shorter=None):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, c string, copies int").repartition(parts)
    got = {r.doc_id: r for r in suffixes.remove_repeats(df, length, keep_text=True, shorter=shorter).collect()}
    for i, want in enumerate(brute(texts, length)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, r, want[:3])
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    if shorter:
        assert [got[i].n_repeated for i in range(len(texts))] == [x[1] for x in brute(texts, shorter)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("texts_", "parts_"))]


def some_texts(seed, alphabet):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    shared = [word(rnd.choice([99, 100, 101, 130, 250, 420])) for _ in range(6)]
    out = []
    for _ in range(40):
        out.append("".join(rnd.choice([word(rnd.randrange(200)), rnd.choice(shared), rnd.choice(shared)[rnd.randrange(40) :]]) for _ in range(rnd.randrange(6))))
    out += rnd.sample(out, 6)
    near = list(rnd.choice([x for x in out if len(x) > 300]))
    for _ in range(8):
        near[rnd.randrange(len(near))] = rnd.choice(alphabet)
        out.append("".join(near))
    return out


@pytest.mark.parametrize("alphabet", ["abcdefgh ", "ab", "aé中"])
def test_random_texts(spark, alphabet):
    check(spark, some_texts(1, alphabet), 160, shorter=100)


def test_long_texts_are_searched_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 123, 9000).astype(np.uint8)
    raw[4000:4700] = raw[1000:1700]
    raw[8000:8300] = 97
    whole = suffixes.anchors(raw, np.array([0, 5000, 9000]), 100)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    for a, b in zip(whole, suffixes.anchors(raw, np.array([0, 5000, 9000]), 100)):
        assert (a == b).all()


def test_fewer_buckets_than_partitions(spark):
    """More input partitions than a table may have buckets."""
    key = "spark.sql.sources.bucketing.maxBuckets"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        check(spark, some_texts(5, "ab"), parts=12)
        check(spark, some_texts(6, "abc"), parts=12, shorter=80)
    finally:
        spark.conf.set(key, before)


def test_very_long_texts(spark):
    """Twenty million bytes, with a passage that another document has."""
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 20_000_000).astype(np.uint8)
    other = rng.integers(97, 123, 1000).astype(np.uint8)
    raw[12_345_678 : 12_346_178] = other[100:600]
    df = spark.createDataFrame([(1, raw.tobytes().decode()), (2, other.tobytes().decode())], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(df).collect()}
    assert got == {1: (20_000_000, 500, 1), 2: (1000, 500, 1)}


def test_hot_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "TOGETHER", 8)
    check(spark, some_texts(2, "abcdefgh "), 130, shorter=100)


def test_one_core_in_many_documents(spark, monkeypatch):
    """No group above HOT is brought together, however many documents share the bytes it is split by."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, other = word(330), word(150)
    texts = [word(60 + i % 7) + passage + word(70) for i in range(60)]
    texts += [x[:45] + passage + y[-50:] for x, y in zip(texts, texts[1:])] + [word(80) + other + word(80), other + word(9)]
    plain, limit = suffixes.repeated, 12

    def watched(contexts, at, count, length):
        assert count.max(initial=0) <= limit, count.max()
        return plain(contexts, at, count, length)

    monkeypatch.setattr(suffixes, "HOT", limit)
    monkeypatch.setattr(suffixes, "TOGETHER", 32)
    monkeypatch.setattr(suffixes, "repeated", watched)
    check(spark, texts, parts=40)
    monkeypatch.setattr(suffixes, "FLAGS", 64)  # small groups share a flag with large ones
    check(spark, texts, parts=40)


def test_edges(spark):
    line = "a common line of some words that every one has, over and over again, for more than a hundred bytes.\n"
    check(spark, [None, "", "x" * 99, "x" * 100, "y" * 100, "y" * 100, "z" * 3000, line * 30, line, "head " + line + "tail", "é" * 50, "q" + "é" * 50, "u" * 99, "u" * 99])
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_collision_is_noticed(monkeypatch):
    rows = np.random.default_rng(0).integers(0, 3, (40, 20)).astype(np.uint8)
    size = np.full(40, 20)
    want = sorted(range(40), key=lambda i: rows[i].tobytes())
    start, count = np.array([0]), np.array([40])
    order, lcp = suffixes.suffix_order(rows, size, start, count)
    assert [rows[i].tobytes() for i in order] == [rows[i].tobytes() for i in want]
    monkeypatch.setattr(suffixes.hasher(5), "of", np.ones(256, np.uint64))  # all hashes collide
    order, again = suffixes.suffix_order(rows, size, start, count)
    assert [rows[i].tobytes() for i in order] == [rows[i].tobytes() for i in want] and (lcp == again).all()


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_suffix_dedup"](spark, sf).collect()}
    for (i, _), want in zip(rows, brute([t for _, t in rows], 400)):
        assert got[i] == want
