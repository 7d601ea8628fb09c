"""Language identification: sums against all segmentations by hand, held-out accuracy, edge rows."""

import itertools
import math
import re
import sys
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["▁", "▁a", "a", "ab", "abc", "b", "bc", "c", "é", "éa"]
PROB = np.random.default_rng(5).dirichlet(np.ones(len(PIECES)), 2).T


def by_hand(word):
    """Sum over all ways to cut a word."""
    s, total = langid.marked(word), np.zeros(2)
    for cut in itertools.product([0, 1], repeat=len(s) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(s)]
        w = np.ones(2)
        for x in (s[i:j] for i, j in zip(at, at[1:])):
            w *= PROB[PIECES.index(x)] if x in PIECES else langid.STRAY if len(x) == 1 else 0
        total += w
    return np.log(total)


def in_fractions(word):
    """The same for long words, by exact fractions."""
    s = langid.marked(word)
    out = []
    for k in range(2):
        p = {x: Fraction(float(PROB[i, k])) for i, x in enumerate(PIECES)}
        alpha = [Fraction(1)]
        for j in range(1, len(s) + 1):
            alpha.append(sum(alpha[i] * p.get(s[i:j], Fraction(langid.STRAY) if j - i == 1 else 0) for i in range(max(0, j - 3), j)))
        out.append(math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcéÉxA", min_size=1, max_size=9), min_size=1, max_size=6))
def test_forward_sums_all_segmentations(texts):
    got = langid.Model(["p", "q"], PIECES, PROB).word_scores(texts)
    for x, t in zip(got, texts):
        assert np.allclose(x, by_hand(t))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcéx", min_size=1, max_size=12), st.integers(1, 30)), min_size=1, max_size=5))
def test_long_words_are_not_cut(parts):
    texts = [t * n for t, n in parts]
    model = langid.Model(["p", "q"], PIECES, PROB)
    for x, t in zip(model.word_scores(texts), texts):
        assert np.allclose(x, in_fractions(t), rtol=1e-9)
    for t in texts:
        for steps, block in ((256, 1 << 16), (6, 12), (9, 27)):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(langid, "STEPS", steps)
                m.setattr(langid, "BLOCK", block)
                assert np.allclose(langid.long_score(model.lattice, model.p, langid.marked(t)), in_fractions(t), rtol=1e-9)


def cuts(word):
    """All segmentations of a marked word, as pieces or stray characters."""
    s = langid.marked(word)
    for cut in itertools.product([0, 1], repeat=len(s) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(s)]
        own = [s[i:j] for i, j in zip(at, at[1:])]
        if all(x in PIECES or len(x) == 1 for x in own):
            yield own


def taught(words_of, rounds):
    """Expectation-maximisation over all segmentations of every word, by enumeration."""
    prob = np.full((len(PIECES), len(words_of)), 1 / len(PIECES))
    for _ in range(rounds):
        after = np.full(prob.shape, langid.BESIDES)
        for k, ws in enumerate(words_of):
            for w in ws:
                all_cuts = list(cuts(w))
                weight = np.array([np.prod([prob[PIECES.index(x), k] if x in PIECES else langid.STRAY for x in c]) for c in all_cuts])
                for c, p in zip(all_cuts, weight / weight.sum()):
                    for x in c:
                        if x in PIECES:
                            after[PIECES.index(x), k] += p
        prob = after / after.sum(0)
    return prob


def test_learning_and_prediction_by_hand(spark, monkeypatch):
    """The whole of learn() and identify() on a small vocabulary: words parted at six ASCII bytes only, in both."""
    monkeypatch.setattr(langid, "vocabulary", lambda path: PIECES)
    texts = [("p", "abc ab a abc"), ("p", "bc ABC\tcab"), ("q", "éa ba\u00a0cb b"), ("q", "cc\x85b éa  éaé"), ("q", "")]
    docs = spark.createDataFrame([(100 + i, t, l) for i, (l, t) in enumerate(texts)], "doc_id long, text string, lang string")
    docs = docs.unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang"))
    docs = docs.where(~langid.held_out("doc_id"))
    split = lambda t: [w for w in re.split("[ \t-\r]+", t) if w]
    rows = [(r.lang, r.text) for r in docs.collect()]
    model = langid.learn(docs, "-")
    want = taught([[w for l, t in rows if l == k for w in split(t)] for k in ("p", "q")], 2)
    assert model.languages == ["p", "q"] and np.allclose(model.prob, want, rtol=1e-9)
    monkeypatch.setattr(sys.modules[__name__], "PROB", want)
    asked = ["abc", "éa b", "a", "c c\u00a0c", "12 !", "bca éa abc ab a b c bc " * 9]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(asked):
        if t == "12 !":
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        s = sum(by_hand(w) for w in split(t))
        n = sum(len(w.encode()) for w in split(t))
        z = np.exp((s - s.max()) * min(n, 48) / n)
        assert got[i].lang_pred == "pq"[int(s.argmax())] and abs(got[i].score - z.max() / z.sum()) < 1e-4


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="abcéx", min_size=1, max_size=9), st.integers(1, 12))
def test_sightings_in_long_words(word, times):
    """The same sums with logarithms as with numbers, in blocks as at once, and whole words: sightings add up to the length."""
    lattice, p = langid.Lattice(PIECES), langid._weights(PROB[:, :1])
    t = langid.marked(word * times)
    alpha, arcs = langid.forward(lattice, p, [t])
    beta, sums = [np.zeros(1) for _ in alpha], np.zeros(len(PIECES) + 1)
    beta[-1] += 1 / alpha[-1][0]
    for (i, j), got in sorted(arcs.items(), reverse=True):
        w = langid._arc(p, got, j - i, lattice.n)[:, 0] * beta[j]
        np.add.at(sums, got, alpha[i][:, 0] * w)
        beta[i] += w
    for block in (1 << 16, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(langid, "BLOCK", block)
            own = np.zeros(len(PIECES) + 1)
            some, n = langid.long_sightings(lattice, p, t)
            own[some] = n
            assert np.allclose(own[:-1], sums[:-1])
    some, n = langid.long_sightings(lattice, p, langid.marked("abc" * 3000))
    assert abs(sum(len(PIECES[i]) * x for i, x in zip(some, n)) - 9001) < 1e-3


def test_vocabulary_lookup():
    pieces = langid.vocabulary(PATH)
    lattice = langid.Lattice(pieces)
    for n in {len(p) for p in pieces}:
        own = [i for i, p in enumerate(pieces) if len(p) == n]
        assert (lattice.find(lattice._extend([pieces[i] for i in own], n)) == own).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op4_language_id"](spark, sf).join(docs, "doc_id").where("held_out")
    right, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right > 0.98 and low >= 0 and high <= 1


def test_edges(spark):
    rows = [(i, t, l, "clash") for i, (t, l) in enumerate([("der und die", "de"), ("the and of", "en")] * 30)]
    odd = [None, "", "  \n", "123 !!", "x" * 9000, "the the", "the the", "of and the " * 20_000]
    rows += [(100 + i, t, None, "clash") for i, t in enumerate(odd)] + [(None, "und die", "de", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.learn(docs, PATH)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[100 + i].lang_pred for i in range(4)] == ["und"] * 4 and got[100].score == 0
    assert all(got[100 + i].lang_pred == "en" for i in (5, 6, 7)) and got[None].lang_pred == "de"
    assert math.isfinite(got[104].score)
    empty = docs.limit(0)
    assert langid.identify(empty, langid.learn(empty, PATH)).count() == 0
    untaught = langid.identify(docs, langid.learn(empty, PATH)).select("lang_pred").distinct().collect()
    assert [r[0] for r in untaught] == ["und"]
