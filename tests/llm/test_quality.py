"""The compression classifier: held-out accuracy and edge rows."""

import math

import zstandard
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op9_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    good, bad, low, high = got.agg(
        F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted"))), F.min("score"), F.max("score")
    ).first()
    assert good > 0.95 and bad > 0.9 and 0 <= low <= high <= 1


def test_edges(spark):
    rows = [(i, ("plain words in a row " if i % 2 else "$$$ ### !! ") * (i % 7 + 3), "clash") for i in range(200)]
    odd = [None, "", " ", "x" * 300_000, "plain words", "plain words"]
    docs = spark.createDataFrame(rows + [(1000 + i, t, "clash") for i, t in enumerate(odd)] + [(None, "$$$", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 1), (7, None), (None, 1), (1001, 1), (1000, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.assess(docs, quality.learn(docs, labels)).collect()}
    assert got[1000] == got[1001] and got[1004] == got[1005] and all(0 <= x <= 1 for x in got.values())
    assert sum(got[i] > 0.5 for i in range(200) if i % 2) > 95 and sum(got[i] < 0.5 for i in range(200) if i % 2 == 0) > 95
    none = quality.learn(docs, labels.limit(0))
    assert {r.score for r in quality.assess(docs, none).collect()} == {0.5}
    assert quality.assess(docs.limit(0), none).count() == 0
    one = quality.learn(docs, labels.where("quality = 1"))
    assert all(r.score > 0.9 for r in quality.assess(docs, one).collect())
    few = quality.learn(docs, labels.where("doc_id IN (0, 2, 4, 6, 9)"))  # one good row is enough
    got = {r.doc_id: r.score for r in quality.assess(docs, few).collect()}
    assert min(got[i] for i in range(1, 200, 2)) > max(got[i] for i in range(0, 200, 2))


def test_what_reaches_the_driver_is_bounded(spark, monkeypatch):
    """Few rows of very long texts, and many rows of one id."""
    seen = []
    plain = quality._dictionary
    monkeypatch.setattr(quality, "_dictionary", lambda x, size: seen.append(sum(map(len, x))) or plain(x, size))
    rows = [(i, ("plain words in a row " if i % 2 else "$$$ ### !! ") * 40_000) for i in range(24)] + [(1, "plain words")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(24)] * 2, "doc_id long, quality int"), sample_bytes=100_000)
    assert len(seen) == 2 and max(seen) <= 100_000
    got = {(r.doc_id, len(r.text)): r.score for r in quality.assess(docs, model).collect()}
    assert min(v for (i, _), v in got.items() if i % 2) > max(v for (i, _), v in got.items() if not i % 2)


def score_by_hand(model, text):
    """The score of one text, straight from the dictionaries and the curve."""
    raw = text.encode()
    bad, good = (
        sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[i : i + quality.CHUNK])) for i in range(0, len(raw), quality.CHUNK))
        for d in model.dictionaries
    )
    x = (bad - good + model.pull * model.usual) / (len(raw) + model.pull)
    return 1 / (1 + math.exp(-(model.slope * x + model.shift)))


def test_scores_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op9_quality"](spark, sf).collect()}
    for r in docs.where("doc_id % 10 = 0").collect():
        assert abs(got[r.doc_id] - score_by_hand(model, r.text or "")) < 1e-4
