"""The pipeline's stages, each against brute force on its own input."""

import re

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_jaccard import brute as brute_components

from tidemark.llm.sampling import held_out

SF = "/root/testdata/sf0.001"


def test_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    one = cp.written(cp.language_id(spark, docs, SF), "t")
    gone = docs.join(one, "doc_id", "left_anti")
    assert one.columns == columns and gone.count() <= 0.02 * docs.count()
    two = cp.written(cp.quality_classifier(spark, one, SF), "t")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = one.join(labels.where("quality = 1"), "doc_id")
    assert good.join(two, "doc_id", "left_anti").count() <= 0.05 * good.count()
    # bad documents: eleven labels here are too few to learn from; see test_quality.py

    three = cp.written(cp.near_duplicates(spark, two, SF), "t")
    import test_jaccard

    plain = test_jaccard.shingle_set
    monkeypatch.setattr(test_jaccard, "shingle_set", lambda t, width=5: plain(t, 5))
    rows = [(r.doc_id, r.text) for r in two.collect()]
    want = {i for (i, _), (_, c) in zip(rows, brute_components(rows, 80)) if c == i}
    assert {r.doc_id for r in three.collect()} == want and three.columns == columns

    four = cp.written(cp.repeated_passages(spark, three, SF), "t")
    before = {r.doc_id: r.text.encode() for r in three.collect()}
    seen = {}
    for i, t in before.items():
        for k in range(len(t) - cp.REPEAT + 1):
            seen.setdefault(t[k : k + cp.REPEAT], []).append((i, k))
    gone = {i: set() for i in before}
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + cp.REPEAT))
    after = {r.doc_id: r for r in four.collect()}
    assert four.columns == columns and after.keys() == before.keys()
    for i, t in before.items():
        left = bytes(b for k, b in enumerate(t) if k not in gone[i]).decode("utf-8", "ignore")
        assert after[i].text == left and after[i].n_chars == len(left)

    five = cp.pack(spark, four, SF)
    assert five.select("doc_id").distinct().count() == four.count()
    assert five.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in five.select("doc_id", "doc_tokens").distinct().collect())


def test_stages_over_nothing_and_nulls(spark):
    """Every stage over an empty table, and the first two and the last over null and empty texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        got = stage(spark, docs.limit(0), SF)
        assert got.count() == 0, name
        assert name == "packing" or got.columns == docs.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, "en", "s", None)], docs.schema)
    both = docs.unionByName(odd)
    one = cp.language_id(spark, both, SF)
    assert one.where("doc_id < 0 OR doc_id IS NULL").count() == 0 and one.count() > 0.95 * docs.count()
    two = cp.quality_classifier(spark, both, SF)
    assert two.where("doc_id < 0 OR doc_id IS NULL").count() == 3
    five = cp.pack(spark, odd, SF).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in five) == [("-1", 0, 1, 1), ("-2", 0, 1, 1), ("None", 0, 1, 1)]


def test_what_the_cut_offs_drop(spark):
    """Held-out documents of sf0.1: nearly all bad ones go, nearly all good ones stay."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(held_out("doc_id")).join(docs.select("doc_id"), "doc_id")
    left = cp.quality_classifier(spark, docs, sf).select("doc_id")
    n = {r.quality: r.n for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    kept = {r.quality: r.n for r in labels.join(left, "doc_id").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    assert n[0] > 100 and kept.get(0, 0) < 0.12 * n[0] and kept[1] > 0.98 * n[1], (n, kept)
    junk = spark.createDataFrame([(-i, "0123 456 !! " * i, "en", "s", 0) for i in range(1, 9)], docs.schema)
    left = cp.language_id(spark, docs.unionByName(junk), sf)
    assert left.where("doc_id < 0").count() == 0 and left.count() >= 0.995 * docs.count()


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d e f g", "en", "s", 3)] * 2 + [(2, "a b c d e f g", "en", "s", 3), (None, "only here is this", "en", "s", 3), (3, None, "en", "s", None), (4, "", "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(cp.near_duplicates(spark, docs, SF).collect(), key=repr)
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4", "4", "None"]
    more = [(None, None, "en", "s", None), (None, "a b c d e f g", "en", "s", 3), (9, "h i j k l m", "en", "s", 3), (9, "n o p q r s", "en", "s", 3), (5, "n o p q r s", "en", "s", 3)]
    got = cp.near_duplicates(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), SF).collect()
    # no null id brings a copy back, and of two texts of id 9 the one that is a copy of 5's goes
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("1", "a b c d e f g"), ("None", "only here is this"), ("None", "None"), ("3", "None"), ("4", ""), ("4", ""), ("9", "h i j k l m"), ("5", "n o p q r s")])
    four = cp.repeated_passages(spark, docs, SF).collect()
    assert sorted(str(r.text) for r in four) == sorted(str(r[1]) for r in rows) and [r.n_chars for r in four if r.doc_id == 3] == [None]
    assert cp.repeated_passages(spark, docs, SF).count() == len(rows)
    assert re.match("doc_id", cp.repeated_passages(spark, docs.limit(0), SF).columns[0])


CLASHING = "row struct<a:int>, row_key_1 string, row_key_2 long, rows_of_key int, words_of_key int, nth_of_key int, score string, lang_pred string, kept boolean, c int, t string, copies int, spans array<int>, no_text int, `a b.c` map<string,int>, n_removed long"


def test_columns_of_any_name_stay_as_they_are(spark):
    """Columns that are named like those the stages make, a name with a point, a map, and none called n_chars; rows equal in
    id and text but not in others; a text of two million bytes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    long = "Quite a long text of plain words that nobody else has, number %d. " * 30_000 % tuple(range(30_000))
    docs = docs.unionByName(spark.createDataFrame([(-1, long, "en", "s")], docs.schema))
    row = "struct(cast(1 AS int)), 'k', 7L, 1, 2, 3, 'sc', 'lp', true, 4, 'tt', 5, array(1, 2), 6, map('m', 1), 8L"
    own = docs.selectExpr("*", f"inline(array(struct({row})))").toDF(*docs.columns, *[f"x{i}" for i in range(16)])
    names = [f.name for f in spark.createDataFrame([], CLASHING).schema]
    own = own.toDF(*docs.columns, *names)
    own = cp.written(own.unionByName(own.where("doc_id = -1").withColumn("row_key_2", F.lit(3).cast("long"))), "t")
    shown = [f"`{c}`" for c in names]
    want = own.where("doc_id >= 0").select(*shown).first()
    for name, stage in cp.STAGES[:-1]:
        got = cp.written(stage(spark, own, SF), "t")
        assert got.columns == own.columns and got.schema == own.schema, name
        plain = cp.written(stage(spark, own.select("doc_id", "text", "lang", "source"), SF), "t")
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in plain.collect()), name
        assert {repr(r) for r in got.where("doc_id >= 0").select(*shown).collect()} == {repr(want)}, name
        mine = [r.row_key_2 for r in got.where("doc_id = -1").collect()]
        assert sorted(mine) == ([3] if name == "n-gram Jaccard join" else [3, 7]), name
    assert cp.pack(spark, own, SF).where("doc_id = -1").count() > 2


def test_run_leaves_one_table(spark):
    """The tables of stages and what they make on their way go; only what the result reads stays."""
    import os

    from tidemark.llm.tables import shared_folder

    folder = shared_folder(spark).removeprefix("file:").removeprefix("//")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = cp.run(spark, SF)
    left = [x for x in set(os.listdir(folder)) - before if x.startswith(("pipeline-", "words-", "sample"))]
    assert got.count() > 0 and len(left) == 1 and left[0].startswith("pipeline-packing")
