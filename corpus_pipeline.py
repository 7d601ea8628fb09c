"""A corpus from raw documents to packed sequences, in five stages over tidemark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. run() writes each result as Parquet in the shared folder and reads it again as the next one's docs, and then removes
the one before, so that two copies of the corpus lie there at most.

Columns of docs besides doc_id and text travel as one struct, so none of them can meet a column that a stage makes, whatever
its name; the repeated-passage stage reads n_chars where there is one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, packing, quality, suffixes
from tidemark.llm.tables import dropped, written

#: A language is rejected below this posterior, a text where a bad label is likelier than a good one. README gives what
#: these cut-offs drop of good and of bad held-out documents.
LANGUAGE, QUALITY = 0.5, 0.5
#: Near copies: shingles of five words, a Jaccard similarity of 0.8. Repeats: bytes that a passage of fifty short words has.
WORDS, PERCENT, REPEAT = 5, 80, 200


def _packed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones, too) or of no clear language. Repeated rows are judged each;
    from an empty table nothing is learnt and nothing is left."""
    got = langid.identify(_packed(docs), langid.learn(docs, public_tokenizers.path("piece_bpe_32k.model")))
    return _unpacked(got.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE)), docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that look like those labelled bad. A null or empty text gets the score of one that tells nothing,
    which stays where most labels are good; without labels of both kinds all have one score. Null ids have no label."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(quality.assess(_packed(docs), model).where(F.col("score") >= QUALITY), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest id (where this has several texts, of one of
    them; of rows equal in both, the least by all columns that can be ordered). Rows are known by id and text, so null and
    repeated ids don't keep others. Documents without words (null, empty) all stay. An empty table stays empty."""
    got = jaccard.jaccard_components(docs, percent=PERCENT, width=WORDS, keys=True)
    key = ["row_key_1", "row_key_2"]
    keep = got.where("kept").groupBy(*key).agg(F.count("*").alias("rows_of_key"), F.max("n_shingles").alias("words_of_key"))
    wide = _packed(docs).withColumns(jaccard.row_keys("doc_id", "text")).join(keep, key)
    order = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))  # rows that repeat an id and its text
    once = wide.where("rows_of_key > 1 AND words_of_key > 0").withColumn("nth_of_key", nth).where("nth_of_key = 1")
    return _unpacked(wide.where("rows_of_key = 1 OR words_of_key = 0"), docs.columns).unionByName(_unpacked(once, docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out strings that occur more than once; what is left of a character that was cut goes too.
    Every document stays, if only with what is left of it; a null text stays null. n_chars follows the text, where there is
    such a column."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").isNull().alias("no_text"))
    kept = suffixes.remove_repeats(docs.select(row.alias("row"), "text"), length=REPEAT, doc_id="row", keep_text=True)
    whole = F.col("kept").cast("string")
    now = F.when(F.is_valid_utf8(whole), whole).otherwise(F.replace(F.make_valid_utf8(whole), F.lit("\ufffd"), F.lit("")))
    now = F.when(~F.col("doc_id.no_text"), now)
    out = {c: F.col("doc_id.row").getField(c) for c in others} | {"text": now}
    if "n_chars" in others:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length(now).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return kept.select([out[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids. Every document has its pieces, a null or empty one that of its end id."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

#: Two classifiers and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if last is not None:
            dropped(spark, last)
        last = docs
    return docs
