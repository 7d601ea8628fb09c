"""How filters of a corpus act upon each other: what each removes in every order.

Documents are counted by part and by which filters they fail, n yes-or-no answers, so a part is a tensor of 2**n counts
however many documents it has. Every number of the report is a contraction of that tensor: along each filter's axis
the passing half, the failing half or both are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache, reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space that parts words.
SPACES = " \t\n\x0b\x0c\r"
PASS, FAIL, ALL = 0, 1, 2
#: What is taken of an axis whose first half passes.
TAKEN = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def few_words(words: Column, text: Column) -> Column:
    """Under 200 words."""
    return F.size(words) < 200


def repeated_words(words: Column, text: Column) -> Column:
    """Fewer than half of the words are distinct."""
    return 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long")


def capitals(words: Column, text: Column) -> Column:
    """More than 3 of 100 characters are A to Z."""
    return 100 * (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long") > 3 * F.char_length(text).cast("long")


def marks(words: Column, text: Column) -> Column:
    """Holds one of the marks of code and tables."""
    return text.rlike("[#$%&*|]")


#: By letter, in the order of the tensor's axes; the last axis is that of copies.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": repeated_words, "C": capitals, "D": marks}
COPIES = "E"


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, part: str = "lang") -> DataFrame:
    """part, fails (a number with one bit for each filter, the first highest, and the lowest for copies), docs, good, toxic:
    documents by part and by what they fail, and how many of them have a label of quality or of toxicity 1.

    The last filter fails a document whose text some smaller doc_id has, anywhere in the table; texts are told apart by
    SHA-256. Texts are read once and only digests travel. Rows that agree in text, part and id are counted first, then
    those that agree in text and part, with the least id and its counts, so a text that a third of all rows share is a row
    a task before anything is shuffled by it.

    A null text is empty, a null part the empty string. A row with null doc_id is no copy of anything, nothing is a copy
    of it, and it has no label. Rows equal in id and text are copies of smaller ids only, each counted. Of several labels of an id
    the greatest count. Other columns are ignored; an empty table gives no row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = F.btrim(text, F.lit(SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    bits = reduce(lambda n, f: n * 2 + f(F.col("words"), F.col("text")).cast("int"), filters.values(), F.lit(0))
    rows = read.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # Rows without an id find no label: they are spread by their digests.
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("spread"), "quality", "toxic").where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id", "spread").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sums = lambda *names: [F.sum(F.coalesce(x, F.lit(0))).cast("long").alias(x) for x in names]
    by_id = rows.join(known, ["doc_id", "spread"], "left").groupBy("doc_id", "spread", "digest", "part", "bits").agg(F.count("*").alias("docs"), *sums("good", "toxic"))
    least = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "docs", "good", "toxic"))
    by_text = by_id.groupBy("digest", "part", "bits").agg(F.min(least).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("docs")).otherwise(0)).alias("free"), *sums("docs", "good", "toxic"))
    # A text has one row for each part by now.
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    own = F.col("least.doc_id") == F.col("first")
    keeps = {x: F.when(own, F.col(f"least.{x}")).otherwise(0) + (F.col("free") if x == "docs" else 0) for x in ("docs", "good", "toxic")}
    both = by_text.withColumn("first", first).select(
        "part",
        F.inline(F.array(F.struct((F.col("bits") * 2).alias("fails"), *[c.alias(x) for x, c in keeps.items()]), F.struct((F.col("bits") * 2 + 1).alias("fails"), *[(F.col(x) - c).alias(x) for x, c in keeps.items()]))),
    )
    return both.where("docs > 0").groupBy("part", "fails").agg(*sums("docs", "good", "toxic"))


@lru_cache
def steps(letters: str) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
    """Every order and step, the axis of the step's filter, and for each axis its place relative to it: taken before,
    now or later."""
    names, axis, when = [], [], []
    for order in permutations(range(len(letters))):
        for k, f in enumerate(order):
            names.append(("".join(letters[i] for i in order), k + 1))
            axis.append(f)
            when.append([np.sign(order.index(i) - k) for i in range(len(letters))])
    return names, np.array(axis), np.array(when)


def contracted(tensors: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Sums of tensors (first axis: which one) for every row of taken, which says for each axis PASS, FAIL or ALL."""
    n = taken.shape[1]
    axes = "abcdefghijklmnopqrst"[:n]
    return np.einsum(f"z{axes}," + ",".join(f"y{x}" for x in axes) + "->zy", tensors, *[TAKEN[taken[:, i]] for i in range(n)], optimize=True)


def report(part: str, fails: np.ndarray, counts: np.ndarray, letters: str) -> pa.RecordBatch:
    """All rows of one part; counts has rows for documents, good and toxic ones, and a column for each number in fails."""
    n = len(letters)
    tensors = np.zeros((3, 2**n), np.int64)
    np.add.at(tensors, (slice(None), fails), counts)
    tensors = tensors.reshape(3, *[2] * n)
    names, axis, when = steps(letters)
    before, now = np.where(when < 0, PASS, ALL), when == 0
    removed, good, toxic = contracted(tensors, np.where(now, FAIL, before))
    kept = contracted(tensors[:1], np.where(now, PASS, before))[0]
    alone = np.eye(n, dtype=bool)
    failing, unique = (contracted(tensors[:1], np.where(alone, FAIL, x))[0] for x in (ALL, PASS))
    over_orders = np.zeros(n, np.int64)
    np.add.at(over_orders, axis, removed)
    columns = [[part] * len(names), [x for x, _ in names], np.array([k for _, k in names], np.int32), kept, removed, failing[axis] - removed, unique[axis], good, toxic, over_orders[axis]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in REPORT.split(", ")])


def interactions(counts: DataFrame, letters: Sequence[str]) -> DataFrame:
    """The report of counts (part, fails, docs, good, toxic): one row for each part, order of all filters and step."""
    own = "".join(letters)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        numbers = np.array([rows[x].to_numpy() for x in ("docs", "good", "toxic")], np.int64)
        return pa.Table.from_batches([report(key[0].as_py(), rows["fails"].to_numpy(), numbers, own)])

    return counts.groupBy("part").applyInArrow(run, REPORT)


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, part: str = "lang") -> DataFrame:
    """For every part, every order of the filters (copies last by letter) and every step: kept (after the step),
    removed (by it), redundant (fail its filter but went before), unique_fails (fail no other filter), good_lost and toxic_lost
    (removed, of label 1) and shapley (removed by the filter, summed over all orders). Cases of rows: see failures()."""
    return interactions(failures(docs, labels, filters, part), [*filters, COPIES])
