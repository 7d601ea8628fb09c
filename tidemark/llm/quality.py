"""A quality classifier from compression.

Two zstandard dictionaries are built from texts labelled good and bad. Each chunk of a text is compressed
with either; the difference of the sizes, normalised by the text's bytes, becomes a probability by a
logistic curve that is fitted on labelled rows other than those in the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.kernels import text_bytes
from tidemark.llm.sampling import bounded, held_out
from tidemark.llm.tables import dropped, small_batches, written

CHUNK, LEVEL = 2048, 3


class Model:
    """Dictionaries (bad, good) and the curve: score = 1 / (1 + exp(-(slope * x + shift)))."""

    def __init__(self, dictionaries: tuple[bytes, bytes], usual: float = 0.0, pull: float = 0.0, slope: float = 0.0, shift: float = 0.0):
        self.dictionaries, self.usual, self.pull, self.slope, self.shift = dictionaries, usual, pull, slope, shift
        self.press = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"press": None}

    def differences(self, raw: bytes) -> int:
        """Bytes by which the whole text is larger with the bad dictionary than with the good one."""
        if self.press is None:
            self.press = []
            for d in self.dictionaries:
                own = zstandard.ZstdCompressionDict(d)
                own.precompute_compress(level=LEVEL)
                self.press.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        bad, good = self.press
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        return sum(len(bad.compress(x)) for x in parts) - sum(len(good.compress(x)) for x in parts)

    def score(self, diff: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A short text tells little, so it is drawn towards the usual value by pull bytes."""
        x = (diff + self.pull * self.usual) / np.maximum(size + self.pull, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -700, 700)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value by Newton steps, with a slight pull towards no slope."""
    m, s = x.mean(), x.std() or 1.0
    z = np.stack([(x - m) / s, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1.0, 0.1]), z.T @ (y - p) - np.array([1.0, 0.1]) * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w[0] / s, w[1] - w[0] * m / s


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 1500, dictionary: int = 1 << 16, sample_bytes: int = 1 << 21, pull: float = 64.0, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Model:
    """Fits on about per_label rows of each label that are not held out. In the order of a hash of their ids they
    go by turns to the dictionaries (at most sample_bytes of text for each label, which is what reaches the driver; of a
    very long text what has room) and to the curve.

    Labels other than 0 and 1, null texts and ids are left out; labels of documents that aren't there, too; texts that
    are empty tell nothing. A document with both labels counts for either; of rows of one id (repeated rows, ties) one
    counts, that with the smallest hash of its text; other columns are ignored. Without rows of both labels, as over
    empty tables, every score is the share of label 1 among what there is, or 0.5.
    """
    small_batches(docs.sparkSession)
    able = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("d"), F.col(quality).cast("int").alias("q")).distinct()
    some = bounded(able, "q", "d", per_label)  # at most about 2 * per_label small rows
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.encode(F.col(text), "UTF-8").alias("t"))
    # first the sizes only: they tell which rows go where, and how much of them
    found = texts.select("d", F.octet_length("t").alias("size"), F.xxhash64("t").alias("h")).join(F.broadcast(some), "d").where("size > 0")
    found = found.groupBy("q", "d").agg(F.min(F.struct("h", "size")).alias("x")).select("q", "d", "x.*")
    order = F.xxhash64("d", F.lit(7)), F.col("d")
    dealt = found.withColumn("curve", F.row_number().over(Window.partitionBy("q").orderBy(*order)) % 2 == 0)
    room = sample_bytes + F.col("size") - F.sum("size").over(Window.partitionBy("q", "curve").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    dealt = written(dealt.withColumn("room", F.least("size", room).cast("int")).where("curve OR room > 0"), "sample")

    # the texts of these few rows, each once: whole for the curve, else what has room
    few = dealt.select("q", "d", "h", "curve", F.when(F.col("curve"), F.col("size")).otherwise(F.col("room")).alias("most"))
    own = texts.join(F.broadcast(few), "d").where(F.xxhash64("t") == F.col("h"))
    own = written(own.groupBy("q", "d", "curve").agg(F.any_value(F.substring(F.col("t"), F.lit(1), F.col("most"))).alias("t")), "sample-texts")
    samples: list[list[bytes]] = [[], []]
    for r in own.where("NOT curve").orderBy("q", *order).collect():
        samples[r["q"]] += [bytes(r["t"][i : i + CHUNK]) for i in range(0, len(r["t"]), CHUNK)]
    if not (samples[0] and samples[1]):
        n = {r["q"]: r["n"] for r in dealt.groupBy("q").agg(F.count("*").alias("n")).collect()}
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        return Model((b"", b""), shift=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    model = Model(tuple(_dictionary(x, dictionary) for x in samples), pull=pull)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"q": b["q"], "diff": [model.differences(x) for x in b["t"]], "size": b["t"].map(len)})

    fit = own.where("curve").select("q", "t").mapInPandas(sizes, "q int, diff long, size long").toPandas()
    dropped(docs.sparkSession, dealt)
    dropped(docs.sparkSession, own)
    if fit["q"].nunique() < 2:  # one row of a label: the dictionaries' own text tells what there is to tell
        fit = pd.DataFrame({"q": [q for q in (0, 1) for _ in samples[q]], "diff": [model.differences(x) for q in (0, 1) for x in samples[q]], "size": [len(x) for q in (0, 1) for x in samples[q]]})
    good = fit[(fit["q"] == 1) & (fit["size"] > 0)]
    model.usual = float(good["diff"].sum() / max(1, good["size"].sum()))
    x = (fit["diff"] + pull * model.usual) / (fit["size"] + pull)
    model.slope, model.shift = _curve(x.to_numpy(float), fit["q"].to_numpy(float))
    return model


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: their text is the dictionary
        return b"".join(samples)[-size:] or b" " * 8


def assess(docs: DataFrame, model: Model, text: str = "text", digits: int = 6) -> DataFrame:
    """score (0 to 1, higher: label 1 likelier) besides all columns of docs; a column of this name is
    replaced, others stay as they are.

    Null and empty texts get the score of a text that tells nothing. A very long text is compressed whole, in chunks;
    repeated rows and ties get equal scores each; null ids don't matter; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop("score")
    names = kept.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(at))
            raw = data.tobytes()
            diff = np.array([model.differences(raw[i:j]) if model.dictionaries[0] else 0 for i, j in zip(bounds[:-1], bounds[1:], strict=True)], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(model.score(diff, np.diff(bounds)), digits))], [*names, "score"])

    return kept.mapInArrow(run, kept.select("*", F.lit(0.0).alias("score")).schema)
