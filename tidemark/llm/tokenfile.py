"""Token-id files by plane shuffling.

A file table has one row per chunk: whole documents in order, with about chunk_ids ids or one longer
document. The ids of a chunk are cut into blocks of block_ids ids (the last may be shorter); a block
is transposed into byte planes (byte 0 of every id, byte 1, ...) or bit planes, and every plane is
compressed by zstandard on its own. sizes holds the planes' stored bytes, block by block: the index by which a block
or a plane is found without reading the others. docs and counts (64-bit little-endian) say which documents
the chunk holds and how many ids each has, the first nulls of them without an id; part and first give the chunk's place in the whole.
Spark's Parquet writer stores the rows, so a lost executor leaves no half-written part behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import dropped, small_batches, written
from tidemark.llm.tokens import encoded

FILE = "part int, first long, n_ids long, block_ids int, width int, planes string, nulls long, docs binary, counts binary, sizes array<int>, data binary"

ARROW = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("width", pa.int32()), ("planes", pa.string()), ("nulls", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])
#: Bytes of a row group of the tables: what Spark reads at once.
ROW_GROUP = 8 << 20


def shuffled(ids: np.ndarray, width: int, planes: str) -> list[bytes]:
    """The planes of a block: width byte planes, or 8 * width bit planes, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if planes == "byte":
        return [x.tobytes() for x in rows.T]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(x, bitorder="little").tobytes() for x in bits.T]


def unshuffled(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for i, x in enumerate(planes):
            out[:, i] = np.frombuffer(x, np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") for x in planes], axis=1)
        out[:, :width] = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


def write_token_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, planes: str = "byte", block_ids: int = 1 << 16, chunk_ids: int = 1 << 18, level: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Writes the ids of all rows of docs to the file table at path, in ascending order of doc_id.

    Texts are encoded where they lie; only their ids, two bytes each where the vocabulary allows it, are dealt by
    ranges and sorted. A null text is empty (its only id is end_id); a null doc_id comes first; rows of one doc_id,
    repeated rows too, are all kept, in the order of a hash of their text; a very long text is encoded in parts and
    makes one chunk; other columns are ignored, whatever their names; an empty table gives an empty file table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 40  # parts rows that are equal, so that many of them don't make one range
        for b in batches:
            for i, j, ids, ends in encoded(b.column(2), tokenizer, end_id):
                width = 4 if int(ids.max()) >> 16 else 2
                own = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((ends * width).astype(np.int64)), pa.py_buffer(ids.astype(f"<u{width}"))])
                at = pa.array(np.arange(nth, nth + j - i))
                nth += j - i
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:2]), at, pa.array(np.full(j - i, width, np.int8)), own.cast(pa.binary())], ["doc_id", "h", "at", "width", "ids"])

    known = written(rows.mapInArrow(coded, "doc_id long, h long, at long, width byte, ids binary"), "coded", row_group=ROW_GROUP, codec="zstd")
    ordered = known.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "width", "ids")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=level)
        held: list[tuple[int | None, np.ndarray]] = []
        n_held = 0

        def chunk() -> pa.RecordBatch:
            nonlocal first, n_held
            ids = np.concatenate([x for _, x in held])
            width = 4 if int(ids.max()) >> 24 else 3 if int(ids.max()) >> 16 else 2
            planes_ = [press.compress(p) for k in range(0, len(ids), block_ids) for p in shuffled(ids[k : k + block_ids], width, planes)]
            row = {
                "part": [part], "first": [first], "n_ids": [len(ids)], "block_ids": [block_ids], "width": [width], "planes": [planes],
                "nulls": [sum(d is None for d, _ in held)], "docs": [np.array([d or 0 for d, _ in held], np.int64).tobytes()], "counts": [np.array([len(x) for _, x in held], np.int64).tobytes()],
                "sizes": [[len(x) for x in planes_]], "data": [b"".join(planes_)],
            }
            first, n_held = first + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=ARROW)

        for b in batches:
            for d, width, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype(np.uint32)
                if held and n_held + len(ids) > chunk_ids:
                    yield chunk()
                held.append((d, ids))
                n_held += len(ids)
        if held:
            yield chunk()

    ordered.mapInArrow(stored, FILE).write.option("compression", "none").option("parquet.block.size", ROW_GROUP).parquet(path)
    dropped(spark, known)


def chunk_ids_of(row: dict) -> np.ndarray:
    """All ids of a chunk."""
    open_, at, out = zstandard.ZstdDecompressor(), 0, []
    each = row["width"] * (1 if row["planes"] == "byte" else 8)
    for k in range(0, row["n_ids"], row["block_ids"]):
        n, planes = min(row["block_ids"], row["n_ids"] - k), []
        for size in row["sizes"][len(out) * each : (len(out) + 1) * each]:
            planes.append(open_.decompress(row["data"][at : at + size]))
            at += size
        out.append(unshuffled(planes, n, row["width"], row["planes"]))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def read_token_ids(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit), one
    row per document of the file table at path."""
    files = spark.read.schema(FILE).parquet(path)
    # one row per part: no more of them than the writer had partitions, whatever the data, so they can be broadcast
    before = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, counts = chunk_ids_of(row).astype("<u4", copy=False), np.frombuffer(row["counts"], np.int64)
                ends = np.cumsum(counts)
                # from buffers, as pa.array never lets go of memoryviews, so a worker would keep all ids it has read
                own = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(4 * np.append(0, ends)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["docs"], np.int64), mask=np.arange(len(counts)) < row["nulls"]),  # null ids come first
                        pa.array(row["before"] + row["first"] + ends - counts),
                        pa.array(counts),
                        own.cast(pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return files.join(F.broadcast(before), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
