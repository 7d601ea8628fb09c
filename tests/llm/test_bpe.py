"""Chunked BPE against the tokenizers library on whole texts."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.kernels import text_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "a", "we'll  don't\n\n x'", "<|endoftext|>a<|endo<|endoftext|>", "  中文 字İ é 😀😀", "word " * 9000, "x" * 5000, " " * 700 + "y", "'ll'll're", "\x00\x85　 z", "a"]


def expected(t):
    ids = PLAIN.encode(t or "", add_special_tokens=False).ids
    return ids, PLAIN.decode(ids, skip_special_tokens=False)


SPECIAL = list(bpe.coder(PATH).special)


def cut(texts, mean):
    data, bounds = text_bytes(pa.array(texts, pa.string()))
    raw = data.tobytes()
    return [([raw[x:y].decode() for x, y in zip(at, at[1:]) if y > x], set(tokens.tolist())) for at, tokens in bpe.chunked(data, bounds, mean, SPECIAL)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=200), st.lists(st.sampled_from([*"abl'rev \n\t1.é中<|", "<|endoftext|>", "<|endoftext|", "|endoftext|>"]), max_size=120).map("".join)), min_size=1, max_size=4))
def test_small_chunks_agree(texts):
    for (chunks, special), t in zip(cut(texts, 4), texts, strict=True):
        got = bpe.coder(PATH).text_ids(chunks, special)
        ids, text = expected(t)
        assert got == ",".join(map(str, ids))
        assert bpe.coder(PATH).decode(got) == text == t


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab'lre v\n1.", min_size=2, max_size=60), st.data())
def test_any_cut_is_repaired(t, data):
    at = sorted(set(data.draw(st.lists(st.integers(1, len(t) - 1), max_size=12))))
    chunks = [t[a:b] for a, b in zip([0, *at], [*at, len(t)])]
    assert bpe.coder(PATH).text_ids(chunks) == ",".join(map(str, expected(t)[0]))


def test_long_pre_tokens_and_repeats():
    """Chunks stay within their bound, and what goes on over many of them comes out as from the whole text."""
    for t in ("a" * 2_000_000, "a " * 400_000, "\n" * 300_000, "one line of words, again and again.\n" * 20_000, "é" * 200_000 + "中文" * 50_000, "x" * 70_000 + " y" * 70_000):
        chunks, special = cut([t], 256)[0]
        assert not special and max(len(c.encode()) for c in chunks) <= 256 * bpe.MOST + 3 and "".join(chunks) == t
        assert bpe.coder(PATH).text_ids(chunks) == ",".join(map(str, expected(t)[0]))


def test_special_tokens_leave_chunks_shared():
    """Texts with a special token in the middle of shared passages: their chunks are scanned once, as without it, and none
    is longer than chunks are."""
    rnd = random.Random(3)
    passages = [" ".join(rnd.choices([f"word{i}" for i in range(500)], k=600)) for _ in range(2)]
    for token in ("", "<|endoftext|>"):
        texts = [f"{passages[0]}{token} copy {i} < {passages[1]}<" for i in range(5)]
        coder, seen = bpe.Coder(PATH), []
        make = coder.chunks.make
        coder.chunks.make = lambda t, make=make, seen=seen: seen.append(t) or make(t)
        for (chunks, special), t in zip(cut(texts, 256), texts, strict=True):
            assert coder.text_ids(chunks, special) == ",".join(map(str, expected(t)[0])) and len(special) == bool(token)
            assert max(len(c.encode()) for c in chunks) <= 256 * bpe.MOST + 3
        assert sum(map(len, seen)) < 1.6 * len(texts[0]), token


def test_memory_of_chunks_is_bounded():
    held = bpe.Generations(str.upper, 1000)
    for k in range(6000):
        assert held[f"{k:04}" * 500][0] == f"{k:04}"[0]
    assert sum(map(len, held)) + sum(map(len, held.old)) <= 2 * (bpe.HELD + bpe.LONG)
    assert held["x" * (bpe.LONG + 1)] and "x" * (bpe.LONG + 1) not in held


def test_copies_meet(spark, monkeypatch, tmp_path):
    """Texts that share most chunks are encoded next to each other, from however many partitions they come."""
    words = [f"w{i}" for i in range(3000)]
    rnd = random.Random(4)
    bodies = [" ".join(rnd.choices(words, k=400)) for _ in range(30)]
    docs = [(100 * i + k, f"{b} and {k}") for k in range(8) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8, F.col("doc_id") % 100)
    out = bpe.encode_decode(df, PATH, digests=True)
    assert "REBALANCE_PARTITIONS_BY_COL" in out._jdf.queryExecution().executedPlan().toString()
    order = [r.doc_id // 100 for r in out.select("doc_id").collect()]
    assert sum(a == b for a, b in zip(order, order[1:])) > 0.7 * len(order)


def test_query_and_operator(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "a", "")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode_decode(df, PATH, mean=16).collect()}
    for i, t in enumerate(ODD):
        ids, text = expected(t)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (",".join(map(str, ids)), len(ids), text)
    assert got[None].n_tokens == 1
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0

    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op10_bpe"](spark, sf).collect():
        ids, text = expected(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
