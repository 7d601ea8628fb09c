"""Token ids, token files and packing against the tokenizers library, document by document."""

import gc
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, tokenfile
from tidemark.llm.tables import new_path
from tidemark.llm.tokens import encoded, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "a", "don't  we'll\n\tİstanbul ǅ é x", "<|endoftext|> a<|startoftext|>b", "é̖ ́a 中文 12,5 ́", "\x0b\x85　z", "word " * 20_000, "x" * 5000, "a"]


def ids_of(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab'é́ \n\x85<|endoftext>ſßİΣς.,-(1_Ab", max_size=40)), max_size=6))
def test_words_give_the_ids_of_the_text(texts):
    got = [ids[a:b] for _, _, ids, ends in encoded(pa.array(texts, pa.string()), PATH, 2) for a, b in zip(ends, ends[1:])]
    assert [x.tolist() for x in got] == [ids_of(t).tolist() for t in texts]


def test_cache_that_starts_anew(monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokens.REMEMBERED", 5)
    word_ids.cache_clear()
    texts = ["one two three four", "five six seven", "one eight nine ten", "one two one", "a b c d e f g h", "one two a, b. c d", "one x y", "z one"]
    got = [ids[a:b].tolist() for t in texts for _, _, ids, ends in encoded(pa.array([t]), PATH, 2) for a, b in zip(ends, ends[1:])]
    word_ids.cache_clear()
    assert got == [ids_of(t).tolist() for t in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_file_round_trip(spark, planes):
    df = table(spark, ODD).unionByName(spark.createDataFrame([(None, "no id", "", 0), (3, "a", "", 0)], "doc_id long, text string, ids string, start int"))
    path = new_path(spark, "t")
    tokenfile.write_token_ids(df, path, PATH, planes=planes, block_ids=1000, chunk_ids=3000)
    got = tokenfile.read_token_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
        if r.doc_id not in (None, 3):
            assert bytes(r.ids) == ids_of(ODD[r.doc_id]).tobytes()


def test_token_file_of_nothing(spark):
    path = new_path(spark, "t")
    tokenfile.write_token_ids(table(spark, []), path, PATH)
    assert tokenfile.read_token_ids(spark, path).count() == 0


def check_pieces(rows, texts):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    for d, t in enumerate(texts):
        ids, at = ids_of(t), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    return padding


def test_packing(spark):
    df = table(spark, ODD).repartition(3, "doc_id")
    assert check_pieces(packing.pack_documents(df, PATH, hold_ids=2000).collect(), ODD) == 0
    assert packing.pack_documents(table(spark, []), PATH).count() == 0
    null = packing.pack_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), PATH).collect()
    assert [r.doc_id for r in null] == [None] * len(null) and sum(r.length for r in null) == 3


def test_packing_sf(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = packing.pack_documents(docs.repartition(7), PATH, step_ids=20_000).collect()
    assert check_pieces(rows, texts) == 0
    steps, total = {}, {}
    for r in rows:
        of = steps.setdefault(r.tier, {})
        of[r.step_group] = of.get(r.step_group, 0) + r.length
        total[r.tier] = total.get(r.tier, 0) + r.length
    assert len({g for of in steps.values() for g in of}) == sum(map(len, steps.values()))  # one tier each
    for tier, of in steps.items():
        assert len(of) == max(1, round(total[tier] / 20_000)) and max(of.values()) - min(of.values()) <= 2 * tier, (tier, of)


def test_registered_digests(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    at = 0
    for r in QUERIES["op6_token_file"](spark, sf).orderBy("doc_id").collect():
        ids = ids_of(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)
    for r in QUERIES["op3_packing"](spark, sf).collect():
        assert r.ids_crc32 == zlib.crc32(ids_of(texts[r.doc_id])[r.start : r.start + r.length].astype("<u4").tobytes())


def test_every_doc_id_comes_back(spark):
    """Null ids, the least and the greatest long, zero; several of a kind."""
    ids = [None, None, -(2**63), -(2**63), 0, 2**63 - 1, -1]
    path = new_path(spark, "t")
    tokenfile.write_token_ids(spark.createDataFrame([(i, f"word {k}") for k, i in enumerate(ids)], "doc_id long, text string"), path, PATH, chunk_ids=8)
    got = tokenfile.read_token_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(2**63), -(2**63), -1, 0, 2**63 - 1] and [r.start for r in got] == list(range(0, 21, 3))


def test_reading_keeps_no_ids(spark, monkeypatch):
    """A worker that reads many chunks, task after task, has none of them left."""
    path = new_path(spark, "t")
    tokenfile.write_token_ids(table(spark, ["word " * 5000, "a", "", "one two " * 5000]), path, PATH, chunk_ids=8000)
    own: list = []
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, _: own.append(f) or self)
        batches = tokenfile.read_token_ids(spark, path).toArrow().to_batches()
    assert sum(x.num_rows for x in own[0](iter(batches))) == 4
    tracemalloc.start()
    for _ in range(50):
        n = sum(x.column(3).nbytes for x in own[0](iter(batches)))
    gc.collect()
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert n > 60_000 and left < 10 * n, left
