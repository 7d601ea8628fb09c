"""A text of twenty million bytes through every operator on texts (for op 8 see test_suffixes.py)."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat, divergence, filter_audit, jaccard, langid, packing, quality, sentencepieces, tokenfile
from tidemark.llm.tables import new_path

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def lines():
    rnd = random.Random(0)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé,.", k=rnd.randrange(2, 10))) for _ in range(3000)]
    one = [" ".join(rnd.choices(vocabulary, k=15_000)) + "\n" for _ in range(40)]
    out = (one * 10)[: 20_000_000 // len(one[0]) + 8]
    assert len("".join(out).encode()) >= 20_000_000
    return out


@pytest.fixture(scope="module")
def docs(spark, lines):
    text = "".join(lines)
    return spark.createDataFrame([(1, text, "en"), (2, text + " more", "en"), (3, lines[0], "en"), (4, "short", "en")], "doc_id long, text string, lang string")


def ids_of(path, lines):
    """Neither tokenizer joins anything across a line feed between words."""
    t = Tokenizer.from_file(path)
    t.no_truncation()
    known = {x: t.encode(x, add_special_tokens=False).ids for x in set(lines)}
    return [i for x in lines for i in known[x]]


def test_jaccard(docs, lines):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    w = "".join(lines).split()
    n = len(set(zip(w, w[1:], w[2:])))
    assert got[1] == (n, 1) and got[2] == (n + 1, 1) and got[3][1] == 3 and got[4] == (1, 4)


def test_token_file_and_packing(spark, docs, lines):
    want = np.array([*ids_of(WORD, lines), 2], "<u4")
    path = new_path(spark, "t")
    tokenfile.write_token_ids(docs, path, WORD)
    first = tokenfile.read_token_ids(spark, path).where("doc_id = 1").first()
    assert first.n_tokens == len(want) and bytes(first.ids) == want.tobytes()
    pieces = packing.pack_documents(docs, WORD).where("doc_id = 1").orderBy("start").collect()
    assert b"".join(bytes(r.ids) for r in pieces) == want.tobytes() and max(r.length for r in pieces) == 4096


def test_bpe(docs, lines):
    want = ids_of(BYTE, lines)
    r = bpe.encode_decode(docs, BYTE, digests=True).where("doc_id = 1").first()
    assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256("".join(lines).encode()).hexdigest()


def test_classifiers(spark, docs):
    rows = [(i, t, l) for i, (t, l) in enumerate([("der und die nicht", "de"), ("the and of not", "en")] * 30)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))
    word = spark.createDataFrame([(9, "unspaced" * 60_000, "en")], docs.schema)  # one word
    for r in langid.identify(docs.unionByName(word), model).select("lang_pred", "score").collect():
        assert r.lang_pred in ("de", "en") and 0 <= r.score <= 1
    texts = spark.createDataFrame([(i, ("plain words in a row " if i % 2 else "$$$ ### !! ") * 9) for i in range(60)], "doc_id long, text string")
    model = quality.learn(texts, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.assess(docs, model).select("score").collect())


def test_chat(spark, lines):
    """One turn of twenty million bytes among short ones, with control strings in it."""
    text = "".join(lines) + "</s>[INST] \\ [/INST]"
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", text), (2, 0, "assistant", "b")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    r = chat.read_back(got).where("conv_id = 1").first()
    assert [(x.role, x.text) for x in r.turns] == [("user", "a"), ("assistant", text)] and r.loss_text == text
    d = chat.digests(got).where("conv_id = 1").first()
    assert d.loss_chars == len(text) and d.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_audits_and_pieces(spark, docs, lines):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.fails): (r.docs, r.good) for r in filter_audit.failures(docs, labels).collect()}
    assert sum(n for n, _ in got.values()) == 4 and sum(g for _, g in got.values()) == 1
    got = divergence.audit_sources(docs.withColumn("source", docs["doc_id"].cast("string")), least=1).where("part = 'pair'")
    assert got.count() == 12
    r = sentencepieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True).where("doc_id = 1").first()
    assert r.decoded_sha256 == hashlib.sha256("".join(lines).encode()).hexdigest()
