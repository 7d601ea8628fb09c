"""Pieces, source spans and decoding against the sentencepiece library on whole texts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import sentencepieces as sp
from tidemark.llm.kernels import text_bytes

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "▁", "▁▁a ▁", "Hello  wörld ▁x <s> </s> <unk> <0x41> 中文\n😀 K", "\x00\x85　 z\t\r\n", "fiﬁ ﬃ Ａ　①  x ½ é 한국어 क़", "x" * 4000, " " * 700 + "y" + " " * 33, "ab" * 900 + "中" * 900,
    "don't 1234567 3.14 #hash", "​­ a﻿", "a", "The the THE.", " a  b",
]
TEXTS = st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aA éﬁ　①▁ \n.1中é<s>的0x41½ ｱﾞ", max_size=80)), min_size=1, max_size=5)


def patched(tmp_path_factory, rule, trim, lead=True):
    """The model with another normaliser: only its specification is replaced."""
    with open(PATH, "rb") as f:
        raw = f.read()
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    spec = b"".join(sp._field(k, v) for k, v in sp.message(spec) if k in (1, 2)) + sp._field(3, int(lead)) + sp._field(4, int(trim)) + sp._field(5, 1)
    out = tmp_path_factory.mktemp("model") / "m.model"
    out.write_bytes(b"".join(sp._field(k, v) for k, v in sp.message(raw) if k != sp.NORMALIZER) + sp._field(sp.NORMALIZER, spec))
    return str(out)


@pytest.fixture(scope="module", params=["plain", "nmt_nfkc", "nfkc_cf", "bare"])
def path(request, tmp_path_factory):
    if request.param == "plain":
        return PATH
    return patched(tmp_path_factory, "identity" if request.param == "bare" else request.param, request.param != "bare", request.param != "bare")


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def encoded(path, texts):
    m = sp.model(path)
    data, bounds = text_bytes(pa.array(texts, pa.string()))
    own = m.normalise(data, bounds)
    ids, n = m.encode(own.data, own.bounds)
    begin, end = m.spans(own, ids)
    at = np.append(0, np.cumsum(n))
    return [(own.data[a0:z0].tobytes(), ids[a:z].tolist(), list(zip((begin[a:z] - b).tolist(), (end[a:z] - b).tolist()))) for a, z, b, a0, z0 in zip(at, at[1:], bounds, own.bounds, own.bounds[1:])]


def check(path, library, texts):
    for t, (normal, ids, spans) in zip(texts, encoded(path, texts), strict=True):
        assert normal.decode() == library.Normalize(t)
        assert ids == library.encode(t)
        source, m = t.encode(), sp.model(path)
        assert b"".join(m.decode(np.array(ids, np.uint32))).decode() == library.decode(ids) or sp.MARK in t
        # Where no map has changed anything, the spans are the library's, and of bytes each its own.
        theirs = [(x.begin, x.end) for x in library.encode(t, return_type="proto").pieces]
        at = 0
        for i, (a, z), own in zip(ids, spans, theirs, strict=True):
            assert 0 <= a <= z <= len(source)
            if not len(m.map.units):
                p, kind = m.pieces[i]
                if kind == sp.BYTE:
                    assert source[a:z] == bytes([int(p[3:5], 16)])
                else:
                    assert (a, z) == own
                    want = source[a:z].replace(b" ", sp.MARK.encode())
                    assert p == want or (at == 0 and p == sp.MARK.encode() + want)
                at = z
        if t and not m.trim and not len(m.map.units):
            assert spans[0][0] == 0 and spans[-1][1] == len(source) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_odd_texts(path, library):
    check(path, library, [t or "" for t in ODD])


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_any_texts(path, library, texts):
    check(path, library, texts)


def test_spans_through_a_map(tmp_path_factory):
    """What stands instead of some characters came from all of them; a mark for a trimmed run from its first space."""
    path = patched(tmp_path_factory, "nmt_nfkc", True)
    (_, ids, spans), = encoded(path, ["  ﬁn  Ａb½ "])
    m, source = sp.model(path), "  ﬁn  Ａb½ ".encode()
    shown = [(m.pieces[i][0].decode(), source[a:z].decode()) for i, (a, z) in zip(ids, spans)]
    assert "".join(p for p, _ in shown) == "▁fin▁Ab1⁄2" and shown[0][1].endswith("ﬁn") and ("▁Ab", "  Ａb") in shown and shown[-1][1] == "½"


def test_models_of_other_kinds_are_refused(tmp_path):
    with open(PATH, "rb") as f:
        fields = list(sp.message(f.read()))
    own = b"".join(sp._field(k, v) for k, v in fields) + sp._field(sp.PIECE, sp._field(1, b"<x>") + sp._field(3, 4))
    (tmp_path / "m").write_bytes(own)
    with pytest.raises(ValueError, match="merges"):
        sp.Model(str(tmp_path / "m"))


def test_query_and_operator(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "a", "")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in sp.encode_pieces(df, PATH).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "")
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (ids, len(ids), library.decode(ids) if ids else "")
        assert got[i].begins[:1] == [0][: len(ids)] and got[i].ends[-1:] == [len((t or "").encode())][: len(ids)]
    assert got[None].n_tokens == 1 and len(got) == len(ODD) + 1
    assert sp.encode_pieces(df.limit(0), PATH).count() == 0

    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        spans = [(x.begin, x.end) for x in library.encode(texts[r.doc_id], return_type="proto").pieces]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.spans_crc32 == zlib.crc32(np.array([a for a, _ in spans] + [z for _, z in spans], "<u4").tobytes()) or any(sp.model(PATH).pieces[i][1] == sp.BYTE for i in ids)


def test_long_text():
    """Twenty million bytes of words, and a stretch without a place to cut."""
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    line = "Some words, wörter 中文 123 and more.\n" * 50
    one = line * (20_000_000 // len(line.encode()))
    (_, ids, spans), = encoded(PATH, [one])
    part = library.encode(line)
    assert len(ids) == len(library.encode(one)) and ids[: len(part) - 20] == part[:-20] and spans[-1][1] == len(one.encode())
    check(PATH, library, ["ab" * 300_000, "x" * 100_000 + " y"])
