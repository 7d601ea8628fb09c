"""Chat formatting: the registered SQL, and reading back hand-made conversations."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from oracle import compare

from tidemark.llm import chat
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn int, role string, text string, segments string"


def test_equals_sql(spark):
    compare(spark, QUERIES["op1_chat_format"], ORACLE_SQL["op1_chat_format"])


PARTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST] ", "[/INST]", "[NEXT]", "\\", "\\b", "\\s", "\\l", "<", "[", "é😀", "x", "\n", ""]), max_size=8).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "", "a\nb", "[INST] "])), st.one_of(st.none(), PARTS)), max_size=12))
def test_reads_back(spark, turns):
    rows = [(c, i, r, t, "clash") for i, (c, r, t) in enumerate(turns)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got.keys() == {c for c, *_ in turns}
    for c, r in got.items():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == c]
        assert [(x.role, x.text) for x in r.turns] == own
        assert r.loss_text == "".join(t for role, t in own if role == "assistant")


def test_ties_nulls_and_empty(spark):
    rows = [(None, 1, "user", "b", ""), (None, 1, "user", "a", ""), (1, None, "user", "first", ""), (1, 0, "assistant", "yes", ""), (1, 0, "assistant", "yes", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[None].turns_sha256 == hashlib.sha256(b"user\na\nuser\nb\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars) == (3, 6)
    assert chat.format_conversations(df.where("conv_id = 1")).first().formatted == "<s>[INST] user\nfirst[/INST][INST] assistant\nyes[NEXT]yes[/INST]</s>"
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("word", ["Python", "Pandas", "Arrow"])
def test_no_python_in_the_plan(spark, word):
    df = chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA)))
    assert word not in df._jdf.queryExecution().executedPlan().toString()
