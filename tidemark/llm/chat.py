"""Chat formatting with Spark expressions only.

Template, for one conversation: <s> then, for every run of adjacent turns of one role,
[INST] role, a line feed, the run's texts joined by [NEXT], and [/INST]; </s> follows a run of
the assistant. Inside roles and texts the characters that open a mark are escaped
(backslash to \\b, < to \\l, [ to \\s; in roles also line feed to \\n), so a mark can't be forged
and read_back() restores every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNT_ROLE = "assistant"


def escape(c: Column) -> Column:
    for raw, safe in (("\\", "\\b"), ("<", "\\l"), ("[", "\\s")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in (("[", "\\s"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _role_in(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _role_out(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: key, segments (text, loss) and formatted, their concatenation.

    Turns are sorted by (order, role, text): ties and repeated rows are all kept, in that order;
    a null order comes first. A null role or text is the empty string, rows of a null key form one
    conversation, other columns are ignored, and an empty table gives an empty result. loss is
    true for the texts of the assistant and for nothing else. One conversation becomes one
    row, so it must fit in a task.
    """
    got = turns.select(
        F.col(key).alias("k"),
        F.struct(F.col(order).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")).alias("turn"),
    )
    t = F.col("turns")
    n = F.size(t)
    at = lambda i: F.get(t, i)
    opens = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i)["r"] != at(i - 1)["r"]))
    mark = lambda s: F.array(F.struct(s.alias("text"), F.lit(False).alias("loss")))

    def run(first: Column, j: Column) -> Column:
        """Segments of the j-th run, which begins at turn first: its texts aggregated between marks."""
        own = at(first)["r"]
        members = F.slice(t, first + 1, F.coalesce(F.get(F.col("opens"), j + 1), n) - first)
        texts = F.flatten(
            F.transform(
                members,
                lambda x, i: F.concat(
                    F.when(i > 0, mark(F.lit("[NEXT]"))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>")),
                    F.array(F.struct(escape(x["t"]).alias("text"), (own == LEARNT_ROLE).alias("loss"))),
                ),
            )
        )
        close = mark(F.when(own == LEARNT_ROLE, F.lit("[/INST]</s>")).otherwise(F.lit("[/INST]")))
        return F.concat(mark(F.concat(F.lit("[INST] "), _role_in(own), F.lit("\n"))), texts, close)

    return (
        got.groupBy("k")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .withColumn("opens", opens)
        .select("k", F.concat(mark(F.lit("<s>")), F.flatten(F.transform("opens", run))).alias("segments"))
        .select(F.col("k").alias(key), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns (role, text) parsed from formatted, loss_text from the segments under the loss
    mask, and formatted."""
    runs = F.filter(F.split(F.expr("substring(formatted, 4)"), r"\[/INST\](?:</s>)?", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        body = F.substring(b, F.lit(8), F.length(b))  # after "[INST] "
        cut = F.instr(body, "\n")
        role = _role_out(F.substring(body, F.lit(1), cut - 1))
        return F.transform(
            F.split(F.substring(body, cut + 1, F.length(body)), r"\[NEXT\]", -1),
            lambda x: F.struct(role.alias("role"), unescape(x).alias("text")),
        )

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select(key, F.flatten(F.transform(runs, turns)).alias("turns"), loss.alias("loss_text"), "formatted")


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and SHA-256 digests of what read_back() finds."""
    each = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read_back(formatted, key).select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
