"""How the sources of a language differ in their words, term by term and source by source.

Counts of (language, source, term) make a sparse matrix with a row for each source. What two sources differ in, summed
over all terms, is a product of that matrix with its transpose under a function of two smoothed shares. It is taken by rows
(Gustavson): in a block of terms the index lists the sources of each term; a source's row scatters, through the lists of its
terms, into a dense accumulator with a place for each peer. No pair of postings leaves a task. The index lacks zeros, so each cell is counted as what
it adds to the baselines: the function where either count or both are zero, which follow from how many terms of a source have each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.kernels import pieces, runs, text_bytes, words
from tidemark.llm.tables import small_batches, written

#: Shares are whole numbers, one for this many.
UNIT = 1_000_000_000
#: Bytes of text counted together, cells of an accumulator, and postings or cells worked on at a time.
HELD, CELLS, BLOCK = 8 << 20, 1 << 22, 1 << 20
#: Parts of the counts of a source.
SHARDS = 4


def _apart() -> np.ndarray:
    """Bytes outside terms: all of ASCII but letters."""
    out = np.arange(256) < 128
    out[65:91] = out[97:123] = False
    return out


APART = _apart()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it). Texts are counted where they lie, some megabytes
    at a time, so what is shuffled is counts that were summed before. Null text, lang and source are empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= HELD:
                yield from counted(pa.Table.from_batches(held))
                held = []
        if held:
            yield from counted(pa.Table.from_batches(held))

    got = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    names = [rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source")]
    group = names[0].indices.to_numpy().astype(np.int64) * len(names[1].dictionary) + names[1].indices.to_numpy()
    data, bounds = text_bytes(rows["text"])
    for i, j in pieces(bounds, HELD):
        own, places = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        start, end, text = words(own, places, APART)
        if not len(start):
            continue
        ends = np.append(0, np.cumsum(end - start)).astype(np.int64)
        letters = LOWER[own[~APART[own]]]  # terms are all there is of such bytes, in order
        terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
        k = len(terms.dictionary)
        pair, n = np.unique(text * k + terms.indices.to_numpy(), return_counts=True)
        key = group[i + pair // k] * k + pair % k
        order = np.argsort(key, kind="stable")
        first, size = runs([key[order]])
        key, n = key[order[first]], np.add.reduceat(n[order], first)
        g = key // k
        lang, source = g // len(names[1].dictionary), g % len(names[1].dictionary)
        yield pa.RecordBatch.from_arrays(
            [names[0].dictionary.take(pa.array(lang)), names[1].dictionary.take(pa.array(source)), pc.cast(terms.dictionary.take(pa.array(key % k)), pa.string()), pa.array(n.astype(np.int64)), pa.array(size.astype(np.int64))],
            ["lang", "source", "term", "n", "docs"],
        )


def share(count: str | Column, total: str | Column, kept: str | Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + kept)), exactly."""
    count, total, kept = (F.col(x) if isinstance(x, str) else x for x in (count, total, kept))
    return F.call_function("div", (count + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + kept).cast("decimal(20,0)")) + 1


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def cell_sums(postings: DataFrame) -> DataFrame:
    """lang, a, b, value: for each two sources of a language that share a term, the sum over shared terms of what the pair's
    cells add to the baselines. postings: lang, term, id (the source's place in the language), sources (how many it has), p
    and p0 (the source's share of the term and of a term it lacks).

    Terms are dealt by hash, so a language is spread however large; a term comes with all its sources. Where a language has
    so many sources that their accumulators exceed CELLS, each row of the index goes to several tasks, one for each band of rows.
    """
    width = F.greatest(F.lit(1), F.call_function("div", F.lit(CELLS), F.col("sources"))).cast("int")
    bands = F.sequence(F.lit(0), F.call_function("div", F.col("sources") - 1, width).cast("int"))
    wide = postings.select("lang", F.explode(bands).alias("band"), "term", "id", "p", "p0", "sources", width.alias("width"))
    dealt = wide.repartition("lang", "band", "term").sortWithinPartitions("lang", "band", "term")

    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, low, sums = None, 0, np.zeros((0, 0), np.int64)
        for rows in whole_terms(batches, block):
            lang, band = rows["lang"].combine_chunks().dictionary_encode(), rows["band"].to_numpy()
            term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            at = lang.indices.to_numpy()
            numbers = [rows[c].to_numpy() for c in ("id", "p", "p0", "sources", "width")]
            for a, n in zip(*runs([at, band]), strict=True):
                ids, p, p0, sources, width = (x[a : a + n] for x in numbers)
                key = lang.dictionary[int(at[a])].as_py(), int(band[a])
                if key != own:
                    if own:
                        yield from cells(own[0], low, sums)
                    own, low = key, key[1] * int(width[0])
                    sums = np.zeros((min(int(width[0]), int(sources[0]) - low), int(sources[0])), np.int64)
                accumulate(sums, low, term[a : a + n], ids, p, p0)
        if own:
            yield from cells(own[0], low, sums)

    return dealt.mapInArrow(run, PAIR)


PAIR = "lang string, a int, b int, value long"


def whole_terms(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Rows in blocks of about so many that part no term of a language and band."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < block:
            continue
        rows = pa.Table.from_batches(held)
        last = rows.slice(rows.num_rows - 1)
        same = pc.and_(pc.equal(rows["term"], last["term"][0]), pc.and_(pc.equal(rows["lang"], last["lang"][0]), pc.equal(rows["band"], last["band"][0])))
        cut = pc.index(same, True).as_py()
        if cut:
            yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def accumulate(sums: np.ndarray, low: int, term: np.ndarray, ids: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
    """Adds a block of the index to the rows of sums, whose first is that of source low. The block is sorted by term."""
    first, size = runs([term])
    of = np.repeat(np.arange(len(first)), size)
    by_row = np.argsort(ids, kind="stable")
    for a, n in zip(*runs([ids[by_row]]), strict=True):
        mine = by_row[a : a + n]
        row = int(ids[mine[0]]) - low
        if not 0 <= row < len(sums):
            continue
        lists = size[of[mine]]
        at = np.repeat(first[of[mine]] - (np.cumsum(lists) - lists), lists) + np.arange(lists.sum())
        here, zero, there, lack = np.repeat(p[mine], lists), p0[mine[0]], p[at], p0[at]
        np.add.at(sums[row], ids[at], f(here, there) - f(here, lack) - f(zero, there) + f(zero, lack))


def cells(lang: str, low: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of different sources that an accumulator, whose first row is that of source low, has a sum for."""
    for k in range(len(sums)):
        b = np.flatnonzero(sums[k])
        b = b[b != low + k].astype(np.int32)
        if len(b):
            yield pairs(lang, np.full(len(b), low + k, np.int32), b, sums[k][b])


def pairs(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(value)], [x.split()[0] for x in PAIR.split(", ")])


def baselines(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, a, b, value: rows that sum, for each two sources, to what the pair would have if no term were in both.

    A source's terms are told by its counts alone: each count and how many terms have it, in SHARDS parts. Each part meets
    the shares of zero of all peers of the language, a dense row as long as there are sources.
    """
    zeros = groups.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "p0"))), lambda x: x["p0"]).alias("zeros"))
    of = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(groups, ["lang", "source"])
    entry = F.struct(share("n", "total", "terms").alias("p"), "m")
    parts = of.groupBy("lang", "id", "p0", "terms", F.pmod("n", F.lit(SHARDS)).alias("shard")).agg(F.collect_list(entry).alias("counts")).drop("shard")
    none = groups.select("lang", "id", "p0", "terms", F.array().cast("array<struct<p:long,m:long>>").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lang, own, p0, terms = (b.column(c)[k].as_py() for c in ("lang", "id", "p0", "terms"))
                lack = b.column("zeros")[k].values.to_numpy()
                table = b.column("counts")[k].values
                others = np.delete(np.arange(len(lack), dtype=np.int32), own)
                me = np.full(len(others), own, np.int32)
                if not len(table):
                    yield pairs(lang, me, others, terms * f(np.int64(p0), lack[others]) if terms else np.zeros(len(others), np.int64))
                    continue
                p, m = (table.field(x).to_numpy() for x in ("p", "m"))
                lack, here, there = lack[others], np.zeros(len(others), np.int64), np.zeros(len(others), np.int64)
                for at in range(0, len(p), max(1, BLOCK // max(1, len(lack)))):
                    q, n = (x[at : at + max(1, BLOCK // max(1, len(lack)))][:, None] for x in (p, m))
                    here += (n * (f(q, lack) - f(np.int64(p0), lack))).sum(0)
                    there += (n * (f(lack, q) - f(lack, np.int64(p0)))).sum(0)
                yield pairs(lang, me, others, here)
                yield pairs(lang, others, me, there)

    return parts.unionByName(none).join(zeros, "lang").mapInArrow(run, PAIR)


def audit_sources(docs: DataFrame, least: int = 3, ranks: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: in part pair every other source of the language, by what the source's shares of
    terms differ from its own; in part term the terms that the source has more of than the language, at most so many ranks.

    Kept are the terms that at least `least` rows of the language hold. A count c of a source or language that has N in all over V kept
    terms is the share p = 1 + floor(UNIT (c + 1) / (N + V)); p differs from q by floor((p - q)**2 / q). All of it in whole numbers.

    Null text, lang and source are empty strings, which are a language and a source like others. A source without terms has
    its pairs; where nothing is kept these are 0. Rows count each, repeated ids and texts, too; ids and other columns are not
    read. Ties go by the item's bytes. An empty table gives no row. A very long text is counted whole.
    """
    w = Window.partitionBy("lang", "term")  # as many rows as sources have the term
    counts = term_counts(docs).withColumns({"held": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "once": F.col("source") == F.min("source").over(w)})
    counts = written(counts.where(F.col("held") >= least).drop("docs", "held"), "term-counts")
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_lang = counts.groupBy("lang").agg(F.count_if("once").alias("terms"), F.sum("n").alias("lang_total"))
    groups = every.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0)
    by_name = Window.partitionBy("lang")  # as many rows as a language has sources
    groups = groups.withColumns({"id": F.row_number().over(by_name.orderBy("source")) - 1, "sources": F.count("*").over(by_name), "p0": F.when(F.col("terms") > 0, share(F.lit(0), "total", "terms")).otherwise(1)})
    groups = written(groups, "source-groups")
    rows = counts.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")})
    both = cell_sums(rows).unionByName(baselines(groups, counts)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda of, as_: groups.select("lang", F.col("id").alias(of), F.col("source").alias(as_))
    between = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    above = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = lambda x, part: x.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(between, "pair").unionByName(out(above, "term").where(F.col("rank") <= ranks))
