"""Audit of how far the sources of a language are from each other in their vocabulary.

A byte-level tokenizer turns each batch into exact word numbers and hands on
counts by (language, source, term) only; those of one language's term travel
together, in the one shuffle that sums them up and tells which terms are kept.
Kept terms are dealt in blocks; a block
holds its counts as a sparse matrix by source, whose divergences from one
source at a time are summed along the rows (``reduceat``).  Sums over blocks,
exact in integers, are the divergences.  The best terms of each source are found
within blocks and ranked among these few afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_words import buffer_of, chunks, table_of, words_of
from .common import checkpointed, written

#: ASCII letters, and every byte of characters beyond ASCII.
TERM_BYTES = table_of(lambda byte: byte >= 128 or chr(byte).isalpha())
#: Probabilities are whole parts of so many.
SCALE = 1_000_000_000
#: Kept terms in a block, about.
TERMS_PER_BLOCK = 2048


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) for each chunk of texts, in order of terms and, within these, of languages."""
    for batch in batches:
        texts, codes = batch.column("text"), [batch.column(c).dictionary_encode() for c in ("lang", "source")]
        pairs = codes[0].indices.to_numpy().astype(np.int64) * len(batch) + codes[1].indices.to_numpy()
        names, first, group = np.unique(pairs, return_index=True, return_inverse=True)
        first = pa.array(first)
        langs, sources = batch.column("lang").take(first), batch.column("source").take(first)
        data, offsets = buffer_of(texts)
        cut_text, met = -1, set()
        for text, begin, bounds in chunks(data, offsets, ~TERM_BYTES):
            found = words_of(data[begin : begin + int(bounds[-1])], bounds, TERM_BYTES)
            if not len(found.code):
                continue
            # Occurrences by (term, text), then occurrences and texts by (term, group).
            pairs, n = np.unique(found.code * len(bounds) + found.text, return_counts=True)
            term, own = pairs // len(bounds), group[text + pairs % len(bounds)]
            cells, cell = np.unique(term * len(names) + own, return_inverse=True)
            total, docs = np.zeros(len(cells), np.int64), np.bincount(cell, minlength=len(cells))
            np.add.at(total, cell, n)
            if len(bounds) == 2:  # perhaps one of several parts of a text, which counts once for each term
                if cut_text != text:
                    cut_text, met = text, set()
                values = [found.distinct[k] for k in (cells // len(names)).tolist()]
                docs = np.array([value not in met for value in values], np.int64)
                met.update(values)
            terms = pa.array([value.decode() for value in found.distinct], pa.string()).take(pa.array(cells // len(names)))
            at = pa.array(cells % len(names))
            yield _rows(langs.take(at), sources.take(at), terms, total, docs)


_TERMS = "lang string, term string, cells array<struct<source: string, n: long, docs: long>>"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_counted``, those of a language's term in a chunk as one row with a list."""
    for rows in _counted(batches):
        langs, terms = rows.column("lang"), rows.column("term")
        moved = pc.or_(pc.not_equal(langs[1:], langs[:-1]), pc.not_equal(terms[1:], terms[:-1]))
        first = np.concatenate([[0], np.flatnonzero(moved.to_numpy(zero_copy_only=False)) + 1])
        cells = pa.StructArray.from_arrays([rows.column(c) for c in ("source", "n", "docs")], names=["source", "n", "docs"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), cells)
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(first)), terms.take(pa.array(first)), lists], names=["lang", "term", "cells"])


def _rows(*columns) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([c.cast(kind) if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])


def parts_of(count: np.ndarray, total: int) -> np.ndarray:
    """floor(SCALE * count / total) + 1 for count <= total, exact also where the product passes 64 bits."""
    found, rest = np.zeros_like(count), count
    for _ in range(3):  # three digits of base 1000
        high, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + high
    return found + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The term's part of the divergence of ``p`` from ``q``."""
    return (p - q) ** 2 // q


def block_divergences(sources: pd.DataFrame, cells: pd.DataFrame, best: int) -> pd.DataFrame:
    """(source, part, item, value) of a block: pairs' sums over its terms, and each source's best terms.

    ``sources``: (source, words, kept, lang_words) of all the language's sources;
    ``cells``: (term, source, n), a row for each term and source with the term.
    """
    sources = sources.sort_values("source", key=_utf8).reset_index(drop=True)
    names, totals = sources["source"].tolist(), (sources["words"] + sources["kept"]).to_numpy(np.int64)
    kept, lang_words = int(sources["kept"].iloc[0]), int(sources["lang_words"].iloc[0])
    pairs = np.zeros((len(names), len(names)), np.int64)
    tops: list[tuple[str, str, str, int]] = []
    if len(cells):
        terms = sorted(cells["term"].unique().tolist(), key=str.encode)
        column = cells["term"].map({term: k for k, term in enumerate(terms)}).to_numpy(np.int64)
        row = cells["source"].map({name: k for k, name in enumerate(names)}).to_numpy(np.int64)
        order = np.lexsort((column, row))
        row, column, n = row[order], column[order], cells["n"].to_numpy(np.int64)[order]
        starts = np.searchsorted(row, np.arange(len(names) + 1))
        filled = np.flatnonzero(np.diff(starts))
        p = np.concatenate([parts_of(n[a:b] + 1, total) for a, b, total in zip(starts[:-1], starts[1:], totals.tolist(), strict=True)])
        # What a source gives a term that it has not.
        bare = np.concatenate([parts_of(np.ones(1, np.int64), total) for total in totals.tolist()])

        def row_sums(values: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(names), np.int64)
            sums[filled] = np.add.reduceat(values, starts[filled])
            return sums

        for a, (begin, end) in enumerate(pairwise(starts)):
            own = np.full(len(terms), bare[a])
            own[column[begin:end]] = p[begin:end]
            has = np.zeros(len(terms), bool)
            has[column[begin:end]] = True
            against, lone = own[column], bare[row]
            both = has[column]
            # Terms of the other source; then terms of this source alone, by their few distinct values; then those of neither.
            values, times = np.unique(p[begin:end], return_counts=True)
            alone = np.array([(gain(values, q) * times).sum() for q in bare]) - row_sums(np.where(both, gain(against, lone), 0))
            neither = len(terms) - (end - begin) - np.diff(starts) + row_sums(both.astype(np.int64))
            pairs[a] = row_sums(gain(against, p)) + alone + neither * gain(bare[a], bare)
        by_term = np.lexsort((row, column))
        lang_n = np.add.reduceat(n[by_term], np.searchsorted(column[by_term], np.arange(len(terms))))
        q = parts_of(lang_n + 1, lang_words + kept)[column]
        value = gain(p, q)
        for a in filled.tolist():
            mine = np.flatnonzero((row == a) & (p > q))
            mine = mine[np.lexsort((column[mine], -value[mine]))][:best]
            tops += [(names[a], "term", terms[k], v) for k, v in zip(column[mine].tolist(), value[mine].tolist(), strict=True)]
    rows = [(names[a], "pair", names[b], int(pairs[a, b])) for a in range(len(names)) for b in range(len(names)) if a != b] + tops
    return pd.DataFrame({name: pd.Series([row[k] for row in rows], dtype=kind) for k, (name, kind) in enumerate({"source": object, "part": object, "item": object, "value": np.int64}.items())})


def _utf8(column: pd.Series) -> pd.Series:
    return column.map(str.encode)


def source_divergence(docs: DataFrame, least_docs: int = 3, best: int = 200, terms_per_block: int = TERMS_PER_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences between a language's sources and each source's most telling terms.

    ``docs`` has (text, lang, source) and any further columns, which are not
    read.  A language keeps the terms that ``least_docs`` of its rows hold.  Part
    ``pair`` has every other source with the sum, over all kept terms, of
    (p - q)^2 / q, where p and q are the two sources' smoothed probabilities in
    whole parts of ``SCALE``; part ``term`` has the ``best`` terms that are more
    likely in the source than in its language, with their own part of the
    divergence from it.

    Defined cases: null text, lang and source are empty strings; a language whose
    rows hold no kept term has pairs of value 0 and no terms; a language with
    one source has no pairs; ties rank by the item's bytes; repeated rows count
    one by one; a very long text is read in parts; an empty table gives no rows.
    """
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    found = docs.select(*blank).mapInArrow(_gathered, _TERMS).repartition("lang", "term").select("lang", "term", F.explode("cells").alias("cell"))
    counts = found.groupBy("lang", "term", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("n"), F.sum("cell.docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term").orderBy("source")
    held = F.sum("docs").over(of_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = counts.select("lang", "term", "source", "n", held.alias("held"), F.row_number().over(of_term).alias("place")).where(F.col("held") >= least_docs)
    kept = written(kept.drop("held"), "kept_terms")
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    sizes = kept.groupBy("lang").agg(F.count_if(F.col("place") == 1).alias("kept"))
    groups = docs.select(*blank[:2]).distinct().join(words, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["words", "kept"])
    groups = checkpointed(groups.withColumn("lang_words", F.sum("words").over(Window.partitionBy("lang"))))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / terms_per_block)).cast("int")
    dealt = kept.join(sizes, "lang").select(F.col("lang").alias("lang"), F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "term", F.col("source").alias("source"), F.col("n").alias("n"))
    asked = groups.select(*(F.col(c).alias(c) for c in groups.columns), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))

    def judged(key: tuple, sources: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        found = block_divergences(sources, cells, best)
        found.insert(0, "lang", pd.Series([key[0]] * len(found), dtype=object))
        return found

    by_block = asked.groupBy("lang", "block").cogroup(dealt.groupBy("lang", "block")).applyInPandas(judged, "lang string, source string, part string, item string, value long")
    by_block = checkpointed(by_block)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = by_block.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(by_block.where(F.col("part") == "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best))
