"""Quality rules whose limits follow the corpus.

Each text's measures are whole numbers.  A sketch of a group's measure counts
values in bins of relative width 1/64 (values below 128 are exact); sketches
of (language, source) groups add up to those of languages and of the corpus.
A limit is the median plus or minus a multiple of the spread.  The spread of
symbols and word lengths is taken on the clean side of the median, so a source
that is one half junk does not move its own limit.  Repeated lines and words are
absent from most texts, so that side has no spread; theirs is the distance to a
high quantile.  Where a spread is nothing, the sketches' own resolution stands
for it: the width of the median's bin, and for rates one occurrence in a text
of the group's median size.  No share of the documents is cut for being last in
order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, tagged

#: Groups with fewer rows that passed the base rules use their language's sketch, then the corpus's.
LEAST_GROUP = 100
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: By measure: the side that is bad, the quantile (percent) whose distance from the median is the spread, the multiple of it allowed, and what a rate counts its occurrences in.
MEASURES = {
    "symbol_rate": ("high", 10, 4, "n_words"),
    "dup_line_rate": ("high", 99, 1.5, "n_lines"),
    "repeat_rate": ("high", 95, 8, "n_words"),
    "word_length": ("high", 10, 5, None),
    "word_length_low": ("low", 90, 4, None),
}
#: Measures without a limit: the sizes of a group's texts.
SIZES = ("n_words", "n_lines")


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, their characters, symbols, lines that repeat an earlier one, words in repeated three-word windows, and lines."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    repeated = 0
    if len(words) > 3:
        _, pairs = np.unique(codes[:-2] * len(ids) + codes[1:-1], return_inverse=True)
        _, which, n = np.unique(pairs * len(ids) + codes[2:], return_inverse=True, return_counts=True)
        often = n[which] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(often)] |= often
        repeated = int(covered.sum())
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, len(lines)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_counts(text.as_py()) for text in batch.column("text")]
        columns = list(zip(*found, strict=True)) or [()] * (len(_COUNTS) + 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", "lang", "source", *_COUNTS, "n_lines"])


def bin_width(value: Column) -> Column:
    """The width of the value's bin: all but its first seven binary digits are open."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(value)) - 7)).cast("long")


def sketch_bin(value: Column) -> Column:
    """The lower end of the value's bin."""
    return value - value % bin_width(value)


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang_key, source_key, measure, limit, bad) for each group of ``measured`` and each measure.

    Sketches are built per language and source; a group of fewer than
    ``LEAST_GROUP`` rows takes the sum of its language's sketches, and where
    that is small too, the sum of all.
    """
    values = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), F.col(name.removesuffix("_low")).alias("value")) for name in (*MEASURES, *SIZES))))
    bins = measured.where("not base_failed").select("lang_key", "source_key", values.alias("v")).select("lang_key", "source_key", "v.measure", sketch_bin(F.col("v.value")).alias("bin"))
    by_source = checkpointed(bins.groupBy("lang_key", "source_key", "measure", "bin").agg(F.count("*").alias("n")))
    by_lang = by_source.groupBy("lang_key", "measure", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("measure", "bin").agg(F.sum("n").alias("n"))

    percents = sorted({percent for _, percent, _, _ in MEASURES.values()})

    def quantiles(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
        group = Window.partitionBy(*keys, "measure")
        ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("of", F.sum("n").over(group))
        at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("of") * percent, F.col("bin")))
        return ranked.groupBy(*keys, "measure").agg(F.struct(F.max("of").alias("of"), at(50).alias("mid"), *(at(p).alias(f"at{p}") for p in percents)).alias(name))

    groups = measured.select("lang_key", "source_key").distinct().withColumn("measure", F.explode(F.array(*map(F.lit, (*MEASURES, *SIZES)))))
    joined = (
        groups.join(quantiles(by_source, ["lang_key", "source_key"], "own"), ["lang_key", "source_key", "measure"], "left")
        .join(quantiles(by_lang, ["lang_key"], "lang"), ["lang_key", "measure"], "left")
        .join(quantiles(overall, [], "all"), "measure", "left")
    )
    q = F.when(F.col("own.of") >= LEAST_GROUP, F.col("own")).when(F.col("lang.of") >= LEAST_GROUP, F.col("lang")).otherwise(F.col("all"))
    here = lambda name: F.col("measure") == name
    group = Window.partitionBy("lang_key", "source_key")
    sized = joined.withColumn("q", q).withColumns({f"mid_{size}": F.max(F.when(here(size), F.col("q.mid"))).over(group) for size in SIZES})
    limit, bad = F.lit(None).cast("long"), F.lit(None).cast("string")
    for name, (side, percent, times, counted_in) in MEASURES.items():
        finest = bin_width(F.col("q.mid"))
        if counted_in:
            finest = F.greatest(finest, F.ceil(1000 / F.greatest(F.lit(1), F.col(f"mid_{counted_in}"))))
        spread = F.greatest(finest, F.abs(F.col(f"q.at{percent}") - F.col("q.mid")))
        limit = F.when(here(name), (F.col("q.mid") + (times if side == "high" else -times) * spread).cast("long")).otherwise(limit)
        bad = F.when(here(name), F.lit(side)).otherwise(bad)
    return sized.where(F.col("measure").isin(*MEASURES)).select("lang_key", "source_key", "measure", limit.alias("limit"), bad.alias("bad"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of ``docs``.

    ``docs`` has (doc_id, text, lang, source).  ``base_failed``: under 50
    words, or over half of them in three-word windows that the text repeats.
    ``kept``: not failed, and no measure beyond the limit of its group.

    Defined cases: a null text has no words and fails; null languages and
    sources are groups of their own; small groups use their language's limits;
    where no text passes the base rules there are no limits; repeated rows are
    judged alike; other columns of ``docs``, whatever their names, are ignored;
    an empty table gives no rows.
    """
    counts = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source").mapInArrow(_counted, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in (*_COUNTS, "n_lines")))
    rate = lambda part, whole: F.expr(f"if({whole} > 0, 1000 * {part} div {whole}, 0L)")
    measured = checkpointed(
        counts.withColumns({
            "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
            "symbol_rate": rate("n_symbols", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"),
            "word_length": F.expr("if(n_words > 0, 100 * word_chars div n_words, 0L)"), "lang_key": tagged(F.col("lang")), "source_key": tagged(F.col("source")),
        })
    )
    pivot = {name: F.max(F.when(F.col("measure") == name, F.col("limit"))).alias(f"{name}_limit") for name in MEASURES}
    limits = thresholds(measured).groupBy("lang_key", "source_key").agg(*pivot.values())
    beyond = F.lit(False)
    for name, (side, *_) in MEASURES.items():
        value, limit = F.col(name.removesuffix("_low")), F.col(f"{name}_limit")
        beyond = beyond | F.coalesce(value > limit if side == "high" else value < limit, F.lit(False))
    judged = measured.join(limits, ["lang_key", "source_key"], "left").withColumn("kept", ~F.col("base_failed") & ~beyond)
    return judged.select("doc_id", *_COUNTS, "base_failed", "kept")
