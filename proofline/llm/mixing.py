"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source.  A source's target
is met by whole repeats of all its documents plus a remaining budget, which a
bounded-knapsack programme meets as nearly as any selection can.  Among the
nearest ones it prefers the same share of all lengths: that share is taken
first, and the programme fits what rounding leaves and some short documents;
only where that misses does it run over the counts of all lengths.  Which documents of a length are
taken is decided by a seeded order, found from bucket counts so that a frequent
length is never ranked as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACED_WORD, checkpointed, tagged

#: One document of each of so many of the shortest lengths is up for choice again, beside those that the shares left out.
FREE_LENGTHS = 48
#: The seeded order is ranked in parts of about so many rows; there are ``LEAST_PARTS`` at least.
ROWS_PER_PART, LEAST_PARTS = 100_000, 256


def knapsack(budget: int, spare: Sequence[tuple[int, int]]) -> dict[int, int]:
    """Counts by length whose total is as near to ``budget`` as any selection from ``spare`` (length, count) gets.

    Counts are split into powers of two, so that each part is taken whole or
    not at all.  For each total the programme keeps the first part with which it
    can be reached, which is all that is needed to trace it back; it ends as soon
    as the budget itself can be reached.  Some selection is less than the longest
    length below the budget, or all of ``spare`` is; so totals that far above it
    are left out.
    """
    parts = []
    for length, count in spare:
        step = 1
        while count > 0:
            parts.append((length, min(step, count)))
            count -= parts[-1][1]
            step *= 2
    sizes = [length * count for length, count in parts]
    unit = math.gcd(*sizes) or 1
    top = max(0, min(2 * budget, budget + max((length for length, _ in parts), default=0))) // unit
    first = np.full(top + 1, len(parts), np.int16 if len(parts) < 32_767 else np.int32)
    first[0] = -1
    exact = budget // unit if budget % unit == 0 else None
    reach = 0
    for k, size in enumerate(sizes):
        size //= unit
        if 0 < size <= top:
            # No total beyond what the parts so far add up to can be reached.
            reach = min(top, reach + size)
            fresh = (first[: reach + 1 - size] < k) & (first[size : reach + 1] == len(parts))
            first[size : reach + 1][fresh] = k
            if exact is not None and first[exact] < len(parts):
                break
    totals = np.flatnonzero(first < len(parts))
    total = int(totals[np.argmin(np.abs(totals * unit - budget))])
    taken: dict[int, int] = {}
    while total:
        length, count = parts[first[total]]
        taken[length] = taken.get(length, 0) + count
        total -= length * count // unit
    return taken


def _total(taken: dict[int, int]) -> int:
    return sum(length * n for length, n in taken.items())


def _shared(counts: Sequence[tuple[int, int]], budget: int) -> dict[int, int]:
    """The same share of every length, then the knapsack for what is left over and one document of each of the shortest lengths."""
    total = sum(length * count for length, count in counts)
    # Every length gets its share; what a share has too few words for goes on to the next length.
    taken, due = {}, 0
    for length, count in counts:
        due += length * count * budget
        taken[length] = min(count, due // (length * total))
        due -= taken[length] * length * total
    spare = {length: count - taken[length] for length, count in counts}
    for length in [length for length, _ in counts if taken[length] > 0][:FREE_LENGTHS]:
        taken[length] -= 1
        spare[length] += 1
    for length, n in knapsack(budget - _total(taken), [(length, n) for length, n in spare.items() if n > 0]).items():
        taken[length] += n
    return taken


def _nearest(counts: Sequence[tuple[int, int]], budget: int) -> dict[int, int]:
    """The selection whose total is nearest to ``budget``, whatever the counts.

    Lengths are taken whole, shortest first, until the budget is used up.  A
    best selection differs from that one by at most twice the longest length and
    one document, and by so many more as the longest length has words where the
    budget itself can't be met (the proximity of whole and fractional solutions of
    one equation); so only that many documents of each length are up for choice.
    """
    reach = 3 * counts[-1][0] + 2
    left, certain, open_ = budget, {}, []
    for length, count in counts:
        n = min(count, left // length)
        left -= n * length
        certain[length] = max(0, n - reach)
        open_.append((length, min(count, n + reach) - certain[length]))
    for length, n in knapsack(budget - _total(certain), open_).items():
        certain[length] += n
    return certain


def fit_budget(lengths: Sequence[tuple[int, int]], budget: int) -> dict[int, int]:
    """Documents to take by length from (length, count) so that their total is as near to ``budget`` as any selection's.

    All lengths have the same share where such a selection is among the nearest
    that can be (as it is wherever lengths are many); else the knapsack
    runs over the counts themselves.

    Defined cases: nothing is taken for a budget of 0 or less, of empty texts, or
    where all are empty; everything is taken for a budget of their total or more;
    of two totals as near the smaller one counts.
    """
    counts = sorted((length, count) for length, count in lengths if length > 0 and count > 0)
    everything = dict(counts)
    if budget <= 0 or not counts:
        return {}
    if budget >= _total(everything):
        return everything
    unit = math.gcd(*everything)
    taken = _shared(counts, budget)
    # No total is nearer than the nearest multiple of what all lengths are multiples of.
    if abs(_total(taken) - budget) > min(budget % unit, -budget % unit):
        taken = _nearest(counts, budget)
    return taken


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size).

    Sources in code-point order, null last, have the weights in turn.  A
    target is the weight times one common level, stopped at ``most`` times
    the source's size; the level is the one at which targets add up to all
    sizes.  That is what resharing the excess by weight ends in.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)).withColumn("stop", F.col("source_size") * float(most))
    # In order of the level at which a source stops: with all earlier ones stopped, the level of the others.
    # It rises as long as the next source would stop too and falls afterwards; so the true level is the largest.
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    stopped = F.coalesce(F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - stopped) / others)
    return levels.withColumn("final", F.max("level").over(Window.partitionBy())).select("key", "source_size", F.least("stop", F.col("final") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 23) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (replacing columns of these names).

    ``docs`` has (doc_id, text, source) and any further columns.  ``size`` is
    the text's number of words; ``copies`` is how often the mix takes the row,
    0 to ``most``.  For a given seed reruns agree.

    Defined cases: a null text has size 0; null is a source of its own, last
    in order; a source of empty texts has the target 0; a doc_id that repeats
    with several texts is told apart by their digests; rows that repeat both
    count one by one, and which of them is taken makes no difference to the
    documents; an empty table gives no rows.
    """
    parts = max(LEAST_PARTS, -(-docs.count() // ROWS_PER_PART))
    size = F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "__text")
    sized = docs.withColumns({"size": size, "__key": tagged(F.col("source")), "__text": F.xxhash64("text")}).withColumn("__order", order)
    sized = sized.withColumn("__part", F.pmod(F.shiftright("__order", 40), F.lit(parts)).cast("int"))
    narrow = checkpointed(sized.groupBy(F.col("__key").alias("key"), "source", "size", F.col("__part").alias("part")).agg(F.count("*").alias("n")))

    totals = narrow.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = checkpointed(source_targets(totals, weights, most))
    lengths = narrow.groupBy("key", "size").agg(F.sum("n").alias("n")).join(targets, "key")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        words, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = min(int(target // words), most) if words else 0
        counts = [(int(length), int(n)) for length, n in zip(group["size"], group["n"], strict=True)]
        taken = fit_budget(sorted(counts), round(target) - whole * words) if whole < most else {}
        return pd.DataFrame({"key": group["key"], "size": group["size"], "whole": whole, "more": [taken.get(int(x), 0) for x in group["size"]]})

    plan = checkpointed(lengths.groupBy("key").applyInPandas(fitted, "key string, size long, whole long, more long"))
    # The documents of a length are in seeded order; part by part, so many of the first ones are taken.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = narrow.select("key", "size", "part", "n", before.alias("before")).join(plan, ["key", "size"])
    cuts = cuts.select(
        F.col("key").alias("__key"), "size", F.col("part").alias("__part"), F.col("whole").alias("__whole"),
        F.greatest(F.lit(0), F.least("n", F.col("more") - F.col("before"))).alias("__most"),
    ).join(targets.withColumnRenamed("key", "__key"), "__key")
    joined = sized.drop("source_size", "target", "copies").join(cuts, ["__key", "size", "__part"])
    rank = F.row_number().over(Window.partitionBy("__key", "size", "__part").orderBy("__order", "doc_id", "__text"))
    placed = joined.withColumn("__rank", rank)
    return placed.withColumn("copies", (F.col("__whole") + F.when(F.col("__rank") <= F.col("__most"), 1).otherwise(0)).cast("long")).drop("__key", "__text", "__order", "__part", "__whole", "__most", "__rank")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mixed`` as often as its ``copies`` say; rows with null, 0 or fewer copies go, an empty table stays empty."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("__copy")
