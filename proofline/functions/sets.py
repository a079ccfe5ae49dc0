"""Set scores over arrays, with the empty cases decided."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(predicted: Column, gold: Column) -> Column:
    """Share of distinct predicted ids that are gold; 1 where both are empty, 0 where one is."""
    return _score(predicted, gold, F.size(F.array_distinct(predicted)))


def recall(predicted: Column, gold: Column) -> Column:
    """Share of distinct gold ids that are predicted; 1 where both are empty, 0 where one is."""
    return _score(predicted, gold, F.size(F.array_distinct(gold)))


def _score(predicted: Column, gold: Column, of: Column) -> Column:
    both = (F.size(predicted) == 0) & (F.size(gold) == 0)
    either = (F.size(predicted) == 0) | (F.size(gold) == 0)
    return F.when(both, 1.0).when(either, 0.0).otherwise(F.size(F.array_intersect(predicted, gold)) / of)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Common ids over all ids; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def gold_ids(buckets: Column) -> Column:
    """The distinct ids of an array of arrays, in order."""
    return F.array_distinct(F.flatten(buckets))


def merged_gold(buckets: Column, additions: Column) -> Column:
    """``additions`` behind each bucket, without repeats; unchanged without additions."""
    return F.when(F.size(additions) == 0, buckets).otherwise(F.transform(buckets, lambda g: F.array_distinct(F.concat(g, additions))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero vector has 0 with all."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    safe = lambda v: F.when(norm(v) < 1e-12, 1.0).otherwise(norm(v))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    return dot / (safe(a) * safe(b))


def unit(v: Column) -> Column:
    """The vector scaled to length 1, in double; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    # The norm goes through a list of one, else it would be summed up again for each element.
    scaled = F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n < 1e-12, 1.0).otherwise(n)))
    return F.get(scaled, F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
