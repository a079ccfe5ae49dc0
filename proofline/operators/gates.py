"""Ground-truth items: spans, quality gates and passage labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sets as S


def span_text(items: DataFrame, sentences: DataFrame) -> DataFrame:
    """(question_id, span): the texts of ``items`` (question_id, span_ids) in the given order, joined by a space; unknown and blank ones are left out."""
    spread = items.select("question_id", F.posexplode("span_ids").alias("at", "sid"))
    found = spread.join(sentences.select("sid", "text").where("trim(coalesce(text, '')) <> ''"), "sid")
    joined = found.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("span"))
    return items.select("question_id").join(joined, "question_id", "left").withColumn("span", F.coalesce("span", F.lit("")))


def union_candidates(hits: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits (query_id, sid, rank) of a query without its seeds; seeds go after the cut, so fewer may be left."""
    return hits.where(F.col("rank") <= k).join(seeds.select("query_id", "sid"), ["query_id", "sid"], "left_anti")


def merge_additions(items: DataFrame, additions: DataFrame) -> DataFrame:
    """``items`` (question_id, gold_citations, ...) with the additions (question_id, sid, at) behind every bucket, and ``union_additions``."""
    lists = additions.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "sid"))), lambda x: x["sid"]).alias("union_additions"))
    joined = items.drop("union_additions").join(lists, "question_id", "left").withColumn("union_additions", F.array_distinct(F.coalesce("union_additions", F.array().cast("array<string>"))))
    return joined.withColumn("gold_citations", S.merged_gold(F.col("gold_citations"), F.col("union_additions")))


def gate_counts(verdicts: DataFrame) -> DataFrame:
    """(n, passed, failed): items that are well formed and supported, and the others, nulls among them."""
    passed = F.count_if(F.coalesce(F.col("well_formed") & F.col("supported"), F.lit(False)))
    return verdicts.agg(F.count("*").alias("n"), passed.alias("passed"), (F.count("*") - passed).alias("failed"))
