"""Scores of citations, roll-ups and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sets as S

MACRO = ("precision", "recall", "f1", "coverage", "retrieval_recall_at_k")
CONFIDENCES = ("high", "medium", "low")


def score_items(items: DataFrame) -> DataFrame:
    """``items`` (pred, gold: arrays of ids) with precision, recall and f1."""
    scored = items.withColumns({"precision": S.precision(F.col("pred"), F.col("gold")), "recall": S.recall(F.col("pred"), F.col("gold"))})
    return scored.withColumn("f1", S.f1(F.col("precision"), F.col("recall")))


def coverage(sentences: DataFrame, by: list[str]) -> DataFrame:
    """(by, coverage): the share of ``sentences`` (n_citations) with a citation."""
    return sentences.groupBy(*by).agg(F.avg((F.col("n_citations") > 0).cast("int")).alias("coverage"))


def histogram(values: Column, edges: list[float]) -> Column:
    """The place, from 0, of the bin with ``values``; bins hold their lower edge and not their upper one; null outside."""
    place = F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        place = F.when((values >= low) & (values < high), k).otherwise(place)
    return place


def described(items: DataFrame, by: list[str], measure: str) -> DataFrame:
    """(by, n, mean, std, min, p25, p50, p75, max) of a measure, nulls left out."""
    x = F.col(measure)
    return items.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), *(F.percentile(x, p / 100).alias(f"p{p}") for p in (25, 50, 75)), F.max(x).alias("max")
    )


def worst(items: DataFrame, by: list[str], measure: str, key: str) -> DataFrame:
    """(by, ``key``, ``measure``): the item with the lowest measure, of equal ones the first by key; nulls are left out."""
    found = items.where(F.col(measure).isNotNull()).groupBy(*by).agg(F.min(F.struct(measure, key)).alias("w"))
    return found.select(*by, f"w.{key}", f"w.{measure}")


def summarize(items: DataFrame, by: list[str], measures: tuple[str, ...] = MACRO, optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows and means of ``measures`` by ``by``; optional measures leave nulls out and are null where all are."""
    return items.groupBy(*by).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in measures), *(F.avg(m).alias(m) for m in optional))


def with_reviews(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """``items`` with the review of their question_id, null where there is none."""
    return items.join(reviews.select("question_id", "confidence", "flags"), "question_id", "left")


def confidence_counts(reviews: DataFrame) -> DataFrame:
    """Reviews of each of the three confidences, zeros kept."""
    domain = reviews.sparkSession.createDataFrame([(c,) for c in CONFIDENCES], "confidence string")
    return domain.join(reviews.groupBy("confidence").agg(F.count("*").alias("n")), "confidence", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def flag_counts(reviews: DataFrame) -> DataFrame:
    """How many reviews have each flag."""
    return reviews.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def top_flags(reviews: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent flags, ties by name."""
    return flag_counts(reviews).orderBy(F.desc("n"), "flag").limit(n)


def faithfulness_by_sentence(sentences: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """Each sentence of the spine with its citations, faithful ones, and whether any or all are; all is false without citations."""
    found = judgments.groupBy(*keys).agg(F.count("*").alias("n_citations"), F.count_if("entails").alias("n_faithful"))
    joined = sentences.join(found, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_citations", "n_faithful")})
    return joined.withColumns({"any_faithful": F.col("n_faithful") > 0, "all_faithful": (F.col("n_citations") > 0) & (F.col("n_faithful") == F.col("n_citations"))})


def faithfulness_report(by_sentence: DataFrame, keys: list[str]) -> DataFrame:
    """Percentages by ``keys`` (none: over all, a micro average): of citations, of cited sentences, and coverage."""
    share = lambda part, whole: F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)
    cited = F.count_if(F.col("n_citations") > 0)
    return by_sentence.groupBy(*keys).agg(
        F.sum("n_citations").alias("n_citations"),
        share(F.sum("n_faithful"), F.sum("n_citations")).alias("percent_faithful"),
        share(F.count_if("any_faithful"), cited).alias("percent_sentences_any_faithful"),
        share(cited, F.count("*")).alias("coverage"),
    )


def citation_frequency(citations: DataFrame) -> DataFrame:
    """(question, sid, freq): runs of a question that cite an id."""
    return citations.groupBy("question", "sid").agg(F.countDistinct("run").alias("freq"))


def run_sets(runs: DataFrame, citations: DataFrame) -> DataFrame:
    """(question, run, sids): the id set of every run, also of those that cite nothing."""
    return runs.join(citations.groupBy("question", "run").agg(F.array_sort(F.collect_set("sid")).alias("sids")), ["question", "run"], "left").withColumn("sids", F.coalesce("sids", F.array().cast("array<string>")))


def stability(runs: DataFrame, citations: DataFrame) -> DataFrame:
    """(question, n_runs, n_all, n_any, stability): ids that every run cites over ids that any cites; 1 where none is cited."""
    n_runs = runs.groupBy("question").agg(F.count("*").alias("n_runs"))
    joined = n_runs.join(citation_frequency(citations), "question", "left")
    counted = joined.groupBy("question", "n_runs").agg(F.count_if(F.col("freq") == F.col("n_runs")).alias("n_all"), F.count("sid").alias("n_any"))
    return counted.withColumn("stability", F.when(F.col("n_any") == 0, 1.0).otherwise(F.col("n_all") / F.greatest(F.col("n_any"), F.lit(1))))


def stable_anchors(runs: DataFrame, citations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(question, sid, freq, rank): ids that at least ceil(threshold * runs) runs cite, the most cited first, then by id."""
    n_runs = runs.groupBy("question").agg(F.count("*").alias("n_runs"))
    kept = citation_frequency(citations).join(n_runs, "question").where(F.col("freq") >= F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("n_runs"))))
    return kept.select("question", "sid", "freq", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("freq"), "sid")).alias("rank"))


def pairwise_jaccard(sets: DataFrame) -> DataFrame:
    """(question, mean_jaccard, coverage_rate) over all pairs of a question's runs; 1 with fewer than two runs.

    Pairs are of the few runs of one question, which ``run_sets`` makes narrow.
    """
    other = sets.select("question", F.col("run").alias("run_b"), F.col("sids").alias("sids_b"))
    pairs = sets.join(other, "question").where("run < run_b").groupBy("question").agg(F.avg(S.jaccard(F.col("sids"), F.col("sids_b"))).alias("j"))
    rates = sets.groupBy("question").agg(F.avg((F.size("sids") > 0).cast("int")).alias("coverage_rate"))
    return rates.join(pairs, "question", "left").select("question", F.coalesce("j", F.lit(1.0)).alias("mean_jaccard"), "coverage_rate")


def position_jaccard(sets: DataFrame, runs: DataFrame) -> DataFrame:
    """(question, position, mean_jaccard) of ``sets`` (question, run, position, sids) where all runs have equally many sentences, above 0."""
    even = runs.groupBy("question").agg(F.min("n_sentences").alias("low"), F.max("n_sentences").alias("high")).where("low = high and low > 0").select("question")
    kept = sets.join(even, "question")
    other = kept.select("question", "position", F.col("run").alias("run_b"), F.col("sids").alias("sids_b"))
    return kept.join(other, ["question", "position"]).where("run < run_b").groupBy("question", "position").agg(F.avg(S.jaccard(F.col("sids"), F.col("sids_b"))).alias("mean_jaccard"))


def markdown_table(items: DataFrame, strategies: list[str], measures: tuple[str, ...] = MACRO) -> DataFrame:
    """(metric, one text column for each strategy): means with three decimals, "n/a" where there are none."""
    long = items.groupBy("strategy").agg(*(F.avg(m).alias(m) for m in measures)).unpivot("strategy", list(measures), "metric", "value")
    wide = long.groupBy("metric").pivot("strategy", strategies).agg(F.max("value"))
    return wide.select("metric", *(F.when(F.col(f"`{s}`").isNull(), "n/a").otherwise(F.format_string("%.3f", F.col(f"`{s}`"))).alias(s) for s in strategies))
