"""How stable an answer's citations are over repeated runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import citation as C
from ..operators import metrics
from ..sources.providers import ChatModel
from .answering import INLINE, Cited, cite, generate
from .retrieving import Retrieval


@dataclass(frozen=True)
class Replicas:
    """``runs``: (question, run, n_sentences), ``citations``: (question, run, position, sid), ``reports``: one row a question, ``batch``: their means."""

    runs: DataFrame
    citations: DataFrame
    reports: DataFrame
    batch: DataFrame


def run_replicas(found: Retrieval, make: Callable[[], ChatModel], model: str, strategy: str = INLINE, n_runs: int = 5, temperature: float = 0.7, threshold: float = 0.5, tau: float = C.TAU, top_k: int = C.TOP_K) -> Replicas:
    """``n_runs`` answers to each query from one retrieval, and how far their citations agree; the model is given ``run`` and ``temperature`` by name."""
    answers = generate(found, make, model, (strategy,), n_runs, temperature, options=("run", "temperature"))
    return replicas_of(cite(answers, found, tau, top_k), threshold)


def replicas_of(cited: Cited, threshold: float = 0.5) -> Replicas:
    """The replicas in ``cited``; a failed run has no sentences and cites nothing."""
    counts = cited.sentences.groupBy("query_id", "run").agg(F.count("*").alias("n_sentences"))
    runs = cited.answers.select("query_id", "run").join(counts, ["query_id", "run"], "left").select(F.col("query_id").alias("question"), "run", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"))
    citations = cited.citations.select(F.col("query_id").alias("question"), "run", F.col("sentence_no").alias("position"), F.col("sentence_id").alias("sid"))
    reports = stability_reports(runs, citations, threshold)
    return Replicas(runs, citations, reports, stability_batch(reports))


def stability_reports(runs: DataFrame, citations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a question: n_runs, union_ids, intersection_ids, frequency, stable_anchors, stability, mean_jaccard, coverage_rate and per_position.

    ``runs`` has (question, run, n_sentences), ``citations`` (question, run,
    position, sid).  ``frequency`` lists (sid, freq), the most cited first;
    ``per_position`` is null unless all runs have equally many sentences, above
    0; a position that no run cites counts as 1.
    """
    sets = metrics.run_sets(runs.select("question", "run"), citations)
    n_runs = runs.groupBy("question").agg(F.count("*").alias("n_runs"))
    freq = metrics.citation_frequency(citations).join(n_runs, "question")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("less"), "sid", "freq", "n_runs")))
    needed = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("n_runs")))
    lists = freq.groupBy("question", "n_runs").agg(ordered.alias("f"), F.max(needed).alias("needed")).select(
        "question",
        F.array_sort(F.transform("f", lambda x: x["sid"])).alias("union_ids"),
        F.array_sort(F.transform(F.filter("f", lambda x: x["freq"] == x["n_runs"]), lambda x: x["sid"])).alias("intersection_ids"),
        F.transform("f", lambda x: F.struct(x["sid"].alias("sid"), x["freq"].alias("freq"))).alias("frequency"),
        F.transform(F.filter("f", lambda x: x["freq"] >= F.col("needed")), lambda x: x["sid"]).alias("stable_anchors"),
    )
    shapes = runs.groupBy("question").agg(F.min("n_sentences").alias("low"), F.max("n_sentences").alias("high")).where("low = high and low > 0").select("question", "low")
    spine = runs.select("question", "run").join(shapes, "question").withColumn("position", F.explode(F.sequence(F.lit(0), (F.col("low") - 1).cast("int")))).drop("low")
    own = citations.groupBy("question", "run", "position").agg(F.collect_set("sid").alias("sids"))
    positions = spine.join(own, ["question", "run", "position"], "left").withColumn("sids", F.coalesce("sids", F.array().cast("array<string>")))
    single = metrics.position_jaccard(positions, runs)
    per = spine.select("question", "position").distinct().join(single, ["question", "position"], "left").groupBy("question").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("mean_jaccard", F.lit(1.0)).alias("j")))).alias("p"))
    none = F.array().cast("array<string>")
    joined = metrics.stability(runs, citations).join(metrics.pairwise_jaccard(sets), "question").join(lists, "question", "left").join(per.select("question", F.col("p.j").alias("per_position")), "question", "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("union_ids", "intersection_ids", "stable_anchors")}).drop("n_all", "n_any")


def stability_batch(reports: DataFrame) -> DataFrame:
    """(items, mean_stability, mean_pairwise_jaccard, mean_coverage_rate), 0 without reports."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return reports.agg(F.count("*").alias("items"), mean("stability").alias("mean_stability"), mean("mean_jaccard").alias("mean_pairwise_jaccard"), mean("coverage_rate").alias("mean_coverage_rate"))
