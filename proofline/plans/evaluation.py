"""Scores of answers against ground truth, item by item and strategy by strategy, with failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sets as S
from ..operators import citation as C
from ..operators import metrics
from ..operators import retrieval as R
from ..sources.providers import ChatModel, Embedder, HashingEmbedder, embed_column
from ..sources.sinks import kept
from .answering import KEY, STRATEGIES, Cited, cite, generate
from .judging import Judged
from .retrieving import Retrieval, packaged, retrieve

SCORES = ("precision", "recall", "f1", "coverage")
#: How failed steps are named.
RETRIEVE_FAILED, GENERATE_FAILED = "retrieve_failed", "generate_or_cite_failed"


@dataclass(frozen=True)
class Evaluation:
    """``items``: one row for each item and strategy; ``retrieval`` and ``cited`` are what they were scored from."""

    items: DataFrame
    retrieval: Retrieval
    cited: Cited


def _predicted(cited: Cited, ids: DataFrame) -> DataFrame:
    """(query_id, strategy, pred, n_answer_sentences, coverage): distinct ids of ``ids`` (KEY, id), sentences and the share of cited ones."""
    pred = ids.groupBy("query_id", "strategy").agg(F.array_sort(F.collect_set("id")).alias("pred"))
    has = cited.citations.select(*KEY, "sentence_no").distinct().withColumn("cited", F.lit(1))
    shares = cited.sentences.join(has, [*KEY, "sentence_no"], "left").groupBy("query_id", "strategy").agg(F.count("*").alias("n_answer_sentences"), (F.count("cited") / F.count("*")).alias("coverage"))
    answers = cited.answers.select("query_id", "strategy", "answer_text", "latency_ms", "error")
    joined = answers.join(pred, ["query_id", "strategy"], "left").join(shares, ["query_id", "strategy"], "left")
    return joined.withColumns({"pred": F.coalesce("pred", F.array().cast(pred.schema["pred"].dataType)), "n_answer_sentences": F.coalesce("n_answer_sentences", F.lit(0)), "coverage": F.coalesce("coverage", F.lit(0.0))})


def _scored(spine: DataFrame, predicted: DataFrame, recall: DataFrame) -> DataFrame:
    """The fact rows: scores where all steps went well; where one failed, zeros, and the error; the recall of what was retrieved stays if only the answer failed."""
    joined = spine.join(predicted.withColumnRenamed("error", "failure"), ["query_id", "strategy"], "left").join(recall, "query_id", "left")
    error = F.when(F.col("retrieve_error").isNotNull(), F.concat(F.lit(f"{RETRIEVE_FAILED}: "), "retrieve_error")).when(F.col("failure").isNotNull(), F.concat(F.lit(f"{GENERATE_FAILED}: "), "failure"))
    scored = metrics.score_items(joined.withColumn("error", error))
    well = F.col("error").isNull()
    zero = {m: F.when(well, F.col(m)).otherwise(0.0) for m in SCORES}
    return scored.withColumns({
        **zero, "n_gold_ids": F.size("gold").cast("long"), "n_pred_ids": F.when(well, F.size("pred")).otherwise(0).cast("long"),
        "n_answer_sentences": F.when(well, F.col("n_answer_sentences")).otherwise(0).cast("long"), "retrieval_recall_at_k": F.when(F.col("retrieve_error").isNotNull(), 0.0).otherwise(F.col("recall_at_k")),
        "answer_text": F.when(well, F.col("answer_text")), "pred_citation_ids": F.when(well, F.col("pred")), "latency_ms": F.when(well, F.col("latency_ms")).otherwise(0.0),
    }).select(
        F.col("query_id").alias("question_id"), "question", "difficulty", "strategy", *SCORES, "retrieval_recall_at_k", "n_answer_sentences", "n_gold_ids", "n_pred_ids", "answer_text", "pred_citation_ids", "latency_ms", "error"
    )


def evaluate_items(
    items: DataFrame, chunks: DataFrame, sentences: DataFrame, make: Callable[[], ChatModel], model: str, strategies: Sequence[str] = STRATEGIES, mode: str = "dual", k_sentences: int = 20, k_chunks: int = 5,
    tau: float = C.TAU, top_k: int = C.TOP_K, embedder: Callable[[], Embedder] = HashingEmbedder,
) -> Evaluation:
    """Every ground-truth item under every strategy; the retrieval of an item is shared by the strategies.

    ``items`` has (question_id, question, difficulty, gold_citations) and may
    have ``retrieve_error``: such items are not retrieved, and all their scores
    are 0; so it is where the question's embedding fails.  An item without gold
    has a recall of 1.
    """
    failed = F.col("retrieve_error") if "retrieve_error" in items.columns else F.lit(None).cast("string")
    base = items.select(F.col("question_id").alias("query_id"), "question", "difficulty", S.gold_ids(F.col("gold_citations")).alias("gold"), failed.alias("retrieve_error"))
    asked = kept(embed_column(base.where("retrieve_error is null").select("query_id", F.col("question").alias("text")), embedder, errors=True), "asked")
    lost = asked.where("embed_error is not null").select("query_id", "embed_error")
    base = base.join(lost, "query_id", "left").withColumn("retrieve_error", F.coalesce("retrieve_error", "embed_error")).drop("embed_error")
    found = retrieve(asked.where("embed_error is null").drop("embed_error"), chunks, sentences, mode, k_sentences, k_chunks, embedder)
    cited = cite(generate(found, make, model, strategies), found, tau, top_k, embedder)
    pool = R.reachable(found.candidates.select("query_id", F.col("sentence_id").alias("sid")), R.nested_sentences(found.context).select("query_id", F.col("sentence_id").alias("sid")))
    gold = base.select("query_id", F.explode("gold").alias("sid"))
    recall = R.recall_at_k(gold, pool, base).select("query_id", F.col("recall").alias("recall_at_k"))
    spine = base.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    predicted = _predicted(cited, cited.citations.select(*KEY, F.col("sentence_id").alias("id")))
    return Evaluation(_scored(spine, predicted, recall), found, cited)


def cited_passages(cited: Cited, found: Retrieval) -> DataFrame:
    """(KEY, id): the passages (documents) of the cited sentences, looked up among the candidates first; unknown ids are left out."""
    columns = ["query_id", "sentence_id", F.col("document_id").alias("id"), F.col("rank").alias("place")]
    known = C.first_by_priority(found.candidates.select(*columns), R.nested_sentences(found.context).select(*columns), "query_id", "sentence_id")
    return cited.citations.select(*KEY, "sentence_id").join(known.where("id is not null"), ["query_id", "sentence_id"]).select(*KEY, "id").distinct()


def evaluate_benchmark(items: DataFrame, make: Callable[[], ChatModel], model: str, strategies: Sequence[str] = STRATEGIES, tau: float = C.TAU, top_k: int = C.TOP_K, embedder: Callable[[], Embedder] = HashingEmbedder) -> Evaluation:
    """Public benchmark ``items`` (item_id, question, passages, gold, and perhaps difficulty) under every strategy, scored by passages.

    Every passage is at hand, so the retrieval's recall is 1 throughout.
    """
    found = packaged(items)
    cited = cite(generate(found, make, model, strategies), found, tau, top_k, embedder)
    difficulty = F.col("difficulty") if "difficulty" in items.columns else F.lit("medium")
    base = items.select(F.col("item_id").alias("query_id"), "question", difficulty.alias("difficulty"), F.array_distinct("gold").alias("gold"), F.lit(None).cast("string").alias("retrieve_error"))
    spine = base.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    return Evaluation(_scored(spine, _predicted(cited, cited_passages(cited, found)), base.select("query_id", F.lit(1.0).alias("recall_at_k"))), found, cited)


def enriched(items: DataFrame, judged: Judged | None = None, stability: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """``items`` with what else is known of them, null where nothing is: faithfulness, stability (question, strategy, stability, mean_jaccard) and the reviewer's confidence, role, flags and notes.

    A failure of the judge is added to ``error``; the scores stay.
    """
    rows = items
    if judged is not None:
        of = judged.by_answer.select(F.col("query_id").alias("question_id"), "strategy", "percent_faithful", "percent_sentences_any_faithful")
        failures = judged.errors.groupBy("query_id", "strategy").agg(F.concat(F.lit("judge_failed: "), F.array_join(F.array_sort(F.collect_list(F.format_string("sentence %d: %s", "sentence_no", "error"))), "; ")).alias("judge_error"))
        rows = rows.join(of, ["question_id", "strategy"], "left").join(failures.withColumnRenamed("query_id", "question_id"), ["question_id", "strategy"], "left")
        rows = rows.withColumn("error", F.nullif(F.concat_ws("; ", "error", "judge_error"), F.lit(""))).drop("judge_error")
    if stability is not None:
        rows = rows.join(stability.select(F.col("question").alias("question_id"), "strategy", "stability", F.col("mean_jaccard").alias("mean_pairwise_jaccard")), ["question_id", "strategy"], "left")
    if reviews is not None:
        names = {"confidence": "reviewer_confidence", "reviewer_role": "reviewer_role", "flags": "reviewer_flags", "notes": "reviewer_notes"}
        rows = rows.join(reviews.select("question_id", *(F.col(a).alias(b) for a, b in names.items())), "question_id", "left")
    return rows


def summaries(items: DataFrame) -> dict[str, DataFrame]:
    """The roll-ups of a report: by strategy, by difficulty and, where there are reviews, by the reviewer's confidence."""
    optional = tuple(c for c in ("percent_faithful", "stability") if c in items.columns)
    found = {"by_strategy": metrics.summarize(items, ["strategy"], optional=optional), "by_difficulty": metrics.summarize(items, ["strategy", "difficulty"])}
    if "reviewer_confidence" in items.columns:
        found["by_confidence"] = metrics.summarize(items.where("reviewer_confidence is not null"), ["strategy", "reviewer_confidence"], SCORES)
    return found
