"""Quality gates of ground-truth items: a judge's verdict, then labels of further supporting sentences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import replies
from ..functions import text as T
from ..operators import gates as G
from ..operators.retrieval import filled
from ..sources.providers import ChatModel, Embedder, HashingEmbedder, complete_column, embed_column
from ..sources.sinks import kept
from .judging import refuse_judge
from .retrieving import search

AGREEMENT = 'Say whether the question is well formed and whether the source supports the answer. Reply with JSON: {"well_formed": true or false, "supported": true or false, "reasons": "..."}.'
LABELLING = 'Say which of the numbered sentences support the answer as well. Reply with JSON: {"supporting_indices": [...], "reasons": "..."}.'


@dataclass(frozen=True)
class Gated:
    """``items``: all of them, stamped and with merged gold; ``failures``: (question_id, stage, error); ``counters``: one row."""

    items: DataFrame
    failures: DataFrame
    counters: DataFrame


def verdicts(items: DataFrame, spans: DataFrame, make: Callable[[], ChatModel]) -> DataFrame:
    """(question_id, well_formed, supported, reasons): the judge on each of ``items`` with its span text (question_id, span); a failed or unreadable reply is false on both."""
    source = F.concat_ws(", ", F.col("document_id").cast("string"), F.concat(F.lit("p"), F.col("page").cast("string")))
    prompt = F.concat(F.lit(AGREEMENT), F.lit("\n\nSource ("), source, F.lit("): "), F.coalesce("span", F.lit("")), F.lit("\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer: "), F.coalesce("gold_answer", F.lit("")))
    asked = kept(complete_column(items.join(spans, "question_id", "left").select("question_id", prompt.alias("prompt")), make), "verdicts")
    read = asked.withColumn("v", replies.verdict_reply("reply"))
    failure = F.coalesce("error", F.col("v.error"))
    reasons = F.when(failure.isNull(), F.col("v.reasons")).otherwise(F.concat(F.lit("judge_agreement error: "), failure))
    return read.select("question_id", F.col("v.well_formed").alias("well_formed"), F.col("v.supported").alias("supported"), reasons.alias("reasons"))


def stamped(items: DataFrame, found: DataFrame, judge_model: str) -> DataFrame:
    """``items`` with the verdicts ``found`` in their judge columns."""
    bare = items.drop("judge_model", "judge_well_formed", "judge_supported", "judge_reasons").join(found, "question_id", "left")
    return bare.withColumn("judge_model", F.lit(judge_model)).withColumnsRenamed({"well_formed": "judge_well_formed", "supported": "judge_supported", "reasons": "judge_reasons"})


def label_supports(items: DataFrame, candidates: DataFrame, make: Callable[[], ChatModel], most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(question_id, sid, at) of the candidates that the judge takes for support, and (question_id, error) of failed calls.

    ``candidates`` has (question_id, rank, sentence_id, document_id, page,
    section_path, text); the first ``most`` are shown.  Items without any ask
    nothing; a reply that is no JSON supports nothing and is no failure.
    """
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank")) - 1
    shown = candidates.withColumn("place", place).where(F.col("place") < most)
    where = F.concat(F.lit("(doc="), F.coalesce(F.col("document_id").cast("string"), F.lit("")), F.lit(", p"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(", "), T.section_label(F.col("section_path")), F.lit(") "))
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), where, F.replace(F.trim(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" ")))
    lists = shown.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence_id", line.alias("line")))).alias("pool"))
    prompt = F.concat(F.lit(LABELLING), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer: "), F.coalesce("gold_answer", F.lit("")), F.lit("\nSentences:\n"), F.array_join("pool.line", "\n"))
    asked = kept(complete_column(items.select("question_id", "question", "gold_answer").join(lists, "question_id").select("question_id", "pool", prompt.alias("prompt")), make), "labels")
    named = asked.where("error is null").select("question_id", "pool", F.posexplode(replies.support_reply("reply", F.size("pool"))["indices"]).alias("at", "i"))
    additions = named.select("question_id", F.get("pool", F.col("i"))["sentence_id"].alias("sid"), "at").where("coalesce(sid, '') <> ''")
    return additions.groupBy("question_id", "sid").agg(F.min("at").alias("at")), asked.where("error is not null").select("question_id", "error")


def run_quality_gates(
    items: DataFrame, sentences: DataFrame, make: Callable[[], ChatModel], judge_model: str, top_k: int = 20, most: int = 10, skip_failed: bool = True, embedder: Callable[[], Embedder] = HashingEmbedder,
    hits: DataFrame | None = None,
) -> Gated:
    """Both gates over ground-truth ``items``; none is dropped, those that fail are flagged.

    ``sentences`` has (sentence_id, document_id, page, section_path, text).
    Candidates are the ``top_k`` hits for the gold answer (or ``hits``:
    question_id, sentence_id, rank), less the item's own span, which is taken
    out after the cut.  Failed items are not labelled while ``skip_failed``.
    What is labelled counts as kept also where it was gold before.
    """
    refuse_judge(items, "author_model", judge_model)
    spans = G.span_text(items.select("question_id", F.col("source_span_sentence_ids").alias("span_ids")), sentences.select(F.col("sentence_id").alias("sid"), "text"))
    found = verdicts(items, spans, make)
    marked = stamped(items, found, judge_model)
    passed = F.coalesce(F.col("judge_well_formed") & F.col("judge_supported"), F.lit(False))
    labelled = marked.where(passed) if skip_failed else marked
    if hits is None:
        queries = embed_column(labelled.select(F.col("question_id").alias("query_id"), F.col("gold_answer").alias("text")), embedder)
        hits = search(queries, sentences, "sentence_id", top_k, make=embedder).withColumnRenamed("query_id", "question_id")
    ranked = hits.join(labelled.select("question_id"), "question_id", "left_semi").select(F.col("question_id").alias("query_id"), F.col("sentence_id").alias("sid"), "rank")
    seeds = labelled.select(F.col("question_id").alias("query_id"), F.explode("source_span_sentence_ids").alias("sid"))
    # Candidates are written first, so that their size is known and the sentences are not shuffled to meet them.
    pool = kept(G.union_candidates(ranked, seeds, top_k), "union_candidates").withColumnsRenamed({"query_id": "question_id", "sid": "sentence_id"}).join(filled(sentences).select("sentence_id", "document_id", "page", "section_path", "text"), "sentence_id")
    additions, errors = label_supports(labelled, pool, make, most)
    merged = G.merge_additions(marked, additions)
    refused = marked.where(~passed).select("question_id", F.lit("agreement").alias("stage"), F.col("judge_reasons").alias("error"))
    failures = refused.unionByName(errors.select("question_id", F.lit("union_labeler").alias("stage"), "error"))
    verdict_rows = marked.select(F.col("judge_well_formed").alias("well_formed"), F.col("judge_supported").alias("supported"))
    counters = G.gate_counts(verdict_rows).crossJoin(additions.agg(F.count("*").alias("union_additions_total")))
    return Gated(merged, failures, counters)
