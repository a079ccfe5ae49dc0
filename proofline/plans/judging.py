"""Judging whether cited sources entail what an answer says."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as T
from ..operators import metrics
from ..sources.providers import ChatModel, complete_column
from ..sources.sinks import kept
from .answering import KEY, Cited, source_texts
from .retrieving import Retrieval

UNAVAILABLE = "(the source is not among what was retrieved)"
INSTRUCTION = 'For every numbered source say whether it entails the statement. Reply with a JSON list of {"entails": true or false, "reason": "..."}, one entry for each source, in order.'


def refuse_judge(rows: DataFrame, column: str, judge: str) -> None:
    """Raise if any row was made by the judge itself, in any case of letters."""
    clash = rows.where(F.lower(F.trim(column)) == judge.strip().lower()).limit(1).collect()
    if clash:
        raise ValueError(f"the judge {judge} must not judge what {clash[0][column]} made")


@dataclass(frozen=True)
class Judged:
    """``judgments``: (KEY, sentence_no, place, sentence_id, source, confidence, entails, reason); ``errors``: (KEY, sentence_no, error); ``by_sentence``, ``by_answer`` and ``batch`` roll them up."""

    judgments: DataFrame
    errors: DataFrame
    by_sentence: DataFrame
    by_answer: DataFrame
    batch: DataFrame


def judge(cited: Cited, found: Retrieval, make: Callable[[], ChatModel], judge_model: str) -> Judged:
    """Every citation of every answer sentence, one question to the model for a cited sentence.

    Uncited sentences ask nothing.  Where the model fails, or its reply cannot
    be read, none of the sentence's citations is faithful, the reason says why,
    and the error is listed.
    """
    refuse_judge(cited.answers, "model", judge_model)
    texts = source_texts(found).withColumnsRenamed({"text": "source_text", "section_path": "source_path"})
    rows = cited.citations.join(texts, ["query_id", "sentence_id"], "left")
    path = F.when(F.size(F.coalesce("source_path", F.array().cast("array<string>"))) > 0, F.col("source_path")).otherwise(F.col("section_path"))
    body = F.coalesce(F.nullif(F.trim(F.replace(F.col("source_text"), F.lit("\n"), F.lit(" "))), F.lit("")), F.lit(UNAVAILABLE))
    line = F.concat(F.lit("(doc="), F.coalesce(F.col("document_id").cast("string"), F.lit("")), F.lit(", p"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(", "), T.section_label(path), F.lit(") "), body)
    entry = F.struct("place", line.alias("line"), "sentence_id", "chunk_id", "source", "confidence")
    grouped = rows.groupBy(*KEY, "sentence_no").agg(F.array_sort(F.collect_list(entry)).alias("cited"))
    listed = F.array_join(F.transform("cited", lambda c, k: F.concat(F.lit("["), k.cast("string"), F.lit("] "), c["line"])), "\n")
    asked = grouped.join(cited.sentences, [*KEY, "sentence_no"]).withColumn("prompt", F.concat(F.lit(INSTRUCTION), F.lit("\n\nStatement: "), "text", F.lit("\n\nSources:\n"), listed))
    answered = kept(complete_column(asked, make), "judgments")
    reply = replies.judge_reply(F.trim("reply"), F.size("cited"))
    judged = answered.withColumn("judged", reply)
    error = F.when(F.col("error").isNotNull(), F.concat(F.lit("judge call failed: "), F.col("error"))).when(F.col("judged.error").isNotNull(), F.concat(F.lit("parse failed: "), F.col("judged.error")))
    judged = judged.withColumn("failure", error)
    pairs = judged.select(*KEY, "sentence_no", "failure", F.explode(F.arrays_zip("cited", F.col("judged.judgments").alias("judgments"))).alias("p"))
    reason = F.substring(F.coalesce("failure", F.col("p.judgments.reason")), 1, 300)
    judgments = pairs.select(*KEY, "sentence_no", "p.cited.place", "p.cited.sentence_id", "p.cited.chunk_id", "p.cited.source", "p.cited.confidence", (F.col("failure").isNull() & F.col("p.judgments.entails")).alias("entails"), reason.alias("reason"))
    by_sentence = metrics.faithfulness_by_sentence(cited.sentences, judgments, [*KEY, "sentence_no"])
    return Judged(judgments, judged.where("failure is not null").select(*KEY, "sentence_no", F.col("failure").alias("error")), by_sentence, metrics.faithfulness_report(by_sentence, KEY), batch(by_sentence))


def batch(by_sentence: DataFrame) -> DataFrame:
    """(items, total_citations, faithful_citations, percent_faithful) over all answers: the share of citations, not the mean of the answers' shares."""
    n, faithful = F.coalesce(F.sum("n_citations"), F.lit(0)), F.coalesce(F.sum("n_faithful"), F.lit(0))
    rows = by_sentence.agg(F.countDistinct(*KEY).alias("items"), n.alias("total_citations"), faithful.alias("faithful_citations"))
    return rows.withColumn("percent_faithful", F.when(F.col("total_citations") > 0, 100.0 * F.col("faithful_citations") / F.col("total_citations")).otherwise(0.0))
