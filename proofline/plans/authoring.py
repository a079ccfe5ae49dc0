"""Ground-truth items written by a model from spans of the corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as T
from ..operators import chunking
from ..sources.providers import ChatModel, Roles, complete_column
from ..sources.sinks import kept, numbered

DIFFICULTIES = ("easy", "medium", "hard")
INSTRUCTION = 'Write one question of the given difficulty that the source answers, and the answer. Reply with JSON: {"question": "...", "gold_answer": "...", "rationale": "..."}.'


@dataclass(frozen=True)
class Authored:
    """``items``: ground truth, ``failures``: (chunk_id, sentence_ids, difficulty, error), ``counts``: (difficulty, n) of all three."""

    items: DataFrame
    failures: DataFrame
    counts: DataFrame


def chunk_spans(chunks: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, chunk_no, first, n, chunk_id, page, section_path, sentence_ids, text, difficulty): the runs of 1 to ``most`` sentences within chunks."""
    sentences = chunks.select("doc_id", "chunk_no", "chunk_id", "page", "section_path", "sentences", F.posexplode("sentences").alias("sentence_no", "s")).withColumn("text", F.col("s.text")).drop("s")
    runs = chunking.spans(sentences, most)
    ids = F.transform(F.slice("sentences", F.col("first") + 1, F.col("n")), lambda s: s["sentence_id"])
    return runs.withColumns({"sentence_ids": ids, "difficulty": T.difficulty(F.col("n"), F.col("text"))}).drop("sentences")


def author_items(spans: DataFrame, make: Callable[[], ChatModel], roles: Roles) -> Authored:
    """An item for each of ``spans`` (chunk_id, document_id, page, section_path, sentence_ids, difficulty, text), in order of chunk and first sentence.

    The span is the gold of every sentence of the answer, and of one bucket if
    the answer cannot be split.  A failed call, a reply without JSON and an empty
    question or answer are failures; they leave a gap in the numbers.
    """
    roles.checked()
    ordered = numbered(spans, "seq", "chunk_id", F.get("sentence_ids", F.lit(0)), F.size("sentence_ids"))
    head = F.concat_ws(", ", F.col("document_id").cast("string"), F.concat(F.lit("p"), F.col("page").cast("string")), T.section_label(F.col("section_path")))
    prompt = F.concat(F.lit(INSTRUCTION), F.lit("\n\nDifficulty: "), "difficulty", F.lit("\nSource ("), head, F.lit("): "), "text")
    asked = kept(complete_column(ordered.withColumn("prompt", prompt), make), "authored")
    read = asked.withColumn("a", replies.author_reply("reply")).withColumn("failure", F.coalesce("error", F.col("a.error")))
    written = chunking.with_sentences(read.where("failure is null").withColumn("gold_answer", F.col("a.gold_answer")), "gold_answer")
    items = written.select(
        F.format_string("synth-%04d-%s", "seq", "chunk_id").alias("question_id"), F.col("a.question").alias("question"), "difficulty", "gold_answer",
        F.array_repeat("sentence_ids", F.greatest(F.lit(1), F.size("sentences"))).alias("gold_citations"), F.lit(roles.author).alias("author_model"), "document_id", "page", "section_path",
        F.col("sentence_ids").alias("source_span_sentence_ids"),
    )
    domain = spans.sparkSession.createDataFrame([(d,) for d in DIFFICULTIES], "difficulty string")
    counts = domain.join(items.groupBy("difficulty").agg(F.count("*").alias("n")), "difficulty", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return Authored(items, read.where("failure is not null").select("chunk_id", "sentence_ids", "difficulty", F.col("failure").alias("error")), counts)
