"""Prompts, answers and the citations attached to them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import citation as C
from ..operators.chunking import with_sentences
from ..operators.retrieval import nested_sentences
from ..sources.providers import ChatModel, Embedder, HashingEmbedder, complete_column, embed_column
from ..sources.sinks import kept
from .retrieving import Retrieval

#: The two strategies.
INLINE, ALIGNED = "inline_prompted", "post_gen_alignment"
STRATEGIES = (INLINE, ALIGNED)
KEY = ["query_id", "strategy", "run"]
#: What the model is told to do, by strategy.
INSTRUCTIONS = {
    INLINE: (
        "Answer from the sources alone, in short sentences with one statement each. Put the tag of every source sentence that supports a statement right behind it, as [s:ID]; use only ids that are "
        "listed. If the sources have no answer, write just INSUFFICIENT SOURCES."
    ),
    ALIGNED: "Answer from the sources alone, in short sentences with one statement each, without any reference marks. If the sources have no answer, write just INSUFFICIENT SOURCES.",
}


def prompts(found: Retrieval, strategies: Sequence[str] = STRATEGIES, most_chars: int | None = None) -> DataFrame:
    """(query_id, strategy, question, prompt, context_sentence_ids, candidate_sentence_ids, retrieved_chunk_ids) for every query and strategy."""
    listed = lambda rows, order, name, out: rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order, name))).alias("r")).select("query_id", F.col(f"r.{name}").alias(out))
    chunk_ids = listed(found.context, "place", "chunk_id", "retrieved_chunk_ids")
    candidate_ids = listed(found.candidates, "rank", "sentence_id", "candidate_sentence_ids")
    none = F.array().cast("array<string>")
    rows = None
    for strategy in strategies:
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}, not {strategy}")
        blocks = C.context_blocks(found.context, strategy == INLINE, most_chars)
        joined = found.queries.select("query_id", F.col("text").alias("question")).join(blocks, "query_id", "left")
        prompt = F.concat(F.lit(INSTRUCTIONS[strategy]), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\n\nSources:\n"), F.coalesce("block", F.lit("")), F.lit("\n\nAnswer:"))
        part = joined.select("query_id", F.lit(strategy).alias("strategy"), "question", prompt.alias("prompt"), F.coalesce("sentence_ids", none).alias("context_sentence_ids"))
        rows = part if rows is None else rows.unionByName(part)
    for lists in (candidate_ids, chunk_ids):
        rows = rows.join(lists, "query_id", "left")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("candidate_sentence_ids", "retrieved_chunk_ids")})


def generate(found: Retrieval, make: Callable[[], ChatModel], model: str, strategies: Sequence[str] = STRATEGIES, runs: int = 1, temperature: float = 0.0, options: Sequence[str] = ()) -> DataFrame:
    """The rows of ``prompts`` for each of ``runs``, with run, temperature, model, answer_text, error, tokens, finish_reason and latency_ms.

    The retrieval is the same for all strategies and runs, and each answer is
    asked for once: what was said is written and read again.  ``options`` (of
    strategy, run and temperature) are given to the model by name.
    """
    if runs < 1:
        raise ValueError("there is one run at least")
    rows = prompts(found, strategies).withColumns({"run": F.explode(F.sequence(F.lit(0), F.lit(runs - 1))), "temperature": F.lit(temperature), "model": F.lit(model)})
    return kept(complete_column(rows, make, options=options).withColumn("answer_text", F.trim("reply")).drop("reply"), "answers")


def sentence_meta(found: Retrieval) -> DataFrame:
    """(query_id, sentence_id, chunk_id, document_id, page, section_path): of the candidates, else of the context's own sentences."""
    columns = ["query_id", "sentence_id", "chunk_id", "document_id", "page", "section_path"]
    flat = found.candidates.select(*columns, F.col("rank").alias("place"))
    nested = nested_sentences(found.context).select(*columns, F.col("rank").alias("place"))
    return C.first_by_priority(flat, nested, "query_id", "sentence_id")


def source_texts(found: Retrieval) -> DataFrame:
    """(query_id, sentence_id, text, section_path): of the context's own sentences, else of the candidates."""
    columns = ["query_id", "sentence_id", "text", "section_path", F.col("rank").alias("place")]
    return C.first_by_priority(nested_sentences(found.context).select(*columns), found.candidates.select(*columns), "query_id", "sentence_id")


def candidate_pool(found: Retrieval) -> DataFrame:
    """(query_id, sentence_id, text): a query's candidates, or where it has none the sentences of its context."""
    without = nested_sentences(found.context).join(found.candidates.select("query_id").distinct(), "query_id", "left_anti")
    return found.candidates.select("query_id", "sentence_id", "text").unionByName(without.select("query_id", "sentence_id", "text"))


@dataclass(frozen=True)
class Cited:
    """Answers with their sentences and citations, each keyed by query_id, strategy and run.

    ``answers``: the generations, with answer_text free of tags; ``sentences``:
    (sentence_no, text); ``citations``: (sentence_no, place, sentence_id,
    chunk_id, document_id, page, section_path, confidence, source); ``report``:
    (n_tags, n_valid, hallucinated) of the inline answers.
    """

    answers: DataFrame
    sentences: DataFrame
    citations: DataFrame
    report: DataFrame


def cite(generations: DataFrame, found: Retrieval, tau: float = C.TAU, top_k: int = C.TOP_K, make: Callable[[], Embedder] = HashingEmbedder, pool: DataFrame | None = None, vectors: DataFrame | None = None) -> Cited:
    """Citations by each answer's own strategy: inline tags, or cosine alignment with the candidate pool.

    ``pool`` (query_id, sentence_id, embedding) and ``vectors`` (KEY, sentence_no,
    embedding) may bring embeddings along, else ``make`` embeds the texts; where
    it fails on a sentence of an aligned answer, or on a candidate of its
    question, that answer has its error and no citations.  Failed generations
    have an answer and no sentences.
    """
    known = F.col("strategy").isin(*STRATEGIES)
    checked = generations.withColumn("strategy", F.when(known, F.col("strategy")).otherwise(F.raise_error(F.concat(F.lit("unknown strategy: "), F.coalesce("strategy", F.lit("none"))))))
    answer = F.when(F.col("strategy") == INLINE, T.strip_tags(F.col("answer_text"))).otherwise(F.col("answer_text"))
    answers = with_sentences(checked.withColumns({"raw_text": F.col("answer_text"), "answer_text": answer}), "answer_text")
    sentences = answers.select(*KEY, F.posexplode("sentences").alias("sentence_no", "s")).select(*KEY, "sentence_no", "s.text")

    tagged = answers.where(F.col("strategy") == INLINE)
    spans = F.transform("sentences", lambda s: F.struct(s["char_start"].alias("start"), s["char_end"].alias("end")))
    rows = tagged.where(F.size("sentences") > 0).select(*KEY, "context_sentence_ids", spans.alias("spans"), F.posexplode(T.tag_anchors(F.col("raw_text"))).alias("tag_no", "tag"))
    placed = rows.select(*KEY, "tag_no", F.col("tag.sid").alias("sentence_id"), T.anchor_sentence(F.col("spans"), F.col("tag.at")).alias("sentence_no"), F.array_contains("context_sentence_ids", F.col("tag.sid")).alias("allowed"))
    tags = placed.join(sentence_meta(found), ["query_id", "sentence_id"], "left").withColumn("valid", F.col("allowed") & F.col("chunk_id").isNotNull())
    first = tags.where("valid").groupBy(*KEY, "sentence_no", "sentence_id", "chunk_id", "document_id", "page", "section_path").agg(F.min("tag_no").alias("tag_no"))
    place = F.row_number().over(Window.partitionBy(*KEY, "sentence_no").orderBy("tag_no"))
    inline = first.withColumns({"place": place, "confidence": F.lit(1.0), "source": F.lit("llm")}).drop("tag_no")
    bad = F.transform(F.array_sort(F.collect_list(F.when(~F.col("valid"), F.struct("tag_no", "sentence_id")))), lambda x: x["sentence_id"])
    counted = tags.groupBy(*KEY).agg(F.count("*").alias("n_tags"), F.count_if("valid").alias("n_valid"), bad.alias("hallucinated"))
    none = F.array().cast("array<string>")
    report = tagged.select(*KEY).join(counted, KEY, "left").withColumns({"n_tags": F.coalesce("n_tags", F.lit(0)), "n_valid": F.coalesce("n_valid", F.lit(0)), "hallucinated": F.coalesce("hallucinated", none)})

    asked = sentences.where(F.col("strategy") == ALIGNED)
    said = kept(embed_column(asked, make, errors=True), "said") if vectors is None else asked.join(vectors, [*KEY, "sentence_no"])
    found_in = kept(embed_column(candidate_pool(found), make, errors=True), "pool") if pool is None else pool
    failures = said.where("embed_error is not null").select(*KEY, "embed_error") if vectors is None else None
    if pool is None:
        of_pool = found_in.where("embed_error is not null").groupBy("query_id").agg(F.min("embed_error").alias("embed_error"))
        of_pool = asked.select(*KEY).distinct().join(of_pool, "query_id").select(*KEY, "embed_error")
        failures = of_pool if failures is None else failures.unionByName(of_pool)
    if failures is not None:
        failures = kept(failures.groupBy(*KEY).agg(F.min("embed_error").alias("embed_error")), "failures")
        answers = answers.join(failures, KEY, "left").withColumn("error", F.coalesce("error", "embed_error")).drop("embed_error")
        said = said.join(failures.select(*KEY), KEY, "left_anti")
    said, found_in = said.drop("embed_error"), found_in.drop("embed_error")
    aligned = C.align_within(said, found_in, KEY, tau, top_k).join(sentence_meta(found), ["query_id", "sentence_id"])
    aligned = aligned.withColumnRenamed("rank", "place").withColumn("source", F.lit("aligner"))
    columns = [*KEY, "sentence_no", "place", "sentence_id", "chunk_id", "document_id", "page", "section_path", "confidence", "source"]
    citations = kept(inline.select(*columns).unionByName(aligned.select(*columns)), "citations")
    return Cited(answers.drop("sentences", "raw_text"), sentences, citations, report)


def cited_answers(cited: Cited) -> DataFrame:
    """One record for each answer: its generation with ``sentences``: array<struct<sentence_no, text, citations>>."""
    fields = ["place", "sentence_id", "chunk_id", "document_id", "page", "section_path", "confidence", "source"]
    lists = cited.citations.groupBy(*KEY, "sentence_no").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("citations"))
    kind = lists.schema["citations"].dataType
    rows = cited.sentences.join(lists, [*KEY, "sentence_no"], "left").withColumn("citations", F.coalesce("citations", F.array().cast(kind)))
    nested = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("sentence_no", "text", "citations"))).alias("sentences"))
    kind = nested.schema["sentences"].dataType
    return cited.answers.join(nested, KEY, "left").withColumn("sentences", F.coalesce("sentences", F.array().cast(kind)))


def auditor_view(cited: Cited, found: Retrieval) -> DataFrame:
    """Each citation beside its source: (KEY, sentence_no, place, sentence_id, document, page, text), a dash where the source is unknown."""
    texts = source_texts(found).select("query_id", "sentence_id", F.col("text").alias("source_text"))
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("—"))
    return cited.citations.join(texts, ["query_id", "sentence_id"], "left").select(*KEY, "sentence_no", "place", "sentence_id", dash("document_id").alias("document"), dash("page").alias("page"), dash("source_text").alias("text"))
