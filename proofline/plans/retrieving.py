"""Retrieval of contexts and citation candidates for many questions at once, in three modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import retrieval as R
from ..operators.chunking import with_sentences
from ..operators.keywords import plain_terms
from ..sources.providers import Embedder, HashingEmbedder, embed_column
from ..sources.sinks import kept

MODES = ("dual", "chunks", "sentences")
CONTEXT = ("query_id", "place", "chunk_id", "document_id", "page", "section_path", "text", "token_count", "sentences", "source", "score")
CANDIDATES = ("query_id", "rank", "sentence_id", "chunk_id", "document_id", "page", "section_path", "text", "score")


@dataclass(frozen=True)
class Retrieval:
    """What was retrieved for ``queries`` (query_id, text, embedding).

    ``context``: (query_id, place, chunk_id, document_id, page, section_path,
    text, token_count, sentences, source, score), ``candidates``: (query_id,
    rank, sentence_id, chunk_id, document_id, page, section_path, text, score),
    ``stats``: (query_id, chunk_search_hits, sentence_search_hits,
    parent_chunks_added).
    """

    queries: DataFrame
    mode: str
    context: DataFrame
    candidates: DataFrame
    stats: DataFrame


def search(queries: DataFrame, rows: DataFrame, key: str, k: int, deep: int | None = None, analyse: Callable[[Column], Column] = plain_terms, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """The ``k`` best ``rows`` (``key``, text and perhaps embedding, else by ``make``) of each query by keywords and vectors fused: (query_id, ``key``, score, rank)."""
    found = R.hybrid_search(queries, rows.select(F.col(key).alias("doc_id"), *(c for c in ("text", "embedding") if c in rows.columns)), k, deep, analyse, make)
    return found.withColumnRenamed("doc_id", key)


def _counted(rows: DataFrame, name: str, test: str = "true") -> DataFrame:
    return rows.where(test).groupBy("query_id").agg(F.count("*").alias(name))


def retrieve(queries: DataFrame, chunks: DataFrame, sentences: DataFrame, mode: str = "dual", k_sentences: int = 20, k_chunks: int = 5, make: Callable[[], Embedder] = HashingEmbedder, analyse: Callable[[Column], Column] = plain_terms) -> Retrieval:
    """Context and candidates of every query.

    ``queries`` has (query_id, text), ``chunks`` (chunk_id, document_id, page,
    section_path, text, token_count, sentences), ``sentences`` (sentence_id,
    chunk_id, document_id, page, section_path, text); what has no column
    ``embedding`` is embedded by ``make``; ``analyse`` splits texts and questions
    for the keywords, ``keywords.english_terms`` does so for English.

    ``chunks``: the chunk hits, and the sentences within them as candidates,
    repeats kept.  ``sentences``: the sentence hits as candidates and no
    context.  ``dual``: both searches; the parents of the sentence hits come
    behind the chunk hits, in order of their ids.  Parents that are not among
    the chunks are left out.  Queries without a hit have no rows but in
    ``stats``.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode}")
    asked = kept(embed_column(queries, make), "queries")
    known = R.filled(chunks).select(*(c for c in CONTEXT if c in chunks.columns))
    chunk_hits = sentence_hits = None
    if mode != "sentences":
        chunk_hits = kept(search(asked, chunks, "chunk_id", k_chunks, analyse=analyse, make=make), "chunk_hits")
    if mode != "chunks":
        # Hits are written first, so that their size is known and the whole table is not shuffled to meet them.
        found = kept(search(asked, sentences, "sentence_id", k_sentences, analyse=analyse, make=make), "found")
        sentence_hits = kept(found.join(R.filled(sentences).select("sentence_id", "chunk_id", "document_id", "page", "section_path", "text"), "sentence_id").select(*CANDIDATES), "sentence_hits")
    if mode == "dual":
        places = R.dual_context(chunk_hits, sentence_hits).join(chunk_hits.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left")
        places = kept(places, "places")
        # Missing parents leave no gap between the places.
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
        context = places.join(known, "chunk_id").withColumn("place", place).select(*CONTEXT)
    elif mode == "chunks":
        context = chunk_hits.join(known, "chunk_id").withColumnRenamed("rank", "place").withColumn("source", F.lit("chunk_search")).select(*CONTEXT)
    else:
        nothing = {"query_id": asked.schema["query_id"].dataType, "place": "int", "source": "string", "score": "double"}
        context = known.where("false").select(*(F.lit(None).cast(nothing[c]).alias(c) if c in nothing else F.col(c) for c in CONTEXT))
    context = kept(context, "context")
    if mode == "chunks":
        candidates = R.nested_sentences(context).withColumn("score", F.lit(None).cast("double")).select(*CANDIDATES)
    else:
        candidates = sentence_hits
    stats = asked.select("query_id")
    counts = [_counted(chunk_hits if chunk_hits is not None else context, "chunk_search_hits"), _counted(sentence_hits if sentence_hits is not None else context.where("false"), "sentence_search_hits"), _counted(context, "parent_chunks_added", "source = 'sentence_parent'")]
    for rows in counts:
        stats = stats.join(rows, "query_id", "left")
    return Retrieval(asked, mode, context, candidates, stats.fillna(0))


def packaged(items: DataFrame) -> Retrieval:
    """The retrieval that public benchmark ``items`` (item_id, question, passages: array<struct<passage_id, text>>) bring with them.

    Every passage is a chunk and its sentences are candidates; one that cannot
    be split is a sentence of its own.  The document is the passage's id.
    """
    rows = items.select(F.col("item_id").alias("query_id"), F.posexplode("passages").alias("pos", "p"))
    chunk_id = F.format_string("bench::%s::p%04d", F.col("query_id").cast("string"), "pos")
    split = with_sentences(rows.select("query_id", "pos", chunk_id.alias("chunk_id"), F.col("p.passage_id").alias("document_id"), F.coalesce("p.text", F.lit("")).alias("text")))
    whole = F.array(F.struct(F.col("text"), F.lit(0).alias("char_start"), F.length("text").alias("char_end")))
    section = F.array(F.lit("benchmark"))
    nested = F.transform(
        F.when(F.size("sentences") > 0, F.col("sentences")).otherwise(whole),
        lambda s, k: F.struct(F.format_string("%s::s%04d", "chunk_id", k).alias("sentence_id"), s["text"].alias("text"), F.lit(1).alias("page"), section.alias("section_path"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end")),
    )
    context = split.select(
        "query_id", (F.col("pos") + 1).alias("place"), "chunk_id", "document_id", F.lit(1).alias("page"), section.alias("section_path"), "text",
        F.greatest(F.lit(1), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("token_count"), nested.alias("sentences"), F.lit("chunk_search").alias("source"), F.lit(None).cast("double").alias("score"),
    )
    # Answers and citations read both several times; texts are split once.
    context = kept(context, "context")
    candidates = kept(R.nested_sentences(context).withColumn("score", F.lit(None).cast("double")).select(*CANDIDATES), "candidates")
    queries = items.select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    stats = queries.select("query_id").join(_counted(context, "chunk_search_hits"), "query_id", "left").join(_counted(candidates, "sentence_search_hits"), "query_id", "left").withColumn("parent_chunks_added", F.lit(0))
    return Retrieval(queries, "dual", context, candidates, stats.fillna(0))


def stored(found: Retrieval, folder: str, live: bool = False) -> Retrieval:
    """``found`` from ``folder``, where it is written if it is not there yet or ``live`` is asked for; so models and searches run once.

    Each set of questions and each mode has a folder of its own below it; after
    a change of the index ask for ``live``.
    """
    spark = found.queries.sparkSession
    n, digest = found.queries.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct("query_id", "text"))).cast("decimal(38,0)"))).first()
    folder, parts = f"{folder}/{found.mode}-{n}-{digest or 0}", {}
    for name in ("queries", "context", "candidates", "stats"):
        path, rows = f"{folder}/{name}", getattr(found, name)
        if live:
            rows.write.mode("overwrite").parquet(path)
        try:
            parts[name] = spark.read.schema(rows.schema).parquet(path)
        except AnalysisException:  # it is not there yet
            rows.write.parquet(path)
            parts[name] = spark.read.schema(rows.schema).parquet(path)
    return Retrieval(mode=found.mode, **parts)
