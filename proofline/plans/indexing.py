"""From layouts to the tables that are searched, and what is still to do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..sources import readers, tables
from ..sources.providers import Embedder, embed_column


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """``chunks`` of ``chunking.pack_chunks`` in the layout of the chunk table."""
    sentence = lambda s: F.struct(
        s["sentence_id"].alias("sentence_id"), F.col("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), s["text"].alias("text"), s["page"].alias("page"), s["section_path"].alias("section_path"),
        s["char_start"].alias("char_start"), s["char_end"].alias("char_end"),
    )
    return chunks.select("chunk_id", F.col("doc_id").cast("string").alias("document_id"), "page", "section_path", "text", "token_count", F.transform("sentences", sentence).alias("sentences"))


def sentence_rows(chunks: DataFrame, overlap: bool = True) -> DataFrame:
    """(sentence_id, chunk_id, document_id, page, section_path, text): each sentence once, in its first chunk; page and section fall back to the chunk's.

    Without ``overlap`` no sentence is in two chunks, and none is shuffled to find out.
    """
    rows = chunks.select("chunk_id", F.col("page").alias("chunk_page"), F.col("section_path").alias("chunk_path"), F.explode("sentences").alias("s"))
    r = F.struct("chunk_id", "chunk_page", "chunk_path", "s")
    first = rows.groupBy("s.sentence_id").agg(F.min_by(r, "chunk_id").alias("r")) if overlap else rows.select("s.sentence_id", r.alias("r"))
    page = F.when(F.coalesce("r.s.page", F.lit(0)) != 0, F.col("r.s.page")).otherwise(F.coalesce("r.chunk_page", F.lit(0)))
    path = F.when(F.size(F.coalesce("r.s.section_path", F.array().cast("array<string>"))) > 0, F.col("r.s.section_path")).otherwise(F.col("r.chunk_path"))
    return first.select("sentence_id", "r.chunk_id", F.col("r.s.document_id").alias("document_id"), page.alias("page"), path.alias("section_path"), F.col("r.s.text").alias("text"))


def chunk_directory(spark: SparkSession, root: str, out: str, document_ids: list[str] | None = None, target_tokens: int = 400, overlap_tokens: int = 40) -> DataFrame:
    """Chunk every layout under ``root``, write JSON lines by document to ``out``, and return (document_id, n_chunks, n_sentences, tokens, mean_tokens, n_sections)."""
    chunks = chunking.chunk_layout(readers.read_layout(spark, root, document_ids), target_tokens, overlap_tokens)
    rows = chunk_rows(chunks)
    rows.withColumn("doc", F.col("document_id")).write.mode("overwrite").partitionBy("doc").json(out)
    written = spark.read.schema(readers.CHUNK).json(out)
    return chunking.corpus_stats(written.withColumns({"doc_id": F.col("document_id"), "n_sentences": F.size("sentences")})).withColumnRenamed("doc_id", "document_id")


def build_index(chunks: DataFrame, path: str, make: Callable[[], Embedder], recreate: bool = False) -> tuple[int, int]:
    """Write the chunk table and the table of unique sentences below ``path``, embedded, and return how many rows of each were written.

    Rows take the place of those with the same id, unless all is recreated.
    Fewer rows than expected raise.
    """
    n_chunks = tables.write_table(embed_column(chunks, make), f"{path}/chunks", "chunk_id", recreate)
    n_sentences = tables.write_table(embed_column(sentence_rows(chunks), make), f"{path}/sentences", "sentence_id", recreate)
    return n_chunks, n_sentences


def to_parse(files: DataFrame, parsed: DataFrame, force: bool = False) -> DataFrame:
    """``files`` (document_id, ...) that have no parsed artefact yet (``parsed``: document_id); all with ``force``."""
    return files if force else files.join(parsed.select("document_id").distinct(), "document_id", "left_anti")


def ingested(uploads: DataFrame, parsed: DataFrame) -> DataFrame:
    """Uploads (document_id, sha256, ...) beside what was parsed of them (document_id, page_count, ...)."""
    return uploads.join(parsed, "document_id")


def manifest(spark: SparkSession, rows: list[tuple[str, str, str]], only: list[str] | None = None) -> DataFrame:
    """(document_id, title, url) of a corpus to fetch, perhaps ``only`` some documents."""
    found = spark.createDataFrame(rows, "document_id string, title string, url string")
    return found if only is None else found.where(F.col("document_id").isin(only))


def to_review(items: DataFrame, reviews: DataFrame, include_failing: bool = False, n: int | None = None, seed: int = 7) -> DataFrame:
    """The items without a review, in a seeded order, at most ``n``; those that failed a gate only if asked for."""
    passing = items if include_failing else items.where("judge_well_formed and judge_supported")
    left = passing.join(reviews.select("question_id"), "question_id", "left_anti")
    ordered = left.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("question_id").cast("string"))), "question_id")
    return ordered if n is None else ordered.limit(n)


def round_trip(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(asked, found): how many of the distinct ``ids`` are in ``table``."""
    asked = ids.select(key).distinct()
    hit = asked.join(table.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return hit.agg(F.count("*").alias("asked"), F.count("hit").alias("found"))


def offsets_hold(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_sentences, n_round_trips): how many nested sentences their offsets cut out of the chunk's text."""
    same = F.filter("sentences", lambda s: F.substr("text", s["char_start"] + 1, s["char_end"] - s["char_start"]) == s["text"])
    return chunks.select("chunk_id", F.size("sentences").alias("n_sentences"), F.size(same).alias("n_round_trips"))


def demo_sentences(answer: DataFrame) -> DataFrame:
    """(query_id, sentence_no, text): answers split on " . "."""
    return answer.select("query_id", F.posexplode(F.filter(F.transform(F.split("text", r" \. "), lambda x: F.trim(x)), lambda x: x != "")).alias("sentence_no", "text"))


def citation_lines(sentences: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, sentence_no, line): each sentence with its ids in brackets."""
    ids = citations.groupBy("query_id", "sentence_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence_id"))), lambda x: x["sentence_id"]).alias("ids"))
    joined = sentences.join(ids, ["query_id", "sentence_no"], "left")
    return joined.select("query_id", "sentence_no", T.cited(F.col("text"), F.coalesce("ids", F.array().cast("array<string>"))).alias("line"))
