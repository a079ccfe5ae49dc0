"""Command line: ``python -m proofline COMMAND ...``; every command is one flow over files that Spark reads and writes.

Models are named as MODULE:CALLABLE; the callable takes nothing and returns a
model with ``complete`` or ``embed``.  Without one, embeddings are hashed words.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, keywords, metrics, retrieval
from .plans import authoring, evaluation, gating, indexing, retrieving
from .sources import providers, readers, sinks, tables


#: How texts are split for keywords.
ANALYSERS = {"plain": keywords.plain_terms, "english": keywords.english_terms}


def named(place: str) -> Callable:
    module, _, name = place.partition(":")
    return getattr(import_module(module), name)


def _index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return tables.read_table(spark, f"{path}/chunks"), tables.read_table(spark, f"{path}/sentences")


def _report(out: str, found: evaluation.Evaluation, items: DataFrame, args: argparse.Namespace) -> str:
    sums = evaluation.summaries(items)
    manifest = sums["by_strategy"].agg(F.to_json(F.collect_list(F.struct("*"))).alias("strategies")).withColumns({"tau": F.lit(args.tau), "top_k": F.lit(args.top_k), "model": F.lit(args.name)})
    table = metrics.markdown_table(items, [r.strategy for r in items.select("strategy").distinct().orderBy("strategy").collect()])
    return sinks.write_run(out, manifest, items=items, report=found.cited.report, table=table)


def hashed(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return readers.read_binaries(spark, args.path)


def chunk(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return indexing.chunk_directory(spark, args.path, args.out, args.only, args.target, args.overlap)


def index(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    n = indexing.build_index(readers.read_chunks(spark, args.path, args.only), args.out, named(args.embedder), args.recreate)
    return spark.createDataFrame([n], "chunks long, sentences long")


def author(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    chunks = readers.read_chunks(spark, args.path).withColumns({"doc_id": F.col("document_id"), "chunk_no": F.regexp_extract("chunk_id", r"c(\d+)$", 1).cast("int")})
    spans = chunking.greedy_spans(authoring.chunk_spans(chunks), chunking.quotas(args.n), seed=args.seed).withColumn("document_id", F.col("doc_id"))
    found = authoring.author_items(spans, named(args.model), providers.Roles(args.answer_name, args.name, args.judge_name))
    sinks.write_run(args.out, found.counts.agg(F.to_json(F.collect_list(F.struct("*"))).alias("difficulty_counts")), items=found.items, failures=found.failures)
    return found.counts


def gate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    found = gating.run_quality_gates(readers.read_ground_truth(spark, args.path), _index(spark, args.index)[1], named(args.model), args.name, embedder=named(args.embedder))
    sinks.write_run(args.out, found.counters, items=found.items, failures=found.failures)
    return found.counters


def evaluate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    items = readers.read_ground_truth(spark, args.path, not args.include_failing, args.limit)
    found = evaluation.evaluate_items(items, *_index(spark, args.index), named(args.model), args.name, mode=args.mode, tau=args.tau, top_k=args.top_k, embedder=named(args.embedder))
    rows = evaluation.enriched(found.items, reviews=readers.read_reviews(spark, args.reviews)) if args.reviews else found.items
    _report(args.out, found, rows, args)
    return evaluation.summaries(rows)["by_strategy"]


def benchmark(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    items = {"hagrid": readers.read_hagrid, "alce": readers.read_alce}[args.form](spark, args.path, args.limit)
    found = evaluation.evaluate_benchmark(items, named(args.model), args.name, tau=args.tau, top_k=args.top_k, embedder=named(args.embedder))
    _report(args.out, found, found.items, args)
    return evaluation.summaries(found.items)["by_strategy"]


def compare(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Both layouts at the same k, without a longer list for the fusion, and how long a question took in each."""
    queries = providers.embed_column(spark.read.json(args.path).select("query_id", "text"), named(args.embedder))
    chunks, sentences = _index(spark, args.index)
    queries = sinks.kept(queries, "queries")
    hits, of_chunks = retrieval.timed(queries, lambda block: retrieving.search(block, chunks, "chunk_id", args.k, args.k, ANALYSERS[args.terms]), args.batch)
    found, of_sentences = retrieval.timed(queries, lambda block: retrieving.search(block, sentences, "sentence_id", args.k, args.k, ANALYSERS[args.terms]), args.batch)
    parents = found.join(sentences.select("sentence_id", "chunk_id"), "sentence_id")
    return retrieval.agreement_summary(retrieval.layout_agreement(hits, parents), {"chunks": of_chunks, "sentences": of_sentences})


def review(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return indexing.to_review(readers.read_ground_truth(spark, args.path), readers.read_reviews(spark, args.reviews), args.include_failing, args.n, args.seed).select("question_id", "question", "gold_answer")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="proofline", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(run: Callable, *options: str) -> None:
        sub = commands.add_parser(run.__name__)
        sub.set_defaults(run=run)
        sub.add_argument("path")
        known: dict[str, dict] = {
            "out": {"required": True}, "index": {"required": True}, "model": {"required": True}, "reviews": {"required": run is review}, "only": {"nargs": "*"}, "recreate": {"action": "store_true"},
            "include_failing": {"action": "store_true"}, "embedder": {"default": "proofline.sources.providers:HashingEmbedder"}, "mode": {"choices": retrieving.MODES, "default": "dual"},
            "form": {"choices": ("hagrid", "alce"), "default": "hagrid"}, "target": {"type": int, "default": 400}, "overlap": {"type": int, "default": 40}, "n": {"type": int}, "k": {"type": int, "default": 10},
            "limit": {"type": int}, "terms": {"choices": tuple(ANALYSERS), "default": "plain"}, "batch": {"type": int, "default": retrieval.BLOCK}, "seed": {"type": int, "default": 7}, "tau": {"type": float, "default": 0.75}, "top_k": {"type": int, "default": 3}, "name": {"default": "model"},
            "answer_name": {"default": "answer"}, "judge_name": {"default": "judge"},
        }
        for option in options:
            sub.add_argument(f"--{option.replace('_', '-')}", **known[option])

    scored = ("out", "model", "name", "tau", "top_k", "embedder", "limit")
    command(hashed)
    command(chunk, "out", "only", "target", "overlap")
    command(index, "out", "only", "recreate", "embedder")
    command(author, "out", "model", "name", "answer_name", "judge_name", "n", "seed")
    command(gate, "out", "model", "name", "index", "embedder")
    command(evaluate, *scored, "index", "mode", "reviews", "include_failing")
    command(benchmark, *scored, "form")
    command(compare, "index", "k", "batch", "terms", "embedder")
    command(review, "reviews", "include_failing", "n", "seed")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args).show(100, truncate=False)


if __name__ == "__main__":
    main()
