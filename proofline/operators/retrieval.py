"""Keyword, vector and fused rankings, and the contexts built from them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.providers import Embedder, HashingEmbedder, PairScorer, embed_column, score_pairs
from ..sources.sinks import kept
from . import keywords

#: Fixed value: the published constant of reciprocal rank fusion.
RRF = 60
#: So many queries are broadcast at once.
BLOCK = 512


def bm25(queries: DataFrame, docs: DataFrame, k: int, analyse: Callable[[Column], Column] = keywords.plain_terms) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best ``docs`` (doc_id, text) for each of ``queries`` (query_id, text).

    Scores are rounded to 6 digits before they are ranked; ties go by doc_id.
    The texts are split once, by ``analyse``, into an index of the queries' terms
    only; over an index that is kept, use ``keywords.search_index``.
    """
    only = kept(keywords.asked_terms(queries, analyse).select("term").distinct(), "question_terms")
    return keywords.search_index(queries, keywords.build_index(docs, only, analyse), k, analyse)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of each query with the highest score, ties by doc_id, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def in_blocks(queries: DataFrame, key: str, size: int = BLOCK) -> list[DataFrame]:
    """``queries`` dealt by their key into blocks of about ``size`` rows, small enough for broadcast."""
    n = max(1, -(-queries.count() // size))
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == at) for at in range(n)]


def _nearest(ids: Sequence, q: np.ndarray, k: int, apart: bool):
    """A pass over batches of vectors that keeps the ``k`` nearest of each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools: list[list[tuple[float, object]]] = [[] for _ in ids]
        for batch in batches:
            column = batch.column("embedding")
            full = pc.fill_null(pc.equal(pc.list_value_length(column), q.shape[1]), False)
            kept = batch.filter(full)
            if not kept.num_rows:
                continue
            v = np.asarray(kept.column("embedding").flatten(), np.float64).reshape(-1, q.shape[1])
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            scores = np.round(q @ (v / np.where(norm < 1e-12, 1, norm)).T, 6) + 0.0
            found = np.array(kept.column("doc_id").to_pylist(), object)
            for at in range(len(ids)):
                mine = scores[at]
                if apart:
                    mine = np.where(found == ids[at], -np.inf, mine)
                least = np.partition(mine, len(mine) - k)[len(mine) - k] if len(mine) > k else -np.inf
                near = np.flatnonzero((mine >= least) & (mine > -np.inf))
                ranked = sorted(zip((-mine[near]).tolist(), found[near].tolist(), strict=True))[:k]
                pools[at] = sorted(pools[at] + ranked)[:k] if pools[at] else ranked
        rows = [(ids[at], doc, -score) for at, pool in enumerate(pools) for score, doc in pool]
        if rows:
            yield pa.RecordBatch.from_pydict({"query_id": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "score": [r[2] for r in rows]})

    return search


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, apart: bool = False, size: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine top ``k`` of ``vectors`` (doc_id, embedding) for ``queries`` (query_id, embedding).

    Any number of queries meets all vectors, a block of about ``size`` queries
    after the other, whose vectors are sent to the tasks; a task keeps ``k``
    rows of a query, so what is shuffled grows with queries and tasks, not with
    pairs.  With ``apart`` a query is no neighbour of the vector that has its
    own id.  Vectors of another length than the query's, and null ones, are not
    found; a zero vector has 0 with all.
    """
    named = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = {name: kind for name, kind in (*queries.select("query_id").dtypes, *named.dtypes)}
    found = None
    for block in in_blocks(queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "query_id", size):
        rows = block.collect()  # a block is bounded by ``size``
        if not rows:
            continue
        q = np.array([row["embedding"] for row in rows], np.float64).reshape(len(rows), -1)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        search = _nearest([row["query_id"] for row in rows], q / np.where(norm < 1e-12, 1, norm), k, apart)
        best = named.mapInArrow(search, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, rank int")
    # One ranking over all blocks: a task holds one sort, not one for each block.
    return top_k(found, k)


def similarity_extent(queries: DataFrame, vectors: DataFrame, apart: bool = False, size: int = BLOCK) -> DataFrame:
    """(n, low, high, mean): one row on the cosines, rounded to 6 digits, of all ``queries`` (query_id, embedding) with all ``vectors`` (doc_id, embedding).

    Blocks of about ``size`` queries go to the tasks, which hand on one row for
    each batch of vectors; no pair is ever a row.  With ``apart`` a query and the vector of its own id are no pair.
    Vectors of another length than the queries' and null ones are left out;
    a zero vector has 0 with all; without a pair ``n`` is 0 and the rest null.
    """
    named, parts = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")), None
    for block in in_blocks(queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "query_id", size):
        rows = block.collect()  # a block is bounded by ``size``
        if not rows:
            continue
        ids, q = np.array([row["query_id"] for row in rows], object), np.array([row["embedding"] for row in rows], np.float64).reshape(len(rows), -1)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        found = named.mapInArrow(_extent(ids, q / np.where(norm < 1e-12, 1, norm), apart), "n long, low double, high double, total double")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = queries.sparkSession.createDataFrame([], "n long, low double, high double, total double")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("total") / F.sum("n")).alias("mean"))


def _extent(ids: np.ndarray, q: np.ndarray, apart: bool):
    """A pass over batches of vectors that sums up their cosines with the queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), q.shape[1]), False))
            v = np.asarray(full.column("embedding").flatten(), np.float64).reshape(-1, q.shape[1])
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            scores = np.round(q @ (v / np.where(norm < 1e-12, 1, norm)).T, 6) + 0.0
            if apart:
                scores = scores[ids[:, None] != np.array(full.column("doc_id").to_pylist(), object)[None, :]]
            if scores.size:
                yield pa.RecordBatch.from_pydict({"n": [scores.size], "low": [float(scores.min())], "high": [float(scores.max())], "total": [float(scores.sum())]})

    return search


def hybrid_search(queries: DataFrame, docs: DataFrame, k: int, deep: int | None = None, analyse: Callable[[Column], Column] = keywords.plain_terms, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """(query_id, doc_id, score, rank): keyword and vector rankings of the same ``docs`` fused.

    ``queries`` has (query_id, text, embedding), ``docs`` (doc_id, text) and
    perhaps embedding; without it ``make`` embeds the texts, on their way to the
    vector search alone.  Both rankings are ``deep`` long, four times ``k`` and
    20 at least if nothing is said; ``analyse`` splits texts and questions for
    the keywords.
    """
    deep = max(4 * k, 20) if deep is None else deep
    vectors = embed_column(docs.select("doc_id", *(c for c in ("text", "embedding") if c in docs.columns)), make).select("doc_id", "embedding")
    return fuse([bm25(queries, docs.select("doc_id", "text"), deep, analyse), vector_search(queries, vectors, deep)], k)


def fuse(rankings: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank)."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for other in rankings[1:]:
        every = every.unionByName(other.select("query_id", "doc_id", "rank"))
    return top_k(every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 6).alias("score")), k)


def rescored(hits: DataFrame, queries: DataFrame, rows: DataFrame, k: int, make: Callable[[], PairScorer] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rescore, rank): the ``k`` best of the fused ``hits`` (query_id, doc_id, score, rank), in the order of a second look at their texts.

    ``queries`` has (query_id, text), ``rows`` (doc_id, text) and perhaps
    section_path, whose entries are the text's keywords.  Pairs go to the scorer in Arrow
    batches; those that it can't score follow in their earlier order.  Without a
    scorer ``rescore`` is null and the order is as it was.
    """
    if make is None:
        return hits.where(F.col("rank") <= k).select("query_id", "doc_id", "score", F.lit(None).cast("double").alias("rescore"), "rank")
    keywords_ = F.coalesce("section_path", F.array().cast("array<string>")) if "section_path" in rows.columns else F.array().cast("array<string>")
    texts = rows.select("doc_id", "text", keywords_.alias("keywords"))
    pairs = hits.select("query_id", "doc_id", "score", "rank").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id").join(texts, "doc_id")
    scored = score_pairs(pairs, make).drop("query_text", "text", "keywords")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rescore"), "rank", "doc_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rescore", "rank")


def dual_context(chunk_hits: DataFrame, sentence_hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, source, place): chunk hits in their rank, then the parents of sentence hits by id.

    ``source`` is chunk_search, sentence_parent or both.
    """
    parents = sentence_hits.select("query_id", "chunk_id").distinct().withColumn("parent", F.lit(True))
    joined = chunk_hits.select("query_id", "chunk_id", "rank").join(parents, ["query_id", "chunk_id"], "full_outer")
    source = F.when(F.col("rank").isNull(), "sentence_parent").when(F.col("parent"), "both").otherwise("chunk_search")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last(), "chunk_id"))
    return joined.select("query_id", "chunk_id", source.alias("source"), place.alias("place"))


def fetch_chunks(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ``chunks`` whose chunk_id is among ``ids``; unknown ids fetch nothing."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def filled(hits: DataFrame) -> DataFrame:
    """``hits`` with 0 for a missing page, no section for a missing path and an empty text for a missing one."""
    return hits.withColumns({"page": F.coalesce("page", F.lit(0)), "section_path": F.coalesce("section_path", F.array().cast("array<string>")), "text": F.coalesce("text", F.lit(""))})


def nested_sentences(context: DataFrame) -> DataFrame:
    """(query_id, rank, sentence_id, chunk_id, document_id, page, section_path, text): the sentences within a context's chunks, in order, repeats kept.

    A missing page, or 0, and a missing or empty section are the chunk's.
    Sentences without an id are left out.
    """
    rows = context.select("query_id", "place", "chunk_id", "document_id", F.col("page").alias("chunk_page"), F.col("section_path").alias("chunk_path"), F.posexplode("sentences").alias("pos", "s")).where("coalesce(s.sentence_id, '') <> ''")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "pos"))
    page = F.when(F.coalesce("s.page", F.lit(0)) != 0, F.col("s.page")).otherwise(F.coalesce("chunk_page", F.lit(0)))
    path = F.when(F.size(F.coalesce("s.section_path", F.array().cast("array<string>"))) > 0, F.col("s.section_path")).otherwise(F.coalesce("chunk_path", F.array().cast("array<string>")))
    return rows.select("query_id", rank.alias("rank"), "s.sentence_id", "chunk_id", "document_id", page.alias("page"), path.alias("section_path"), F.coalesce("s.text", F.lit("")).alias("text"))


def reachable(candidates: DataFrame, nested: DataFrame) -> DataFrame:
    """(query_id, sid): distinct ids of the candidates and of the context's own sentences."""
    return candidates.select("query_id", "sid").union(nested.select("query_id", "sid")).distinct()


def recall_at_k(gold: DataFrame, pool: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_gold, recall): share of gold ids in the pool; 1 without gold."""
    hit = pool.select("query_id", "sid").distinct().withColumn("hit", F.lit(1))
    counted = gold.distinct().join(hit, ["query_id", "sid"], "left").groupBy("query_id").agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_hit"))
    joined = queries.select("query_id").join(counted, "query_id", "left")
    return joined.select("query_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce(F.col("n_hit") / F.col("n_gold"), F.lit(1.0)).alias("recall"))


def recall_of_class(queries: DataFrame, rows: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, n_gold, recall): as ``recall_at_k``, where a query's gold are all ``rows`` (sid, label) of its own label but itself.

    ``queries`` has (query_id, label).  Gold is counted by label and met with the
    pool only, so no pair of a query and a gold id that was not found is ever a
    row.  An id under several labels counts once.
    """
    asked, members = queries.select("query_id", "label").distinct(), rows.select("sid", "label").distinct()
    itself = F.col("query_id") == F.col("sid")
    sizes = members.groupBy("label").agg(F.count("*").alias("n"))
    own = asked.join(members, itself & (asked["label"] == members["label"])).select("query_id", asked["label"]).withColumn("own", F.lit(1))
    n_gold = asked.join(sizes, "label").join(own, ["query_id", "label"], "left").groupBy("query_id").agg(F.sum(F.col("n") - F.coalesce("own", F.lit(0))).alias("n_gold"))
    # What several labels of one query count twice: only ids under several labels can be.
    several = lambda rows, key: rows.where("label is not null").groupBy(key).agg(F.collect_set("label").alias("labels")).where("size(labels) > 1").select(key, F.explode("labels").alias("label"))
    met_often = several(asked, "query_id").join(several(members, "sid"), "label").where(~itself).groupBy("query_id", "sid").agg((F.count("*") - 1).alias("more"))
    twice = met_often.groupBy("query_id").agg(F.sum("more").alias("twice"))
    met = pool.select("query_id", "sid").distinct().where(~itself).join(asked, "query_id").join(members, ["sid", "label"])
    hits = met.groupBy("query_id").agg(F.countDistinct("sid").alias("n_hit"))
    joined = queries.select("query_id").distinct()
    for counted in (n_gold, twice, hits):
        joined = joined.join(counted, "query_id", "left")
    none = F.lit(0)
    joined = joined.select("query_id", (F.coalesce("n_gold", none) - F.coalesce("twice", none)).alias("n_gold"), F.coalesce("n_hit", none).alias("n_hit"))
    return joined.select("query_id", "n_gold", F.when(F.col("n_gold") > 0, F.col("n_hit") / F.col("n_gold")).otherwise(1.0).alias("recall"))


def layout_agreement(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """(query_id, agreement): share of the sentence layout's parent chunks that the chunk layout found too."""
    found = chunks.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1))
    joined = parents.select("query_id", "chunk_id").distinct().join(found, ["query_id", "chunk_id"], "left")
    return joined.groupBy("query_id").agg((F.count("hit") / F.greatest(F.lit(1), F.count("*"))).alias("agreement"))


def timed(queries: DataFrame, search: Callable[[DataFrame], DataFrame], size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What ``search`` finds for ``queries`` (query_id, ...), a block of about ``size`` after the other, and (batch, n_queries, latency_ms): a block's time over its queries.

    A block's hits are written before its clock stops.  Blocks without a query
    are left out; without any query there are no latencies and no hits.
    """
    spark, found, took = queries.sparkSession, None, []
    for at, block in enumerate(in_blocks(queries, "query_id", size)):
        n = block.count()
        if n or found is None:
            began = time.perf_counter()
            hits = kept(search(block), "timed_hits")
            ms = (time.perf_counter() - began) * 1000
            took += [(at, n, ms / n)] if n else []
            found = hits if found is None else found.unionByName(hits)
    return found, spark.createDataFrame(took, "batch int, n_queries long, latency_ms double")


def agreement_summary(agreement: DataFrame, latencies: dict[str, DataFrame] | None = None) -> DataFrame:
    """(n, mean_agreement, min_agreement), and of each layout's ``latencies`` (latency_ms) the median and the maximum, as NAME_median_ms and NAME_max_ms."""
    summary = agreement.agg(F.count("*").alias("n"), F.avg("agreement").alias("mean_agreement"), F.min("agreement").alias("min_agreement"))
    for name, rows in (latencies or {}).items():
        summary = summary.crossJoin(rows.agg(F.median("latency_ms").alias(f"{name}_median_ms"), F.max("latency_ms").alias(f"{name}_max_ms")))
    return summary
